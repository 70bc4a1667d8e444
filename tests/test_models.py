import pytest
from pyspark.sql import functions as F

from caudal.operators import features, metrics, models
from caudal.operators.liquidity import liquidity_features
from caudal.sources.adapters import Bank
from tests.conftest import dicts


@pytest.fixture(scope="module")
def credit(spark):
    b = Bank(spark, "/root/testdata/sf0.001")
    return features.credit_features(b.creditos, b.clientes).persist()


def one(df):
    return dicts(df)[0]


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.7), (1, 0.7), (0, 0.7), (0, 0.1), (1, 0.1)]
    return spark.createDataFrame(rows, "y int, s double")


def test_auc_counts_pairs(scored):
    rows = [tuple(r) for r in scored.collect()]
    pairs = [(p, n) for y, p in rows if y for z, n in rows if not z]
    expected = sum((p > n) + 0.5 * (p == n) for p, n in pairs) / len(pairs)
    got = one(metrics.auc_gini(scored, "y", "s"))
    assert got["auc"] == pytest.approx(expected)
    assert got["gini"] == pytest.approx(2 * expected - 1)


def test_reversed_scores_turn_auc_around(scored):
    forward = one(metrics.auc_gini(scored, "y", "s"))["auc"]
    backward = one(metrics.auc_gini(scored.withColumn("s", 1 - F.col("s")), "y", "s"))["auc"]
    assert forward + backward == pytest.approx(1)


def test_auc_needs_both_classes(scored):
    assert one(metrics.auc_gini(scored.filter("y = 1"), "y", "s"))["auc"] is None


def test_precision_recall(scored):
    curve = metrics.pr_curve(scored, "y", "s")
    got = {r["puntaje"]: (r["vp"], r["fp"]) for r in dicts(curve)}
    assert got == {0.9: (1, 0), 0.8: (1, 1), 0.7: (3, 2), 0.1: (4, 3)}
    area = 0.25 * 1 + 0 * 0.5 + 0.5 * 3 / 5 + 0.25 * 4 / 7
    assert one(metrics.pr_auc(curve))["pr_auc"] == pytest.approx(area)


def test_classification_report(spark):
    rows = [(1, 1)] * 3 + [(1, 0)] * 1 + [(0, 1)] * 2 + [(0, 0)] * 4
    df = spark.createDataFrame(rows, "y int, p int")
    got = {r["clase"]: r for r in dicts(metrics.classification_report(df, "y", "p"))}
    assert got[1]["precision"] == 0.6 and got[1]["recall"] == 0.75 and got[1]["soporte"] == 4
    assert got[1]["f1"] == pytest.approx(2 * 0.6 * 0.75 / 1.35)
    assert got[0]["soporte"] == 6


def test_report_of_a_class_never_predicted(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "y int, p int")
    got = {r["clase"]: r for r in dicts(metrics.classification_report(df, "y", "p"))}
    assert (got[1]["precision"], got[1]["recall"], got[1]["f1"]) == (0.0, 0.0, 0.0)


def test_forecast_error(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 0.0), (1.0, None)], "a double, f double")
    got = one(metrics.forecast_error(df, "a", "f"))
    assert (got["n"], got["mae"], got["rmse"]) == (2, 2.0, 5**0.5)


def test_split_is_whole_disjoint_and_near_the_share(credit):
    train, test = features.train_test_split(credit)
    assert train.join(test, "id", "left_semi").count() == 0
    assert train.count() + test.count() == credit.count()
    assert 0.15 < test.count() / credit.count() < 0.25


def test_unknown_category_is_all_zeros(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    got = [tuple(r) for r in features.one_hot(df, {"c": ["a", "b"]}).collect()]
    assert sorted(got) == [(0, 0), (0, 0), (1, 0)]


def test_constant_column_standardizes_to_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert sorted(tuple(r) for r in features.standardized(df, ["a", "b"]).collect()) == [
        (-1.0, 0.0), (1.0, 0.0)]


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "y int")
    got = {r["y"]: r["peso"] for r in dicts(features.class_weights(df, "y"))}
    assert got == {0: pytest.approx(4 / 6), 1: 2.0}


@pytest.mark.parametrize("kind", ["rf", "lr", "gbt"])
def test_scoring_models(credit, kind):
    train, test = features.train_test_split(credit)
    # The target is made learnable: weak scores default.
    def mark(df):
        return df.withColumn(features.TARGET, (F.col("score_credito") < 450).cast("int"))

    model = models.fit_pd_model(mark(train), kind, trees=5)
    unseen = mark(test).withColumn("tipo_credito", F.lit("Desconocido"))  # unknown category
    scores = models.score(model, unseen)
    assert scores.count() == test.count()
    auc = one(metrics.auc_gini(scores, features.TARGET, "probabilidad"))["auc"]
    assert auc > 0.9


def test_fraud_model_finds_night_frauds(spark):
    b = Bank(spark, "/root/testdata/sf0.01")
    table = models.without_income(
        features.fraud_features(b.transacciones, b.cuentas, b.clientes, b.centroides))
    train, test = features.train_test_split(table)
    scores = models.score(models.fit_fraud_model(train, trees=10), test, "es_fraude")
    assert scores.count() == test.count()
    assert one(metrics.auc_gini(scores, "es_fraude", "probabilidad"))["auc"] > 0.9


def test_gap_forecast_beats_nothing(spark):
    b = Bank(spark, "/root/testdata/sf0.001")
    table = liquidity_features(b.resumen_liquidez_diario, b.indicadores_macro)
    forecast = models.forecast_gap(models.fit_gap_forecast(table), table).persist()
    error = one(metrics.forecast_error(forecast, "brecha_liquidez_usd", "pronostico_usd"))
    mean = forecast.agg(F.avg("brecha_liquidez_usd")).collect()[0][0]
    flat = one(metrics.forecast_error(
        forecast.withColumn("m", F.lit(mean)), "brecha_liquidez_usd", "m"))
    assert error["n"] == forecast.count() and error["rmse"] <= flat["rmse"]


def test_training_rows_lie_in_few_parts_whatever_the_shuffle_makes(spark):
    rows = spark.range(400).select((F.col("id") % 2).cast("int").alias("y"), "id").repartition(40)
    ready = models.weighted(rows, "y")
    assert ready.rdd.getNumPartitions() == models.LEAST_PARTS
    assert {r["peso"] for r in ready.collect()} == {1.0} and ready.count() == 400
    assert models.weighted(rows.filter("id < 0"), "y").count() == 0


def test_training_parts_follow_the_rows():
    sizes = [0, 200_000, 200_001, 1_000_000, 20_000_000, 60_000_000]
    assert [models.training_parts(n) for n in sizes] == [8, 8, 9, 40, 48, 120]
