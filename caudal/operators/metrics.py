"""Model quality: classification report, AUC and Gini, precision-recall, forecast errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.functions.numeric import count_if, double, num
from caudal.operators.running import running_totals


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, from the counts of (label, prediction)."""
    pairs = df.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(
        F.count("*").alias("n")
    )
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("y").alias("clase"), F.col("n").alias("soporte"),
                         F.lit(0).cast("long").alias("predichas"),
                         F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("ok")),
                F.struct(F.col("p").alias("clase"), F.lit(0).cast("long").alias("soporte"),
                         F.col("n").alias("predichas"), F.lit(0).cast("long").alias("ok")),
            )
        ).alias("s")
    ).select("s.*")
    counts = sides.groupBy("clase").agg(
        *[F.sum(c).alias(c) for c in ("soporte", "predichas", "ok")]
    )

    def ratio(a, b):
        return F.when(b > 0, double(a) / double(b)).otherwise(num(0))

    ok, support, predicted = F.col("ok"), F.col("soporte"), F.col("predichas")
    return counts.select(
        "clase",
        ratio(ok, predicted).alias("precision"),
        ratio(ok, support).alias("recall"),
        ratio(2 * ok, support + predicted).alias("f1"),
        "soporte",
    )


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score, and of all scores up to it.

    There may be as many scores as rows, so the running counts are summed slice by slice.
    """
    positive = F.col(label) == 1
    counts = df.groupBy(double(F.col(score)).alias("puntaje")).agg(
        count_if(positive).alias("pos"), count_if(~positive).alias("neg")
    )
    upto = running_totals(
        counts.withColumn("_todo", F.lit(0)), "_todo", ["puntaje"],
        {"pos_hasta": F.col("pos"), "neg_hasta": F.col("neg")},
    )
    return upto.drop("_todo")


def auc_gini(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve and Gini; rows of equal score count as half."""
    below = double(F.col("neg_hasta") - F.col("neg"))
    wins = F.col("pos") * (below + double(F.col("neg")) / 2)
    totals = _by_score(df, label, score).agg(
        F.sum("pos").alias("positivos"), F.sum("neg").alias("negativos"),
        F.sum(wins).alias("aciertos"),
    )
    pairs = double(F.col("positivos")) * double(F.col("negativos"))
    auc = F.when(pairs > 0, F.col("aciertos") / pairs)
    return totals.select(
        "positivos", "negativos", auc.alias("auc"), (num(2) * auc - num(1)).alias("gini")
    )


def pr_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """Precision and recall when all rows of at least each score are taken as positive."""
    scores = _by_score(df, label, score)
    whole = scores.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    positives, negatives = (whole.select(c).scalar() for c in ("p", "n"))
    curve = scores.select(
        "puntaje", "pos",
        (positives - F.col("pos_hasta") + F.col("pos")).alias("vp"),
        (negatives - F.col("neg_hasta") + F.col("neg")).alias("fp"),
        positives.alias("positivos"),
    )
    tp = double(F.col("vp"))
    return curve.select(
        "puntaje", "vp", "fp",
        (tp / (tp + double(F.col("fp")))).alias("precision"),
        F.when(F.col("positivos") > 0, tp / double(F.col("positivos"))).alias("recall"),
        F.when(F.col("positivos") > 0, double(F.col("pos")) / double(F.col("positivos")))
        .alias("paso"),
    )


def pr_auc(curve: DataFrame) -> DataFrame:
    """Area under a precision-recall curve as a step function (average precision)."""
    return curve.agg(F.sum(F.col("paso") * F.col("precision")).alias("pr_auc"))


def forecast_error(df: DataFrame, actual: str, forecast: str) -> DataFrame:
    """MAE and RMSE over the rows that have both values."""
    error = double(F.col(actual)) - double(F.col(forecast))
    return df.agg(
        F.count(error).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
    )
