"""Scoring and forecasting models on MLlib."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal import constants as K
from caudal.functions.numeric import double
from caudal.operators.features import (
    CATEGORICAL, FRAUD_CATEGORICAL, FRAUD_NUMERIC, FRAUD_TARGET, NUMERIC, TARGET, class_weights,
)
from caudal.operators.support import join_small, materialize

WEIGHT = "peso"
#: Training passes over the rows hundreds of times: few parts, up to PARTS of PART_ROWS rows, then
#: larger ones of up to MOST_ROWS.
LEAST_PARTS, PART_ROWS, PARTS, MOST_ROWS = 8, 25_000, 48, 500_000


def weighted(df: DataFrame, label: str = TARGET) -> DataFrame:
    """Rows with the balanced weight of their class, in parts that suit their number."""
    weights = materialize(class_weights(df, label))
    rows = weights.agg(F.sum("filas")).first()[0] or 0
    return join_small(df, weights.select(label, WEIGHT), label).repartition(training_parts(rows))


def training_parts(rows: int) -> int:
    """Parts to train on: work for all cores where it pays, else few, since a pass over a part
    costs the driver a task whatever the part holds. ``spark.sql.shuffle.partitions`` plays no
    part in it."""
    return max(LEAST_PARTS, min(PARTS, -(-rows // PART_ROWS)), -(-rows // MOST_ROWS))


def _preparation(numeric: list[str], categorical: list[str]) -> list:
    """Scaled numbers and one-hot texts in one vector; unknown texts become all zeros."""
    return [
        VectorAssembler(inputCols=numeric, outputCol="numeros"),
        StandardScaler(inputCol="numeros", outputCol="escalados", withMean=True, withStd=True),
        StringIndexer(
            inputCols=categorical, outputCols=[f"{c}_n" for c in categorical],
            handleInvalid="keep",
        ),
        OneHotEncoder(
            inputCols=[f"{c}_n" for c in categorical],
            outputCols=[f"{c}_v" for c in categorical], dropLast=True,
        ),
        VectorAssembler(
            inputCols=["escalados", *[f"{c}_v" for c in categorical]], outputCol="features"
        ),
    ]


def classifier(kind: str, label: str = TARGET, trees: int = K.TREES):
    common = {"featuresCol": "features", "labelCol": label, "weightCol": WEIGHT}
    if kind == "rf":
        return RandomForestClassifier(numTrees=trees, seed=K.SEED, **common)
    if kind == "gbt":
        return GBTClassifier(maxIter=trees, seed=K.SEED, **common)
    if kind == "lr":
        return LogisticRegression(regParam=0.01, elasticNetParam=0.5, **common)
    raise ValueError(f"unknown model: {kind}")


def fit_pd_model(train: DataFrame, kind: str = "rf", trees: int = K.TREES) -> PipelineModel:
    """Probability of default from the credit features."""
    return fit_classifier(train, kind, NUMERIC, CATEGORICAL, TARGET, trees)


def fit_fraud_model(train: DataFrame, kind: str = "rf", trees: int = K.TREES) -> PipelineModel:
    """Probability of fraud from the fraud features (with ``without_income`` applied)."""
    return fit_classifier(train, kind, FRAUD_NUMERIC, FRAUD_CATEGORICAL, FRAUD_TARGET, trees)


def without_income(features: DataFrame) -> DataFrame:
    """Mark the missing income ratio with -1, which trees can tell from every real ratio."""
    return features.withColumn("monto_ingreso", F.coalesce("monto_ingreso", F.lit(-1.0)))


def fit_classifier(
    train: DataFrame, kind: str, numeric: list[str], categorical: list[str], label: str,
    trees: int = K.TREES,
) -> PipelineModel:
    """Fit a classifier with balanced class weights on a feature table."""
    numbers = [double(F.col(c)).alias(c) for c in numeric]
    rows = weighted(train.select(*numbers, *categorical, label), label).persist()
    try:
        stages = [*_preparation(numeric, categorical), classifier(kind, label, trees)]
        return Pipeline(stages=stages).fit(rows)
    finally:
        rows.unpersist()


def score(model: PipelineModel, df: DataFrame, label: str = TARGET) -> DataFrame:
    """Rows with the predicted class and the probability of the positive one."""
    probability = vector_to_array("probability")[1]
    return model.transform(df).select(
        "id", label,
        F.col("prediction").cast("int").alias("prediccion"),
        probability.alias("probabilidad"),
    )


def fit_gap_forecast(features: DataFrame, label: str = "brecha_liquidez_usd"):
    """Linear forecast of the liquidity gap from the lag, spread and season columns."""
    inputs = [c for c in features.columns if c not in ("fecha", label)]
    rows = features.dropna().select(
        "fecha", *[double(F.col(c)).alias(c) for c in [*inputs, label]]
    )
    stages = [
        VectorAssembler(inputCols=inputs, outputCol="numeros"),
        StandardScaler(inputCol="numeros", outputCol="features", withMean=True, withStd=True),
        LinearRegression(featuresCol="features", labelCol=label, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(rows)


def forecast_gap(model: PipelineModel, features: DataFrame) -> DataFrame:
    rows = features.dropna()
    numbers = [double(F.col(c)).alias(c) for c in rows.columns if c != "fecha"]
    return model.transform(rows.select("fecha", *numbers)).select(
        "fecha", "brecha_liquidez_usd", F.col("prediction").alias("pronostico_usd")
    )
