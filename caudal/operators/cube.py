"""The ledger cube kept up to date: partial figures per day, of which late rows replace only their
days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.operators.ledger import cube_of, cube_partials
from caudal.operators.support import materialize
from caudal.sources.tables import exists

MEASURES = ("n", "usd", "f", "f_usd")


def append_to_cube(spark: SparkSession, folder: str, tx: DataFrame) -> int:
    """Add ledger rows to the stored partials (a folder per day); the days rewritten.

    The rows are reduced to channel, status and day first. Only the days among them are read, added
    up and written again, in one commit: a failed append leaves the table as it was. Every row
    is to be appended once.
    """
    new = materialize(cube_partials(tx))
    if not exists(spark, folder):
        new.repartition("dia").write.partitionBy("dia").parquet(folder)
        return new.select("dia").distinct().count()
    days = [row[0] for row in new.select("dia").distinct().collect()]  # bounded by the calendar
    known = F.col("dia").isin([d for d in days if d is not None])
    touched = known | F.col("dia").isNull() if None in days else known
    old = spark.read.schema(new.schema).parquet(folder).filter(touched)
    merged = old.unionByName(new).groupBy("canal", "estado", "dia").agg(
        *[F.sum(c).cast(new.schema[c].dataType).alias(c) for c in MEASURES]
    )
    (
        merged.select(*new.columns).repartition("dia").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("dia").parquet(folder)
    )
    spark.catalog.refreshByPath(folder)
    return len(days)


def kept_cube(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """The cube from stored partials; ``like`` is a ledger frame whose types they have."""
    return cube_of(spark.read.schema(cube_partials(like).schema).parquet(folder))
