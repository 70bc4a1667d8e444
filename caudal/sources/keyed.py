"""Stored tables that are updated in place by key: ranges of ids, rewritten where they change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_IDS = 1_000_000
#: Up to so many changed ranges are named in the plan, so that only their folders are listed.
NAMED_RANGES = 10_000
_PREFIX = "_rango_"


def _range(key: Column, ids: int) -> Column:
    return F.floor(key / F.lit(ids)).cast("long")


def store_keyed(df: DataFrame, folder: str, key: str = "id", ids: int = RANGE_IDS) -> None:
    """Write a table from nothing in one folder per range of ``ids`` keys.

    The width of a range is part of the folder's name, so an update finds it again.
    """
    name = f"{_PREFIX}{ids}"
    ranged = df.withColumn(name, _range(F.col(key), ids))
    ranged.repartition(name).write.mode("overwrite").partitionBy(name).parquet(folder)


def load_keyed(spark: SparkSession, folder: str) -> DataFrame:
    stored = spark.read.parquet(folder)
    return stored.drop(_range_column(stored))


def _range_column(stored: DataFrame) -> str:
    names = [c for c in stored.columns if c.startswith(_PREFIX)]
    if len(names) != 1:
        raise ValueError("not a table stored by ranges of its key")
    return names[0]


def update_keyed(
    spark: SparkSession,
    folder: str,
    changes: DataFrame,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    key: str = "id",
) -> int:
    """Replace the ranges that ``changes`` touches by ``merge(rows, changes)``; their number.

    Only folders of those ranges are read and written; ``merge`` keeps their rows' keys. New files
    are written beside the table and take the place of the old ones when all of them are complete,
    range by range, so reading and writing the same folder is safe and a write that fails leaves the
    table as it was. Changes without a stored range have no effect.
    """
    stored = spark.read.parquet(folder)
    name = _range_column(stored)
    ids = int(name.removeprefix(_PREFIX))
    placed = changes.filter(F.col(key).isNotNull()).withColumn(name, _range(F.col(key), ids))
    touched = placed.select(name).distinct()
    known = [row[0] for row in touched.limit(NAMED_RANGES + 1).collect()]
    if not known:
        return 0
    if len(known) <= NAMED_RANGES:
        old = stored.filter(F.col(name).isin(known))
    else:
        old = stored.join(touched, name, "left_semi")
    merged = merge(old.drop(name), changes).withColumn(name, _range(F.col(key), ids))
    (
        merged.select(*stored.columns).repartition(name).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(folder)
    )
    spark.catalog.refreshByPath(folder)
    return len(known) if len(known) <= NAMED_RANGES else touched.count()
