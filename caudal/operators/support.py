"""Shared building blocks: safe cut of lineage, checked small joins, slices of ordered rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see: the cluster's checkpoint folder, else (local runs) a new one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor sees")
        folder = tempfile.mkdtemp(prefix="caudal-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, purpose: str) -> str:
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of one's own in whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Compute once into the shared folder, so that a lost executor costs no repetition."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def join_small(df: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join a side that should be small: sent to every executor if its counted size allows.

    The side is stored first, so counting it does not compute it twice. Series keyed by date
    come here: a row per day, about 36,500 in a century whatever the size of the facts. Beyond
    ``BROADCAST_ROWS`` Spark joins by shuffling as usual.
    """
    stored = materialize(small)
    side = F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored
    return df.join(side, on, how)


def ordered_slices(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """Store the rows in slices of about equal size that follow ``order``; add ``_tramo``.

    A slice is a range of the whole order, so a key or a moment with very many rows is split,
    and the slices of a key have rising numbers. Ranges are drawn anew on every run, hence the
    store. ``parts`` is a hint of layout; without it Spark's shuffle partitions hold.
    """
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return materialize(ranged.withColumn("_tramo", F.spark_partition_id().cast("long")))


def sorted_slices(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """``ordered_slices`` with each slice in order: one task reads one slice, row after row."""
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return materialize(
        ranged.sortWithinPartitions(*order)
        .withColumn("_tramo", F.spark_partition_id().cast("long"))
    )


def join_slices(sliced: DataFrame, carried: DataFrame, order: list[str]) -> DataFrame:
    """Add what is carried into each slice, at most one row of ``carried`` per ``_tramo``.

    A broadcast leaves the slices as they lie. With more slices than may be broadcast they are
    dealt and sorted anew.
    """
    stored = materialize(carried)
    if stored.count() <= BROADCAST_ROWS:
        return sliced.join(F.broadcast(stored), "_tramo", "left")
    joined = sliced.join(stored, "_tramo", "left")
    return joined.repartition("_tramo").sortWithinPartitions("_tramo", *order)
