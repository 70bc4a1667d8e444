"""Dense positions and prefix sums of rows spread over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caudal.llm.storage import stored

#: Blocks of a prefix sum: a task sums at most this many blocks (or rows of one block) in order.
FAN = 4096


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows with ``pos`` (from 0 in the order of their group) and ``n`` (rows of the group).

    Rows are stored in ranges of (group, order), each numbered for itself and moved on by what
    lies before it in other ranges; a group of any size is split, also where all its rows tie.
    """
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(
        group, *order, "_tie"
    )
    sliced = stored(ranged.withColumn("_slice", F.spark_partition_id()), "ranges")
    per_slice = sliced.groupBy(group, "_slice").agg(F.count("*").alias("_rows"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        group, "_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias("n"),
    )
    inside = Window.partitionBy(group, "_slice").orderBy(*order, "_tie")
    return (
        sliced.join(offsets, [group, "_slice"])
        .withColumn("pos", F.row_number().over(inside) - 1 + F.col("_before"))
        .select(*rows.columns, "pos", "n")
    )


def prefix(sums: DataFrame, pos: str, value: str, before: str) -> DataFrame:
    """``pos``, ``value`` and ``before``: the sum of ``value`` at all smaller positions.

    Positions are whole numbers from 0, one row each. They are summed by blocks of ``FAN``, the
    blocks' sums in the same way, so no task orders more than ``FAN`` rows at once.
    """
    kept = stored(
        sums.select(F.col(pos).cast("long").alias("_pos"), F.col(value).alias("_value")), "sums"
    )
    last = kept.agg(F.max("_pos")).first()[0] or 0
    inside = (
        Window.partitionBy("_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    )
    summed = kept.withColumn("_block", F.floor(F.col("_pos") / F.lit(FAN)).cast("long"))
    summed = summed.withColumn("_in", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    earlier = F.lit(0)
    if last >= FAN:
        blocks = summed.groupBy("_block").agg(F.sum("_value").alias("_total"))
        summed = summed.join(
            prefix(blocks, "_block", "_total", "_outer").drop("_total"), "_block"
        )
        earlier = F.col("_outer")
    return summed.select(
        F.col("_pos").alias(pos), F.col("_value").alias(value), (F.col("_in") + earlier).alias(before)
    )
