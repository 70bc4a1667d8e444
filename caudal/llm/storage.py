"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from caudal.operators.support import new_folder


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write once as compressed Parquet into the shared folder and read it back.

    Lineage ends here: a lost executor costs no repetition, and several later steps can read
    the rows without computing them again.
    """
    spark = df.sparkSession
    folder = new_folder(spark, purpose)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def join_shuffled(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join two sides that both grow with the input: by shuffling and sorting, never by sending one.

    Spark sends a side that it takes for small through the driver to every executor. It goes by
    compressed file sizes, or by the rows before an explode, and so takes a table for small that
    is many times larger in memory. Skewed keys are still split by AQE.
    """
    return left.join(right.hint("merge"), on, how)
