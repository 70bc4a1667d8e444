"""Exports: CSV folders, warehouse tables, INSERT scripts, surrogate ids."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caudal import constants as K
from caudal.functions.text import sql_literal
from caudal.operators.quality import row_counts
from caudal.operators.support import join_small, materialize, new_folder
from caudal.sources.schemas import TABLES
from caudal.sources.tables import CSV_WRITING

Tables = dict[str, DataFrame]
CSV_ROWS = 100_000


def export_csv(tables: Tables, folder: str, rows_per_file: int = CSV_ROWS) -> None:
    """Every table as CSV parts with a header line, in a folder of its name.

    Quotes are doubled, spaces and line breaks kept; a null is nothing, an empty text is ``""``.
    Texts with line breaks make a file unsplittable, so files are kept small. Tables are written
    at the same time: one of few parts leaves cores free.
    """

    def write(name: str) -> None:
        (
            tables[name].write.mode("overwrite").options(**CSV_WRITING)
            .option("maxRecordsPerFile", rows_per_file).csv(f"{folder}/{name}")
        )

    with ThreadPoolExecutor(max(len(tables), 1)) as pool:
        for written in [pool.submit(write, name) for name in tables]:
            written.result()


def warehouse_shape(df: DataFrame) -> DataFrame:
    """Upper-case names, and dates and times as text."""
    return df.select(
        *[
            (F.col(c).cast("string") if "FECHA" in c.upper() else F.col(c)).alias(c.upper())
            for c in df.columns
        ]
    )


def export_warehouse(tables: Tables, mode: str = "overwrite") -> DataFrame:
    """Save every table in warehouse shape as a catalog table and report its rows."""
    saved = {}
    for name, df in tables.items():
        warehouse_shape(df).write.mode(mode).saveAsTable(name.upper())
        saved[name] = df.sparkSession.table(name.upper())
    return row_counts(saved)


def row_literals(df: DataFrame) -> DataFrame:
    """Each row as the text of a VALUES entry."""
    parts = F.concat_ws(", ", *[sql_literal(f.name, f.dataType) for f in df.schema])
    return df.select(F.concat(F.lit("("), parts, F.lit(")")).alias("fila"))


def sql_literals(df: DataFrame, table: str, chunk: int = K.INSERT_ROWS) -> DataFrame:
    """INSERT statements of up to ``chunk`` rows, made where the rows are: no shuffle."""
    head = f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES\n"

    def joined(rows: list[str]) -> pd.DataFrame:
        texts = [head + ",\n".join(rows[i:i + chunk]) + ";" for i in range(0, len(rows), chunk)]
        return pd.DataFrame({"sentencia": pd.Series(texts, dtype="object")})

    def statements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[str] = []
        for batch in batches:
            waiting.extend(batch["fila"])
            full = len(waiting) - len(waiting) % chunk
            if full:
                yield joined(waiting[:full])
                waiting = waiting[full:]
        if waiting:
            yield joined(waiting)

    return row_literals(df).mapInPandas(statements, "sentencia string")


def _stored(df: DataFrame, purpose: str) -> DataFrame:
    """Rows written once into the shared folder, their texts compressed."""
    folder = new_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def insert_statements(
    tables: Tables, chunk: int = K.INSERT_ROWS, parts: int | None = None
) -> DataFrame:
    """INSERT statements of all tables: (tabla, numero, filas, sentencia).

    Rows stand by primary key, ``numero`` counts a table's statements from 0 without gaps, and
    every statement but a table's last has ``chunk`` rows. The rows of all tables are numbered
    together: their texts are made and stored once, sorted once by table and key, and stored with
    their position in their slice; what a table has in the slices before is added to it.
    """
    heads, rows = [], []
    for name, df in tables.items():
        key = TABLES[name].unique[0]
        order = F.datediff(F.col(key), F.lit("1970-01-01").cast("date")) if (
            df.schema[key].dataType.typeName() == "date") else F.col(key)
        literals = F.concat(F.lit("("), F.concat_ws(
            ", ", *[sql_literal(f.name, f.dataType) for f in df.schema]), F.lit(")"))
        rows.append(df.select(
            F.lit(name).alias("tabla"), order.cast("long").alias("orden"), literals.alias("fila")
        ))
        heads.append((name, f"INSERT INTO {name} ({', '.join(df.columns)}) VALUES\n"))
    every = _stored(reduce(DataFrame.unionByName, rows), "filas")
    order = ["tabla", "orden", "fila"]
    ranged = every.repartitionByRange(parts, *order) if parts else every.repartitionByRange(*order)
    lying = _stored(
        ranged.sortWithinPartitions(*order)
        .select("tabla", "fila", F.monotonically_increasing_id().alias("_m"))
        .withColumn("_tramo", F.shiftright("_m", 33)),
        "tramos",
    )
    before = Window.partitionBy("tabla").orderBy("_tramo").rowsBetween(
        Window.unboundedPreceding, -1
    )
    begin = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_m")
    offsets = (
        lying.groupBy("tabla", "_tramo").agg(F.count("*").alias("_n"), F.min("_m").alias("_m"))
        .select("tabla", "_tramo", begin.alias("_base"))
    )
    placed = join_small(lying, offsets, ["tabla", "_tramo"])  # a row per table and slice
    grouped = placed.groupBy(
        "tabla",
        F.floor((F.col("_m") + F.col("_base")) / F.lit(chunk)).cast("long").alias("numero"),
    ).agg(F.sort_array(F.collect_list(F.struct("_m", "fila"))).alias("r"))
    head = F.create_map(*[F.lit(x) for pair in heads for x in pair])
    return grouped.select(
        "tabla", "numero", F.size("r").cast("long").alias("filas"),
        F.concat(head[F.col("tabla")], F.array_join("r.fila", ",\n"), F.lit(";"))
        .alias("sentencia"),
    )


def export_sql(tables: Tables, folder: str, chunk: int = K.INSERT_ROWS) -> None:
    """One folder of INSERT script parts per table."""
    for name, df in tables.items():
        sql_literals(df, name, chunk).write.mode("overwrite").text(f"{folder}/{name}")


def with_unique_ids(df: DataFrame, name: str = "id") -> DataFrame:
    """Ids that differ but leave gaps; needs no look at other partitions."""
    return df.withColumn(name, F.monotonically_increasing_id())


def with_dense_ids(df: DataFrame, name: str = "id", first: int = 1) -> DataFrame:
    """Ids without gaps: the position in the partition plus the rows of those before it.

    The rows are stored first, so that both steps see the same partitions; the window runs
    over one row per partition.
    """
    position = F.col("_m").bitwiseAND((1 << 33) - 1)
    stored = materialize(
        df.withColumn("_m", F.monotonically_increasing_id())
        .withColumn("_parte", F.shiftright("_m", 33))
        .withColumn("_pos", position)
    )
    before = Window.orderBy("_parte").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy("_parte").count()
        .withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .select("_parte", "_base")
    )
    ids = F.col("_base") + F.col("_pos") + first
    placed = join_small(stored, offsets, "_parte")  # one row per partition
    return placed.withColumn(name, ids).select(name, *df.columns)
