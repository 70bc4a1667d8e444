"""Declared constraints checked as jobs: one row per rule with the number of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.functions.numeric import count_if
from caudal.operators.keys import declared_references, offending_keys
from caudal.sources.schemas import TABLES

Tables = dict[str, DataFrame]


def _stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _as_rows(counts: DataFrame, table: str, columns: list[str], name: str) -> DataFrame:
    """Turn one row of counts into a row per column."""
    pairs = F.map_from_arrays(
        F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(f"`{c}`") for c in columns])
    )
    return counts.select(F.lit(table).alias("tabla"), F.explode(pairs).alias("columna", name))


def dq_nulls(tables: Tables) -> DataFrame:
    """Nulls in each column declared NOT NULL, with one pass over each table."""
    parts = []
    for name, df in tables.items():
        columns = TABLES[name].required
        counts = df.agg(*[count_if(F.col(c).isNull()).alias(c) for c in columns])
        parts.append(_as_rows(counts, name, columns, "nulos"))
    return _stacked(parts)


def dq_domains(tables: Tables) -> DataFrame:
    """Values outside each declared domain; a null passes."""
    parts = []
    for name, df in tables.items():
        domains = TABLES[name].domains
        if domains:
            counts = df.agg(
                *[count_if(~F.col(c).isin(*values)).alias(c) for c, values in domains.items()]
            )
            parts.append(_as_rows(counts, name, list(domains), "fuera_de_dominio"))
    return _stacked(parts)


def dq_unique(tables: Tables) -> DataFrame:
    """Values that occur more than once in each column declared unique."""
    declared = [(t, c) for t in tables for c in TABLES[t].unique]
    return _per_rule(tables, "repetida", declared, "claves_repetidas", "filas")


def dq_orphans(tables: Tables) -> DataFrame:
    """Rows whose reference is missing."""
    declared = [(t, c) for t, c, _ in declared_references(tables)]
    return _per_rule(tables, "huerfana", declared, "_claves", "huerfanas").drop("_claves")


def _per_rule(
    tables: Tables, rule: str, declared: list[tuple[str, str]], keys: str, rows: str
) -> DataFrame:
    """Offending values and their rows per declared column, also where there are none."""
    spark = next(iter(tables.values())).sparkSession
    none = spark.createDataFrame(declared, "tabla string, columna string").select(
        "tabla", "columna", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("filas")
    )
    found = offending_keys(tables).filter(F.col("regla") == rule).select(
        "tabla", "columna", F.lit(1).cast("long").alias("k"), "filas"
    )
    return found.unionByName(none).groupBy("tabla", "columna").agg(
        F.sum("k").alias(keys), F.sum("filas").alias(rows)
    )


def row_counts(tables: Tables) -> DataFrame:
    return _stacked(
        [
            df.agg(F.lit(name).alias("tabla"), F.count("*").alias("filas"))
            for name, df in tables.items()
        ]
    )


def next_ids(tables: Tables) -> DataFrame:
    """Next free id of each table that has one; 1 for an empty table."""
    return _stacked(
        [
            df.agg(
                F.lit(name).alias("tabla"),
                F.coalesce(F.max("id") + 1, F.lit(1)).alias("siguiente_id"),
            )
            for name, df in tables.items()
            if "id" in df.columns
        ]
    )
