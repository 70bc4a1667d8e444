"""Declared keys and references of all tables, checked together in one shuffle.

A parent's id is a key of its own table and what other tables refer to. So all uses of a value
meet under the name of the key and the value: its rows in its own table, and the rows that refer
to it from each declared column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.functions.numeric import count_if
from caudal.sources.schemas import TABLES

Tables = dict[str, DataFrame]
OWN = "propia"


def declared_references(tables: Tables) -> list[tuple[str, str, str]]:
    """(table, column, name of the key it refers to)."""
    return [(t, c, f"{p}.id") for t in tables for c, p in TABLES[t].references.items()]


def key_usage(tables: Tables) -> DataFrame:
    """Per key and value: ``propias``, rows of its own table, and ``usos_k``, rows of the k-th
    declared reference. One scan of each table, one shuffle of all; counts are combined before it.
    """
    references = declared_references(tables)
    parts = []
    for name, df in tables.items():
        uses = [(f"{name}.{c}", OWN, c) for c in TABLES[name].unique]
        uses += [(space, f"{name}.{c}", c) for t, c, space in references if t == name]
        marks = F.array(*[
            F.struct(F.lit(space).alias("espacio"), F.lit(source).alias("fuente"),
                     F.col(c).cast("string").alias("clave"))
            for space, source, c in uses
        ])
        parts.append(df.select(F.inline(marks)))
    every = reduce(DataFrame.unionByName, parts).filter("clave is not null")
    return every.groupBy("espacio", "clave").agg(
        count_if(F.col("fuente") == OWN).alias("propias"),
        *[count_if(F.col("fuente") == f"{t}.{c}").alias(f"usos_{k}")
          for k, (t, c, _) in enumerate(references)],
    )


def offending_keys(tables: Tables) -> DataFrame:
    """Values that break a rule: (regla, tabla, columna, clave, filas)."""
    space = F.split("espacio", r"\.")
    entry = lambda rule, table, column, rows: F.struct(
        F.lit(rule).alias("regla"), table.alias("tabla"), column.alias("columna"),
        F.col("clave").alias("clave"), rows.alias("filas"),
    )
    found = [F.when(F.col("propias") > 1, entry(
        "repetida", space[0], space[1], F.col("propias")
    ))]
    for k, (t, c, key) in enumerate(declared_references(tables)):
        lost = (F.col("espacio") == key) & (F.col("propias") == 0) & (F.col(f"usos_{k}") > 0)
        found.append(F.when(lost, entry("huerfana", F.lit(t), F.lit(c), F.col(f"usos_{k}"))))
    listed = F.filter(F.array(*found), lambda x: x.isNotNull())
    return key_usage(tables).filter(F.size(listed) > 0).select(F.inline(listed))
