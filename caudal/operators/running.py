"""Running sums within keys over stored, sorted slices: the rows are shuffled once.

Sums are exact: every value is a whole number of its smallest unit, cut into a high and a low half
of 64-bit integers, which numpy adds up separately; Spark joins the halves as decimals.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, LongType, StructField, StructType

from caudal.operators.support import join_slices, sorted_slices

LOW_BITS = 30


def running_totals(
    df: DataFrame,
    key: str,
    order: list[str],
    totals: dict[str, Column],
    parts: int | None = None,
) -> DataFrame:
    """Running sums within each key, the current row included; ``order`` is unique in a key.

    Totals are sums of whole numbers or of decimals of at most 18 digits; a null adds nothing.
    The rows are stored once in sorted ranges of (key, order). A key that goes on in a further
    slice gets what its earlier slices add up to handed into that slice: one row per slice, found
    from the first and the last key of each.
    """
    kinds = df.select(*[c.alias(n) for n, c in totals.items()]).schema
    scales = {f.name: f.dataType.scale if isinstance(f.dataType, DecimalType) else 0
              for f in kinds}
    for f in kinds:
        if isinstance(f.dataType, DecimalType) and f.dataType.precision > 18:
            raise ValueError(f"{f.name}: decimals of more than 18 digits")
    whole = {n: F.coalesce(_units(c, scales[n]), F.lit(0)) for n, c in totals.items()}
    halves = [f"_{half}{k}" for k in range(len(totals)) for half in ("alto", "bajo")]
    cut = []
    for k, c in enumerate(whole.values()):
        cut += [F.shiftright(c, LOW_BITS).alias(f"_alto{k}"),
                c.bitwiseAND((1 << LOW_BITS) - 1).alias(f"_bajo{k}")]
    sliced = sorted_slices(df.select("*", *cut), [key, *order], parts)
    edges = sliced.select(F.col(key), "_tramo", *halves).mapInArrow(
        _edges(key, halves), _schema(sliced, [key, "_tramo"], halves)
    )
    one = Window.partitionBy(key).orderBy("_tramo")
    before = one.rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        "_tramo", F.lag("_tramo").over(one).alias("_de"),
        *[F.sum(h).over(before).alias(f"{h}_antes") for h in halves],
    ).filter("_de is not null").drop("_de")
    joined = join_slices(sliced, carried, [key, *order])
    summed = joined.mapInArrow(_sums(key, halves, df.columns), _schema(sliced, df.columns, halves))
    out = {}
    for k, f in enumerate(kinds):
        units = F.col(f"_alto{k}").cast("decimal(20,0)") * (1 << LOW_BITS) + F.col(f"_bajo{k}")
        if isinstance(f.dataType, DecimalType):
            out[f.name] = (units * F.lit(Decimal(1).scaleb(-scales[f.name]))).cast(
                f"decimal({f.dataType.precision + 10},{scales[f.name]})")
        else:
            out[f.name] = units.cast("long")
    return summed.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def _units(c: Column, scale: int) -> Column:
    return (c * F.lit(10**scale)).cast("long") if scale else c.cast("long")


def _schema(sliced: DataFrame, columns: list[str], halves: list[str]) -> StructType:
    return StructType(
        [sliced.schema[c] for c in columns] + [StructField(h, LongType()) for h in halves]
    )


def _runs(batch: pa.RecordBatch, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Slice of every row, and where a key or a slice begins."""
    code = batch[key].dictionary_encode(null_encoding="encode").indices.to_numpy()
    tramo = batch["_tramo"].to_numpy(zero_copy_only=False)
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (tramo[1:] != tramo[:-1])
    return tramo, np.flatnonzero(new)


def _edges(key: str, halves: list[str]):
    """The sums of the first and of the last key of a slice."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "_tramo", *halves]
        kind, first, now = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema.field(key).type
            tramo, starts = _runs(batch, key)
            sums = [np.add.reduceat(batch[h].to_numpy(), starts) for h in halves]
            for run in sorted({0, len(starts) - 1}):
                head = (batch[key][int(starts[run])].as_py(), int(tramo[starts[run]]))
                found = [int(s[run]) for s in sums]
                if now is not None and now[0] == head:
                    now = (head, [a + b for a, b in zip(now[1], found, strict=True)])
                else:
                    first = first or now
                    now = (head, found)
        rows = [r for r in (first, now) if r is not None]
        if rows:
            columns = [[(*head, *sums)[i] for head, sums in rows] for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names
            )

    return edges


def _sums(key: str, halves: list[str], kept: list[str]):
    """Running sums; only the sums of the key at hand are kept from batch to batch."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, [0] * len(halves)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tramo, starts = _runs(batch, key)
            goes_on = last == (batch[key][0].as_py(), int(tramo[0]))
            earlier = np.concatenate([[-1 if last is None else last[1]], tramo[starts[1:] - 1]])
            entered = np.flatnonzero(tramo[starts] != earlier)
            sizes = np.diff(np.append(starts, n))
            made = []
            for k, half in enumerate(halves):
                total = np.cumsum(batch[half].to_numpy())
                add = -np.where(starts > 0, total[starts - 1], 0)
                entry = pc.fill_null(batch[f"{half}_antes"], 0).to_numpy()
                add[entered] += entry[starts[entered]]
                if goes_on:
                    add[0] += state[k]
                total = total + np.repeat(add, sizes)
                state[k] = int(total[-1])
                made.append(pa.array(total, pa.int64()))
            last = (batch[key][n - 1].as_py(), int(tramo[n - 1]))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *made], [*kept, *halves])

    return sums
