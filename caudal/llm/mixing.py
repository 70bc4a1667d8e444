"""Mixing sources to target weights by iterative proportional fitting (op 8).

Token counts of the cells source x language x topic are raked until every marginal meets its
target; what a cell gains or loses calibrates the probability with which its documents are
sampled. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caudal.llm.storage import stored

SPACE = r"[\x20\x09-\x0D]+"
SMALL_CELLS = 10_000  # cells that one task rakes and that are sent to every executor
ROUNDS_AT_ONCE = 4
MAX_ROUNDS = 40
TOLERANCE = 1e-9


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, SPACE), "")).cast("long")


def kind_of_text(text: Column) -> Column:
    """A topic for tables that have none: what kind of text it is by its marks."""
    return (
        F.when(text.contains(" | "), F.lit("table"))
        .when(text.contains("icense"), F.lit("licence"))
        .when(text.contains("@"), F.lit("contact"))
        .otherwise(F.lit("prose"))
    )


def with_targets(
    cells: DataFrame, dim: str, target: float | Mapping[str, float]
) -> DataFrame:
    """Add ``t_<dim>``, the target share of the cell's value.

    A number is a power: shares proportional to the observed share to that power (1 keeps them,
    0 makes them equal). A mapping names shares; values it lacks keep their observed share, and
    all are scaled to sum to one.
    """
    totals = cells.groupBy(dim).agg(F.sum("tokens").alias("_n"))
    if isinstance(target, Mapping):
        every = cells.agg(F.sum("tokens")).first()[0] or 1
        share = F.col("_n") / F.lit(float(every))
        for value, part in target.items():
            share = F.when(F.col(dim) == value, F.lit(float(part))).otherwise(share)
    else:
        share = F.pow(F.col("_n").cast("double"), F.lit(float(target)))
    raw = totals.select(dim, F.when(F.col("_n") > 0, share).otherwise(F.lit(0.0)).alias("_s"))
    norm = raw.agg(F.sum("_s")).first()[0] or 1.0
    return cells.join(raw.select(dim, (F.col("_s") / F.lit(norm)).alias(f"t_{dim}")), dim)


def rake(cells: DataFrame, dims: tuple[str, ...], max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Add ``weight`` to cells with ``tokens`` and target shares: raked token weights.

    Each step scales the cells of every value of one dimension to its target. Rounds go on until
    no marginal is off by more than ``TOLERANCE`` of its target, or targets that cannot be met
    together have been approached for ``max_rounds``. The total stays that of the tokens.
    """
    now = stored(cells.withColumn("weight", F.col("tokens").cast("double")), "cells")
    total = now.agg(F.sum("weight")).first()[0] or 0.0
    few = now.count() <= SMALL_CELLS
    for _ in range(max(1, max_rounds // ROUNDS_AT_ONCE)):
        step = now.coalesce(1) if few else now  # few cells need no shuffles
        for _ in range(ROUNDS_AT_ONCE):
            for dim in dims:
                have = F.sum("weight").over(Window.partitionBy(dim))
                step = step.withColumn(
                    "weight",
                    F.when(have > 0, F.col("weight") * F.col(f"t_{dim}") * F.lit(total) / have)
                    .otherwise(F.lit(0.0)),
                )
        now = stored(step, "raked")
        seen = now.coalesce(1) if few else now
        have = seen.select(
            *[F.sum("weight").over(Window.partitionBy(d)).alias(f"_{d}") for d in dims],
            *[f"t_{d}" for d in dims],
        )
        off = F.greatest(*[
            F.max(F.abs(F.col(f"_{d}") - F.col(f"t_{d}") * F.lit(total))) for d in dims
        ])
        if (have.agg(off).first()[0] or 0.0) <= TOLERANCE * total:
            break
    return now


def mix(
    docs: DataFrame,
    targets: Mapping[str, float | Mapping[str, float]],
    columns: Mapping[str, Column],
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: float | None = None,
    seed: int = 8,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: id, ``carry``, the dimensions, ``n_tokens`` (words),
    ``weight`` (what a token of its cell is worth under the targets), ``probability``, ``sampled``.

    ``columns`` gives an expression for each dimension of ``targets``. A null value counts as
    the empty text, a null text has no tokens. Probabilities are proportional to the weights: the
    largest is 1, or, with ``keep``, they are scaled to keep that share of the tokens and
    end at 1, so that the heaviest cells may fall short. A document is drawn by a hash of id and
    ``seed``: the same on every run, and alike for repeated rows. Cells without tokens have
    weight and probability 1, so documents without words stay. An empty table gives an empty
    result.
    """
    dims = tuple(targets)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in carry]
    rows = docs.select(
        F.col(f"`{id_col}`").alias("_id"), F.struct(F.lit(0), *kept).alias("_carry"),
        *[F.coalesce(columns[d].cast("string"), F.lit("")).alias(d) for d in dims],
        n_words(text).alias("n_tokens"),
    )
    cells = rows.groupBy(*dims).agg(F.sum("n_tokens").alias("tokens"))
    cells = stored(cells, "counts")
    aimed = cells
    for d in dims:
        aimed = with_targets(aimed, d, targets[d])
    worth = rake(aimed, dims).select(
        *dims, "tokens",
        F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0).alias("weight"),
    )
    worth = stored(worth, "worth")
    some = worth.filter("tokens > 0")
    scale = 1.0 / (some.agg(F.max("weight")).first()[0] or 1.0)
    if keep is not None:
        scale = calibrated(some, keep, scale)
    probability = F.when(
        F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") * F.lit(scale))
    ).otherwise(1.0)
    worth = worth.withColumn("probability", probability).drop("tokens")
    few = worth.count() <= SMALL_CELLS
    draw = F.shiftrightunsigned(F.xxhash64("_id", F.lit(seed)), 11) / F.lit(float(1 << 53))
    return rows.join(F.broadcast(worth) if few else worth, list(dims)).select(
        F.col("_id").alias(id_col), *[F.col(f"_carry.`{c}`") for c in carry],
        *dims, "n_tokens", "weight", "probability", (draw < F.col("probability")).alias("sampled"),
    )


def calibrated(cells: DataFrame, keep: float, low: float) -> float:
    """The factor that makes the expected kept tokens ``keep`` of all, by nested grids."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    least = cells.filter("weight > 0").agg(F.min("weight")).first()[0]
    low, high = 0.0, max(low, 1.0 / (least or 1.0))
    for _ in range(8):
        steps = [low + (high - low) * k / 32 for k in range(33)]
        got = cells.agg(*[
            F.sum(F.least(F.lit(1.0), F.col("weight") * F.lit(s)) * F.col("tokens")) for s in steps
        ]).first()
        over = next((k for k in range(33) if (got[k] or 0.0) >= keep * total), 32)
        low, high = steps[max(over - 1, 0)], steps[over]
    return high
