"""Intervals of ranking metrics by the Poisson bootstrap, all replicates in one pass.

Every row takes part in every replicate a number of times that a digest of seed, replicate and id
draws from the Poisson distribution of mean 1. So nothing is sampled or stored per replicate: the
rows are reduced to weighted counts per replicate and score, and these are summed up in order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal import constants as K
from caudal.functions.numeric import double, num
from caudal.operators.isolation import digest_share
from caudal.operators.running import running_totals
from caudal.operators.support import join_small, materialize

REPLICATES = 40


def poisson_steps() -> list[float]:
    """Upper ends of the shares of 0, 1, 2, ... draws, as far as a digest can tell them apart."""
    out, total, k = [], 0.0, 0
    while total < 1 - 2.0**-33:
        total += math.exp(-1) / math.factorial(k)
        out.append(total)
        k += 1
    return out


def poisson_weight(share: Column) -> Column:
    steps = poisson_steps()
    weight = F.when(share < num(steps[0]), 0)
    for k, step in enumerate(steps[1:], 1):
        weight = weight.when(share < num(step), k)
    return weight.otherwise(len(steps))


def replicate_weight(identity: Column, replicate: Column, seed: int) -> Column:
    """How often a row takes part; replicate 0 is the data as they are."""
    drawn = poisson_weight(digest_share(F.concat_ws(
        ":", F.lit(str(seed)), replicate.cast("string"), identity.cast("string")
    )))
    return F.when(replicate == 0, 1).otherwise(drawn)


def metric_intervals(
    df: DataFrame,
    label: str,
    score: str,
    identity: str = "id",
    replicates: int = REPLICATES,
    level: float = 0.95,
    seed: int = K.SEED,
) -> DataFrame:
    """``auc`` and ``pr_auc`` with their interval: (metrica, estimacion, bajo, alto, replicas).

    Rows of equal score count as half in the AUC and together in the precision. A replicate
    without both classes has no AUC, one without positives no PR-AUC; they are not counted.
    """
    numbers = F.sequence(F.lit(0), F.lit(replicates))
    weighted = F.filter(
        F.transform(numbers, lambda r: F.struct(
            r.alias("replica"),
            replicate_weight(F.col(identity), r, seed).cast("long").alias("w"),
        )),
        lambda x: x["w"] > 0,
    )
    drawn = df.select(
        (F.col(label) == 1).alias("y"), double(F.col(score)).alias("puntaje"),
        F.inline(weighted),
    )
    zero = F.lit(0).cast("long")
    counts = drawn.groupBy("replica", "puntaje").agg(
        F.sum(F.when(F.col("y"), F.col("w")).otherwise(zero)).alias("pos"),
        F.sum(F.when(F.col("y"), zero).otherwise(F.col("w"))).alias("neg"),
    )
    upto = running_totals(
        counts, "replica", ["puntaje"], {"p": F.col("pos"), "n": F.col("neg")}
    )
    whole = upto.groupBy("replica").agg(F.sum("pos").alias("total_p"), F.sum("neg").alias("total_n"))
    rows = join_small(upto, whole, "replica")
    wins = double(F.col("pos")) * (double(F.col("n") - F.col("neg")) + double(F.col("neg")) / 2)
    tp = double(F.col("total_p") - F.col("p") + F.col("pos"))
    fp = double(F.col("total_n") - F.col("n") + F.col("neg"))
    total_p, total_n = double(F.col("total_p")), double(F.col("total_n"))
    both = (F.col("total_p") > 0) & (F.col("total_n") > 0)
    found = rows.groupBy("replica").agg(
        F.sum(F.when(both, wins / (total_p * total_n))).alias("auc"),
        F.sum(F.when(F.col("total_p") > 0, double(F.col("pos")) / total_p * tp / (tp + fp)))
        .alias("pr_auc"),
    )
    long = materialize(found.select("replica", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metrica"), F.col(m).alias("x")) for m in ("auc", "pr_auc")
    ]))))
    drawn_x = F.when(F.col("replica") > 0, F.col("x"))
    tail = (1 - level) / 2
    return long.groupBy("metrica").agg(
        F.max(F.when(F.col("replica") == 0, F.col("x"))).alias("estimacion"),
        F.percentile(drawn_x, F.lit(tail)).alias("bajo"),
        F.percentile(drawn_x, F.lit(1 - tail)).alias("alto"),
        F.count(drawn_x).alias("replicas"),
    )
