"""Anomaly scores by isolation trees, grown level by level from Spark aggregates.

Every tree sees a small sample and cuts it at random until rows stand alone; rows that are
few and different stand alone early. All trees grow together: per level one aggregation gives the
ranges of all open nodes, and digests of tree and node choose a column and a place in its range, so
the same data give the same trees on every run and layout. Nodes are numbered as in a heap: the
children of node k are 2k+1 (below the cut) and 2k+2.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caudal import constants as K
from caudal.functions.numeric import double, num
from caudal.operators.support import materialize

FOREST_TREES = 50
SAMPLE_ROWS = 256
EULER = 0.5772156649015329


def digest_share(text: Column) -> Column:
    """A number between 0 and 1, both excluded, that a text decides."""
    digits = double(F.conv(F.substring(F.md5(text), 1, 8), 16, 10))
    return (digits + num(0.5)) / num(2.0**32)


def mean_depth(n: Column) -> Column:
    """Mean depth at which a row of ``n`` is found by random cuts."""
    m = double(n)
    more = num(2) * (F.ln(m - num(1)) + num(EULER)) - num(2) * (m - num(1)) / m
    return F.when(n > 2, more).when(n == 2, num(1)).otherwise(num(0))


def forest_sample(
    rows: DataFrame, id_col: str, columns: list[str], trees: int, size: int, seed: int
) -> DataFrame:
    """Of every tree the ``size`` rows with the least digests: (tree, x), bounded by both.

    Rows are first cut to a share that leaves a little more than is asked; a tree that it leaves
    short makes the share larger, so the result does not depend on it.
    """
    x = F.array(*[F.coalesce(double(F.col(c)), num(0)) for c in columns])
    total = rows.count()
    share = min(1.0, (size + 8 * math.sqrt(size)) / max(total, 1))
    while True:
        mark = lambda t: digest_share(
            F.concat_ws(":", F.lit(str(seed)), t.cast("string"), F.col(id_col).cast("string"))
        )
        numbers = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: mark(t) <= share)
        drawn = rows.select(id_col, x.alias("x"), F.explode(numbers).alias("tree"))
        in_order = Window.partitionBy("tree").orderBy(mark(F.col("tree")), id_col)
        kept = materialize(
            drawn.withColumn("_k", F.row_number().over(in_order)).filter(F.col("_k") <= size)
            .select("tree", "x")
        )
        if share == 1.0 or kept.count() >= trees * min(size, total):
            return kept
        share = min(1.0, share * 2)


def grow(sample: DataFrame, columns: int, depth: int, seed: int) -> DataFrame:
    """Nodes of all trees: (tree, node, f, cut) inside, (tree, node, length) at the leaves."""
    now, cuts = sample.withColumn("node", F.lit(0)), []
    for level in range(depth):
        ranges = F.array(*[
            F.struct(F.lit(f).alias("f"), F.min(F.element_at("x", f + 1)).alias("lo"),
                     F.max(F.element_at("x", f + 1)).alias("hi"))
            for f in range(columns)
        ])
        draw = lambda what: digest_share(F.concat_ws(
            ":", F.lit(str(seed)), F.col("tree").cast("string"), F.col("node").cast("string"),
            F.lit(what),
        ))
        varying = F.filter("r", lambda v: v["hi"] > v["lo"])
        open_ = now.filter(F.col("node") >= 2**level - 1).groupBy("tree", "node").agg(
            ranges.alias("r")
        ).withColumn("r", varying).filter(F.size("r") > 0)
        pick = F.element_at("r", F.floor(draw("f") * F.size("r")).cast("int") + 1)
        chosen = open_.withColumn("v", pick).select(
            "tree", "node", F.col("v.f").alias("f"),
            (F.col("v.lo") + draw("cut") * (F.col("v.hi") - F.col("v.lo"))).alias("cut"),
            F.col("v.lo").alias("lo"),
        ).filter("cut > lo").drop("lo")
        cut = materialize(chosen)
        cuts.append(cut)
        right = (F.element_at("x", F.col("f") + 1) >= F.col("cut")).cast("int")
        child = F.when(F.col("f").isNull(), F.col("node")).otherwise(F.col("node") * 2 + 1 + right)
        # at most a node per sampled row: bounded by trees and sample, not by the data
        now = now.join(F.broadcast(cut), ["tree", "node"], "left").select(
            "tree", "x", child.alias("node")
        )
    level = F.floor(F.log2(double(F.col("node")) + num(1)))
    leaves = now.groupBy("tree", "node").agg(F.count("*").alias("n")).select(
        "tree", "node", F.lit(None).cast("int").alias("f"),
        F.lit(None).cast("double").alias("cut"),
        (double(level) + mean_depth(F.col("n"))).alias("length"),
    )
    inner = reduce(DataFrame.unionByName, cuts).withColumn("length", F.lit(None).cast("double"))
    return materialize(inner.unionByName(leaves))


def with_path_length(
    rows: DataFrame, nodes: DataFrame, x: Column, trees: int, depth: int
) -> DataFrame:
    """Rows with ``camino``, their mean path length, by look-ups in arrays over heap numbers.

    The trees, of a size that their number and depth bound, enter as one scalar subquery.
    """
    size = 2 ** (depth + 1) - 1
    spark = nodes.sparkSession
    places = spark.range(trees * size).select(
        F.floor(F.col("id") / size).cast("int").alias("tree"), (F.col("id") % size).cast("int").alias("node")
    )
    full = places.join(nodes, ["tree", "node"], "left")
    packed = full.groupBy("tree").agg(
        F.sort_array(F.collect_list(F.struct("node", "f", "cut", "length"))).alias("k")
    ).select(F.struct(F.col("k.f").alias("f"), F.col("k.cut").alias("cut"),
                      F.col("k.length").alias("length")).alias("t"))
    model = packed.agg(F.collect_list("t").alias("m")).scalar()

    def down(tree: Column, row: Column) -> Column:
        steps = F.sequence(F.lit(1), F.lit(depth))
        return F.aggregate(steps, F.lit(0), lambda node, _: F.when(
            F.get(tree["f"], node).isNull(), node
        ).otherwise(
            node * 2 + 1 + (F.get(row, F.get(tree["f"], node)) >= F.get(tree["cut"], node)).cast("int")
        ))

    # bound once a row: named within the steps, the values would be computed at each of them
    total = F.element_at(F.transform(F.array(x), lambda row: F.aggregate(
        "_bosque", num(0), lambda acc, tree: acc + F.get(tree["length"], down(tree, row))
    )), 1)
    return rows.withColumn("_bosque", model).select(
        *[F.col(f"`{c}`") for c in rows.columns], (total / num(trees)).alias("camino")
    )


def isolation_scores(
    rows: DataFrame,
    columns: list[str],
    id_col: str = "id",
    trees: int = FOREST_TREES,
    size: int = SAMPLE_ROWS,
    seed: int = K.SEED,
) -> DataFrame:
    """The rows with ``camino`` (mean path length) and ``anomalia`` (0 to 1, high is rare).

    The trees are fitted on ``trees`` samples of ``size`` rows, chosen by digests of the ids; all rows
    are scored by column expressions. A null counts as 0. Equal rows have equal scores.
    """
    depth = math.ceil(math.log2(size))
    sample = forest_sample(rows, id_col, columns, trees, size, seed)
    nodes = grow(sample, len(columns), depth, seed)
    x = F.array(*[F.coalesce(double(F.col(c)), num(0)) for c in columns])
    found = sample.filter("tree = 0").agg(F.count("*").alias("n")).select("n").scalar()
    usual = F.greatest(mean_depth(found), num(1))
    return with_path_length(rows, nodes, x, trees, depth).withColumn(
        "anomalia", F.pow(num(2), -F.col("camino") / usual)
    )
