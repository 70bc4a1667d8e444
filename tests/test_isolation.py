"""Isolation trees against a plain walk over the same nodes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from caudal.operators import isolation as I


def frame(spark, n=600):
    rng = random.Random(1)
    rows = [(i, rng.gauss(0, 1), rng.choice([1.0, 2.0, None]), 5.0) for i in range(n - 2)]
    rows += [(n - 2, 40.0, 90.0, 5.0), (n - 1, 40.0, 90.0, 5.0)]
    return spark.createDataFrame(rows, "id long, a double, b double, flat double"), rows


def c(n):
    return 2 * (math.log(n - 1) + I.EULER) - 2 * (n - 1) / n if n > 2 else float(n == 2)


@pytest.mark.parametrize("size", [64, 1000])
def test_path_lengths_equal_a_walk(spark, size):
    df, rows = frame(spark)
    columns, trees = ["a", "b", "flat"], 10
    depth = math.ceil(math.log2(size))
    sample = I.forest_sample(df, "id", columns, trees, size, 42)
    per_tree = {r["tree"]: r["count"] for r in sample.groupBy("tree").count().collect()}
    assert per_tree == dict.fromkeys(range(trees), min(size, len(rows)))
    nodes = I.grow(sample, 3, depth, 42)
    table = {(r["tree"], r["node"]): r for r in nodes.collect()}
    assert all(r["f"] != 2 for r in table.values())
    held = {}
    for r in sample.collect():
        node = 0
        while table[r["tree"], node]["f"] is not None:
            t = table[r["tree"], node]
            node = 2 * node + 1 + (r["x"][t["f"]] >= t["cut"])
        held.setdefault((r["tree"], node), []).append(r["x"])
    for key, t in table.items():
        if t["f"] is None:
            level = int(math.log2(key[1] + 1))
            assert t["length"] == pytest.approx(level + c(len(held[key])))
            assert level == depth or len({tuple(x) for x in held[key]}) == 1
    got = {r["id"]: r["camino"] for r in I.isolation_scores(
        df, columns, trees=trees, size=size).collect()}
    for i, *x in rows:
        x, total = [v or 0.0 for v in x], 0.0
        for tree in range(trees):
            node = 0
            while table[tree, node]["f"] is not None:
                t = table[tree, node]
                node = 2 * node + 1 + (x[t["f"]] >= t["cut"])
            total += table[tree, node]["length"]
        assert got[i] == pytest.approx(total / trees)


def test_rare_rows_score_highest_and_the_layout_does_not_matter(spark):
    df, rows = frame(spark)
    got = {r["id"]: r["anomalia"] for r in I.isolation_scores(df, ["a", "b"]).collect()}
    again = I.isolation_scores(df.repartition(5, F.rand(3)), ["a", "b"]).collect()
    assert {r["id"]: r["anomalia"] for r in again} == pytest.approx(got)
    assert sorted(got, key=got.get)[-2:] in ([598, 599], [599, 598])
    assert got[598] == got[599] and all(0 < v < 1 for v in got.values())


def test_a_short_share_is_widened(spark, monkeypatch):
    df, _ = frame(spark)
    whole = sorted(map(str, I.forest_sample(df, "id", ["a"], 4, 64, 42).collect()))
    monkeypatch.setattr(I.math, "sqrt", lambda _: -7.5)
    assert sorted(map(str, I.forest_sample(df, "id", ["a"], 4, 64, 42).collect())) == whole
    assert I.isolation_scores(df.filter("id < 0"), ["a"]).count() == 0
