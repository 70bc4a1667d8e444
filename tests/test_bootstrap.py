"""Bootstrap weights and intervals against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caudal.operators import bootstrap as B
from caudal.operators.metrics import auc_gini, pr_auc, pr_curve


def weight(seed, replicate, identity):
    if not replicate:
        return 1
    text = f"{seed}:{replicate}:{identity}".encode()
    share = (int(hashlib.md5(text).hexdigest()[:8], 16) + 0.5) / 2**32
    return next((k for k, c in enumerate(B.poisson_steps()) if share < c), len(B.poisson_steps()))


def measures(rows):
    """AUC and PR-AUC of (weight, label, score) rows, pair by pair and cut by cut."""
    pos = [(w, s) for w, y, s in rows if y == 1 and w]
    neg = [(w, s) for w, y, s in rows if y != 1 and w]
    p, n = sum(w for w, _ in pos), sum(w for w, _ in neg)
    wins = sum(a * b * (1 if s > t else 0.5 if s == t else 0) for a, s in pos for b, t in neg)
    ap = 0.0
    for s in {s for _, s in pos}:
        here = sum(w for w, t in pos if t == s)
        tp = sum(w for w, t in pos if t >= s)
        fp = sum(w for w, t in neg if t >= s)
        ap += here / p * tp / (tp + fp)
    return (wins / (p * n) if p and n else None, ap if p else None)


def test_weights_are_poisson():
    draws = [weight(42, 1, i) for i in range(20_000)]
    assert np.mean(draws) == pytest.approx(1, abs=0.03)
    assert np.var(draws) == pytest.approx(1, abs=0.06)


def test_intervals_equal_plain_replicates(spark):
    rng = random.Random(1)
    rows = [(i, int(rng.random() < 0.3), rng.randint(0, 12) + 3 * (i % 3)) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, y int, s int")
    got = {r["metrica"]: r for r in B.metric_intervals(df, "y", "s", replicates=15).collect()}
    made = [measures([(weight(42, r, i), y, s) for i, y, s in rows]) for r in range(16)]
    for k, name in enumerate(("auc", "pr_auc")):
        values = [m[k] for m in made]
        assert got[name]["estimacion"] == pytest.approx(values[0])
        assert got[name]["bajo"] == pytest.approx(np.quantile(values[1:], 0.025))
        assert got[name]["alto"] == pytest.approx(np.quantile(values[1:], 0.975))
        assert got[name]["replicas"] == 15
    assert got["auc"]["estimacion"] == pytest.approx(auc_gini(df, "y", "s").first()["auc"])
    assert got["pr_auc"]["estimacion"] == pytest.approx(
        pr_auc(pr_curve(df, "y", "s")).first()["pr_auc"])


def test_the_layout_does_not_matter_and_the_seed_does(spark):
    df = spark.range(300).selectExpr("id", "cast(id % 4 = 0 as int) y", "id % 17 s")
    one = sorted(map(str, B.metric_intervals(df, "y", "s", replicates=5).collect()))
    other = df.repartition(7, F.rand(1))
    assert sorted(map(str, B.metric_intervals(other, "y", "s", replicates=5).collect())) == one
    assert sorted(map(str, B.metric_intervals(df, "y", "s", replicates=5, seed=1).collect())) != one


def test_one_class_has_no_auc(spark):
    df = spark.range(20).selectExpr("id", "0 y", "id s")
    got = {r["metrica"]: r for r in B.metric_intervals(df, "y", "s", replicates=3).collect()}
    assert got["auc"]["estimacion"] is None and got["auc"]["replicas"] == 0
