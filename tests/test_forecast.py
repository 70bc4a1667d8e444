"""Walk-forward forecasts against a regression refitted for every day."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caudal.operators import forecast as W
from caudal.plans.modelling import QUERIES

START = dt.date(2024, 1, 1)


def series(seed, n, d, holes=False):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        x = [rng.gauss(50, 10) * 10**i for i in range(d)]
        y = 1000 + sum((i + 1) * v / 10**i for i, v in enumerate(x)) + rng.gauss(0, 5)
        if holes and k % 11 == 3:
            x[0] = None
        if holes and k % 13 == 5:
            y = None
        rows.append((START + dt.timedelta(k), y, *x))
    return rows


def frame(spark, rows, d, key=None):
    names = ", ".join(f"x{i} double" for i in range(d))
    df = spark.createDataFrame(rows, f"fecha date, y double, {names}")
    return df.withColumn("k", F.lit(key)) if key else df


def refitted(rows, warmup, ridge):
    out = {}
    for k, (day, _, *x) in enumerate(rows):
        past = [r for r in rows[:k] if r[1] is not None and None not in r[2:]]
        if len(past) < warmup or None in x:
            out[day] = None
            continue
        a = np.array([r[2:] for r in past])
        y = np.array([r[1] for r in past])
        mean, sd = a.mean(0), a.std(0)
        z = (a - mean) / np.where(sd > 0, sd, 1)
        b = np.linalg.lstsq(z.T @ z / len(y) + ridge * np.eye(z.shape[1]),
                            z.T @ (y - y.mean()) / len(y), rcond=None)[0]
        out[day] = float(y.mean() + (np.array(x) - mean) / np.where(sd > 0, sd, 1) @ b)
    return out


@pytest.mark.parametrize("d, ridge", [(1, 0.0), (4, 0.0), (4, 0.1)])
def test_equals_a_refit_for_every_day(spark, d, ridge):
    rows = series(1, 120, d, holes=True)
    got = W.walk_forward(frame(spark, rows, d), "y", [f"x{i}" for i in range(d)],
                         warmup=20, ridge=ridge).collect()
    want = refitted(rows, 20, ridge)
    assert len(got) == len(rows)
    for r in got:
        assert (r["pronostico"] is None) == (want[r["fecha"]] is None)
        if r["pronostico"] is not None:
            assert r["pronostico"] == pytest.approx(want[r["fecha"]], rel=1e-6)
    assert sum(v is not None for v in want.values()) > 50


def test_series_stay_apart_and_flat_regressors_do_no_harm(spark):
    a, b = series(2, 60, 2), series(3, 60, 2)
    a = [(day, y, 7.0, x1) for day, y, _, x1 in a]
    both = frame(spark, a, 2, "a").unionByName(frame(spark, b, 2, "b"))
    got = W.walk_forward(both, "y", ["x0", "x1"], keys=("k",), warmup=10).collect()
    for key, rows in (("a", a), ("b", b)):
        want = refitted(rows, 10, 0.0)
        mine = {r["fecha"]: r["pronostico"] for r in got if r["k"] == key}
        for day, value in want.items():
            assert mine[day] == (None if value is None else pytest.approx(value, rel=1e-6))


def test_later_days_change_no_earlier_forecast(spark):
    rows = series(4, 80, 2)
    whole = W.walk_forward(frame(spark, rows, 2), "y", ["x0", "x1"]).collect()
    part = W.walk_forward(frame(spark, rows[:50], 2), "y", ["x0", "x1"]).collect()
    early = {r["fecha"]: r["pronostico"] for r in part}
    assert all(early[r["fecha"]] == r["pronostico"] for r in whole if r["fecha"] in early)
    assert W.walk_forward(frame(spark, [], 2), "y", ["x0"]).count() == 0


def test_season_marks():
    assert set(W.season(F.lit(START))) == {"anual_seno", "anual_coseno", "semanal_seno",
                                           "semanal_coseno", "quincena", "diciembre"}


def test_the_seasonal_forecast_is_no_worse_than_its_mean(spark):
    rows = QUERIES["gap_seasonal_forecast"].run(spark, "/root/testdata/sf0.01").collect()
    made = [(r["brecha_liquidez_usd"], r["pronostico"]) for r in rows if r["pronostico"] is not None]
    assert len(made) > 100
    y, p = (np.array(v) for v in zip(*made, strict=True))
    assert np.abs(y - p).mean() < 1.05 * np.abs(y - y.mean()).mean()
