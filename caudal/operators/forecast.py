"""Walk-forward forecasts: every day is forecast from the days before it, in one pass.

A regression needs only sums of products. Their running sums by day are the regressions of all
days at once; what is left per day is a small system of equations, solved for a whole Arrow batch.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caudal.functions.calendar import is_december, is_payday
from caudal.functions.numeric import double, num

WARMUP = 30
#: A regressor whose variance is below this share of its mean square does not vary.
FLAT = 1e-12


def season(day: Column) -> dict[str, Column]:
    """Regressors of the season: year and week on a circle, payday, December."""
    year = double(F.dayofyear(day)) * num(2 * math.pi / 365.25)
    week = double(F.weekday(day)) * num(2 * math.pi / 7)
    return {
        "anual_seno": F.sin(year), "anual_coseno": F.cos(year),
        "semanal_seno": F.sin(week), "semanal_coseno": F.cos(week),
        "quincena": double(is_payday(day).cast("int")),
        "diciembre": double(is_december(day).cast("int")),
    }


def walk_forward(
    series: DataFrame,
    label: str,
    inputs: list[str],
    order: str = "fecha",
    keys: tuple[str, ...] = (),
    warmup: int = WARMUP,
    ridge: float = 0.0,
) -> DataFrame:
    """Rows (keys, order, label) with ``pronostico``, the forecast from the rows before.

    A linear regression with intercept; ``ridge`` is added to the correlations' diagonal, so it does
    not depend on the units. A row without all values is not learnt from, one without all inputs
    gets no forecast, nor do rows with fewer than ``warmup`` learnt rows before them. ``order`` is
    unique within the keys. One window orders the rows of a series: a row per day.
    """
    d = len(inputs)
    rows = series.select(
        *keys, order, double(F.col(label)).alias(label),
        F.array(*[double(F.col(c)) for c in inputs]).alias("_x"),
    )
    complete = F.forall("_x", lambda v: v.isNotNull())
    learnt = complete & F.col(label).isNotNull()
    before = (
        Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    x = [F.element_at("_x", i + 1) for i in range(d)]
    y = F.col(label)
    products = [num(1), *x, y]
    products += [x[i] * x[j] for i in range(d) for j in range(i, d)]
    products += [v * y for v in x]
    sums = F.array(*[
        F.coalesce(F.sum(F.when(learnt, p)).over(before), num(0)) for p in products
    ])

    @F.pandas_udf("double")
    def forecast(moments: pd.Series, now: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=moments.index)
        ready = moments.notna()
        if ready.any():
            out[ready] = solved(
                np.stack(moments[ready].to_list()), np.stack(now[ready].to_list()), ridge
            )
        return out

    ready = complete & (F.element_at("_m", 1) >= num(max(warmup, 1)))
    made = forecast(F.when(ready, F.col("_m")), F.col("_x"))
    return rows.withColumn("_m", sums).select(
        *keys, order, label, F.when(ready, made).alias("pronostico")
    )


def solved(moments: np.ndarray, x: np.ndarray, ridge: float) -> np.ndarray:
    """Forecasts at ``x`` (a row each) from the sums of products of what came before."""
    rows, d = x.shape
    n = moments[:, 0]
    mean = moments[:, 1 : d + 1] / n[:, None]
    level = moments[:, d + 1] / n
    upper = np.triu_indices(d)
    squares = np.zeros((rows, d, d))
    start = d + 2
    squares[:, upper[0], upper[1]] = moments[:, start : start + len(upper[0])]
    squares[:, upper[1], upper[0]] = squares[:, upper[0], upper[1]]
    raw = np.einsum("rii->ri", squares) / n[:, None]
    cross = moments[:, start + len(upper[0]) :] / n[:, None] - mean * level[:, None]
    spread = squares / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    variance = np.einsum("rii->ri", spread)
    flat = variance <= FLAT * raw
    scale = np.sqrt(np.where(flat, 1.0, variance))
    system = spread / scale[:, :, None] / scale[:, None, :]
    system = np.where(flat[:, :, None] | flat[:, None, :], 0.0, system)
    system[:, np.arange(d), np.arange(d)] = np.where(flat, 1.0, 1.0 + ridge)
    right = np.where(flat, 0.0, cross / scale)
    if ridge:
        slope = np.linalg.solve(system, right[:, :, None])[:, :, 0]
    else:
        slope = np.einsum("rij,rj->ri", np.linalg.pinv(system, hermitian=True), right)
    return level + np.einsum("ri,ri->r", slope / scale, x - mean)


def forecast_errors(forecasts: dict[str, DataFrame], label: str) -> DataFrame:
    """MAE and RMSE of several forecasts (``fecha``, label, ``pronostico``) on their common days."""
    joined = None
    for name, df in forecasts.items():
        part = df.filter(F.col("pronostico").isNotNull() & F.col(label).isNotNull()).select(
            "fecha", *([double(F.col(label)).alias("_y")] if joined is None else []),
            F.col("pronostico").alias(f"_{name}"),
        )
        joined = part if joined is None else joined.join(part, "fecha")
    errors = F.array(*[
        F.struct(F.lit(name).alias("modelo"), (F.col("_y") - F.col(f"_{name}")).alias("e"))
        for name in forecasts
    ])
    return joined.select(F.explode(errors).alias("x")).groupBy(F.col("x.modelo").alias("modelo")).agg(
        F.count("*").alias("n"), F.avg(F.abs("x.e")).alias("mae"),
        F.sqrt(F.avg(F.col("x.e") * F.col("x.e"))).alias("rmse"),
    )


def lagged(series: DataFrame, label: str) -> DataFrame:
    """The forecast that nothing changes: the value of the row before."""
    return series.select(
        "fecha", double(F.col(label)).alias(label),
        double(F.lag(label).over(Window.orderBy("fecha"))).alias("pronostico"),
    )
