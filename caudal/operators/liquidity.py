"""Daily liquidity, treasury and the macro series.

Every frame here has one row per day (and entity): its size is set by the calendar, so a
window over all of it stays small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caudal import constants as K
from caudal.functions.calendar import (
    activity_rate, carry_forward, is_december, is_payday, is_weekend, season_factor, week_key,
    year_month,
)
from caudal.functions.numeric import (
    double, exact_mean, legal_reserve, liquidity_gap, liquidity_ratio, minimum_cash, num,
    rate_spread, round_half_up, sum_if,
)
from caudal.operators.rollforward import cash_rollforward
from caudal.operators.support import join_small

# ---- macro --------------------------------------------------------------------------

# ---- Fixed values: report column and its source column ----
MACRO_SERIES = {
    "bcv": "tasa_bcv_usd_ves",
    "paralela": "tasa_paralela_usd_ves",
    "inflacion_pct": "inflacion_mensual_pct",
    "pib_var_pct": "variacion_pib_mensual_pct",
    "tasa_activa": "tasa_activa_ves_anual",
    "tasa_pasiva": "tasa_pasiva_ves_anual",
}


def macro_monthly(macro: DataFrame) -> DataFrame:
    means = [
        round_half_up(exact_mean(F.col(source)), 2).alias(name)
        for name, source in MACRO_SERIES.items()
    ]
    return macro.groupBy(year_month(F.col("fecha")).alias("mes")).agg(*means).orderBy("mes")


def fx_spread(macro: DataFrame) -> DataFrame:
    spread = rate_spread(F.col("tasa_paralela_usd_ves"), F.col("tasa_bcv_usd_ves"))
    return macro.select("fecha", spread.alias("brecha"))


def fx_devaluation(macro: DataFrame) -> DataFrame:
    """Change of the official rate against the day before in the series."""
    previous = F.lag("tasa_bcv_usd_ves").over(Window.orderBy("fecha"))
    change = F.col("tasa_bcv_usd_ves") - F.col("tasa_previa")
    return macro.withColumn("tasa_previa", previous).select(
        "fecha",
        "tasa_bcv_usd_ves",
        change.alias("cambio"),
        (double(change) / double(F.col("tasa_previa")) * num(100)).alias("devaluacion_pct"),
        rate_spread(F.col("tasa_paralela_usd_ves"), F.col("tasa_bcv_usd_ves")).alias("brecha"),
    )


def with_last_known(
    df: DataFrame, series: DataFrame, day: str = "fecha", found: str = "fecha_tasa"
) -> DataFrame:
    """Rows with the values of the last day of ``series`` (by ``fecha``) up to their own.

    The series has one row per day, with gaps. Its days are repeated up to the next one and, behind
    its end, to the last day of ``df``; so every day asked for is met by equality, and the
    large side is neither ordered nor shuffled. A row before the series has nulls, as has one
    without a day. ``found`` names the day that the values are of.
    """
    last = df.agg(F.max(day)).scalar()
    days = series.withColumn(found, F.col("fecha")).withColumn("_fin", last)
    every = carry_forward(days, "fecha", until=F.col("_fin")).drop("_fin")
    every = every.select(*[F.col(c).alias(day if c == "fecha" else c) for c in every.columns])
    return join_small(df, every, day, "left")


def month_rate_lookup(
    df: DataFrame, day: str, macro: DataFrame,
    inflation: float = K.DEFAULT_INFLATION, gdp: float = K.DEFAULT_GDP,
) -> DataFrame:
    """Monthly inflation and output by a date column, with defaults for unknown months."""
    months = macro.groupBy(year_month(F.col("fecha")).alias("mes")).agg(
        exact_mean(F.col("inflacion_mensual_pct")).alias("inflacion_pct"),
        exact_mean(F.col("variacion_pib_mensual_pct")).alias("pib_var_pct"),
    )
    keyed = df.withColumn("mes", year_month(F.col(day)))
    return join_small(keyed, months, "mes", "left").fillna(
        {"inflacion_pct": inflation, "pib_var_pct": gdp}
    )


def calendar_features(days: DataFrame) -> DataFrame:
    """Season marks of each day and the activity expected on it."""
    day = F.col("fecha")
    factor = season_factor(day)
    return days.select(
        "fecha",
        is_payday(day).cast("int").alias("quincena"),
        is_december(day).cast("int").alias("diciembre"),
        is_weekend(day).cast("int").alias("fin_semana"),
        factor.alias("multiplicador"),
        *[activity_rate(m, factor).alias(f"actividad_{m.lower()}") for m in K.CURRENCIES],
    )


# ---- daily liquidity ----------------------------------------------------------------


def liquidity_weekly(daily: DataFrame) -> DataFrame:
    def mean(source: str, factor: float = 1.0):
        return round_half_up(exact_mean(F.col(source)) * num(factor), 2)

    return (
        daily.groupBy(week_key(F.col("fecha")).alias("semana"))
        .agg(
            F.min("fecha").alias("fecha"),
            mean("total_depositos_ves").alias("depositos_ves"),
            mean("total_depositos_usd").alias("depositos_usd"),
            mean("disponible_caja_ves").alias("disponible_ves"),
            mean("encaje_legal_bcv_ves").alias("encaje_ves"),
            mean("tasa_liquidez", 100).alias("tasa_liquidez"),
        )
        .orderBy("semana")
    )


def liquidity_ratios(daily: DataFrame, macro: DataFrame) -> DataFrame:
    """Reserve, minimum cash, liquidity ratio and gap of each day.

    Takes fecha, total_depositos_ves and disponible_caja_ves.
    """
    deposits, cash = F.col("total_depositos_ves"), F.col("disponible_caja_ves")
    reserve = legal_reserve(deposits)
    gap = liquidity_gap(cash, reserve, F.col("tasa_bcv_usd_ves"))
    rates = macro.select("fecha", "tasa_bcv_usd_ves")
    rows = daily.select("fecha", deposits, cash).join(rates, "fecha")
    return rows.select(
        "fecha",
        reserve.alias("encaje_ves"),
        minimum_cash(deposits).alias("caja_minima_ves"),
        liquidity_ratio(cash, deposits).alias("tasa_liquidez"),
        gap.alias("brecha_usd"),
        (double(deposits) - reserve).alias("depositos_utilizables_ves"),
        F.when(gap < 0, 1).otherwise(0).alias("deficit"),
    )


def gap_free(daily: DataFrame, *keys: str) -> DataFrame:
    """The daily series with missing days filled with the last known level."""
    return carry_forward(daily, "fecha", *keys)


LAGS = (1, 7, 30)


def liquidity_lags(series: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """Levels of 1, 7 and 30 days before, over a series without gaps."""
    order = Window.partitionBy(*keys).orderBy("fecha")
    lagged = {
        f"{c}_t{n}": F.lag(c, n).over(order) for c in columns for n in LAGS
    }
    return gap_free(series.select(*keys, "fecha", *columns), *keys).withColumns(lagged)


def liquidity_features(daily: DataFrame, macro: DataFrame) -> DataFrame:
    """Lagged deposits, rate spread, payday and December marks, and the gap to forecast."""
    columns = ["total_depositos_ves", "total_depositos_usd"]
    lags = liquidity_lags(daily, [*columns, "brecha_liquidez_usd"])
    rows = lags.join(fx_spread(macro), "fecha")
    return rows.select(
        "fecha",
        *[f"{c}_t{n}" for c in columns for n in LAGS],
        "brecha",
        is_payday(F.col("fecha")).cast("int").alias("quincena"),
        is_december(F.col("fecha")).cast("int").alias("diciembre"),
        "brecha_liquidez_usd",
    )


# ---- treasury -----------------------------------------------------------------------


def treasury_by_operation(ops: DataFrame) -> DataFrame:
    return ops.groupBy(F.col("tipo_operacion").alias("operacion")).agg(
        F.count("*").alias("cantidad"),
        F.sum("monto_usd").alias("volumen_usd"),
        round_half_up(exact_mean(F.col("tasa_anual")), 2).alias("tasa_promedio"),
    )


def treasury_monthly_flow(ops: DataFrame) -> DataFrame:
    kind, usd = F.col("tipo_operacion"), F.col("monto_usd")
    return (
        ops.groupBy(year_month(F.col("fecha")).alias("mes"))
        .agg(
            sum_if(kind == K.FUNDING, usd).alias("fondeo_usd"),
            sum_if(kind.isin(*K.INVESTING), usd).alias("inversiones_usd"),
        )
        .orderBy("mes")
    )


def treasury_operations(
    forward: DataFrame, macro: DataFrame,
    funding_rate: float = K.FUNDING_RATE_FACTOR, investing_rate: float = K.INVESTING_RATE_FACTOR,
) -> DataFrame:
    """The operations a roll-forward has made: overnight funding, or an investment."""
    funding = F.col("fondeo_usd").isNotNull()
    made = forward.filter(funding | F.col("inversion_usd").isNotNull())
    rates = macro.select("fecha", "tasa_activa_ves_anual", "tasa_pasiva_ves_anual")
    rate = F.when(funding, double(F.col("tasa_activa_ves_anual")) * num(funding_rate)).otherwise(
        double(F.col("tasa_pasiva_ves_anual")) * num(investing_rate)
    )
    return made.join(rates, "fecha").select(
        "entidad",
        "fecha",
        F.when(funding, K.FUNDING).otherwise(K.INVESTING[1]).alias("tipo_operacion"),
        round_half_up(F.coalesce("fondeo_usd", "inversion_usd"), 2).alias("monto_usd"),
        round_half_up(rate, 2).alias("tasa_anual"),
        F.when(funding, 1).cast("int").alias("plazo_dias"),
    )
