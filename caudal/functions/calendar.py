"""Date keys, season factors and day sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caudal import constants as K
from caudal.functions.numeric import num


def year_month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def week_key(day: Column) -> Column:
    """Year and week number: weeks start on Monday, days before the first Monday are week 00."""
    week = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7)
    return F.concat(F.date_format(day, "yyyy"), F.lit("-"), F.lpad(week.cast("string"), 2, "0"))


def is_payday(day: Column) -> Column:
    d = F.dayofmonth(day)
    return d.isin(15, 30) | ((F.month(day) == 2) & (d == 28))


def paydays_of(month_start: Column) -> Column:
    """The two paydays of a month: the 15th, and the 30th or 28 February."""
    second = F.when(F.month(month_start) == 2, 27).otherwise(29)
    return F.array(F.date_add(month_start, 14), F.date_add(month_start, second))


def is_december(day: Column) -> Column:
    return F.month(day) == 12


def is_weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def season_factor(day: Column) -> Column:
    def step(condition: Column, factor: float) -> Column:
        return F.when(condition, num(factor)).otherwise(num(1))

    return (
        step(is_payday(day), K.PAYDAY_FACTOR)
        * step(is_december(day), K.DECEMBER_FACTOR)
        * step(is_weekend(day), K.WEEKEND_FACTOR)
    )


def activity_rate(currency: str, factor: Column) -> Column:
    """Share of the accounts of a currency expected to move on a day."""
    daily, cap = K.TX_RATES[currency]
    return F.least(num(cap), num(daily) * factor)


def maturity(start: Column, months: Column) -> Column:
    """Thirty days a month, not calendar months."""
    return F.date_add(start, (months * K.DAYS_PER_MONTH).cast("int"))


def day_range(first_last: DataFrame, first: str, last: str, name: str = "fecha") -> DataFrame:
    """Every day between two date columns of a frame, both ends included."""
    return first_last.select(F.explode(F.sequence(F.col(first), F.col(last))).alias(name))


def carry_forward(
    levels: DataFrame, day: str, *keys: str, until: Column | None = None
) -> DataFrame:
    """Repeat each level on the days up to the next one, which leaves no gap in the series.

    ``levels`` is already one row per day (and key), so the windows hold calendar days,
    however large the facts below them are.
    """
    order = Window.partitionBy(*keys).orderBy(day)
    last = F.max(day).over(Window.partitionBy(*keys)) if until is None else until
    next_day = F.lead(day).over(order)
    end = F.greatest(F.coalesce(F.date_sub(next_day, 1), last), F.col(day))
    days = F.explode(F.sequence(F.col(day), F.col("_hasta")))
    kept = [c for c in levels.columns if c != day]
    return levels.withColumn("_hasta", end).select(days.alias(day), *kept)
