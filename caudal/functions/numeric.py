"""Rates, money and distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caudal import constants as K

EARTH_KM = 6371.0


def num(value: float) -> Column:
    return F.lit(float(value))


def double(c: Column) -> Column:
    return c.cast("double")


def round_half_up(x: Column, digits: int) -> Column:
    """Round on the stored double value, ties upwards: the same in every engine.

    ``floor`` gives a whole number of 64 bits, so it is used only where it fits; from 2**52 on
    a double has no fraction to cut off.
    """
    scale = num(10.0**digits)
    shifted = double(x) * scale + num(0.5)
    return F.when(F.abs(shifted) < num(2.0**52), double(F.floor(shifted))).otherwise(shifted) / scale


def share(a: Column, b: Column) -> Column:
    """100 * a / b, and 0.0 when there is nothing to divide by."""
    return F.when(b > 0, double(a) / double(b) * num(100)).otherwise(num(0))


def pct(a: Column, b: Column, digits: int = 2) -> Column:
    return round_half_up(share(a, b), digits)


def exact_mean(x: Column) -> Column:
    """Mean of a decimal or whole-number column from its exact sum."""
    return double(F.sum(x)) / double(F.count(x))


def count_if(condition: Column) -> Column:
    """Rows that meet a condition; 0 for no rows, and null conditions do not count."""
    return F.count(F.when(condition, 1))


def sum_if(condition: Column, x: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, x)), F.lit(0))


def zero_if_null(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low, F.least(high, x))


def to_ves(usd: Column, rate: Column) -> Column:
    return usd * rate


def to_usd(ves: Column, rate: Column) -> Column:
    return double(ves) / double(rate)


def rate_spread(parallel: Column, official: Column) -> Column:
    return double(parallel) / double(official) - num(1)


def french_instalment(principal: Column, annual_pct: Column, months: Column) -> Column:
    """Constant monthly instalment at a nominal annual rate in percent."""
    monthly = double(annual_pct) / num(100) / num(12)
    return double(principal) * monthly / (num(1) - F.pow(num(1) + monthly, -double(months)))


def instalment_to_income(amount: Column, months: Column, income: Column) -> Column:
    """Flat instalment over income, with one dollar added so that no income is no error."""
    return double(amount) / double(months) / (double(income) + num(1))


def debt_to_income(amount: Column, months: Column, income: Column) -> Column:
    """Amount over the income of the whole term; null without income."""
    whole = double(income) * double(months)
    return F.when(whole != 0, double(amount) / whole)


def amount_to_income(amount: Column, income: Column) -> Column:
    return F.when(income != 0, double(amount) / double(income))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of two points given in degrees."""
    half_lat = F.sin(F.radians(lat2 - lat1) / num(2))
    half_lon = F.sin(F.radians(lon2 - lon1) / num(2))
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return num(2 * EARTH_KM) * F.asin(F.sqrt(F.least(num(1), h)))


def legal_reserve(deposits_ves: Column) -> Column:
    return double(deposits_ves) * num(K.RESERVE_SHARE)


def minimum_cash(deposits_ves: Column) -> Column:
    return double(deposits_ves) * num(K.CASH_FLOOR_SHARE)


def liquidity_ratio(cash: Column, deposits_ves: Column) -> Column:
    return double(cash) / (double(deposits_ves) + num(1))


def liquidity_gap(cash: Column, reserve: Column, rate: Column) -> Column:
    return (double(cash) - double(reserve)) / double(rate)
