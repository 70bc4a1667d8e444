"""The bank's classification rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from caudal import constants as K
from caudal.functions.numeric import double, num


def score_band(score: Column) -> Column:
    first, *rest = [(score >= floor, F.lit(label)) for floor, label in K.SCORE_BANDS]
    chain = reduce(lambda done, step: done.when(*step), rest, F.when(*first))
    return chain.otherwise(F.lit(K.LOWEST_BAND))


def risk_tier(score: Column, income: Column) -> Column:
    low = (score > 700) & (income > 1000)
    high = (score < 500) | (income < 200)
    return F.when(low, "Bajo").when(high, "Alto").otherwise("Medio")


def payment_class(days_late: Column) -> Column:
    return (
        F.when(days_late == 0, "A Tiempo")
        .when(days_late <= K.LATE_LIMIT_DAYS, "Atrasado")
        .otherwise("No Pagado")
    )


def seriously_late(days_late: Column) -> Column:
    return (days_late > K.SERIOUS_LATE_DAYS).cast("int")


def in_default(loan_state: Column) -> Column:
    return loan_state.isin(*K.DEFAULTED)


def default_target(loan_state: Column) -> Column:
    return F.when(in_default(loan_state), 1).otherwise(0)


def default_probability(inflation_pct: Column, score: Column) -> Column:
    """Expected chance of missing an instalment: base rate times inflation, plus score."""
    pressure = F.greatest(num(1), double(inflation_pct) / num(K.INFLATION_UNIT))
    weak = F.when(score < 500, num(0.20)).when(score < 600, num(0.08)).otherwise(num(0))
    return num(K.BASE_DEFAULT_PROBABILITY) * pressure + weak


def night_instant(state: Column, kind: Column, hour: Column) -> Column:
    """The part of the fraud rule that the ledger row alone decides."""
    return (state == "Completada") & kind.isin(*K.INSTANT_TYPES) & hour.between(*K.FRAUD_HOURS)


def above_income_share(amount_usd: Column, income: Column) -> Column:
    return double(amount_usd) > double(income) * num(K.FRAUD_INCOME_SHARE)


def can_borrow(client_state: Column, score: Column, registered: Column, day: Column) -> Column:
    return (client_state == "Activo") & (score > K.LOAN_MIN_SCORE) & (registered <= day)


def is_deposit(kind: Column) -> Column:
    return kind == K.DEPOSIT


def signed_amount(kind: Column, amount: Column) -> Column:
    """Deposits count up, everything else counts down."""
    return F.when(is_deposit(kind), amount).otherwise(-amount)
