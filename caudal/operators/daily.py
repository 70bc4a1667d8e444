"""The daily liquidity table, composed from the ledger, the accounts, the loans and the rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caudal.functions.numeric import double, round_half_up, to_ves, zero_if_null
from caudal.operators.ledger import daily_deposits, daily_net_flow
from caudal.operators.liquidity import cash_rollforward
from caudal.operators.portfolio import open_loan_balance

ENTITY = "banco"


def daily_flows(
    tx: DataFrame, accounts: DataFrame, loans: DataFrame, macro: DataFrame
) -> DataFrame:
    """Per day with a rate: deposits by currency, open loans and net flow, as levels of that day.

    Days run from the first to the last day with deposits. Every input is reduced to days before
    they meet, so the window without a key holds calendar days only.
    """
    deposits = daily_deposits(tx, accounts)
    wide = deposits.groupBy("fecha").agg(
        *[F.max(F.when(F.col("moneda") == c, F.col("total_depositos"))).alias(c)
          for c in ("VES", "USD")]
    )
    ends = deposits.agg(F.min("fecha").alias("a"), F.max("fecha").alias("z"))
    first, last = (ends.select(c).scalar() for c in ("a", "z"))
    owed = open_loan_balance(loans, macro).select("fecha", "total_creditos_usd")
    days = (
        macro.select("fecha", "tasa_bcv_usd_ves")
        .join(wide, "fecha", "full").join(owed, "fecha", "full")
        .join(daily_net_flow(tx), "fecha", "left")
    )
    upto = Window.orderBy("fecha").rowsBetween(Window.unboundedPreceding, 0)
    level = lambda c: zero_if_null(F.last(c, ignorenulls=True).over(upto))
    levels = days.select(
        F.lit(ENTITY).alias("entidad"), "fecha", "tasa_bcv_usd_ves",
        zero_if_null(F.col("flujo_neto_usd")).alias("flujo_neto_usd"),
        level("VES").alias("total_depositos_ves"), level("USD").alias("total_depositos_usd"),
        level("total_creditos_usd").alias("total_creditos_usd"),
    )
    return levels.filter(
        F.col("tasa_bcv_usd_ves").isNotNull() & F.col("fecha").between(first, last)
    )


def daily_liquidity(
    tx: DataFrame, accounts: DataFrame, loans: DataFrame, macro: DataFrame
) -> DataFrame:
    """One row per day in the shape of ``resumen_liquidez_diario``."""
    flows = daily_flows(tx, accounts, loans, macro)
    cash = cash_rollforward(flows).drop("entidad")
    owed = double(F.col("total_creditos_usd"))
    digits = {"tasa_liquidez": 4}
    columns = {
        "total_depositos_ves": F.col("total_depositos_ves"),
        "total_depositos_usd": F.col("total_depositos_usd"),
        "total_creditos_ves": to_ves(owed, double(F.col("tasa_bcv_usd_ves"))),
        "total_creditos_usd": owed,
        **{c: F.col(c) for c in ("disponible_caja_ves", "encaje_legal_bcv_ves", "tasa_liquidez",
                                 "brecha_liquidez_usd")},
    }
    return flows.join(cash, "fecha").select(
        "fecha",
        *[round_half_up(x, digits.get(name, 2)).alias(name) for name, x in columns.items()],
    )
