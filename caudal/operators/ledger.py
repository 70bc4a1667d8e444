"""The transaction ledger: volumes, outages, fraud, balances and currency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caudal import constants as K
from caudal.functions import rules
from caudal.functions.calendar import carry_forward, paydays_of
from caudal.functions.numeric import (
    clamp, count_if, double, num, pct, sum_if, to_usd, to_ves, zero_if_null,
)
from caudal.functions.text import coordinates, full_name
from caudal.operators.liquidity import with_last_known
from caudal.operators.portfolio import instalment, preferred_account
from caudal.operators.running import running_totals
from caudal.operators.support import join_small


def _fraud() -> Column:
    return F.col("es_fraude") == 1


def _failed() -> Column:
    return F.col("estado") == "Fallida"


def _done() -> Column:
    return F.col("estado") == "Completada"


def _usd() -> Column:
    return F.col("monto_usd")


def _day() -> Column:
    return F.to_date("fecha_hora")


# ---- figures ------------------------------------------------------------------------


def operational_kpis(tx: DataFrame) -> DataFrame:
    return tx.agg(
        F.count("*").alias("total_transacciones"),
        count_if(_fraud()).alias("cantidad_fraudes"),
        sum_if(_fraud(), _usd()).alias("monto_fraude_usd"),
        count_if(_failed()).alias("transacciones_fallidas"),
        pct(count_if(_failed()), F.count("*"), 4).alias("tasa_falla_pct"),
    )


def tx_by_channel_status(tx: DataFrame) -> DataFrame:
    return tx.groupBy("canal", "estado").agg(
        F.count("*").alias("cantidad"), F.sum(_usd()).alias("total_usd")
    )


def fraud_by_channel(tx: DataFrame) -> DataFrame:
    return tx.groupBy("canal").agg(
        F.count("*").alias("total_txs"),
        zero_if_null(F.sum("es_fraude")).alias("fraudes"),
        sum_if(_fraud(), _usd()).alias("monto_fraude_usd"),
        pct(zero_if_null(F.sum("es_fraude")), F.count("*"), 4).alias("tasa_fraude_pct"),
    )


def _days(tx: DataFrame) -> DataFrame:
    return tx.groupBy(_day().alias("dia")).agg(
        F.count("*").alias("total_txs"),
        count_if(_failed()).alias("fallidas"),
        count_if(_done()).alias("completadas"),
        sum_if(_failed(), _usd()).alias("volumen_fallido_usd"),
    )


def _outages(days: DataFrame, threshold: float) -> DataFrame:
    return days.filter(F.col("fallidas") > F.col("total_txs") * num(threshold))


def outage_days(tx: DataFrame, threshold: float = K.OUTAGE_SHARE) -> DataFrame:
    """Days on which more than a share of the transactions failed."""
    days = _outages(_days(tx), threshold)
    rate = pct(F.col("fallidas"), F.col("total_txs")).alias("tasa_falla_pct")
    return days.select("dia", "total_txs", "fallidas", "completadas", rate).orderBy("dia")


def outage_cost(tx: DataFrame, fee: float, threshold: float = K.OUTAGE_SHARE) -> DataFrame:
    """Failed volume of each outage day and the commission lost on it."""
    days = _outages(_days(tx), threshold)
    lost = double(F.col("volumen_fallido_usd")) * num(fee)
    return days.select("dia", "fallidas", "volumen_fallido_usd", lost.alias("costo_usd"))


def fraud_by_hour(tx: DataFrame) -> DataFrame:
    legal = F.col("es_fraude") == 0

    def mean(condition):
        n = count_if(condition)
        return F.when(n > 0, double(F.sum(F.when(condition, _usd()))) / n)

    return tx.groupBy(F.hour("fecha_hora").alias("hora")).agg(
        F.count("*").alias("total_txs"),
        count_if(_fraud()).alias("fraudes"),
        mean(_fraud()).alias("monto_medio_fraude"),
        mean(legal).alias("monto_medio_legitimo"),
    )


def ledger_cube(tx: DataFrame) -> DataFrame:
    """All channel, status and day figures from one scan of the ledger.

    The ledger is first reduced to one row per channel, status and day; only those few rows
    are grouped again, once per report.
    """
    return cube_of(cube_partials(tx))


def cube_partials(tx: DataFrame) -> DataFrame:
    """Counts and sums per channel, status and day; those of several parts add up."""
    return tx.groupBy("canal", "estado", _day().alias("dia")).agg(
        F.count("*").alias("n"),
        F.sum(_usd()).alias("usd"),
        zero_if_null(F.sum("es_fraude")).alias("f"),
        sum_if(_fraud(), _usd()).alias("f_usd"),
    )


def cube_of(base: DataFrame) -> DataFrame:
    """The cube from partial figures."""
    sets = [
        (F.col("canal"), F.col("estado")), (F.col("canal"),), (F.col("dia"),), (),
    ]
    state = F.col("estado")
    cube = base.withColumn("e", state).groupingSets(
        sets, F.col("canal"), F.col("estado"), F.col("dia")
    ).agg(
        F.grouping_id().alias("g"),
        F.sum("n").alias("total_txs"),
        F.sum("usd").alias("total_usd"),
        F.sum("f").alias("fraudes"),
        F.sum("f_usd").alias("monto_fraude_usd"),
        F.sum(F.when(F.col("e") == "Fallida", F.col("n")).otherwise(0)).alias("fallidas"),
        F.sum(F.when(F.col("e") == "Completada", F.col("n")).otherwise(0)).alias("completadas"),
    )
    level = (
        F.when(F.col("g") == 1, "canal_estado").when(F.col("g") == 3, "canal")
        .when(F.col("g") == 6, "dia").otherwise("total")
    )
    return cube.withColumn("nivel", level).drop("g")


def daily_net_flow(tx: DataFrame) -> DataFrame:
    """Deposits less everything else per day, whatever the status of the row."""
    return tx.groupBy(_day().alias("fecha")).agg(
        F.sum(rules.signed_amount(F.col("tipo_transaccion"), _usd())).alias("flujo_neto_usd")
    )


# ---- fraud --------------------------------------------------------------------------


def account_owner(accounts: DataFrame, clients: DataFrame, *columns: str) -> DataFrame:
    """Client columns by account, so that the ledger needs a single join."""
    owner = clients.select(F.col("id").alias("cliente_id"), *columns)
    side = accounts.select(F.col("id").alias("cuenta_id"), "cliente_id")
    return side.join(owner, "cliente_id").drop("cliente_id")


def top_frauds(tx: DataFrame, accounts: DataFrame, clients: DataFrame, k: int = 10) -> DataFrame:
    """The k largest frauds with their clients; ties go to the lower id."""
    frauds = tx.filter(_fraud()).select(
        "id", "cuenta_id", "fecha_hora", "monto_usd", "tipo_transaccion", "canal",
        "latitud", "longitud",
    )
    holders = accounts.select(F.col("id").alias("cuenta_id"), "cliente_id")
    people = clients.select(F.col("id").alias("cliente_id"), "cedula", "nombre", "apellido")
    return (
        frauds.join(holders, "cuenta_id").join(people, "cliente_id")
        .orderBy(F.desc("monto_usd"), "id")
        .limit(k)
        .select(
            "id",
            "fecha_hora",
            "cedula",
            full_name(F.col("nombre"), F.col("apellido")).alias("cliente"),
            "monto_usd",
            F.col("tipo_transaccion").alias("tipo"),
            "canal",
            coordinates(F.col("latitud"), F.col("longitud")).alias("coords"),
        )
    )


def fraud_rule(tx: DataFrame, accounts: DataFrame, clients: DataFrame) -> DataFrame:
    """Ledger rows that meet the fraud rule; what the row alone decides comes before the join."""
    hour = F.hour("fecha_hora")
    night = tx.filter(rules.night_instant(F.col("estado"), F.col("tipo_transaccion"), hour))
    rows = night.select("id", "cuenta_id", "monto_usd")
    income = account_owner(accounts, clients, "ingresos_mensuales_usd")
    return rows.join(income, "cuenta_id").filter(
        rules.above_income_share(_usd(), F.col("ingresos_mensuales_usd"))
    )


def amount_vs_history(tx: DataFrame, parts: int | None = None) -> DataFrame:
    """Each amount against the mean of the account's earlier amounts (null for the first)."""
    rows = tx.select("id", "cuenta_id", "fecha_hora", "monto_usd")
    upto = running_totals(
        rows, "cuenta_id", ["fecha_hora", "id"], {"n": F.lit(1), "suma": _usd()}, parts
    )
    before = F.col("n") - 1
    mean = double(F.col("suma") - _usd()) / before
    mean = F.when(before > 0, mean)
    return upto.select(
        "id", "cuenta_id", "monto_usd",
        before.alias("previas"),
        mean.alias("media_previa"),
        F.when(mean != 0, double(_usd()) / mean).alias("razon"),
    )


def new_device_flag(tx: DataFrame) -> DataFrame:
    """1 on the first row of a device on an account, unless it is the account's first row.

    First rows come from map-side combined minima, and are matched by row id from then on,
    so no step holds the rows or devices of an account together.
    """
    per_device = tx.groupBy("cuenta_id", "dispositivo_id").agg(
        F.min(F.struct("fecha_hora", "id")).alias("m")
    )
    first = per_device.groupBy("cuenta_id").agg(F.min("m").alias("m")).select("m.id")
    fresh = per_device.select("m.id").join(first, "id", "left_anti").withColumn("nuevo", F.lit(1))
    known = F.col("dispositivo_id").isNotNull()
    return tx.select("id", "cuenta_id", "dispositivo_id").join(fresh, "id", "left").select(
        "id", "cuenta_id", "dispositivo_id",
        F.when(known, zero_if_null(F.col("nuevo"))).otherwise(0).alias("dispositivo_nuevo"),
    )


# ---- balances -----------------------------------------------------------------------


def _movement():
    amount = rules.signed_amount(F.col("tipo_transaccion"), F.col("monto"))
    return F.when(_done(), amount).otherwise(F.lit(0)).cast("decimal(18,2)")


def running_balance(
    tx: DataFrame, accounts: DataFrame, parts: int | None = None
) -> DataFrame:
    """Balance after each row: opening balance plus completed movements so far.

    Openings enter as rows that stand before an account's movements, so the ledger is shuffled
    once and meets no other table. Rows of unknown accounts are left out.
    """
    rows = tx.select("id", "cuenta_id", "fecha_hora", _movement().alias("mov"),
                     F.lit(0).alias("apertura"))
    openings = accounts.select(
        F.lit(None).cast(rows.schema["id"].dataType).alias("id"), F.col("id").alias("cuenta_id"),
        F.lit(None).cast(rows.schema["fecha_hora"].dataType).alias("fecha_hora"),
        F.col("saldo_actual").cast("decimal(18,2)").alias("mov"), F.lit(1).alias("apertura"),
    )
    upto = running_totals(
        rows.unionByName(openings), "cuenta_id", ["fecha_hora", "id"],
        {"saldo": F.col("mov"), "abierta": F.col("apertura")}, parts,
    )
    return upto.filter("apertura = 0 and abierta > 0").select("id", "cuenta_id", "saldo")


def closing_balances(tx: DataFrame, accounts: DataFrame) -> DataFrame:
    """Final balance (id, saldo_nuevo) of each account that has moved."""
    moved = tx.groupBy(F.col("cuenta_id").alias("id")).agg(F.sum(_movement()).alias("total"))
    return accounts.join(moved, "id").select(
        "id", (F.col("saldo_actual") + F.col("total")).alias("saldo_nuevo")
    )


def daily_deposits(tx: DataFrame, accounts: DataFrame) -> DataFrame:
    """Total balance of the active accounts per day and currency.

    Balances add up, so the day's total is the running sum of openings and movements; the
    ledger is reduced to accounts and days before it meets the accounts. Movements dated
    before an account opened count from its opening day.
    """
    active = accounts.filter(F.col("estado_cuenta") == "Activa").select(
        F.col("id").alias("cuenta_id"), "moneda", "fecha_apertura", "saldo_actual"
    )
    moves = tx.groupBy("cuenta_id", _day().alias("fecha")).agg(F.sum(_movement()).alias("x"))
    moved = moves.join(active, "cuenta_id").select(
        "moneda", F.greatest("fecha", "fecha_apertura").alias("fecha"), "x"
    )
    opened = active.select("moneda", F.col("fecha_apertura").alias("fecha"),
                           F.col("saldo_actual").alias("x"))
    changes = moved.unionByName(opened).groupBy("moneda", "fecha").agg(F.sum("x").alias("x"))
    upto = (
        Window.partitionBy("moneda").orderBy("fecha").rowsBetween(Window.unboundedPreceding, 0)
    )
    level = changes.select("moneda", "fecha", F.sum("x").over(upto).alias("total_depositos"))
    return carry_forward(level, "fecha", "moneda")


# ---- amounts ------------------------------------------------------------------------


def fx_normalize(tx: DataFrame, accounts: DataFrame) -> DataFrame:
    """Each stored amount, kept in the account's currency, in both currencies at the row's rate."""
    currency = accounts.select(F.col("id").alias("cuenta_id"), "moneda")
    amount, rate = double(F.col("monto")), double(F.col("tasa_cambio"))
    local = F.col("moneda") == "VES"
    return tx.join(currency, "cuenta_id").select(
        "id", "moneda", "monto", "tasa_cambio", "monto_usd",
        F.when(local, amount).otherwise(to_ves(amount, rate)).alias("en_ves"),
        F.when(local, to_usd(amount, rate)).otherwise(amount).alias("en_usd"),
    )


def clamped_amounts(tx: DataFrame, accounts: DataFrame) -> DataFrame:
    """Amounts held within the range of the account's currency."""
    currency = accounts.select(F.col("id").alias("cuenta_id"), "moneda")
    low, high = (
        F.when(F.col("moneda") == "USD", num(usd)).otherwise(num(ves))
        for usd, ves in zip(K.USD_AMOUNT_RANGE, K.VES_AMOUNT_RANGE)
    )
    rows = tx.select("id", "cuenta_id", "monto_usd").join(currency, "cuenta_id")
    return rows.select("id", "moneda", clamp(double(_usd()), low, high).alias("monto_acotado_usd"))


# ---- ledger rows made by the bank itself --------------------------------------------

LEDGER = (
    "cuenta_id", "tipo_transaccion", "monto", "monto_usd", "tasa_cambio", "fecha_hora",
    "canal", "estado", "codigo_error", "es_fraude", "latitud", "longitud", "dispositivo_id",
)


def _bank_rows(df: DataFrame, kind: str, channel: str, usd, currency, time: str) -> DataFrame:
    """Completed ledger rows of the bank's own system at a fixed time of day."""
    rate = F.col("tasa_cambio")
    cents = usd.cast("decimal(18,2)")
    local = F.when(currency == "USD", cents).otherwise((cents * rate).cast("decimal(18,2)"))
    stamp = F.concat(F.col("fecha").cast("string"), F.lit(f" {time}")).cast("timestamp_ntz")
    return df.select(
        "cuenta_id",
        F.lit(kind).alias("tipo_transaccion"),
        local.alias("monto"),
        cents.alias("monto_usd"),
        "tasa_cambio",
        stamp.alias("fecha_hora"),
        F.lit(channel).alias("canal"),
        F.lit("Completada").alias("estado"),
        F.lit(None).cast("string").alias("codigo_error"),
        F.lit(0).alias("es_fraude"),
        num(K.TELLER_POINT[0]).alias("latitud"),
        num(K.TELLER_POINT[1]).alias("longitud"),
        F.lit(K.SYSTEM_DEVICE).alias("dispositivo_id"),
    )


def payroll_run(
    accounts: DataFrame, clients: DataFrame, macro: DataFrame,
    salaried=K.SALARIED, retiree: str = K.RETIREE,
) -> DataFrame:
    """Salary deposits: half the income on each payday, pensions whole but not on the 30th.

    Paydays run to the last month with a rate; one without a rate takes the last known.
    """
    rates = macro.select("fecha", F.col("tasa_bcv_usd_ves").alias("tasa_cambio"))
    last_month = macro.agg(F.trunc(F.max("fecha"), "MM")).scalar()
    earners = clients.filter(F.col("actividad_economica").isin(*salaried)).select(
        F.col("id").alias("cliente_id"), "actividad_economica", "ingresos_mensuales_usd"
    )
    open_ves = accounts.filter(
        (F.col("moneda") == "VES") & (F.col("estado_cuenta") == "Activa")
    ).select(F.col("id").alias("cuenta_id"), "cliente_id", "fecha_apertura")
    # Each account lists its own months and their two paydays; no pairs are thrown away.
    first_month = F.trunc("fecha_apertura", "MM")
    months = F.sequence(
        first_month, F.greatest(first_month, last_month), F.expr("interval 1 month")
    )
    paid = (
        open_ves.join(earners, "cliente_id")
        .withColumn("mes", F.explode(months))
        .withColumn("fecha", F.explode(paydays_of(F.col("mes"))))
        .filter(F.col("fecha") >= F.col("fecha_apertura"))
    )
    retired = F.col("actividad_economica") == retiree
    rated = with_last_known(paid, rates, found="_dia_tasa").filter("_dia_tasa is not null")
    due = rated.drop("_dia_tasa").filter(~(retired & (F.dayofmonth("fecha") == 30)))
    half = (F.col("ingresos_mensuales_usd") / 2).cast("decimal(18,2)")
    salary = F.when(retired, F.col("ingresos_mensuales_usd")).otherwise(half)
    return _bank_rows(due, K.DEPOSIT, "Taquilla", salary, F.lit("VES"), "08:30:00")


def loan_payouts(loans: DataFrame, accounts: DataFrame, macro: DataFrame) -> DataFrame:
    """One deposit per loan into the client's preferred account."""
    rows = loans.select("cliente_id", F.col("fecha_otorgamiento").alias("fecha"),
                        F.col("monto_aprobado_usd").alias("usd"))
    placed = _placed(rows, accounts, macro, "cuenta_desembolso")
    return _bank_rows(placed, K.DEPOSIT, "Taquilla", F.col("usd"), F.col("moneda"), "10:00:00")


def instalment_charges(
    loans: DataFrame, payments: DataFrame, accounts: DataFrame, macro: DataFrame
) -> DataFrame:
    """One transfer per instalment paid on time, from the account it is collected from."""
    terms = instalment(loans).select(
        F.col("id").alias("credito_id"), "cliente_id", F.col("cuota_mensual").alias("usd")
    )
    paid = payments.filter(F.col("dias_atraso") == 0).select(
        "credito_id", F.col("fecha_pago").alias("fecha")
    )
    placed = _placed(paid.join(terms, "credito_id"), accounts, macro, "cuenta_cobro")
    return _bank_rows(
        placed, "Transferencia", "Banca Movil", F.col("usd"), F.col("moneda"), "09:00:00"
    )


def _placed(rows: DataFrame, accounts: DataFrame, macro: DataFrame, which: str) -> DataFrame:
    """Attach the client's account, its currency and the last rate known on the day.

    A day without a rate takes that of the last one before it; rows before the first rate are
    left out.
    """
    chosen = preferred_account(accounts).select("cliente_id", F.col(which).alias("cuenta_id"))
    currency = accounts.select(F.col("id").alias("cuenta_id"), "moneda")
    side = chosen.join(currency, "cuenta_id")
    rate = macro.select("fecha", F.col("tasa_bcv_usd_ves").alias("tasa_cambio"))
    known = with_last_known(rows.join(side, "cliente_id"), rate, found="_dia_tasa")
    return known.filter("_dia_tasa is not null").drop("_dia_tasa")


def ledger_union(*parts: DataFrame) -> DataFrame:
    """Ledger rows of several origins in one frame."""
    return reduce(lambda a, b: a.unionByName(b), [p.select(*LEDGER) for p in parts])
