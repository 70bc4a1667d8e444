"""Clients, deposits, loans and loan payments."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caudal import constants as K
from caudal.functions import rules
from caudal.functions.calendar import carry_forward, maturity, year_month
from caudal.functions.numeric import (
    count_if, double, exact_mean, french_instalment, num, pct, round_half_up, share, sum_if,
    to_usd, to_ves, zero_if_null,
)
from caudal.operators.support import join_small
from caudal.sources.keyed import update_keyed

# ---- one-row figures ----------------------------------------------------------------


def client_kpis(clients: DataFrame) -> DataFrame:
    gone = count_if(F.col("estado_cliente") == "Inactivo")
    return clients.agg(
        F.count("*").alias("total_clientes"),
        gone.alias("clientes_inactivos"),
        pct(gone, F.count("*")).alias("churn_rate_pct"),
    )


def deposits_by_currency(accounts: DataFrame) -> DataFrame:
    """Balances of active accounts, one column per currency, 0 where there are none."""
    active = accounts.filter(F.col("estado_cuenta") == "Activa")
    return active.agg(
        *[sum_if(F.col("moneda") == m, F.col("saldo_actual")).alias(m) for m in K.CURRENCIES]
    )


def credit_kpis(loans: DataFrame) -> DataFrame:
    bad = rules.in_default(F.col("estado"))
    return loans.agg(
        F.count("*").alias("total_prestamos"),
        count_if(bad).alias("prestamos_default"),
        zero_if_null(F.sum("monto_aprobado_usd")).alias("monto_total_usd"),
        sum_if(bad, F.col("saldo_pendiente_usd")).alias("monto_default_usd"),
        pct(count_if(bad), F.count("*")).alias("default_rate_pct"),
    )


def dollarization(accounts: DataFrame, macro: DataFrame) -> DataFrame:
    """Share of dollar deposits in all deposits, at the latest official rate."""
    latest = macro.agg(F.max_by("tasa_bcv_usd_ves", "fecha").alias("tasa"))
    totals = deposits_by_currency(accounts).withColumn("tasa_bcv", latest.scalar())
    ves_in_usd = to_usd(F.col("VES"), F.col("tasa_bcv"))
    usd = double(F.col("USD"))
    return totals.select(
        F.col("VES").alias("depositos_ves"),
        F.col("USD").alias("depositos_usd"),
        "tasa_bcv",
        ves_in_usd.alias("depositos_ves_en_usd"),
        pct(usd, usd + ves_in_usd).alias("indice_dolarizacion_pct"),
    )


def commercial_balance(accounts: DataFrame, loans: DataFrame, macro: DataFrame) -> DataFrame:
    """Deposits against loans in dollars: all loans, and those still open."""
    lent = loans.agg(zero_if_null(F.sum("monto_aprobado_usd")).alias("x"))
    owed = loans.filter(F.col("estado").isin(*K.OPEN_LOAN)).agg(
        zero_if_null(F.sum("saldo_pendiente_usd")).alias("x")
    )
    deposits = dollarization(accounts, macro)
    return deposits.select(
        (double(F.col("depositos_usd")) + F.col("depositos_ves_en_usd"))
        .alias("depositos_totales_usd"),
        lent.scalar().alias("creditos_aprobados_usd"),
        owed.scalar().alias("creditos_abiertos_usd"),
    )


# ---- grouped figures ----------------------------------------------------------------


def _per_client(loans: DataFrame, *more: str) -> DataFrame:
    """Loans and defaults of each client.

    Counting before the join keeps the join free of skew: a client with very many loans
    reaches it as one row, and both steps use the same partitioning.
    """
    return loans.groupBy("cliente_id", *more).agg(
        F.count("*").alias("total"),
        count_if(rules.in_default(F.col("estado"))).alias("defaults"),
    )


def _with_client(loan_rows: DataFrame, clients: DataFrame, *columns: str) -> DataFrame:
    side = clients.select(F.col("id").alias("cliente_id"), *columns)
    return loan_rows.join(side, "cliente_id")


def _default_rate(grouped) -> DataFrame:
    return grouped.agg(
        F.sum("total").alias("total"), F.sum("defaults").alias("defaults")
    ).withColumn("tasa_default", pct(F.col("defaults"), F.col("total")))


def default_by_score_band(loans: DataFrame, clients: DataFrame) -> DataFrame:
    scored = _with_client(_per_client(loans), clients, "score_credito")
    banded = scored.withColumn("rango", rules.score_band(F.col("score_credito")))
    return _default_rate(banded.groupBy("rango")).orderBy(F.desc("rango"))


def default_by_activity(loans: DataFrame, clients: DataFrame) -> DataFrame:
    rows = _with_client(_per_client(loans), clients, "actividad_economica")
    return _default_rate(rows.groupBy(F.col("actividad_economica").alias("actividad")))


def portfolio_by_type_status(loans: DataFrame) -> DataFrame:
    return loans.groupBy(F.col("tipo_credito").alias("tipo"), "estado").agg(
        F.count("*").alias("cantidad"),
        zero_if_null(F.sum("saldo_pendiente_usd")).alias("saldo_usd"),
    )


def delinquency_monthly(payments: DataFrame) -> DataFrame:
    """Unpaid or late share by month; the over-90-days view stands in its own columns."""
    unpaid = count_if(F.col("estado_pago").isin(*K.UNPAID))
    serious = count_if(F.col("dias_atraso") > K.SERIOUS_LATE_DAYS)
    return (
        payments.groupBy(year_month(F.col("fecha_pago")).alias("mes"))
        .agg(
            F.count("*").alias("total_pagos"),
            unpaid.alias("impagos"),
            pct(unpaid, F.count("*")).alias("tasa_morosidad"),
            round_half_up(zero_if_null(exact_mean(F.col("dias_atraso"))), 1)
            .alias("promedio_dias_atraso"),
            serious.alias("mora_mayor_90"),
            pct(serious, F.count("*")).alias("tasa_mora_mayor_90"),
        )
        .orderBy("mes")
    )


def delinquency_vs_inflation(payments: DataFrame, macro: DataFrame) -> DataFrame:
    """Both monthly series on one axis."""
    inflation = macro.groupBy(year_month(F.col("fecha")).alias("mes")).agg(
        round_half_up(exact_mean(F.col("inflacion_mensual_pct")), 2).alias("inflacion_pct")
    )
    late = delinquency_monthly(payments).select("mes", "tasa_morosidad", "tasa_mora_mayor_90")
    return late.join(inflation, "mes").orderBy("mes")


def risk_profile(clients: DataFrame) -> DataFrame:
    return clients.groupBy("nivel_riesgo_interno").agg(F.count("*").alias("clientes"))


def inflation_delay_corr(payments: DataFrame, macro: DataFrame) -> DataFrame:
    """Correlation of inflation and days late, from exact sums of one row per payment date."""
    days = F.col("dias_atraso").cast("decimal(20,0)")
    per_date = payments.groupBy(F.col("fecha_pago").alias("fecha")).agg(
        F.count("*").alias("n"), F.sum(days).alias("y"), F.sum(days * days).alias("yy")
    )
    x = F.col("inflacion_mensual_pct")
    n = F.col("n").cast("decimal(20,0)")
    y = F.col("y").cast("decimal(20,0)")
    sums = per_date.join(macro.select("fecha", "inflacion_mensual_pct"), "fecha").agg(
        F.sum("n").alias("pagos"),
        double(F.sum(n * x)).alias("sx"),
        double(F.sum(y)).alias("sy"),
        double(F.sum(n * x * x)).alias("sxx"),
        double(F.sum("yy")).alias("syy"),
        double(F.sum(y * x)).alias("sxy"),
    )
    c = {name: F.col(name) for name in sums.columns}
    spread = F.sqrt(
        (c["pagos"] * c["sxx"] - c["sx"] * c["sx"]) * (c["pagos"] * c["syy"] - c["sy"] * c["sy"])
    )
    cross = c["pagos"] * c["sxy"] - c["sx"] * c["sy"]
    return sums.select("pagos", F.when(spread > 0, cross / spread).alias("correlacion"))


def default_volatility(loans: DataFrame, clients: DataFrame, macro: DataFrame) -> DataFrame:
    """Spread of the monthly default rate by activity, over months of falling output."""
    falling = (
        macro.groupBy(year_month(F.col("fecha")).alias("mes"))
        .agg(F.sum("variacion_pib_mensual_pct").alias("pib"))
        .filter(F.col("pib") < 0)
        .select("mes")
    )
    dated = loans.withColumn("mes", year_month(F.col("fecha_otorgamiento")))
    in_months = join_small(dated, falling, "mes", "left_semi")
    rows = _with_client(_per_client(in_months, "mes"), clients, "actividad_economica")
    monthly = (
        rows.groupBy(F.col("actividad_economica").alias("actividad"), "mes")
        .agg(F.sum("total").alias("total"), F.sum("defaults").alias("defaults"))
        .withColumn("tasa", share(F.col("defaults"), F.col("total")))
    )
    return monthly.groupBy("actividad").agg(
        F.count("*").alias("meses"), F.stddev_pop("tasa").alias("volatilidad_pct")
    )


def open_loan_balance(loans: DataFrame, macro: DataFrame) -> DataFrame:
    """Open balance per day in dollars and, at the day's official rate, in bolívares."""
    granted = (
        loans.filter(F.col("estado").isin(*K.OPEN_LOAN))
        .groupBy(F.col("fecha_otorgamiento").alias("fecha"))
        .agg(F.sum("saldo_pendiente_usd").alias("nuevo"))
    )
    # One row per day from here on, so the unpartitioned window holds calendar days only.
    upto = Window.orderBy("fecha").rowsBetween(Window.unboundedPreceding, 0)
    level = granted.select("fecha", F.sum("nuevo").over(upto).alias("total_creditos_usd"))
    daily = carry_forward(level, "fecha")
    rate = macro.select("fecha", "tasa_bcv_usd_ves")
    return daily.join(rate, "fecha").select(
        "fecha",
        "total_creditos_usd",
        to_ves(double(F.col("total_creditos_usd")), double(F.col("tasa_bcv_usd_ves")))
        .alias("total_creditos_ves"),
    )


# ---- clients and accounts -----------------------------------------------------------


def risk_tier(clients: DataFrame) -> DataFrame:
    return clients.select(
        "id",
        rules.risk_tier(F.col("score_credito"), F.col("ingresos_mensuales_usd"))
        .alias("nivel_calculado"),
        "nivel_riesgo_interno",
    )


def loan_eligible(clients: DataFrame, loans: DataFrame, day) -> DataFrame:
    """Clients who may borrow on a day: the rule holds and no loan granted by then is open."""
    day = F.lit(day).cast("date")
    fit = clients.filter(
        rules.can_borrow(
            F.col("estado_cliente"), F.col("score_credito"), F.col("fecha_registro"), day
        )
    )
    busy = (
        loans.filter(F.col("estado").isin(*K.OPEN_LOAN) & (F.col("fecha_otorgamiento") <= day))
        .select(F.col("cliente_id").alias("id")).distinct()
    )
    return fit.join(busy, "id", "left_anti").select("id", "score_credito")


def preferred_account(accounts: DataFrame) -> DataFrame:
    """Per client the account to pay a loan out to, and the active one to collect from.

    Dollars come before bolívares, then the lowest id.
    """
    usd = F.col("moneda") == "USD"
    active = F.col("estado_cuenta") == "Activa"

    def lowest(*conditions: Column) -> Column:
        return F.min(F.when(reduce(and_, conditions, F.lit(True)), F.col("id")))

    return accounts.groupBy("cliente_id").agg(
        F.coalesce(lowest(usd), lowest()).alias("cuenta_desembolso"),
        F.coalesce(lowest(usd, active), lowest(active)).alias("cuenta_cobro"),
    )


def merge_balances(accounts: DataFrame, balances: DataFrame) -> DataFrame:
    """Accounts with their balance replaced where a new one (id, saldo_nuevo) is given."""
    joined = accounts.join(balances, "id", "left")
    new = F.coalesce(F.col("saldo_nuevo"), F.col("saldo_actual")).cast("decimal(18,2)")
    return joined.withColumn("saldo_actual", new).select(*accounts.columns)


def write_balances(spark: SparkSession, folder: str, balances: DataFrame) -> int:
    """Update the stored accounts (``store_keyed``) with new balances (id, saldo_nuevo) in place.

    Of several balances of one account the greatest holds. Returns the ranges rewritten.
    """
    one = balances.groupBy("id").agg(F.max("saldo_nuevo").alias("saldo_nuevo"))
    return update_keyed(spark, folder, one, merge_balances)


def active_accounts_daily(accounts: DataFrame) -> DataFrame:
    """Active accounts open on each day by currency, from daily openings (no range join)."""
    opened = (
        accounts.filter(F.col("estado_cuenta") == "Activa")
        .groupBy("moneda", F.col("fecha_apertura").alias("fecha"))
        .agg(F.count("*").alias("abiertas"))
    )
    upto = (
        Window.partitionBy("moneda").orderBy("fecha").rowsBetween(Window.unboundedPreceding, 0)
    )
    level = opened.select("moneda", "fecha", F.sum("abiertas").over(upto).alias("cuentas_activas"))
    last = F.max("fecha").over(Window.partitionBy())  # daily rows per currency only
    return carry_forward(level.withColumn("_fin", last), "fecha", "moneda", until=F.col("_fin")).drop(
        "_fin"
    )


# ---- loans --------------------------------------------------------------------------


def instalment(loans: DataFrame) -> DataFrame:
    """Loans with their constant monthly instalment."""
    return loans.withColumn(
        "cuota_mensual",
        french_instalment(
            F.col("monto_aprobado_usd"), F.col("tasa_interes_anual"), F.col("plazo_meses")
        ),
    )


def loan_maturity(loans: DataFrame) -> DataFrame:
    return loans.select(
        "id",
        "fecha_otorgamiento",
        maturity(F.col("fecha_otorgamiento"), F.col("plazo_meses")).alias("fecha_vencimiento"),
    )


def loan_macro_context(loans: DataFrame, macro: DataFrame) -> DataFrame:
    """Macro figures of the day each loan was granted."""
    context = macro.select(
        F.col("fecha").alias("fecha_otorgamiento"),
        "inflacion_mensual_pct", "variacion_pib_mensual_pct", "tasa_bcv_usd_ves",
    )
    return join_small(loans, context, "fecha_otorgamiento").select(
        "id", "fecha_otorgamiento", *context.columns[1:]
    )


def expected_default(loans: DataFrame, clients: DataFrame, macro: DataFrame) -> DataFrame:
    dated = loans.select("id", "cliente_id", F.col("fecha_otorgamiento").alias("fecha"))
    rows = join_small(dated, macro.select("fecha", "inflacion_mensual_pct"), "fecha")
    return _with_client(rows, clients, "score_credito").select(
        "id",
        rules.default_probability(F.col("inflacion_mensual_pct"), F.col("score_credito"))
        .alias("prob_default"),
    )


def instalments_due(loans: DataFrame) -> DataFrame:
    """Due dates of every loan: the day of month it was granted on, from that day on.

    Months without that day are passed over, as many months as it takes to fill the term
    (two calendar months hold at least one such day, so twice the term always suffices).
    """
    granted, term = F.col("fecha_otorgamiento"), F.col("plazo_meses")
    day = F.dayofmonth(granted)
    every_month = F.sequence(
        granted, F.add_months(granted, term - 1), F.expr("interval 1 month")
    )
    candidates = F.transform(
        F.sequence(F.lit(0), 2 * term),
        lambda m: F.date_add(F.add_months(F.trunc(granted, "MM"), m), day - 1),
    )
    having_the_day = F.filter(candidates, lambda d: F.dayofmonth(d) == day)
    dates = F.when(day <= 28, every_month).otherwise(F.slice(having_the_day, F.lit(1), term))
    return loans.select(
        F.col("id").alias("credito_id"), F.posexplode(dates).alias("n", "fecha_cuota")
    ).select("credito_id", (F.col("n") + 1).alias("cuota_no"), "fecha_cuota")


def instalments_due_on(loans: DataFrame, day) -> DataFrame:
    """Open loans with an instalment on a day: granted by then, on the same day of month."""
    day = F.lit(day).cast("date")
    granted = F.col("fecha_otorgamiento")
    due = (granted <= day) & (F.dayofmonth(granted) == F.dayofmonth(day))
    open_loans = loans.filter(F.col("estado").isin(*K.OPEN_LOAN))
    return instalment(open_loans.filter(due)).select(
        F.col("id").alias("credito_id"), "cliente_id", "cuota_mensual"
    )


def payment_class(payments: DataFrame) -> DataFrame:
    """Payments by class and by the over-90-days mark, both taken from the days late."""
    late = F.col("dias_atraso")
    return payments.groupBy(
        rules.payment_class(late).alias("estado_pago"),
        rules.seriously_late(late).alias("mora_mayor_90"),
    ).agg(
        F.count("*").alias("pagos"),
        F.min("dias_atraso").alias("min_dias"),
        F.max("dias_atraso").alias("max_dias"),
    )


def loan_balance_path(loans: DataFrame, payments: DataFrame) -> DataFrame:
    """Straight-line balance after each paid instalment, never below zero.

    Instalments of one loan and date are counted first, which leaves at most a calendar of
    rows per loan to accumulate, and numbered again from the counts at the end.
    """
    daily = (
        payments.filter(F.col("dias_atraso") == 0)
        .groupBy("credito_id", "fecha_pago").agg(F.count("*").alias("n"))
    )
    upto = (
        Window.partitionBy("credito_id").orderBy("fecha_pago")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    terms = loans.select(
        F.col("id").alias("credito_id"), "monto_aprobado_usd", "cuotas_totales"
    )
    last, block = F.col("hasta"), 4096
    numbered = (
        daily.withColumn("hasta", F.sum("n").over(upto))
        .join(terms, "credito_id")
        # Two steps, so that a date with very many payments makes no long array.
        .withColumn("desde", F.explode(F.sequence(last - F.col("n") + 1, last, F.lit(block))))
        .withColumn(
            "cuota_no",
            F.explode(F.sequence(F.col("desde"), F.least(F.col("desde") + block - 1, last))),
        )
    )
    amount = double(F.col("monto_aprobado_usd"))
    left = amount - F.col("cuota_no") * (amount / F.col("cuotas_totales"))
    return numbered.select(
        "credito_id", "fecha_pago", "cuota_no", F.greatest(num(0), left).alias("saldo_usd")
    )


def late_surcharge(loans: DataFrame, payments: DataFrame) -> DataFrame:
    """Surcharge gathered by each loan: a share of the instalment per missed payment."""
    missed = (
        payments.filter(F.col("dias_atraso") > 0)
        .groupBy(F.col("credito_id").alias("id"))
        .agg(F.count("*").alias("cuotas_impagas"))
    )
    owed = F.col("cuotas_impagas") * num(K.SURCHARGE) * F.col("cuota_mensual")
    return (
        instalment(loans).join(missed, "id")
        .select(F.col("id").alias("credito_id"), "cuotas_impagas", owed.alias("recargo_usd"))
    )


def loan_summary(loans: DataFrame, payments: DataFrame) -> DataFrame:
    """Paid instalments, balance and state of each loan as its payments leave it.

    A paid instalment sets the balance to the straight line; each one missed after the last
    paid date adds the surcharge. Payments are first reduced to one row per loan and date,
    so a loan holds at most as many rows as the calendar has days.
    """
    daily = payments.groupBy(F.col("credito_id").alias("id"), "fecha_pago").agg(
        count_if(F.col("dias_atraso") == 0).alias("pagadas"),
        count_if(F.col("dias_atraso") > 0).alias("impagas"),
    )
    last_paid = F.max(F.when(F.col("pagadas") > 0, F.col("fecha_pago"))).over(
        Window.partitionBy("id")
    )
    later = F.col("ultimo").isNull() | (F.col("fecha_pago") > F.col("ultimo"))
    counts = (
        daily.withColumn("ultimo", last_paid)
        .groupBy("id")
        .agg(F.sum("pagadas").alias("pagadas"), sum_if(later, F.col("impagas")).alias("impagas"))
    )
    n = zero_if_null(F.col("pagadas"))
    amount = double(F.col("monto_aprobado_usd"))
    line = F.greatest(num(0), amount - n * (amount / F.col("cuotas_totales")))
    extra = zero_if_null(F.col("impagas")) * num(K.SURCHARGE) * F.col("cuota_mensual")
    done = n >= F.col("cuotas_totales")
    return instalment(loans).join(counts, "id", "left").select(
        F.col("id").alias("credito_id"),
        n.alias("cuotas_pagadas"),
        (line + extra).alias("saldo_pendiente_usd"),
        F.when(done, "Pagado").otherwise(F.col("estado")).alias("estado"),
    )
