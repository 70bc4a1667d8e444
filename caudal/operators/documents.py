"""The five dashboard answers as nested JSON, one row each.

Lists hold finished report rows: channels, days, months or bands, never ledger rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal import constants as K
from caudal.functions.numeric import num, pct
from caudal.operators import ledger as L
from caudal.operators import liquidity as Q
from caudal.operators import portfolio as P


LEVELS = ("depositos_ves", "depositos_usd", "disponible_ves", "encaje_ves")


def _one(df: DataFrame) -> Column:
    """The only row of a report as one value."""
    return df.select(F.struct("*")).scalar()


def _many(df: DataFrame, *order: str) -> Column:
    """All rows of a small report as a list, in the order of the named columns."""
    columns = [*order, *[c for c in df.columns if c not in order]]
    rows = df.select(F.struct(*columns).alias("fila"))
    return rows.agg(F.array_sort(F.collect_list("fila"))).scalar()


def _document(some: DataFrame, **parts: Column) -> DataFrame:
    row = some.sparkSession.range(1)
    fields = [value.alias(name) for name, value in parts.items()]
    return row.select(F.to_json(F.struct(*fields)).alias("documento"))


def kpi_document(
    clients: DataFrame, accounts: DataFrame, loans: DataFrame, tx: DataFrame
) -> DataFrame:
    churn = P.client_kpis(clients).select(
        F.col("total_clientes").alias("total"), "churn_rate_pct"
    )
    credit = P.credit_kpis(loans).drop("prestamos_default")
    return _document(
        clients,
        clientes=_one(churn),
        depositos=_one(P.deposits_by_currency(accounts)),
        creditos=_one(credit),
        operativo=_one(L.operational_kpis(tx)),
    )


def macro_document(macro: DataFrame) -> DataFrame:
    """A plain list of months."""
    months = _many(Q.macro_monthly(macro), "mes")
    return macro.sparkSession.range(1).select(F.to_json(months).alias("documento"))


def credit_document(loans: DataFrame, clients: DataFrame, payments: DataFrame) -> DataFrame:
    return _document(
        loans,
        scores=F.reverse(_many(P.default_by_score_band(loans, clients), "rango")),
        cartera_tipo=_many(P.portfolio_by_type_status(loans), "tipo", "estado"),
        evolucion_morosidad=_many(
            P.delinquency_monthly(payments).drop("mora_mayor_90", "tasa_mora_mayor_90"), "mes"
        ),
        actividad_economica=_many(
            P.default_by_activity(loans, clients).withColumnRenamed("total", "total_prestamos"),
            "actividad",
        ),
    )


def operational_document(
    tx: DataFrame, accounts: DataFrame, clients: DataFrame
) -> DataFrame:
    """Channel, fraud and outage lists from one scan of the ledger, frauds from another."""
    cube = L.ledger_cube(tx)
    total = F.col("total_txs")
    failed = F.col("fallidas")

    def listed(level: str, name: str, *fields: Column, also: Column | None = None) -> Column:
        here = F.col("nivel") == level
        here = here if also is None else here & also
        return F.array_sort(F.collect_list(F.when(here, F.struct(*fields)))).alias(name)

    lists = cube.agg(
        listed("canal_estado", "canales", F.col("canal"), F.col("estado"),
               total.alias("cantidad"), F.col("total_usd")),
        listed("canal", "fraudes_canal", F.col("canal"), total, F.col("fraudes"),
               F.col("monto_fraude_usd"), pct(F.col("fraudes"), total, 4).alias("tasa_fraude_pct")),
        listed("dia", "caidas_sistema", F.col("dia"), total, failed,
               pct(failed, total).alias("tasa_falla_pct"),
               also=failed > total * num(K.OUTAGE_SHARE)),
    )
    frauds = L.top_frauds(tx, accounts, clients).withColumns(
        {
            "orden": -F.col("monto_usd"),
            "fecha_hora": F.date_format("fecha_hora", "yyyy-MM-dd HH:mm:ss"),
        }
    )
    listing = F.transform(F.col("frauds"), lambda row: row.dropFields("orden", "id"))
    return lists.withColumn("frauds", _many(frauds, "orden", "id")).select(
        F.to_json(F.struct(*lists.columns, listing.alias("listado_fraudes"))).alias("documento")
    )


def liquidity_document(daily: DataFrame, ops: DataFrame) -> DataFrame:
    weekly = Q.liquidity_weekly(daily).select(
        "fecha",
        # Plain digits in the text, where a large double would be written with an exponent.
        *[F.col(c).cast("decimal(22,2)").alias(c) for c in LEVELS],
        "tasa_liquidez",
    )
    return _document(
        daily,
        evolucion=_many(weekly, "fecha"),
        tesoreria=_many(Q.treasury_by_operation(ops), "operacion"),
        flujo_mensual=_many(Q.treasury_monthly_flow(ops), "mes"),
    )
