import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from caudal.operators import documents, ledger, liquidity, portfolio
from tests.conftest import dicts

D = dt.date


def test_empty_tables_give_one_row_of_zeros(make):
    clients, accounts = make("clientes"), make("cuentas")
    loans, tx = make("creditos"), make("transacciones")
    assert dicts(portfolio.client_kpis(clients)) == [
        dict(total_clientes=0, clientes_inactivos=0, churn_rate_pct=0.0)]
    assert dicts(portfolio.deposits_by_currency(accounts)) == [dict(VES=0, USD=0)]
    assert set(dicts(portfolio.credit_kpis(loans))[0].values()) == {0}
    assert set(dicts(ledger.operational_kpis(tx))[0].values()) == {0}
    doc = documents.kpi_document(clients, accounts, loans, tx).collect()[0][0]
    assert json.loads(doc)["operativo"]["tasa_falla_pct"] == 0.0


def test_null_fraud_flag_counts_in_total_only(make):
    tx = make("transacciones", dict(es_fraude=None))
    row = dicts(ledger.operational_kpis(tx))[0]
    assert (row["total_transacciones"], row["cantidad_fraudes"]) == (1, 0)
    assert dicts(ledger.fraud_by_channel(tx))[0]["fraudes"] == 0


def test_deposits_skip_accounts_that_are_not_active(make):
    accounts = make("cuentas", dict(id=1), dict(id=2, estado_cuenta="Bloqueada"),
                    dict(id=3, moneda="USD", saldo_actual=7))
    assert [float(v) for v in dicts(portfolio.deposits_by_currency(accounts))[0].values()] == [
        100.0, 7.0]


@pytest.mark.parametrize("failed, listed", [(3, 0), (4, 1)])
def test_outage_edge(make, failed, listed):
    rows = [dict(id=n, estado="Fallida" if n < failed else "Completada") for n in range(20)]
    tx = make("transacciones", *rows)
    assert ledger.outage_days(tx).count() == listed
    assert ledger.outage_cost(tx, 0.5).count() == listed


def test_top_frauds_ties_take_the_lowest_ids(make):
    tx = make("transacciones", *[dict(id=n, es_fraude=1) for n in range(11, 0, -1)])
    got = dicts(ledger.top_frauds(tx, make("cuentas", {}), make("clientes", {})))
    assert [r["id"] for r in got] == list(range(1, 11))
    assert got[0]["cliente"] == "Ana Rivas Silva"
    assert got[0]["coords"] == "10.5, -66.9"


def test_instalments_skip_short_months(make):
    loans = make("creditos", dict(fecha_otorgamiento=D(2024, 1, 31), plazo_meses=12),
                 dict(id=2, fecha_otorgamiento=D(2024, 1, 28), plazo_meses=3),
                 dict(id=3, fecha_otorgamiento=D(2023, 1, 29), plazo_meses=3))
    due = {}
    for r in sorted(dicts(portfolio.instalments_due(loans)), key=lambda r: r["cuota_no"]):
        due.setdefault(r["credito_id"], []).append(r["fecha_cuota"])
    assert len(due[1]) == 12
    assert due[1][:3] == [D(2024, 1, 31), D(2024, 3, 31), D(2024, 5, 31)]
    assert due[2] == [D(2024, 1, 28), D(2024, 2, 28), D(2024, 3, 28)]
    assert due[3] == [D(2023, 1, 29), D(2023, 3, 29), D(2023, 4, 29)]


def test_instalments_due_on_a_day(make):
    loans = make(
        "creditos", dict(id=1), dict(id=2, estado="Vencido"), dict(id=3, estado="En Litigio"),
        dict(id=4, estado="Pagado"), dict(id=5, fecha_otorgamiento=D(2024, 1, 11)),
        dict(id=6, fecha_otorgamiento=D(2024, 3, 10)))
    due = portfolio.instalments_due_on(loans, "2024-02-10")
    assert sorted(r["credito_id"] for r in due.collect()) == [1, 2]


def test_loan_summary(make):
    loans = make("creditos", dict(id=1), dict(id=2, plazo_meses=1, cuotas_totales=1),
                 dict(id=3))
    payments = make(
        "pagos_creditos",
        dict(credito_id=1, fecha_pago=D(2024, 1, 1), dias_atraso=20),  # before the paid one
        dict(credito_id=1, fecha_pago=D(2024, 2, 1)),
        dict(credito_id=1, fecha_pago=D(2024, 3, 1), dias_atraso=20),
        dict(credito_id=2),
    )
    got = {r["credito_id"]: r for r in dicts(portfolio.loan_summary(loans, payments))}
    assert got[1]["cuotas_pagadas"] == 1
    assert got[1]["saldo_pendiente_usd"] == pytest.approx(1100 + 0.05 * 120.5545, abs=1e-3)
    assert (got[2]["estado"], got[2]["saldo_pendiente_usd"]) == ("Pagado", 0.0)
    assert (got[3]["cuotas_pagadas"], got[3]["saldo_pendiente_usd"]) == (0, 1200.0)


def test_preferred_account(make):
    accounts = make(
        "cuentas", dict(id=1), dict(id=2, moneda="USD", estado_cuenta="Bloqueada"),
        dict(id=3, cliente_id=2, estado_cuenta="Cerrada"),
    )
    got = {r["cliente_id"]: r for r in dicts(portfolio.preferred_account(accounts))}
    assert (got[1]["cuenta_desembolso"], got[1]["cuenta_cobro"]) == (2, 1)
    assert (got[2]["cuenta_desembolso"], got[2]["cuenta_cobro"]) == (3, None)


def test_eligible_clients(make):
    clients = make(
        "clientes", dict(id=1), dict(id=2, score_credito=580), dict(id=3, estado_cliente="Inactivo"),
        dict(id=4, fecha_registro=D(2024, 2, 1)), dict(id=5), dict(id=6),
    )
    loans = make("creditos", dict(cliente_id=5, estado="Vencido"),
                 dict(id=2, cliente_id=6, estado="En Litigio"))
    got = portfolio.loan_eligible(clients, loans, "2024-01-15")
    assert sorted(r["id"] for r in got.collect()) == [1, 6]


def test_merge_balances_keeps_accounts_without_a_new_one(spark, make):
    accounts = make("cuentas", dict(id=1), dict(id=2))
    new = spark.createDataFrame([(2, 55.0)], "id long, saldo_nuevo double")
    got = {r["id"]: float(r["saldo_actual"]) for r in
           dicts(portfolio.merge_balances(accounts, new))}
    assert got == {1: 100.0, 2: 55.0}


def test_payroll_rules(make):
    accounts = make("cuentas", dict(id=1), dict(id=2, cliente_id=2), dict(id=3, cliente_id=3),
                    dict(id=4, moneda="USD"))
    clients = make("clientes", dict(id=1), dict(id=2, actividad_economica="Jubilado"),
                   dict(id=3, actividad_economica="Desempleado"))
    macro = make("indicadores_macro", *[dict(fecha=D(2024, 1, d)) for d in (5, 15, 16, 30)],
                 dict(fecha=D(2024, 2, 28)))
    rows = dicts(ledger.payroll_run(accounts, clients, macro))
    got = sorted((r["cuenta_id"], r["fecha_hora"].day, float(r["monto_usd"]), float(r["monto"]))
                 for r in rows)
    # 15 February has no rate of its own and is paid at the last known one
    assert got == [(1, 15, 250.0, 2500.0), (1, 15, 250.0, 2500.0), (1, 28, 250.0, 2500.0),
                   (1, 30, 250.0, 2500.0),
                   (2, 15, 500.0, 5000.0), (2, 15, 500.0, 5000.0), (2, 28, 500.0, 5000.0)]


def test_cube_agrees_with_each_report(spark):
    from caudal.sources.adapters import Bank

    tx = Bank(spark, "/root/testdata/sf0.001").transacciones
    cube = ledger.ledger_cube(tx).persist()

    def level(name, *columns):
        return sorted(tuple(r) for r in cube.filter(F.col("nivel") == name)
                      .select(*columns).collect())

    direct = ledger.tx_by_channel_status(tx).select("canal", "estado", "cantidad", "total_usd")
    assert level("canal_estado", "canal", "estado", "total_txs", "total_usd") == sorted(
        tuple(r) for r in direct.collect())
    frauds = ledger.fraud_by_channel(tx).select("canal", "total_txs", "fraudes", "monto_fraude_usd")
    assert level("canal", "canal", "total_txs", "fraudes", "monto_fraude_usd") == sorted(
        tuple(r) for r in frauds.collect())
    whole = ledger.operational_kpis(tx).select("total_transacciones", "transacciones_fallidas")
    assert level("total", "total_txs", "fallidas") == [tuple(whole.collect()[0])]
    cube.unpersist()


def test_documents_hold_the_reports(spark):
    from caudal.sources.adapters import Bank

    b = Bank(spark, "/root/testdata/sf0.001")
    doc = json.loads(documents.operational_document(b.transacciones, b.cuentas, b.clientes)
                     .collect()[0][0])
    assert set(doc) == {"canales", "fraudes_canal", "caidas_sistema", "listado_fraudes"}
    top = dicts(ledger.top_frauds(b.transacciones, b.cuentas, b.clientes))
    assert [r["monto_usd"] for r in doc["listado_fraudes"]] == [float(r["monto_usd"]) for r in top]
    assert set(doc["listado_fraudes"][0]) == {
        "fecha_hora", "cedula", "cliente", "monto_usd", "tipo", "canal", "coords"}
    outages = dicts(ledger.outage_days(b.transacciones))
    assert [r["dia"] for r in doc["caidas_sistema"]] == [str(r["dia"]) for r in outages]
    assert [r["tasa_falla_pct"] for r in doc["caidas_sistema"]] == [
        r["tasa_falla_pct"] for r in outages]
    credit = json.loads(documents.credit_document(b.creditos, b.clientes, b.pagos_creditos)
                        .collect()[0][0])
    months = dicts(portfolio.delinquency_monthly(b.pagos_creditos))
    assert [r["mes"] for r in credit["evolucion_morosidad"]] == [r["mes"] for r in months]
    assert set(credit["evolucion_morosidad"][0]) == {
        "mes", "total_pagos", "impagos", "tasa_morosidad", "promedio_dias_atraso"}
    bands = [r["rango"] for r in credit["scores"]]
    assert bands == sorted(bands, reverse=True)
    assert "total_prestamos" in credit["actividad_economica"][0]
    liquid = json.loads(documents.liquidity_document(
        b.resumen_liquidez_diario, b.operaciones_tesoreria).collect()[0][0])
    assert len(liquid["evolucion"]) == liquidity.liquidity_weekly(b.resumen_liquidez_diario).count()
    macro = json.loads(documents.macro_document(b.indicadores_macro).collect()[0][0])
    assert macro == sorted(macro, key=lambda r: r["mes"])
