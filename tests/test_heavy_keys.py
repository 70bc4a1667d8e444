"""Heavy keys: however many slices the rows are cut into, nothing may change."""

import datetime as dt
import random

import pytest

from caudal.operators import ledger, portfolio
from caudal.operators.replay import authorization_replay
from caudal.sources.adapters import Bank
from tests.conftest import dicts

START = dt.datetime(2024, 1, 1)


def ledger_rows(rng, n, accounts, spread_minutes, sizes=(1, 400)):
    rows = []
    for i in range(n):
        # Two thirds of all rows on account 1.
        account = 1 if rng.random() < 0.67 else rng.randint(2, accounts)
        kind = "Deposito Taquilla" if rng.random() < 0.35 else "Pago Movil"
        state = "Fallida" if kind == "Pago Movil" and rng.random() < 0.1 else "Completada"
        rows.append(dict(
            id=i, cuenta_id=account, tipo_transaccion=kind, estado=state,
            codigo_error="ERR_TIMEOUT" if state == "Fallida" else None,
            monto=rng.randint(*sizes) + rng.randint(0, 99) / 100,
            monto_usd=rng.randint(1, 50),
            fecha_hora=START + dt.timedelta(minutes=rng.randint(0, spread_minutes)),
        ))
    return rows


def replay_by_hand(rows, opening):
    balance, out = dict(opening), {}
    for r in sorted(rows, key=lambda r: (r["fecha_hora"], r["id"])):
        account, cents = r["cuenta_id"], round(r["monto"] * 100)
        have = balance.get(account, 0)
        state, code = "Completada", None
        if r["tipo_transaccion"] == "Deposito Taquilla":
            have += cents
        elif have < cents:
            state, code = "Rechazada", "ERR_FONDO_INSUFICIENTE"
        elif r["estado"] == "Fallida":
            state, code = "Fallida", r["codigo_error"]
        else:
            have -= cents
        balance[account] = have
        out[r["id"]] = (state, code, have)
    return out


# (.., 0, ..): account 1 has two thirds of all rows, all in one minute
@pytest.mark.parametrize("seed, minutes, parts", [(1, 60, 40), (2, 300, 12), (3, 0, 60), (4, 60, 1)])
def test_replay_equals_brute_force(make, seed, minutes, parts):
    rng = random.Random(seed)
    rows = ledger_rows(rng, 600, 6, minutes)
    accounts = [dict(id=a, saldo_actual=200) for a in range(1, 6)]  # account 6 opens with nothing
    got = authorization_replay(make("transacciones", *rows), make("cuentas", *accounts), parts=parts)
    got = {r["id"]: (r["estado"], r["codigo_error"], round(r["saldo"] * 100)) for r in dicts(got)}
    assert got == replay_by_hand(rows, {a: 20000 for a in range(1, 6)})
    assert {s for s, _, _ in got.values()} == {"Completada", "Rechazada", "Fallida"}
    assert min(balance for _, _, balance in got.values()) >= 0


def test_replay_of_an_account_that_is_always_short(make):
    rng = random.Random(9)
    rows = ledger_rows(rng, 300, 2, 30, sizes=(300, 900))
    accounts = [dict(id=a, saldo_actual=0) for a in (1, 2)]
    got = authorization_replay(make("transacciones", *rows), make("cuentas", *accounts), parts=25)
    got = {r["id"]: (r["estado"], r["codigo_error"], round(r["saldo"] * 100)) for r in dicts(got)}
    assert got == replay_by_hand(rows, {1: 0, 2: 0})


def same(plain, sliced):
    key = lambda rows: sorted(tuple(r) for r in rows)
    assert key(plain.collect()) == key(sliced.collect())


def test_running_figures_do_not_depend_on_the_slices(spark):
    b = Bank(spark, "/root/testdata/sf0.001")
    same(ledger.running_balance(b.transacciones, b.cuentas),
         ledger.running_balance(b.transacciones, b.cuentas, parts=50))
    same(ledger.amount_vs_history(b.transacciones),
         ledger.amount_vs_history(b.transacciones, parts=50))
    same(authorization_replay(b.transacciones, b.cuentas),
         authorization_replay(b.transacciones, b.cuentas, parts=60))


def test_running_balance_of_one_account_in_one_minute(make):
    rng = random.Random(5)
    rows = ledger_rows(rng, 400, 6, 0)
    got = ledger.running_balance(make("transacciones", *rows),
                                 make("cuentas", *[dict(id=a, saldo_actual=7) for a in range(1, 7)]),
                                 parts=30)
    expected, balance = {}, {}
    for r in sorted(rows, key=lambda r: r["id"]):
        cents = round(r["monto"] * 100) * (1 if r["tipo_transaccion"] == "Deposito Taquilla" else -1)
        a = r["cuenta_id"]
        balance[a] = balance.get(a, 700) + (cents if r["estado"] == "Completada" else 0)
        expected[r["id"]] = balance[a]
    assert {r["id"]: round(r["saldo"] * 100) for r in dicts(got)} == expected


def test_instalments_of_one_day_are_all_numbered(make):
    """More payments on one date than fit into one block of numbers."""
    days = [dt.date(2024, 1, 2)] * 3 + [dt.date(2024, 1, 3)] * 5000 + [dt.date(2024, 1, 4)]
    loans = make("creditos", dict(cuotas_totales=10000, monto_aprobado_usd=10000))
    paid = make("pagos_creditos", *[dict(id=n, fecha_pago=d) for n, d in enumerate(days)])
    got = sorted(tuple(r) for r in portfolio.loan_balance_path(loans, paid).collect())
    assert got == sorted((1, d, n, 10000.0 - n) for n, d in enumerate(days, 1))


def test_last_running_balance_is_the_closing_balance(spark):
    b = Bank(spark, "/root/testdata/sf0.001")
    order = {r["id"]: r["fecha_hora"] for r in b.transacciones.select("id", "fecha_hora").collect()}
    last = {}
    for r in ledger.running_balance(b.transacciones, b.cuentas).collect():
        if r["cuenta_id"] not in last or (order[r["id"]], r["id"]) > last[r["cuenta_id"]][0]:
            last[r["cuenta_id"]] = ((order[r["id"]], r["id"]), r["saldo"])
    closing = {r["id"]: r["saldo_nuevo"] for r in
               ledger.closing_balances(b.transacciones, b.cuentas).collect()}
    assert {k: v for k, (_, v) in last.items()} == closing


def test_first_device_of_an_account_is_not_new(make):
    rows = [("A", 1), ("A", 2), ("B", 3), ("A", 4), (None, 5), ("B", 6)]
    tx = make("transacciones", *[
        dict(id=n, dispositivo_id=d, fecha_hora=START + dt.timedelta(hours=n)) for d, n in rows])
    got = {r["id"]: r["dispositivo_nuevo"] for r in dicts(ledger.new_device_flag(tx))}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0}
