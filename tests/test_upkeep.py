"""Cube appends, keys in one shuffle, numbered statements, last known rates."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from caudal.operators import export, ledger, liquidity
from caudal.operators.cube import append_to_cube, kept_cube
from caudal.operators.keys import key_usage, offending_keys
from caudal.sources.adapters import Bank

D = dt.date


def plain(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def moment(day, hour=12):
    return dt.datetime(2024, 1, day, hour)


def test_two_appends_equal_the_cube_from_scratch(spark, make, tmp_path):
    rows = [dict(id=i, fecha_hora=moment(1 + i % 5), monto_usd=i, es_fraude=int(i % 7 == 0),
                 estado=("Completada", "Fallida")[i % 2], canal=("ATM", "Web")[i % 3 % 2])
            for i in range(1, 60)]
    first, late = make("transacciones", *rows[:40]), make("transacciones", *rows[40:])
    folder = str(tmp_path / "cubo")
    assert append_to_cube(spark, folder, first) == 5
    assert append_to_cube(spark, folder, late) == 5
    whole = ledger.ledger_cube(make("transacciones", *rows))
    cube = kept_cube(spark, folder, first)
    assert cube.columns == whole.columns
    assert plain(cube) == plain(whole)


def test_late_rows_replace_only_their_days(spark, make, tmp_path):
    folder = tmp_path / "cubo"
    files = lambda: {p.relative_to(folder) for p in folder.rglob("*.parquet")}
    append_to_cube(spark, str(folder), make(
        "transacciones", *[dict(id=i, fecha_hora=moment(i)) for i in range(1, 6)]))
    before = files()
    late = make("transacciones", dict(id=9, fecha_hora=moment(2, 1)), dict(id=10, fecha_hora=moment(8)))
    assert append_to_cube(spark, str(folder), late) == 2
    changed = {p.parts[0] for p in before ^ files()}
    assert changed == {"dia=2024-01-02", "dia=2024-01-08"}
    days = {r["dia"]: r["total_txs"] for r in
            kept_cube(spark, str(folder), late).filter("nivel = 'dia'").collect()}
    assert days[D(2024, 1, 2)] == 2 and sum(days.values()) == 7


def test_all_keys_meet_in_one_shuffle(spark):
    plan = key_usage(Bank(spark, "/root/testdata/sf0.001").tables)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(espacio") == 1 and "Join" not in text.replace(
        "BroadcastHashJoin", "")


def test_offending_values_are_listed(make):
    tables = {
        "clientes": make("clientes", {"id": 1, "cedula": "V-1"}, {"id": 2, "cedula": "V-1"}),
        "cuentas": make("cuentas", {"id": 1, "cliente_id": 1, "numero_cuenta": "a"},
                        {"id": 1, "cliente_id": 7, "numero_cuenta": "b"},
                        {"id": 2, "cliente_id": 7, "numero_cuenta": "c"}),
    }
    assert plain(offending_keys(tables)) == [
        ("huerfana", "cuentas", "cliente_id", "7", "2"),
        ("repetida", "clientes", "cedula", "V-1", "2"), ("repetida", "cuentas", "id", "1", "2")]


@pytest.mark.parametrize("parts", [None, 5])
def test_statements_are_numbered_without_gaps(make, parts):
    tables = {
        "cuentas": make("cuentas", *[{"id": i, "numero_cuenta": f"n'{i}"} for i in range(1, 26)]),
        "indicadores_macro": make("indicadores_macro", *[{"fecha": D(2024, 1, i)} for i in range(1, 9)]),
    }
    got = export.insert_statements(tables, chunk=4, parts=parts).collect()
    by = {t: sorted((r["numero"], r["filas"]) for r in got if r["tabla"] == t) for t in tables}
    assert by["cuentas"] == [(k, 4) for k in range(6)] + [(6, 1)]
    assert by["indicadores_macro"] == [(0, 4), (1, 4)]
    first = next(r["sentencia"] for r in got if (r["tabla"], r["numero"]) == ("cuentas", 0))
    assert first.startswith("INSERT INTO cuentas (id, cliente_id,") and first.endswith(");")
    assert [line.split(",")[0] for line in first.split("\n")[1:]] == ["(1", "(2", "(3", "(4"]
    assert "'n''1'" in first


@pytest.mark.parametrize("parts", [None, 5])
def test_statements_of_repeated_keys_stand_by_text_without_leaving_spark(make, parts):
    rows = [{"id": None if i % 3 else 7, "numero_cuenta": f"n{i % 20:02}"} for i in range(60)]
    tables = {"cuentas": make("cuentas", *rows, nullable=True), "clientes": make("clientes")}
    made = export.insert_statements(tables, chunk=7, parts=parts)
    assert "MapInArrow" not in made._jdf.queryExecution().toString()
    got = sorted(made.collect(), key=lambda r: r["numero"])
    assert [(r["tabla"], r["filas"]) for r in got] == [("cuentas", 7)] * 8 + [("cuentas", 4)]
    lines = [x.rstrip(",;") for r in got for x in r["sentencia"].split("\n")[1:]]
    assert lines == sorted(lines, key=lambda x: (x.startswith("(7,"), x))


def test_rows_take_the_last_rate_up_to_their_day(spark):
    series = spark.createDataFrame([(D(2024, 1, 2), 10), (D(2024, 1, 5), 20)], "fecha date, tasa int")
    rows = spark.createDataFrame([(k, D(2024, 1, d) if d else None) for k, d in
                                  enumerate([1, 2, 4, 5, 9, None, 9])], "k int, fecha date")
    got = {r["k"]: (r["tasa"], r["fecha_tasa"] and r["fecha_tasa"].day)
           for r in liquidity.with_last_known(rows, series).collect()}
    assert got == {0: (None, None), 1: (10, 2), 2: (10, 2), 3: (20, 5), 4: (20, 5),
                   5: (None, None), 6: (20, 5)}


def test_tables_of_a_database_get_their_declared_types(spark):
    from caudal.sources.schemas import SCHEMAS
    from caudal.sources.tables import as_declared

    raw = spark.createDataFrame(
        [("2024-01-02", "36.5", 40.25, 3.0, 1.0, 30, "10", "x")],
        "FECHA string, TASA_BCV_USD_VES string, tasa_paralela_usd_ves double, "
        "inflacion_mensual_pct double, variacion_pib_mensual_pct double, "
        "tasa_activa_ves_anual int, tasa_pasiva_ves_anual string, extra string")
    got = as_declared(raw, "indicadores_macro")
    assert [(f.name, f.dataType) for f in got.schema] == [
        (f.name, f.dataType) for f in SCHEMAS["indicadores_macro"]]
    row = got.first()
    assert row["fecha"] == D(2024, 1, 2) and float(row["tasa_bcv_usd_ves"]) == 36.5
    with pytest.raises(ValueError, match="tasa_bcv_usd_ves"):
        as_declared(raw.drop("TASA_BCV_USD_VES"), "indicadores_macro")


def test_payroll_pays_on_days_without_a_rate(spark, make):
    accounts = make("cuentas", {"id": 1, "moneda": "VES", "fecha_apertura": D(2024, 1, 1)})
    clients = make("clientes", {"id": 1, "actividad_economica": "Empleado Privado"})
    macro = make("indicadores_macro", {"fecha": D(2024, 1, 2), "tasa_bcv_usd_ves": 10},
                 {"fecha": D(2024, 1, 20), "tasa_bcv_usd_ves": 20},
                 {"fecha": D(2024, 1, 31), "tasa_bcv_usd_ves": 30})
    paid = ledger.payroll_run(accounts, clients, macro).select(
        F.dayofmonth("fecha_hora").alias("d"), "tasa_cambio").collect()
    assert sorted((r["d"], float(r["tasa_cambio"])) for r in paid) == [(15, 10.0), (30, 20.0)]
