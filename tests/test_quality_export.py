import datetime as dt
import re

import pytest

from caudal.operators import export, quality
from caudal.sources import tables as T
from caudal.sources.schemas import SCHEMAS, TABLES
from tests.conftest import PLAIN, dicts

D = dt.date


@pytest.fixture(scope="module")
def bank(make):
    return {name: make(name, {}) for name in TABLES}


def violations(df, name):
    return {(r["tabla"], r["columna"]): r[name] for r in dicts(df) if r[name]}


def test_a_clean_bank_has_no_violations(bank):
    assert violations(quality.dq_nulls(bank), "nulos") == {}
    assert violations(quality.dq_domains(bank), "fuera_de_dominio") == {}
    assert violations(quality.dq_unique(bank), "filas") == {}
    assert violations(quality.dq_orphans(bank), "huerfanas") == {}


def test_nulls_and_domains(bank, make):
    bad = {**bank, "clientes": make(
        "clientes", dict(id=1, genero=None), dict(id=2, genero="X", nivel_riesgo_interno="Raro"),
        nullable=True)}
    assert violations(quality.dq_nulls(bad), "nulos") == {("clientes", "genero"): 1}
    assert violations(quality.dq_domains(bad), "fuera_de_dominio") == {
        ("clientes", "genero"): 1, ("clientes", "nivel_riesgo_interno"): 1}


def test_repeated_keys_and_orphans(bank, make):
    bad = {**bank, "cuentas": make(
        "cuentas", dict(id=1), dict(id=2, cliente_id=9), dict(id=3, cliente_id=9))}
    assert violations(quality.dq_unique(bad), "filas") == {("cuentas", "numero_cuenta"): 3}
    assert violations(quality.dq_orphans(bad), "huerfanas") == {("cuentas", "cliente_id"): 2}


def test_next_ids_and_row_counts(bank, make):
    some = {**bank, "creditos": make("creditos"), "cuentas": make("cuentas", dict(id=41))}
    ids = {r["tabla"]: r["siguiente_id"] for r in dicts(quality.next_ids(some))}
    assert ids["creditos"] == 1 and ids["cuentas"] == 42 and "indicadores_macro" not in ids
    counts = {r["tabla"]: r["filas"] for r in dicts(quality.row_counts(some))}
    assert counts["creditos"] == 0 and counts["clientes"] == 1


def test_row_literals_escape_quotes_and_nulls(spark):
    df = spark.createDataFrame([("O'Neil", None, 1.5, D(2024, 1, 2))],
                               "a string, b string, c double, d date")
    assert export.row_literals(df).collect()[0][0] == "('O''Neil', NULL, 1.5, '2024-01-02')"


def test_statements_hold_every_row_in_chunks(spark):
    df = spark.range(0, 25, numPartitions=2).selectExpr("id", "concat('n', id) as n")
    statements = [r[0] for r in export.sql_literals(df, "t", chunk=5).collect()]
    sizes = [len(re.findall(r"^\(", s, re.M)) for s in statements]
    assert sum(sizes) == 25 and max(sizes) == 5 and len(statements) == 6
    assert all(s.startswith("INSERT INTO t (id, n) VALUES\n(") and s.endswith(";")
               for s in statements)
    ids = sorted(int(n) for s in statements for n in re.findall(r"\((\d+),", s))
    assert ids == list(range(25))


def test_script_export_is_text(spark, bank, tmp_path):
    export.export_sql({"cuentas": bank["cuentas"]}, str(tmp_path))
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/cuentas").collect()]
    assert lines[0].startswith("INSERT INTO cuentas (id, cliente_id")


def test_csv_keeps_every_value(spark, bank, tmp_path):
    export.export_csv(bank, str(tmp_path))
    for name, df in bank.items():
        assert T.load_csv(spark, str(tmp_path), name).collect() == df.collect()


@pytest.mark.parametrize("text", [
    'a "quoted" one', "comma, semicolon; tab\t", "line\nbreak", "line\r\nbreak", "", " outer ",
    None, "\\", '\\"', "'", "N", "null", '""', "é 😀",
])
def test_csv_keeps_every_text(spark, make, tmp_path, text):
    clients = make("clientes", dict(id=1, nombre=text), dict(id=2, nombre="x"), nullable=True)
    export.export_csv({"clientes": clients}, str(tmp_path))
    copy = T.load_csv(spark, str(tmp_path), "clientes")
    assert sorted(copy.collect(), key=lambda r: r["id"]) == clients.collect()


def test_csv_with_other_columns_is_refused(spark, make, tmp_path):
    clients = make("clientes", dict(id=1)).withColumnRenamed("nombre", "otro")
    export.export_csv({"clientes": clients}, str(tmp_path))
    with pytest.raises(Exception):
        T.load_csv(spark, str(tmp_path), "clientes").collect()


def test_append_recreate_and_load(spark, bank, tmp_path):
    folder = str(tmp_path)
    T.recreate(bank["creditos"], folder, "creditos")
    T.append(bank["creditos"], folder, "creditos")
    assert T.load(spark, folder, "creditos").count() == 2
    T.recreate(bank["creditos"], folder, "creditos", partition_by="estado")
    assert T.load(spark, folder, "creditos").count() == 1


def test_ledger_folders_by_day(spark, make, tmp_path):
    days = [dt.datetime(2024, 1, d, 23, 59) for d in (1, 2, 2, 3)]
    tx = make("transacciones", *[dict(id=n, fecha_hora=t) for n, t in enumerate(days)])
    T.save_ledger(tx, str(tmp_path))
    assert {p.name for p in (tmp_path / "transacciones").glob("fecha=*")} == {
        "fecha=2024-01-01", "fecha=2024-01-02", "fecha=2024-01-03"}
    whole = T.load_ledger(spark, str(tmp_path))
    assert sorted(whole.collect()) == sorted(tx.collect()) and whole.columns == tx.columns
    part = T.load_ledger(spark, str(tmp_path), "2024-01-02", "2024-01-02")
    assert sorted(r["id"] for r in part.collect()) == [1, 2]
    plan = part._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(fecha" in plan


def test_warehouse_tables(spark, bank):
    report = {r["tabla"]: r["filas"] for r in dicts(export.export_warehouse(bank))}
    assert report == {name: 1 for name in TABLES}
    saved = spark.table("transacciones")
    assert saved.columns == [c.upper() for c in SCHEMAS["transacciones"].names]
    assert saved.schema["FECHA_HORA"].dataType.simpleString() == "string"
    assert saved.schema["MONTO"].dataType.simpleString() == "decimal(18,2)"


def test_surrogate_ids(spark):
    df = spark.range(0, 1000, numPartitions=7).withColumnRenamed("id", "x")
    assert export.with_unique_ids(df).select("id").distinct().count() == 1000
    dense = export.with_dense_ids(df)
    assert dense.columns == ["id", "x"]
    assert sorted(r["id"] for r in dense.collect()) == list(range(1, 1001))


def test_every_declared_column_has_a_plain_value():
    for name, schema in SCHEMAS.items():
        assert set(schema.names) == set(PLAIN[name])


def test_csv_files_are_small_enough_to_be_read_by_many_tasks(spark, tmp_path):
    export.export_csv({"t": spark.range(0, 250_000, 1, 1), "u": spark.range(3)}, str(tmp_path))
    assert len(list((tmp_path / "t").glob("part-*"))) == 3
    assert spark.read.option("header", True).csv(f"{tmp_path}/t").distinct().count() == 250_000
