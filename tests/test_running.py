"""Running sums over sorted slices, against plain folds."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from caudal.operators import support
from caudal.operators.ledger import amount_vs_history, running_balance
from caudal.operators.running import running_totals
from caudal.sources.adapters import Bank

SCHEMA = "k string, t int, id long, x decimal(18,2), n int"


def rows_of(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None])
        x = Decimal(rng.randint(-10**17, 10**17)).scaleb(-2) if i % 2 else None
        out.append((key, rng.choice([None, *range(4)]), i, x, rng.choice([None, 1, -5])))
    rng.shuffle(out)
    return out


def folded(rows):
    sums, out = {}, {}
    for k, t, i, x, n in sorted(rows, key=lambda r: (r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        a, b = sums.get(k, (Decimal(0), 0))
        sums[k] = (a + (x or 0), b + (n or 0))
        out[i] = sums[k]
    return out


@pytest.mark.parametrize("parts, batch", [(None, 10_000), (9, 10_000), (9, 7), (300, 50)])
def test_equal_to_a_fold(spark, parts, batch):
    rows = rows_of(1, 1200)
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = running_totals(df, "k", ["t", "id"], {"s": F.col("x"), "m": F.col("n")}, parts)
        assert got.columns == [*df.columns, "s", "m"]
        assert {r["id"]: (r["s"], r["m"]) for r in got.collect()} == folded(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert running_totals(df.filter("id < 0"), "k", ["id"], {"s": F.col("x")}).count() == 0


def test_more_slices_than_may_be_broadcast(spark, monkeypatch):
    monkeypatch.setattr(support, "BROADCAST_ROWS", 0)
    rows = rows_of(2, 600)
    df = spark.createDataFrame(rows, SCHEMA)
    got = running_totals(df, "k", ["t", "id"], {"s": F.col("x"), "m": F.col("n")}, 20)
    assert {r["id"]: (r["s"], r["m"]) for r in got.collect()} == folded(rows)


def test_sums_beyond_64_bits_are_exact(spark):
    big = Decimal(10**18 - 1).scaleb(-2)
    df = spark.range(50).select(F.lit(1).alias("k"), "id", F.lit(big).cast("decimal(18,2)").alias("x"))
    got = running_totals(df, "k", ["id"], {"s": F.col("x")}, 4)
    assert {r["id"]: r["s"] for r in got.collect()} == {i: big * (i + 1) for i in range(50)}
    wide = df.withColumn("x", F.col("x").cast("decimal(20,2)"))
    with pytest.raises(ValueError):
        running_totals(wide, "k", ["id"], {"s": F.col("x")})


@pytest.mark.parametrize("query", [
    lambda b: running_balance(b.transacciones, b.cuentas),
    lambda b: amount_vs_history(b.transacciones),
])
def test_stored_slices_are_not_shuffled_again(spark, query):
    plan = query(Bank(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning" not in plan and "SinglePartition" not in plan
    assert "SortMergeJoin" not in plan and "Window" not in plan


def test_rows_of_unknown_accounts_have_no_balance(spark, make):
    accounts = make("cuentas", {"id": 1, "saldo_actual": 100}, {"id": 2, "saldo_actual": 7})
    tx = make("transacciones", {"id": 1, "cuenta_id": 1, "tipo_transaccion": "Retiro ATM", "monto": 30},
              {"id": 2, "cuenta_id": 3, "monto": 10})
    got = {r["id"]: float(r["saldo"]) for r in running_balance(tx, accounts).collect()}
    assert got == {1: 70.0}
