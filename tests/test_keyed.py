"""Tables updated in place by ranges of their key."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from caudal.operators import portfolio
from caudal.sources.keyed import load_keyed, store_keyed, update_keyed


@pytest.fixture
def stored(spark, tmp_path):
    folder = str(tmp_path / "cuentas")
    df = spark.range(1, 500).selectExpr(
        "id", "cast(id as decimal(18,2)) saldo_actual", "concat('n', id) numero_cuenta"
    )
    store_keyed(df.unionByName(df.limit(1).withColumn("id", F.lit(None).cast("long"))), folder,
                ids=50)
    return folder


def files(folder):
    return {str(p.relative_to(folder)) for p in Path(folder).rglob("*.parquet")}


def balances(spark, folder):
    return {r["id"]: float(r["saldo_actual"]) for r in load_keyed(spark, folder).collect()}


def test_only_changed_ranges_are_rewritten(spark, stored):
    before, old = files(stored), balances(spark, stored)
    new = spark.createDataFrame([(3, 70), (7, 80), (7, 90), (320, 5), (9999, 1), (None, 4)],
                                "id long, saldo_nuevo int")
    assert portfolio.write_balances(spark, stored, new) == 3
    after = files(stored)
    touched = {f.split("/")[0] for f in before ^ after}
    assert touched == {"_rango_50=0", "_rango_50=6"}
    assert balances(spark, stored) == old | {3: 70.0, 7: 90.0, 320: 5.0}
    assert load_keyed(spark, stored).columns == ["id", "saldo_actual", "numero_cuenta"]


def test_the_same_folder_is_read_and_written(spark, stored):
    def doubled(rows, changes):
        return rows.join(changes, "id", "left_semi").unionByName(
            rows.join(changes, "id", "left_anti")
        ).withColumn("saldo_actual", (F.col("saldo_actual") * 2).cast("decimal(18,2)"))

    everything = load_keyed(spark, stored).select("id")
    assert update_keyed(spark, stored, everything, doubled) == 10
    assert {k: v for k, v in balances(spark, stored).items() if k} == {
        k: 2.0 * k for k in range(1, 500)}


def test_a_failed_write_leaves_the_old_table(spark, stored):
    before, old = files(stored), balances(spark, stored)

    def broken(rows, changes):
        bad = F.when(F.col("id") == 120, F.raise_error(F.lit("stop")).cast("decimal(18,2)"))
        return rows.withColumn("saldo_actual", F.coalesce(bad, F.col("saldo_actual") + 1))

    changes = spark.range(1, 200).select("id")
    with pytest.raises(Exception, match="stop"):
        update_keyed(spark, stored, changes, broken)
    assert balances(spark, stored) == old and files(stored) == before


def test_no_changes_write_nothing(spark, stored):
    before = files(stored)
    none = spark.createDataFrame([], "id long, saldo_nuevo int")
    assert portfolio.write_balances(spark, stored, none) == 0
    assert files(stored) == before


def test_more_ranges_than_are_named(spark, stored, monkeypatch):
    monkeypatch.setattr("caudal.sources.keyed.NAMED_RANGES", 2)
    old = balances(spark, stored)
    new = spark.range(1, 300, 40).selectExpr("id", "0 saldo_nuevo")
    assert portfolio.write_balances(spark, stored, new) == 6
    assert balances(spark, stored) == old | {k: 0.0 for k in range(1, 300, 40)}


def test_a_folder_without_ranges_is_refused(spark, tmp_path):
    folder = str(tmp_path / "plain")
    spark.range(3).write.parquet(folder)
    with pytest.raises(ValueError):
        load_keyed(spark, folder)
