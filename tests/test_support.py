import datetime as dt

import pytest

from caudal.functions.calendar import carry_forward
from caudal.operators import support
from caudal.operators.ledger import running_balance
from caudal.sources.adapters import Bank


def text(df):
    return df._jdf.queryExecution().toString()


def test_the_configured_folder_is_used(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert support.shared_folder(spark) == configured
    assert support.new_folder(spark, "csv").startswith(configured)
    assert configured in spark.sparkContext.getCheckpointDir()


def test_small_side_is_broadcast_and_large_side_is_not(spark, monkeypatch):
    facts = spark.range(1000).withColumnRenamed("id", "k")
    side = spark.range(10).withColumnRenamed("id", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = support.join_small(facts, side, "k")
        assert "BroadcastHashJoin" in text(small) and small.count() == 10
        monkeypatch.setattr(support, "BROADCAST_ROWS", 5)
        large = support.join_small(facts, side, "k")
        assert "BroadcastHashJoin" not in text(large) and large.count() == 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_running_totals_need_no_broadcast(spark, monkeypatch):
    b = Bank(spark, "/root/testdata/sf0.001")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    expected = key(running_balance(b.transacciones, b.cuentas))
    monkeypatch.setattr(support, "BROADCAST_ROWS", 0)
    assert key(running_balance(b.transacciones, b.cuentas, parts=20)) == expected


def test_slices_split_a_key_and_follow_the_order(spark):
    df = spark.range(1000).selectExpr("id % 3 < 2 as k", "id")
    rows = support.ordered_slices(df, ["k", "id"], 10).collect()
    assert len({r["_tramo"] for r in rows if r["k"]}) > 3
    for k in (True, False):
        part = sorted((r["_tramo"], r["id"]) for r in rows if r["k"] == k)
        assert [i for _, i in part] == sorted(i for _, i in part)


def test_levels_fill_gaps_up_to_the_next_one(spark):
    d = lambda n: dt.date(2024, 1, n)
    levels = spark.createDataFrame(
        [("a", d(1), 10), ("a", d(4), 20), ("b", d(2), 5)], "k string, fecha date, v int")
    got = sorted(tuple(r) for r in carry_forward(levels, "fecha", "k").select("k", "fecha", "v")
                 .collect())
    assert got == [("a", d(1), 10), ("a", d(2), 10), ("a", d(3), 10), ("a", d(4), 20),
                   ("b", d(2), 5)]


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        support.shared_folder(Session())
