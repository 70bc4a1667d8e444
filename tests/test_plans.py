"""Shape of the physical plans: no cross joins, no ledger in one task, narrow scans."""

import re

import pytest

from caudal.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
LEDGER_WINDOWS = ["amount_vs_history", "running_balance", "loan_balance_path", "loan_summary",
                  "new_device_flag"]
JOINS = ["top_frauds", "fraud_rule", "default_by_activity", "payroll_run", "daily_deposits",
         "active_accounts_daily", "fraud_features", "credit_features", "ledger_union",
         "commercial_balance", "standardized"]


def plan(spark, name):
    df = QUERIES[name].run(spark, SF)
    return df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", LEDGER_WINDOWS)
def test_windows_are_partitioned(spark, name):
    assert "SinglePartition" not in plan(spark, name)


@pytest.mark.parametrize("name", JOINS + LEDGER_WINDOWS)
def test_no_cross_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_read_only_the_columns_they_need(spark):
    schemas = re.findall(r"ReadSchema: struct<(.*)>", plan(spark, "outage_days"))
    assert [[c.split(":")[0] for c in s.split(",")] for s in schemas] == [
        ["ts", "event_type", "props"]]


def test_cube_scans_the_ledger_once(spark):
    assert len(set(re.findall(r"\((\d+)\) Scan parquet", plan(spark, "ledger_cube")))) == 1


def test_top_k_is_one_operator(spark):
    assert "TakeOrderedAndProject" in plan(spark, "top_frauds")
