"""Filters and columns reach the Parquet scan."""

from datetime import datetime

import pytest

from promptledger.operators import audit
from promptledger.plans import QUERIES
from promptledger.plans import fixtures as X
from promptledger.session import scratch_path


def test_period_filter_and_columns_reach_the_scan(spark):
    path = scratch_path(spark, "audit-plan")
    audit.append_audit(X.audit(spark, "/root/testdata/sf0.001"), path)
    stored = spark.read.parquet(path)
    plan = audit.usage_by(stored, "model", hours=24, as_of=datetime(2024, 1, 20))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(event_ts), GreaterThanOrEqual(event_ts" in plan
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert "error_message" not in schema and "user_id" not in schema


def test_retention_drops_whole_days_unread(spark):
    path = scratch_path(spark, "audit-days")
    audit.append_audit(X.audit(spark, "/root/testdata/sf0.001"), path)
    stored = spark.read.parquet(path)
    plan = audit.retained(stored, 5, datetime(2024, 1, 30))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


@pytest.mark.parametrize("name", ["c1_period_stats", "c2_requests_by_endpoint", "c3_top_models", "c4_model_usage", "c5_endpoint_usage", "b9_retained_rows"])
def test_period_queries_push_their_filter_and_scan_once(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan and plan.count("FileScan parquet") == (2 if name == "c2_requests_by_endpoint" else 1)
