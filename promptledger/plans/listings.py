"""B: listings, filters, top-k."""

from __future__ import annotations

from promptledger.functions.threats import at_least
from promptledger.operators import audit as A
from promptledger.operators import catalog as K
from promptledger.operators import keys, scans
from promptledger.plans import fixtures as X
from promptledger.plans.registry import query
from promptledger.plans.scan_tables import SCANS_SQL, store, stored_alerts, stored_scans
from pyspark.sql import functions as F

_LIST = "request_id, epoch_us(event_ts) as event_ts, client_id, environment, status, model"


@query("b1_recent_requests", X.with_sql(f"select {_LIST} from audit where status = 'success' and environment = 'prod' order by event_ts desc, request_id limit 100", X.AUDIT_SQL))
def b1(spark, sf):
    rows = A.recent_requests(X.audit(spark, sf), limit=100, environment="prod", status="success")
    return rows.select("request_id", "event_ts", "client_id", "environment", "status", "model")


@query("b2_request_page", X.with_sql("""
select request_id, epoch_us(event_ts) as event_ts, client_id, user_id, environment, task, model, endpoint, status,
  round(latency_ms, 6) as latency_ms, prompt_tokens::bigint as prompt_tokens, completion_tokens::bigint as completion_tokens,
  total_tokens::bigint as total_tokens, error_code, (select count(*) from audit where client_id = 'client-3') as total_matches
from audit where client_id = 'client-3' order by event_ts desc, request_id limit 50 offset 25""", X.AUDIT_SQL))
def b2(spark, sf):
    return A.request_page(X.audit(spark, sf), limit=50, offset=25, client_id="client-3")


@query("b3_request_by_id", X.with_sql(f"select {_LIST} from audit where request_id = 'req-77'", X.AUDIT_SQL))
def b3(spark, sf):
    return A.request_by_id(X.audit(spark, sf), "req-77").select("request_id", "event_ts", "client_id", "environment", "status", "model")


_DETAIL = (
    "request_id, client_id, user_id, environment, task, model, endpoint, provider_type, stream, max_tokens, temperature, status, error_code, error_message, "
    "latency_ms, time_to_first_token_ms, prompt_tokens, completion_tokens, total_tokens, estimated_cost_usd"
).split(", ")
_DETAIL_SQL = ", ".join(
    f"round({c}, 6) as {c}" if c in ("latency_ms", "time_to_first_token_ms", "temperature", "estimated_cost_usd")
    else f"cast({c} as bigint) as {c}" if c in ("max_tokens", "prompt_tokens", "completion_tokens", "total_tokens") else c for c in _DETAIL)


@query("b3_request_detail", X.with_sql(f"select {_DETAIL_SQL}, concat('body of ', request_id) as request_body, cast(null as varchar) as response_body from audit where request_id = 'req-77'", X.AUDIT_SQL))
def b3_detail(spark, sf):
    """The whole row, with the bodies that may be stored."""
    raw = X.raw_audit(spark, sf).withColumn("request_body", F.concat(F.lit("body of "), "request_id")).withColumn("response_body", F.lit("secret"))
    return A.request_by_id(A.audit_rows(raw, store_request_body=True), "req-77").select(*_DETAIL, "request_body", "response_body")


_SCAN = ["request_id", "event_ts", "regex_threat_level", "regex_match_count", "guard_safe", "label", "is_disagreement"]
_SCAN_SQL = "request_id, event_us as event_ts, regex_threat_level, regex_match_count, guard_safe, label, is_disagreement"


@query("b4_scan_list", X.with_sql(f"""
select {_SCAN_SQL}, (select count(*) from scans where is_disagreement and threat_ord >= 2 and label is null) as total_matches from scans
where is_disagreement and threat_ord >= 2 and label is null order by event_us desc, request_id limit 50 offset 3""", SCANS_SQL))
def b4(spark, sf):
    page = scans.list_scans(stored_scans(spark, sf, store(spark, sf)), 50, 3, None, True, True, "medium")
    return page.select(*_SCAN, "total_matches")


@query("b5_threat_filter", X.with_sql(f"select {_SCAN_SQL} from scans where regex_threat_level in ('high', 'critical')", SCANS_SQL))
def b5(spark, sf):
    return stored_scans(spark, sf, store(spark, sf)).filter(at_least(F.col("regex_threat_level"), "HIGH")).select(*_SCAN)


@query("b6_scan_by_id", X.with_sql(f"select {_SCAN_SQL} from scans where request_id = 'conv-3'", SCANS_SQL))
def b6(spark, sf):
    return scans.scan_by_id(stored_scans(spark, sf, store(spark, sf)), "conv-3").select(*_SCAN)


@query("b8_key_inventory", X.with_sql("""
select key_id, key_prefix, name, client_id, environment, created_us as created_at, is_active, rate_limit_rpm::bigint as rate_limit_rpm, description
from stored_keys""", X.KEYS_SQL))
def b8(spark, sf):
    rows = keys.inventory(X.stored_keys(spark, sf))
    return rows.select("key_id", "key_prefix", "name", "client_id", "environment", "created_at", "is_active", "rate_limit_rpm", "description")


@query("b9_retention_report", X.with_sql("""
select count(*) filter (where event_ts < cutoff) as deleted_count, count(*) filter (where event_ts >= cutoff) as kept_count
from audit, (select max(event_ts) - interval 10 day as cutoff from audit) c""", X.AUDIT_SQL))
def b9_report(spark, sf):
    return A.purge_report(X.audit(spark, sf), days=10, as_of=X.newest(spark, sf))


@query("b9_retained_rows", X.with_sql("""
select request_id, epoch_us(event_ts) as event_ts from audit where event_ts >= (select max(event_ts) - interval 10 day from audit)""", X.AUDIT_SQL))
def b9_rows(spark, sf):
    return A.retained(X.audit(spark, sf), days=10, as_of=X.newest(spark, sf)).select("request_id", "event_ts")


def _sources(spark, sf):
    rows = X.audit(spark, sf).withColumn("source_ip", F.concat(F.lit("10.0.0."), F.substring_index("user_id", "-", -1)))
    trusted = rows.filter("environment = 'dev'").select("source_ip")
    return rows, trusted


_SOURCES_SQL = f"""{X.AUDIT_SQL},
sourced as (select *, concat('10.0.0.', split_part(user_id, '-', 2)) as source_ip from audit),
trusted as (select distinct source_ip from sourced where environment = 'dev')"""


@query("b10_trusted_sources", X.with_sql("select request_id, source_ip from sourced where source_ip not in (select source_ip from trusted)", _SOURCES_SQL))
def b10(spark, sf):
    return scans.skip_trusted(*_sources(spark, sf)).select("request_id", "source_ip")


@query("b10_trusted_report", X.with_sql("""
select count(*) filter (where source_ip not in (select source_ip from trusted)) as analyzed_count,
  count(*) filter (where source_ip in (select source_ip from trusted)) as skipped_count from sourced""", _SOURCES_SQL))
def b10_report(spark, sf):
    return scans.trusted_report(*_sources(spark, sf))


@query("b11_recent_alerts", X.with_sql("""
select request_id, event_us as event_ts, client_id, alert_type, severity, description from alerts
order by event_us desc, request_id, alert_type limit 40""", SCANS_SQL))
def b11(spark, sf):
    return scans.recent_alerts(stored_alerts(spark, store(spark, sf)), 40)


@query("b12_recent_results", X.with_sql(f"""
select {_SCAN_SQL} from scans where guard_safe is not null and not guard_skipped and (regex_threat_level <> 'none') <> (not guard_safe)
order by event_us desc, request_id limit 20""", SCANS_SQL))
def b12(spark, sf):
    return scans.recent_results(stored_scans(spark, sf, store(spark, sf)), 20, guard_only=True, disagreements_only=True).select(*_SCAN)


@query("b13_catalog_search", X.with_sql("select name, endpoint, family from catalog where name glob 'llama3.[0-9]:*'", X.CATALOG_SQL))
def b13(spark, sf):
    return K.find_model(X.catalog(spark, sf), "llama3.[0-9]:*").select("name", "endpoint", "family")


@query("b14_enabled_endpoints", X.with_sql("""
select e.ord::bigint as ord, e.name, e.type, count(a.request_id) as request_count from endpoints e left join audit a on a.endpoint = e.name
where e.enabled group by all""", X.AUDIT_SQL, X.ENDPOINTS_SQL))
def b14(spark, sf):
    used = X.audit(spark, sf).groupBy("endpoint").agg(F.count("*").alias("request_count"))
    rows = K.enabled(X.endpoints(spark)).join(used.withColumnRenamed("endpoint", "name"), "name", "left")
    return rows.select("ord", "name", "type", F.coalesce("request_count", F.lit(0)).alias("request_count"))
