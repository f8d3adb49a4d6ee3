"""A1, A2, A18 and C: audit rows, statistics, rollups, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptledger.functions.requests import local_capabilities
from promptledger.operators import audit as A
from promptledger.operators import budget as B
from promptledger.operators import catalog as K
from promptledger.operators import health as H
from promptledger.operators import metrics as M
from promptledger.operators import scan_store, scans
from promptledger.plans import fixtures as X
from promptledger.plans.registry import query
from promptledger.plans.scan_tables import PII_EVENTS_SQL, SCANS_SQL, store, stored_alerts, stored_scans


@query("a1_audit_append", X.with_sql("""
select request_id, epoch_us(event_ts) as event_ts, client_id, model, endpoint, status, error_message,
  prompt_tokens::bigint as prompt_tokens, completion_tokens::bigint as completion_tokens, total_tokens::bigint as total_tokens,
  round(tokens_per_second, 6) as tokens_per_second, event_date::varchar as event_date from audit""", X.AUDIT_SQL))
def a1(spark, sf):
    return X.audit(spark, sf).select(
        "request_id", "event_ts", "client_id", "model", "endpoint", "status", "error_message", "prompt_tokens",
        "completion_tokens", "total_tokens", "tokens_per_second", "event_date",
    )


@query("a2_body_privacy", "select concat('conv-', cast(conv_id as varchar), '-', cast(turn as varchar)) as request_id, text as request_body, null::varchar as response_body from conversations")
def a2(spark, sf):
    rows = X._table(spark, sf, "conversations").selectExpr(
        "concat('conv-', cast(conv_id as string), '-', cast(turn as string)) as request_id",
        "text as request_body", "text as response_body",
    )
    return A.keep_bodies(rows, store_request_body=True, store_response_body=False)


_COUNTED = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@query("a18_table_counts", " union all ".join(f"select '{t}' as table_name, count(*) as row_count from {t}" for t in _COUNTED))
def a18(spark, sf):
    return A.table_counts({t: X._table(spark, sf, t) for t in _COUNTED})


_SINCE = "event_ts >= (select max(event_ts) - interval {} hour from audit)"
_MEASURES = """count(*) as request_count, count(*) filter (where status = 'success') as success_count,
  count(*) filter (where status <> 'success') as error_count, sum(total_tokens)::bigint as total_tokens, round(avg(latency_ms), 2) as avg_latency_ms"""


@query("c1_period_stats", X.with_sql(f"""
select count(*) as total_requests, count(*) filter (where status = 'success') as success_count,
  count(*) filter (where status <> 'success') as error_count,
  round(count(*) filter (where status = 'success') * 100.0::double / count(*), 2) as success_rate,
  sum(prompt_tokens)::bigint as prompt_tokens, sum(completion_tokens)::bigint as completion_tokens, sum(total_tokens)::bigint as total_tokens,
  round(avg(latency_ms), 2) as avg_latency_ms, round(min(latency_ms), 2) as min_latency_ms, round(max(latency_ms), 2) as max_latency_ms,
  round(sum(estimated_cost_usd), 4) as total_cost_usd
from audit where {_SINCE.format(168)}""", X.AUDIT_SQL))
def c1(spark, sf):
    return A.period_stats(X.audit(spark, sf), hours=168, as_of=X.newest(spark, sf))


@query("c2_requests_by_endpoint", X.with_sql(f"""
select endpoint, count(*) as request_count, round(count(*) * 100.0::double / sum(count(*)) over (), 6) as share_pct
from audit where {_SINCE.format(24)} group by endpoint""", X.AUDIT_SQL))
def c2(spark, sf):
    return A.requests_by_endpoint(X.audit(spark, sf), as_of=X.newest(spark, sf))


@query("c3_top_models", X.with_sql(f"select model, count(*) as request_count from audit where {_SINCE.format(24)} group by model order by 2 desc, 1 limit 10", X.AUDIT_SQL))
def c3(spark, sf):
    return A.top_models(X.audit(spark, sf), as_of=X.newest(spark, sf))


@query("c4_model_usage", X.with_sql(f"select model, {_MEASURES} from audit where {_SINCE.format(720)} group by model", X.AUDIT_SQL))
def c4(spark, sf):
    return A.usage_by(X.audit(spark, sf), "model", hours=720, as_of=X.newest(spark, sf))


@query("c5_endpoint_usage", X.with_sql(f"select endpoint, {_MEASURES} from audit where {_SINCE.format(720)} group by endpoint", X.AUDIT_SQL))
def c5(spark, sf):
    return A.usage_by(X.audit(spark, sf), "endpoint", hours=720, as_of=X.newest(spark, sf))


_ROLLUP_SQL = """rollup_daily as (
  select event_date as usage_date, client_id, endpoint, model, count(*) as request_count,
    count(*) filter (where status = 'success') as success_count, sum(total_tokens)::bigint as total_tokens,
    coalesce(sum(estimated_cost_usd), 0) as total_cost_usd, avg(latency_ms) as avg_latency_ms
  from audit group by all)"""


@query("c6_daily_rollup", X.with_sql("""
select usage_date::varchar as usage_date, client_id, endpoint, model, request_count, success_count, total_tokens,
  round(total_cost_usd, 6) as total_cost_usd, round(avg_latency_ms, 6) as avg_latency_ms from rollup_daily""", X.AUDIT_SQL, _ROLLUP_SQL))
def c6(spark, sf):
    return A.daily_rollup(X.audit(spark, sf))


_FULL = """select event_date::varchar as usage_date, {keys}, count(*) as request_count,
  count(*) filter (where status = 'success') as success_count, count(*) filter (where status <> 'success') as error_count,
  count(*) filter (where stream) as stream_count, sum(prompt_tokens)::bigint as total_prompt_tokens,
  sum(completion_tokens)::bigint as total_completion_tokens, sum(total_tokens)::bigint as total_tokens,
  round(coalesce(sum(estimated_cost_usd), 0), 6) as total_cost_usd, round(avg(latency_ms), 6) as avg_latency_ms,
  round(min(latency_ms), 6) as min_latency_ms, round(max(latency_ms), 6) as max_latency_ms,
  round(avg(time_to_first_token_ms), 6) as avg_ttft_ms, round(avg(tokens_per_second), 6) as avg_tokens_per_second,
  round(quantile_cont(latency_ms, 0.5), 6) as p50_latency_ms, round(quantile_cont(latency_ms, 0.95), 6) as p95_latency_ms,
  round(quantile_cont(latency_ms, 0.99), 6) as p99_latency_ms from audit group by all"""


@query("c7_full_rollup", X.with_sql(_FULL.format(keys="client_id, user_id, environment, endpoint, model"), X.AUDIT_SQL))
def c7(spark, sf):
    return A.full_daily_rollup(X.audit(spark, sf))


@query("c7_rollup_by_model", X.with_sql(_FULL.format(keys="model"), X.AUDIT_SQL))
def c7_model(spark, sf):
    return A.full_daily_rollup(X.audit(spark, sf), keys=("usage_date", "model"))


@query("c8_daily_usage", X.with_sql("""
select usage_date::varchar as usage_date, sum(request_count)::bigint as request_count, sum(success_count)::bigint as success_count,
  sum(total_tokens)::bigint as total_tokens, round(sum(total_cost_usd), 6) as total_cost_usd
from rollup_daily where client_id = 'client-4' and usage_date >= (select max(usage_date) - interval 14 day from rollup_daily)
group by usage_date""", X.AUDIT_SQL, _ROLLUP_SQL))
def c8(spark, sf):
    return A.daily_usage(A.daily_rollup(X.audit(spark, sf)), days=14, client_id="client-4")


@query("c9_pii_stats", X.with_sql("""
select count(*) as total_detections, count(*) filter (where was_scrubbed) as scrubbed_count,
  count(*) filter (where not was_scrubbed) as flagged_only_count, count(distinct request_id) as unique_requests,
  count(distinct value_hash) as unique_values from pii_events
where event_us >= (select max(event_us) - 3600000000 from pii_events)""", PII_EVENTS_SQL))
def c9(spark, sf):
    return scans.pii_stats(scan_store.pii_events(spark, store(spark, sf)), hours=1)


@query("c9_pii_by_type", X.with_sql("select pii_type, count(*) as detections from pii_events where event_us >= (select max(event_us) - 86400000000 from pii_events) group by 1", PII_EVENTS_SQL))
def c9_type(spark, sf):
    return scans.pii_by_type(scan_store.pii_events(spark, store(spark, sf)))


@query("c10_label_stats", X.with_sql("""
select count(*) as total_scans, count(label) as labeled, count(*) - count(label) as unlabeled,
  count(*) filter (where label = 'safe') as safe, count(*) filter (where label = 'unsafe') as unsafe,
  count(*) filter (where is_disagreement) as disagreements,
  count(*) filter (where is_disagreement and label is null) as unlabeled_disagreements,
  round(count(label) * 100.0::double / count(*), 1) as label_progress_pct from scans""", SCANS_SQL))
def c10(spark, sf):
    return scans.label_stats(stored_scans(spark, sf, store(spark, sf)))


@query("c11_run_stats", X.with_sql("""
select count(*) as requests_analyzed, count(guard_safe) as guard_scans, count(*) filter (where guard_skipped) as guard_skipped,
  count(*) filter (where not guard_skipped and not guard_safe) as guard_unsafe, (select count(*) from alerts) as alerts_generated,
  (select count(*) from requests where client_id = 'client-1') as requests_allowlisted from scans""", SCANS_SQL))
def c11(spark, sf):
    skipped = X.requests(spark, sf).filter("client_id = 'client-1'")
    path = store(spark, sf)
    return scans.run_stats(stored_scans(spark, sf, path), stored_alerts(spark, path), skipped)


@query("c12_alerts_by_severity", X.with_sql("select severity, count(*) as alert_count from alerts group by 1", SCANS_SQL))
def c12(spark, sf):
    return scans.alerts_by_severity(stored_alerts(spark, store(spark, sf)))


@query("c13_counters", X.with_sql("""
select endpoint as provider, replace(model, ':', '_') as model, task, status, count(*) as requests_total,
  sum(prompt_tokens)::bigint as tokens_prompt_total, sum(completion_tokens)::bigint as tokens_completion_total, count(error_code) as errors_total
from audit group by all""", X.AUDIT_SQL))
def c13(spark, sf):
    return M.counters(X.audit(spark, sf))


@query("c13_error_counters", X.with_sql("select endpoint as provider, error_code as error_type, count(*) as errors_total from audit where error_code is not null group by all", X.AUDIT_SQL))
def c13_errors(spark, sf):
    return M.error_counters(X.audit(spark, sf))


def _histogram_sql(value: str, labels: str, bounds) -> str:
    values = ", ".join(f"('{b}', {float(b)})" for b in bounds) + ", ('+Inf', 1e300)"
    return X.with_sql(
        f"""select {labels}, le, count(*) filter (where {value} <= bound) as cumulative_count, count(*) as observation_count,
  round(sum({value}), 6) as observation_sum from labelled, (values {values}) b(le, bound) where {value} is not null group by {labels}, le""",
        X.AUDIT_SQL, "labelled as (select endpoint as provider, replace(model, ':', '_') as model, task, latency_ms, time_to_first_token_ms, tokens_per_second from audit)",
    )


@query("c14_latency_histogram", _histogram_sql("latency_ms", "provider, model, task", M.LATENCY_BOUNDS))
def c14(spark, sf):
    return M.histogram(M.with_labels(X.audit(spark, sf)), ["provider", "model", "task"], "latency_ms", M.LATENCY_BOUNDS)


@query("c14_ttft_histogram", _histogram_sql("time_to_first_token_ms", "provider, model", M.TTFT_BOUNDS))
def c14_ttft(spark, sf):
    return M.histogram(M.with_labels(X.audit(spark, sf)), ["provider", "model"], "time_to_first_token_ms", M.TTFT_BOUNDS)


@query("c14_speed_histogram", _histogram_sql("tokens_per_second", "provider, model", M.TOKENS_PER_SECOND_BOUNDS))
def c14_speed(spark, sf):
    return M.histogram(M.with_labels(X.audit(spark, sf)), ["provider", "model"], "tokens_per_second", M.TOKENS_PER_SECOND_BOUNDS)


def _spans(spark, sf):
    # Latencies stretched to minutes, so that requests of the sparse log overlap.
    return X.audit(spark, sf).select(
        "endpoint", F.col("event_ts").alias("end_ts"),
        A.start_ts(F.col("event_ts"), F.col("latency_ms") * 10_000).alias("start_ts"),
    )


_SPANS_SQL = f"""{X.AUDIT_SQL},
moves as (
  select endpoint, epoch_us(event_ts) as moment, -1 as delta from audit
  union all
  select endpoint, epoch_us(event_ts) - cast(round(coalesce(latency_ms, 0) * 10000 * 1000) as bigint), 1 from audit),
net as (select endpoint, moment, sum(delta) as delta from moves group by all),
flight as (select endpoint, moment, cast(sum(delta) over (partition by endpoint order by moment) as bigint) as in_flight from net)"""


@query("c15_concurrency", X.with_sql("select endpoint, moment, in_flight from flight", _SPANS_SQL))
def c15(spark, sf):
    return M.concurrency(_spans(spark, sf))


@query("c15_peak_concurrency", X.with_sql("select endpoint, max(in_flight) as peak_in_flight from flight group by 1", _SPANS_SQL))
def c15_peak(spark, sf):
    return M.peak_concurrency(_spans(spark, sf))


@query("c16_catalog_summary", X.with_sql("""
select e.name as endpoint, e.type, e.ord::bigint as ord, coalesce(h.healthy, false) as healthy,
  coalesce((select string_agg(name, ',' order by name) from catalog c where c.endpoint = e.name), '') as model_list,
  (select count(*) from catalog c where c.endpoint = e.name) as model_count,
  (select count(*) from catalog) as total_models, (select count(*) from endpoints where enabled) as total_endpoints
from endpoints e left join health h on h.provider = e.name where e.enabled""", X.CATALOG_SQL, X.ENDPOINTS_SQL, X.HEALTH_SQL))
def c16(spark, sf):
    out = K.summary(X.endpoints(spark), X.catalog(spark, sf), H.current_health(X.checks(spark, sf)))
    return out.select(
        "endpoint", "type", "ord", "healthy", F.array_join("models", ",").alias("model_list"), "model_count",
        "total_models", "total_endpoints",
    )


@query("c17_fleet_health", X.with_sql("""
select count(*) as providers_configured, count(*) filter (where h.healthy) as providers_healthy,
  case when count(*) filter (where h.healthy) > 0 then 'healthy' else 'degraded' end as status
from endpoints e left join health h on h.provider = e.name""", X.ENDPOINTS_SQL, X.HEALTH_SQL))
def c17(spark, sf):
    return K.fleet_health(X.endpoints(spark), H.current_health(X.checks(spark, sf)))


CAPABILITIES_SQL = f"""{X.CATALOG_SQL},
caps as (
  select endpoint, unnest(case when name like '%embed%' or name like '%nomic%' then ['embeddings'] else ['chat', 'completion', 'streaming'] end) as capability
  from catalog),
capabilities as (select endpoint, string_agg(distinct capability, ',' order by capability) as capabilities from caps group by 1)"""


def capabilities(spark, sf):
    rows = X.catalog(spark, sf).select("endpoint", local_capabilities(F.col("name")).alias("capabilities"))
    return K.capability_union(rows)


@query("c18_capabilities", X.with_sql("select * from capabilities", CAPABILITIES_SQL))
def c18(spark, sf):
    return capabilities(spark, sf).select("endpoint", F.array_join("capabilities", ",").alias("capabilities"))


@query("c19_error_breakdown", X.with_sql("""
select endpoint as provider, error_code, case error_code when 'no_provider' then 'dispatch' when 'token_limit_exceeded' then 'policy' else 'provider' end as category,
  count(*) as error_count from audit where error_code is not null group by all""", X.AUDIT_SQL))
def c19(spark, sf):
    return M.error_breakdown(X.audit(spark, sf))


def charged(spark, sf):
    rows = X.audit(spark, sf)
    tiers = B.resolve_tiers(rows, X.assignments(spark), X.tiers(spark))
    return B.charges(B.with_tiers(rows, tiers).withColumn("key", F.col("client_id")).withColumn("tokens", F.col("total_tokens")))


@query("c20_usage_by_key", X.with_sql("""
select key, sum(tokens_used)::bigint as tokens_used, sum(request_count)::bigint as request_count,
  string_agg(concat(tier, '=', tokens_used), ',' order by tier) as tier_usage, 1000000::bigint as daily_limit,
  greatest(0, 1000000 - sum(tokens_used))::bigint as tokens_remaining
from (select key, tier, sum(weighted_tokens)::bigint as tokens_used, count(*) as request_count from charged group by all) group by key""", X.CHARGES_SQL))
def c20(spark, sf):
    out = B.usage_by_key(charged(spark, sf))
    return out.withColumn(
        "tier_usage",
        F.array_join(F.transform(F.map_entries("tier_usage"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","),
    )
