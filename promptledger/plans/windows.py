"""E: windows, ledgers, replay, health histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptledger.operators import audit as A
from promptledger.operators import budget as B
from promptledger.operators import health as H
from promptledger.operators import policy as P
from promptledger.operators.ratelimit import RateLimits, demand, replay_limits
from promptledger.plans import fixtures as X
from promptledger.plans.aggregates import charged
from promptledger.plans.joins import AUTH_SQL, authenticated, task_policies
from promptledger.plans.registry import query

# Limits low enough for a sparse log to hit them.
LIMITS = RateLimits(burst=2, per_minute=3, per_hour=4)
DAILY_LIMIT = 40_000


def limited_requests(spark, sf):
    return X.audit(spark, sf).select(F.col("client_id").alias("key"), "request_id", F.col("event_ts").alias("start_ts"))


_FRAME = "count(*) over (partition by client_id order by event_ts range between interval '{}' second preceding and current row)"


@query("e1_demand_windows", X.with_sql(f"""
select client_id as key, request_id, epoch_us(event_ts) as start_ts, burst_demand, minute_demand, hour_demand,
  greatest(0, 2 - burst_demand)::bigint as burst_remaining, greatest(0, 3 - minute_demand)::bigint as minute_remaining,
  greatest(0, 4 - hour_demand)::bigint as hour_remaining
from (select *, {_FRAME.format('9.999999')} as burst_demand, {_FRAME.format('59.999999')} as minute_demand,
  {_FRAME.format('3599.999999')} as hour_demand from audit) x""", X.AUDIT_SQL))
def e1(spark, sf):
    return demand(limited_requests(spark, sf), LIMITS)


def _limiter_walk(name: str, turns: str) -> str:
    """One request after the other per key (turns: key, n, request_id, us, rpm); state is the accepted times."""
    return f"""{name} as (
  select key, n, request_id, us, [us] as accepted, cast(null as varchar) as limit_hit, cast(null as bigint) as oldest, 0 as burst_count, 0 as minute_count, 0 as hour_count
  from {turns} where n = 1
  union all
  select key, n, request_id, us, case when hit is null then list_append(hours, us) else hours end, hit,
    case hit when 'burst' then bursts[1] + 10000000 when 'minute' then minutes[1] + 60000000 when 'hour' then hours[1] + 3600000000 end,
    len(bursts), len(minutes), len(hours)
  from (select *, case when len(bursts) >= 2 then 'burst' when len(minutes) >= rpm then 'minute' when len(hours) >= 4 then 'hour' end as hit
    from (select t.*, list_filter(w.accepted, lambda a: t.us - a < 10000000) as bursts, list_filter(w.accepted, lambda a: t.us - a < 60000000) as minutes,
        list_filter(w.accepted, lambda a: t.us - a < 3600000000) as hours
      from {name} w join {turns} t on t.key = w.key and t.n = w.n + 1) x) y)"""


LIMITER_SQL = f"""recursive {X.AUDIT_SQL},
turns as (
  select client_id as key, request_id, epoch_us(event_ts) as us, 3 as rpm, row_number() over (partition by client_id order by event_ts, request_id) as n from audit),
{_limiter_walk('walk', 'turns')}"""


@query("e2_limiter_replay", X.with_sql("""
select key, request_id, us as start_ts, limit_hit is null as allowed, limit_hit, round(greatest(0.1::double, (oldest - us) / 1000000.0), 6) as retry_after,
  burst_count::bigint as burst_count, minute_count::bigint as minute_count, hour_count::bigint as hour_count
from (select * from walk where limit_hit is not null) z
union all
select key, request_id, us, true, null, null, burst_count, minute_count, hour_count from walk where limit_hit is null""", LIMITER_SQL))
def e2(spark, sf):
    return replay_limits(limited_requests(spark, sf), LIMITS)


@query("e3_weighted_ledger", X.with_sql("""
select request_id, key, usage_day::varchar as usage_day, tier, weighted_tokens,
  cast(sum(weighted_tokens) over w as bigint) as running_tokens, count(*) over w as running_requests from charged
window w as (partition by key, usage_day order by event_ts, request_id rows unbounded preceding)""", X.CHARGES_SQL))
def e3(spark, sf):
    return B.ledger(charged(spark, sf)).select(
        "request_id", "key", "usage_day", "tier", "weighted_tokens", "running_tokens", "running_requests"
    )


@query("e3_ledger_by_tier", X.with_sql("select key, usage_day::varchar as usage_day, tier, sum(weighted_tokens)::bigint as weighted_tokens, count(*) as request_count from charged group by all", X.CHARGES_SQL))
def e3_tier(spark, sf):
    return B.ledger_by_tier(charged(spark, sf))


def budget_requests(spark, sf):
    """Requests that last a few minutes but start on the day they end, with an estimate that varies."""
    rows = X.audit(spark, sf)
    tiers = B.resolve_tiers(rows, X.assignments(spark), X.tiers(spark))
    return B.with_tiers(rows, tiers).select(
        "request_id", F.col("client_id").alias("key"), "tier", "tier_daily_limit", "cost_multiplier",
        F.col("total_tokens").alias("tokens"),
        (F.col("event_id") % 7 * 100).cast("int").alias("estimated_tokens"),
        F.greatest(A.start_ts(F.col("event_ts"), F.col("latency_ms") * 1000), F.date_trunc("day", "event_ts")).alias("start_ts"),
        F.col("event_ts").alias("end_ts"),
    )


def _budget_walk(limit: int) -> str:
    """One check or charge of a day after the other, from ``asked``; state is the use per client, that of
    the capped tier, and the denied requests whose end is still to come."""
    return f"""moves as (
  select *, at_us // 86400000000 as day, row_number() over (partition by at_us // 86400000000 order by at_us, request_id, kind) as n
  from (select *, start_us as at_us, 0 as kind from asked union all select *, end_us, 1 from asked) x),
budget_walk as (
  select distinct 0::bigint as n, day, list_resize([0::bigint], 10, 0::bigint) as used, 0::bigint as tier_used, []::varchar[] as denied,
    null::varchar as request_id, 0 as kind, null::varchar as budget_type from moves
  union all
  select n, day, case when kind = 1 and not is_denied then list_transform(used, lambda u, i: case when i = slot then u + cost else u end) else used end,
    case when kind = 1 and not is_denied and cap > 0 then tier_used + raw else tier_used end,
    case when kind = 0 and verdict is not null then list_append(denied, request_id) when kind = 1 and is_denied then list_filter(denied, lambda d: d <> request_id) else denied end,
    request_id, kind, verdict
  from (select *, kind = 1 and list_contains(denied, request_id) as is_denied,
      case when kind = 0 then case when used[slot] + weighted_estimate > {limit} then 'daily_key_limit'
        when cap > 0 and tier_used + estimate > cap then concat('daily_tier_limit:', tier) end end as verdict
    from (select m.*, w.used, w.tier_used, w.denied from budget_walk w join moves m on m.day = w.day and m.n = w.n + 1) y) z)"""


def _start_us(factor: int) -> str:
    begin = f"epoch_us(a.event_ts) - cast(round(coalesce(a.latency_ms, 0) * {factor} * 1000) as bigint)"
    return f"greatest({begin}, epoch_us(a.event_ts) // 86400000000 * 86400000000)"


_BUDGET_SQL = f"""recursive {X.AUDIT_SQL}, {X.TIERS_SQL},
asked as (
  select a.request_id, cast(substr(a.client_id, 8) as int) + 1 as slot, r.tier, coalesce(r.tier_daily_limit, 0) as cap,
    cast(trunc(a.total_tokens * r.cost_multiplier) as bigint) as cost, a.total_tokens as raw, event_id % 7 * 100 as estimate,
    cast(trunc(event_id % 7 * 100 * r.cost_multiplier) as bigint) as weighted_estimate, epoch_us(a.event_ts) as end_us, {_start_us(1000)} as start_us
  from audit a join resolved r on r.model = a.model),
{_budget_walk(DAILY_LIMIT)}"""


@query("e4_budget_replay", X.with_sql("""
select w.request_id, concat('client-', a.slot - 1) as key, a.tier, a.start_us as start_ts, w.budget_type is null as admitted, w.budget_type,
  w.used[a.slot] as key_used, case when a.cap > 0 then w.tier_used end as tier_used, a.weighted_estimate,
  case when w.budget_type is null then a.cost else 0 end as charged_tokens
from budget_walk w join asked a using (request_id) where w.kind = 0 and w.n > 0""", _BUDGET_SQL))
def e4(spark, sf):
    return B.replay_admissions(budget_requests(spark, sf), DAILY_LIMIT)


@query("e5_budget_state", X.with_sql("""
select key, usage_day::varchar as usage_day, tokens_used, request_count, daily_limit, greatest(0, daily_limit - tokens_used)::bigint as tokens_remaining,
  round(used_pct, 6) as used_pct, case when used_pct > 90 then 'red' when used_pct > 70 then 'yellow' else 'green' end as band,
  epoch_us(cast(usage_day as timestamp) + interval 1 day) as resets_at
from (select key, usage_day, sum(weighted_tokens)::bigint as tokens_used, count(*) as request_count, 40000::bigint as daily_limit,
  sum(weighted_tokens)::double / 40000 * 100 as used_pct from charged group by all) x""", X.CHARGES_SQL))
def e5(spark, sf):
    return B.budget_state(charged(spark, sf), DAILY_LIMIT)


@query("e5_budget_view", X.with_sql("""
select key, usage_day::varchar as usage_day, sum(t)::bigint as tokens_used, sum(n)::bigint as request_count, 40000::bigint as daily_limit,
  greatest(0, 40000 - sum(t))::bigint as tokens_remaining, epoch_us(cast(usage_day as timestamp) + interval 1 day) as resets_at,
  string_agg(concat(tier, '=', t), ',' order by tier) as tier_usage
from (select key, usage_day, tier, sum(weighted_tokens)::bigint as t, count(*) as n from charged group by all) x group by key, usage_day""", X.CHARGES_SQL))
def e5_view(spark, sf):
    out = B.budget_view(charged(spark, sf), DAILY_LIMIT).select(
        "key", "usage_day", "tokens_used", "request_count", "daily_limit", "tokens_remaining", "resets_at", "tier_usage")
    shown = F.transform(F.map_entries("tier_usage"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.withColumn("tier_usage", F.array_join(shown, ","))


@query("e6_tier_totals", X.with_sql("""
select tier, usage_day::varchar as usage_day, sum(tokens)::bigint as raw_tokens, max(tier_daily_limit) as tier_daily_limit,
  coalesce(max(tier_daily_limit) > 0 and sum(tokens) > max(tier_daily_limit), false) as over_cap
from charged where classified group by tier, usage_day""", X.CHARGES_SQL))
def e6(spark, sf):
    return B.tier_totals(charged(spark, sf))


@query("e6_tier_running", X.with_sql("""
select request_id, tier, usage_day::varchar as usage_day,
  cast(sum(tokens) over (partition by tier, usage_day order by event_ts, request_id rows unbounded preceding) as bigint) as running_raw_tokens
from charged where classified""", X.CHARGES_SQL))
def e6_running(spark, sf):
    return B.tier_running(charged(spark, sf)).select("request_id", "tier", "usage_day", "running_raw_tokens")


_CHAIN_LIMIT = 200_000

_CHAIN_SQL = f"""recursive {X.AUDIT_SQL}, {X.TIERS_SQL}, {AUTH_SQL},
base as (
  select a.request_id, a.client_id as key, a.total_tokens, r.tier, coalesce(r.tier_daily_limit, 0) as cap, r.cost_multiplier,
    epoch_us(a.event_ts) as end_us, {_start_us(1)} as start_us, a.event_id % 50 * 800 as max_tokens,
    coalesce(nullif(case when u.auth_status = 'stored' then u.rate_limit_rpm end, 0), 3) as rpm,
    case when u.auth_status <> 'stored' or u.key_id % 4 in (2, 3) then true when u.key_id % 4 = 0 then a.model glob 'phi4:*' or a.model glob 'gpt-?o'
      else a.model glob '*embed*' end as model_ok,
    case when u.auth_status <> 'stored' or u.key_id % 3 = 2 then true when u.key_id % 3 = 0 then a.endpoint = 'north-gpu'
      else a.endpoint in ('south-gpu', 'lab-vllm') end as endpoint_ok,
    case when a.task in ('chat', 'embeddings') and a.endpoint = 'lab-vllm' then 'provider_denied_for_task'
      when a.task = 'embeddings' and a.endpoint <> 'north-gpu' then 'provider_not_allowed_for_task' end as provider_violation
  from audit a join resolved r on r.model = a.model join authenticated u on u.request_id = a.request_id),
turns as (select key, request_id, start_us as us, rpm, row_number() over (partition by key order by start_us, request_id) as n from base),
{_limiter_walk('walk', 'turns')},
checked as (
  select b.*, w.limit_hit, round(greatest(0.1::double, (w.oldest - w.us) / 1000000.0), 6) as wait,
    case when w.limit_hit is not null then 'rate_limit' when max_tokens > 32768 then 'token_limit' when not model_ok then 'model_not_allowed'
      when not endpoint_ok then 'endpoint_not_allowed' end as early
  from base b join walk w using (request_id)),
asked as (
  select request_id, cast(substr(key, 8) as int) + 1 as slot, tier, cap, case when provider_violation is null then total_tokens else 0 end as raw,
    cast(trunc(case when provider_violation is null then total_tokens else 0 end * cost_multiplier) as bigint) as cost, max_tokens as estimate,
    cast(trunc(max_tokens * cost_multiplier) as bigint) as weighted_estimate, end_us, start_us
  from checked where early is null),
{_budget_walk(_CHAIN_LIMIT)},
judged as (
  select c.*, coalesce(c.early, case when w.budget_type is not null then 'token_budget_exceeded' when c.provider_violation is not null then 'provider_task' end) as violation
  from checked c left join (select * from budget_walk where kind = 0 and n > 0) w using (request_id))"""


@query("e7_policy_chain", X.with_sql("""
select request_id, key, start_us as start_ts, violation is null as allowed, violation,
  case violation when 'rate_limit' then 'rate_limit_exceeded' when 'token_limit' then 'token_limit_exceeded' when 'provider_task' then provider_violation
    else violation end as violation_code,
  case when violation = 'rate_limit' then wait end as retry_after from judged""", _CHAIN_SQL))
def e7(spark, sf):
    rights = authenticated(spark, sf).select("request_id", "allowed_models", "allowed_endpoints", F.col("rate_limit_rpm").alias("rpm_override"))
    rows = X.audit(spark, sf)
    tiers = B.resolve_tiers(rows, X.assignments(spark), X.tiers(spark))
    requests = B.with_tiers(rows, tiers).join(rights, "request_id").select(
        "request_id", F.col("client_id").alias("key"), "task", "model", "endpoint", "tier", "tier_daily_limit",
        "cost_multiplier", "allowed_models", "allowed_endpoints", "rpm_override",
        F.col("total_tokens").alias("tokens"),
        (F.col("event_id") % 50 * 800).cast("int").alias("max_tokens"),
        F.greatest(A.start_ts(F.col("event_ts"), F.col("latency_ms")), F.date_trunc("day", "event_ts")).alias("start_ts"),
        F.col("event_ts").alias("end_ts"),
    )
    return P.enforce(requests, task_policies(spark), LIMITS, daily_limit=_CHAIN_LIMIT)


_HISTORY_SQL = """
select provider, epoch_us(check_ts) as check_ts, seq, healthy,
  case when healthy then 0 else cast(count(*) over (partition by provider, island order by check_ts, seq rows unbounded preceding) as bigint)
    - case when island > 0 then 1 else 0 end end as consecutive_failures,
  epoch_us(max(case when healthy then check_ts end) over (partition by provider order by check_ts, seq rows unbounded preceding)) as last_healthy
from (select *, sum(case when healthy then 1 else 0 end) over (partition by provider order by check_ts, seq rows unbounded preceding) as island from checks) x"""


@query("e8_health_history", X.with_sql(_HISTORY_SQL, X.CHECKS_SQL))
def e8(spark, sf):
    return H.health_history(X.checks(spark, sf))


@query("e8_current_health", X.with_sql(f"""
select provider, check_ts as last_check, last_healthy, consecutive_failures, healthy, case when healthy then 'healthy' else 'unhealthy' end as status,
  round(((select epoch_us(max(check_ts)) from checks) - last_healthy) / 1e6, 6) as seconds_since_healthy
from (select *, row_number() over (partition by provider order by check_ts desc, seq desc) as rn from history) y where rn = 1""",
    X.CHECKS_SQL, f"history as ({_HISTORY_SQL})"))
def e8_current(spark, sf):
    return H.current_health(X.checks(spark, sf))


@query("e9_guard_outages", X.with_sql("""
select provider, epoch_us(min(check_ts)) as outage_start, epoch_us(max(check_ts)) as outage_end, count(*) as failed_calls
from (select *, sum(case when healthy then 1 else 0 end) over (partition by provider order by check_ts, seq rows unbounded preceding) as island from checks) x
where not healthy group by provider, island having count(*) >= 5""", X.CHECKS_SQL))
def e9(spark, sf):
    calls = X.checks(spark, sf).withColumnsRenamed({"check_ts": "call_ts", "healthy": "ok"})
    return H.outages(calls)


@query("e10_current_ledger", X.with_sql("select request_id, key, weighted_tokens from charged where usage_day = (select max(usage_day) from charged)", X.CHARGES_SQL))
def e10(spark, sf):
    return B.drop_stale(charged(spark, sf)).select("request_id", "key", "weighted_tokens")
