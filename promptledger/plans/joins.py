"""D: joins with keys, tiers, labels, catalog and routing tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptledger.operators import budget as B
from promptledger.operators import catalog as K
from promptledger.operators import health as H
from promptledger.operators import keys
from promptledger.operators import policy as P
from promptledger.operators import routing as R
from promptledger.operators import scans
from promptledger.plans import fixtures as X
from promptledger.plans.aggregates import CAPABILITIES_SQL, capabilities
from promptledger.plans.registry import query
from promptledger.plans.scan_tables import PII_EVENTS_SQL, SCANS_SQL, labelled_scans, pii_events, scan_rows

# --- keys --------------------------------------------------------------------------------------

AUTH_SQL = f"""{X.KEYS_SQL}, {X.KEYED_SQL},
authenticated as (
  select q.request_id, epoch_us(q.request_ts) as request_ts, q.model, q.endpoint, s.key_id,
    case when q.api_key = '' then 'anonymous' when length(q.api_key) < 16 then 'invalid_api_key_format'
      when q.api_key = 'configured-key-0001' then 'configured' when s.key_id is not null then 'stored' else 'invalid_api_key' end as auth_status,
    case when q.api_key = '' then 'default' when q.api_key = 'configured-key-0001' then 'ops-team' else s.client_id end as client_id,
    case when q.api_key = 'configured-key-0001' then 'prod' else s.environment end as environment,
    s.rate_limit_rpm::bigint as rate_limit_rpm,
    case when q.api_key = 'configured-key-0001' then 'north-gpu' end as target_endpoint,
    sha256(q.api_key) as key_hash
  from keyed q left join stored_keys s
    on s.api_key = q.api_key and s.is_active and (s.expires_us is null or s.expires_us > epoch_us(q.request_ts)))"""


def authenticated(spark, sf):
    return keys.authenticate(X.keyed_requests(spark, sf), X.stored_keys(spark, sf), X.configured_keys(spark))


@query("d1_authenticate", X.with_sql("select request_id, request_ts, auth_status, client_id, environment, rate_limit_rpm, target_endpoint from authenticated", AUTH_SQL))
def d1(spark, sf):
    return authenticated(spark, sf).select(
        "request_id", "request_ts", "auth_status", "client_id", "environment", "rate_limit_rpm", "target_endpoint"
    )


@query("d1_rejected", X.with_sql("select request_id, auth_status from authenticated where auth_status like 'invalid%'", AUTH_SQL))
def d1_rejected(spark, sf):
    return keys.rejected(authenticated(spark, sf)).select("request_id", "auth_status")


@query("d2_last_used", X.with_sql("""
select s.key_id, max(a.request_ts) as last_used_at from stored_keys s
left join (select * from authenticated where auth_status = 'stored') a on a.key_id = s.key_id group by s.key_id""", AUTH_SQL))
def d2(spark, sf):
    uses = authenticated(spark, sf).filter("auth_status = 'stored'")
    return keys.touch_last_used(X.stored_keys(spark, sf), uses).select("key_id", "last_used_at")


@query("d3_revoke", X.with_sql("""
select key_id, is_active and description <> 'BUILDING' as is_active, description = 'BUILDING' as revoked from stored_keys""", X.KEYS_SQL))
def d3(spark, sf):
    stored = X.stored_keys(spark, sf)
    return keys.revoke(stored, stored.filter("description = 'BUILDING'")).select("key_id", "is_active", "revoked")


@query("d9_allowlists", X.with_sql("""
select request_id,
  case when auth_status <> 'stored' or key_id % 4 in (2, 3) or model = '' then true
    when key_id % 4 = 0 then model glob 'phi4:*' or model glob 'gpt-?o' else model glob '*embed*' end as model_allowed,
  case when auth_status <> 'stored' or key_id % 3 = 2 then true
    when key_id % 3 = 0 then endpoint = 'north-gpu' else endpoint in ('south-gpu', 'lab-vllm') end as endpoint_allowed
from authenticated""", AUTH_SQL))
def d9(spark, sf):
    return keys.check_allowlists(authenticated(spark, sf)).select("request_id", "model_allowed", "endpoint_allowed")


# --- tiers -------------------------------------------------------------------------------------


@query("d4_model_tiers", X.with_sql("select model, tier, cost_multiplier, tier_daily_limit, classified from resolved", X.AUDIT_SQL, X.TIERS_SQL))
def d4(spark, sf):
    return B.resolve_tiers(X.audit(spark, sf), X.assignments(spark), X.tiers(spark))


_REPORT_SQL = """report as (
  select coalesce(c.model, r.model) as model, r.tier, coalesce(r.cost_multiplier, 5.0) as cost_multiplier, coalesce(r.classified, false) as classified
  from (select distinct requested_model as model from routed) c full outer join resolved r on r.model = c.model)"""


def _report(spark, sf):
    listed = X.routed_requests(spark, sf).select(F.col("requested_model").alias("model"))
    classified = B.resolve_tiers(X.audit(spark, sf), X.assignments(spark), X.tiers(spark))
    return B.classification_report(listed, classified)


@query("d5_classification", X.with_sql("select * from report", X.AUDIT_SQL, X.TIERS_SQL, X.ROUTED_SQL, _REPORT_SQL))
def d5(spark, sf):
    return _report(spark, sf)


@query("d5_unclassified", X.with_sql("select model from report where not classified", X.AUDIT_SQL, X.TIERS_SQL, X.ROUTED_SQL, _REPORT_SQL))
def d5_open(spark, sf):
    return _report(spark, sf).filter("not classified").select("model")


# --- scans, labels, PII ------------------------------------------------------------------------

_PII_SQL = "select request_id, event_us as event_ts, client_id, model, task, pii_type, message_index::bigint as message_index, message_role, position_start, position_end, value_hash, was_scrubbed from pii_events"


@query("d6_pii_events", X.with_sql(_PII_SQL, PII_EVENTS_SQL))
def d6(spark, sf):
    return pii_events(spark, sf)


@query("d6_part_events", X.with_sql("""
select request_id, pii_type, message_index::bigint as message_index, message_role, 1::bigint as part_index, position_start, position_end, value_hash from pii_events""", PII_EVENTS_SQL))
def d6_parts(spark, sf):
    """Messages whose text is the second of three content parts."""
    image = "named_struct('type', 'image_url', 'text', cast(null as string))"
    rows = X.requests(spark, sf).withColumn(
        "messages", F.expr(f"transform(messages, m -> named_struct('role', m.role, 'parts', array({image}, named_struct('type', 'text', 'text', m.content), {image})))"))
    return scans.part_pii_events(rows).select(
        "request_id", "pii_type", "message_index", "message_role", "part_index", "position_start", "position_end", "value_hash")


@query("b7_pii_event_list", X.with_sql(_PII_SQL + " where pii_type = 'SSN' and client_id = 'client-2' order by event_us desc, request_id, message_index, position_start limit 5", PII_EVENTS_SQL))
def b7(spark, sf):
    return scans.list_pii_events(pii_events(spark, sf), 5, "SSN", "client-2")


@query("d7_labelled_scans", X.with_sql("select request_id, label, label_category, labeled_us as labeled_at, regex_threat_level from scans", SCANS_SQL))
def d7(spark, sf):
    return labelled_scans(spark, sf).select("request_id", "label", "label_category", "labeled_at", "regex_threat_level")


_MISLABELED = "case when request_id like '%7' then 'harmful' when request_id like '%3' then '' when request_id like '%1' then null else label end as label"


@query("d7_label_rejects", X.with_sql(f"""
select request_id, seq, label, case when label = 'harmful' then 'label_unknown' else 'label_missing' end as reason
from (select request_id, seq::bigint as seq, {_MISLABELED} from label_events) x where label is null or label in ('harmful', '')""", X.LABELS_SQL))
def d7_rejects(spark, sf):
    """Labels nobody knows, and missing ones."""
    wrong = X.label_events(spark, sf).withColumn("label", F.expr(_MISLABELED.removesuffix(" as label")))
    return scans.rejected_labels(wrong).select("request_id", "seq", "label", "reason")


@query("d8_bulk_label", X.with_sql("select request_id, request_id in (select request_id from scans) as labeled from latest_labels", SCANS_SQL))
def d8(spark, sf):
    return scans.bulk_label_report(scan_rows(spark, sf), X.label_events(spark, sf))


# Several rows per request: one per event of a user and day.
_COPIES = [
    "concat(cast(user_id as string), '/', cast(cast(ts as date) as string)) as request_id",
    "cast(ts as timestamp) as event_ts",
    "event_id as seq",
    "event_type",
    "value",
]


@query("d20_first_write_wins", X.with_sql("""
select request_id, epoch_us(min(event_ts)) as event_ts, first(seq order by event_ts, seq) as seq,
  first(event_type order by event_ts, seq) as event_type, round(first(value order by event_ts, seq), 6) as value from copies group by request_id""",
    f"copies as (select {', '.join(_COPIES)} from events)"))
def d20(spark, sf):
    return scans.first_write_wins(X._table(spark, sf, "events").selectExpr(*_COPIES))


# --- policy ------------------------------------------------------------------------------------


def task_policies(spark):
    return spark.sql(
        """
        select 'chat' as task, cast(array() as array<string>) as allowed_providers, array('lab-vllm') as denied_providers
        union all select 'embeddings', array('north-gpu', 'lab-vllm'), array('lab-vllm')
        """
    )


@query("d10_provider_policy", X.with_sql("""
select request_id, case when task = 'chat' and endpoint = 'lab-vllm' then 'provider_denied_for_task'
  when task = 'embeddings' and endpoint = 'lab-vllm' then 'provider_denied_for_task'
  when task = 'embeddings' and endpoint <> 'north-gpu' then 'provider_not_allowed_for_task' end as provider_violation from audit""", X.AUDIT_SQL))
def d10(spark, sf):
    return P.check_providers(X.audit(spark, sf), task_policies(spark)).select("request_id", "provider_violation")


# --- catalog -----------------------------------------------------------------------------------

_EFFECTIVE = """
select e.environment, c.name, c.endpoint from catalog c, (values ('prod'), ('dev'), ('staging')) e(environment)
where (e.environment = 'prod' and c.endpoint in ('north-gpu', 'lab-vllm') and (c.name glob 'phi4:14b' or c.name glob 'llama*'))
  or e.environment = 'dev' or (e.environment = 'staging' and c.endpoint in ('north-gpu', 'south-gpu') and c.name glob '*:?b')"""


@query("d11_effective_models", X.with_sql(_EFFECTIVE, X.CATALOG_SQL))
def d11(spark, sf):
    return K.effective_models(X.catalog(spark, sf), X.endpoints(spark), X.environments(spark))


@query("d12_environment", X.with_sql("""
select request_id, case wanted when 'qa' then null else wanted end as resolved_environment
from (select request_id, coalesce(nullif(header_environment, ''), nullif(key_environment, ''), 'dev') as wanted from routed) x""", X.ROUTED_SQL))
def d12(spark, sf):
    return R.resolve_environment(X.routed_requests(spark, sf), X.environments(spark)).select("request_id", "resolved_environment")


_RESOLVE_SQL = f"""{X.CATALOG_SQL}, {X.ENDPOINTS_SQL}, {X.ROUTED_SQL},
pairs as (
  select distinct requested_model, environment,
    case when requested_model like 'north-gpu/%' then 'north-gpu' when requested_model like 'no-such-box/%' then 'no-such-box'
      when requested_model like 'meta-llama/%' then 'meta-llama' end as hint
  from routed),
named as (select *, case when hint is null then requested_model else split_part(requested_model, '/', 2) end as model_name from pairs),
cand0 as (
  select n.requested_model, n.environment, e.ord, e.name as endpoint, e.labels,
    exists (select 1 from catalog c where c.name = n.model_name and c.endpoint = e.name) as has_it,
    exists (select 1 from catalog c join endpoints e2 on e2.name = c.endpoint and e2.enabled where c.name = n.model_name) as some_has
  from named n, endpoints e where e.enabled),
cand as (
  select requested_model, environment, ord, endpoint from cand0
  where (has_it or not some_has) and case coalesce(environment, '') when 'prod' then labels['tier'] = 'prod'
    when 'staging' then endpoint in ('north-gpu', 'south-gpu') else true end),
lists as (
  select n.*, coalesce(list(c.endpoint order by c.ord) filter (where c.endpoint is not null), []) as eps
  from named n left join cand c on c.requested_model = n.requested_model and c.environment is not distinct from n.environment
  group by all),
steps as (
  select *, len(eps) as candidate_count,
    case when model_name glob 'llama3.1:*' then 'south-gpu' when model_name = 'gpt-4o' then 'lab-vllm' end as dflt from lists),
staged as (
  select *, case when hint = 'north-gpu' then 'explicit' when hint is not null then 'error' when candidate_count = 0 then 'error'
    when candidate_count = 1 then 'single' when list_contains(eps, dflt) then 'model_default'
    when list_contains(eps, 'lab-vllm') then 'priority' else 'error' end as step from steps),
resolved_endpoints as (
  select requested_model, environment, model_name, step,
    case step when 'explicit' then hint when 'single' then eps[1] when 'model_default' then dflt when 'priority' then 'lab-vllm' end as resolved_endpoint,
    case when step = 'error' then case when hint is not null then 'endpoint_not_found' when candidate_count = 0 then 'no_provider' else 'ambiguous_model' end end as resolution_error,
    candidate_count from staged)"""


def resolved(spark, sf):
    return R.resolve_endpoints(
        X.routed_requests(spark, sf), X.catalog(spark, sf), X.endpoints(spark), X.environments(spark),
        X.model_defaults(spark), X.priorities(spark),
    )


@query("d13_resolve_endpoints", X.with_sql("select * from resolved_endpoints", _RESOLVE_SQL))
def d13(spark, sf):
    return resolved(spark, sf)


@query("d13_routed_requests", X.with_sql("""
select q.request_id, q.requested_model, q.environment, r.model_name, r.step, r.resolved_endpoint, r.resolution_error, r.candidate_count
from routed q join resolved_endpoints r on r.requested_model = q.requested_model and r.environment is not distinct from q.environment""", _RESOLVE_SQL))
def d13_rows(spark, sf):
    out = R.with_resolution(X.routed_requests(spark, sf), resolved(spark, sf))
    return out.select(
        "request_id", "requested_model", "environment", "model_name", "step", "resolved_endpoint", "resolution_error", "candidate_count"
    )


_PREFIX = """case when requested_model like '9bad/%' then null when contains(requested_model, '/') then split_part(requested_model, '/', 1) end as hint,
  case when requested_model like '9bad/%' or not contains(requested_model, '/') then requested_model else split_part(requested_model, '/', 2) end as model_name"""


@query("d14_model_prefix", X.with_sql(f"select request_id, {_PREFIX} from routed", X.ROUTED_SQL))
def d14(spark, sf):
    hint, name = R.split_prefix(F.col("requested_model"))
    return X.routed_requests(spark, sf).select("request_id", hint.alias("hint"), name.alias("model_name"))


_PROVIDER_SQL = f"""{X.ROUTED_SQL},
provided as (
  select request_id, fallback_allowed, coalesce(hint, nullif(preferred_provider, ''), 'north-gpu') as provider,
    case when hint is not null then model_name else requested_model end as model_name
  from (select *, {_PREFIX} from routed) x)"""


def provided(spark, sf):
    return R.resolve_provider(X.routed_requests(spark, sf), R.default_provider(X.endpoints(spark)))


@query("d15_resolve_provider", X.with_sql("select request_id, provider, model_name from provided", _PROVIDER_SQL))
def d15(spark, sf):
    return provided(spark, sf).select("request_id", "provider", "model_name")


_FALLBACK = """
options as (
  select p.provider, p.model_name, p.fallback_allowed, c.endpoint, case when h.healthy then 0 else 1 end as class, coalesce(e.ord, 0) as ord
  from (select distinct provider, model_name, fallback_allowed from provided) p join catalog c on c.name = p.model_name
    left join endpoints e on e.name = c.endpoint left join health h on h.provider = c.endpoint
  union all
  select distinct provider, model_name, fallback_allowed, provider, 2, 0 from provided
  union all
  select p.provider, p.model_name, p.fallback_allowed, e.name, 3, e.ord
  from (select distinct provider, model_name, fallback_allowed from provided where fallback_allowed) p, endpoints e where e.enabled),
ranked as (select provider, model_name, fallback_allowed, endpoint, min(class * 100 + ord) as rnk from options group by all),
fallbacks as (select provider, model_name, fallback_allowed, list(endpoint order by rnk) as attempts from ranked group by all)"""


@query("d16_fallback_order", X.with_sql("select provider, model_name, fallback_allowed, array_to_string(attempts, ',') as attempts from fallbacks", _PROVIDER_SQL, X.CATALOG_SQL, X.ENDPOINTS_SQL, X.HEALTH_SQL, _FALLBACK))
def d16(spark, sf):
    out = R.fallback_order(provided(spark, sf), X.catalog(spark, sf), H.current_health(X.checks(spark, sf)), X.endpoints(spark))
    return out.withColumn("attempts", F.array_join("attempts", ","))


@query("d17_endpoints_for_model", X.with_sql("""
select distinct endpoint from catalog where name = 'llama3.1:70b' and endpoint in (select name from endpoints where labels['tier'] = 'prod')""", X.CATALOG_SQL, X.ENDPOINTS_SQL))
def d17(spark, sf):
    return K.endpoints_for_model(X.catalog(spark, sf), "llama3.1:70b", X.endpoints(spark), {"tier": "prod"})


@query("d17_models_for_endpoint", X.with_sql("select name from catalog where endpoint = 'lab-vllm'", X.CATALOG_SQL))
def d17_models(spark, sf):
    return K.models_for_endpoint(X.catalog(spark, sf), "lab-vllm")


@query("d17_distinct_models", X.with_sql("select distinct name from catalog", X.CATALOG_SQL))
def d17_all_models(spark, sf):
    return K.distinct_models(X.catalog(spark, sf))


@query("d17_distinct_endpoints", X.with_sql("select distinct endpoint from catalog", X.CATALOG_SQL))
def d17_all_endpoints(spark, sf):
    return K.distinct_endpoints(X.catalog(spark, sf))


@query("d17_existence", X.with_sql("""
select request_id, model in (select name from catalog) as model_known,
  exists (select 1 from catalog c where c.name = a.model and c.endpoint = a.endpoint) as model_on_endpoint from audit a""", X.AUDIT_SQL, X.CATALOG_SQL))
def d17_exists(spark, sf):
    return K.with_existence(X.audit(spark, sf), X.catalog(spark, sf)).select("request_id", "model_known", "model_on_endpoint")


@query("d18_catalog_refresh", X.with_sql("""
select endpoint, name, snapshot_ts::varchar as snapshot_ts, ord from (
  select a.*, row_number() over (partition by name, endpoint order by ord desc) as rn from snaps a
  where snapshot_ts = (select max(snapshot_ts) from snaps b where b.endpoint = a.endpoint)) x where rn = 1""",
    X.AUDIT_SQL, "snaps as (select endpoint, event_date as snapshot_ts, model as name, event_id as ord from audit)"))
def d18(spark, sf):
    rows = X.audit(spark, sf).select("endpoint", F.col("event_date").alias("snapshot_ts"), F.col("model").alias("name"), F.col("event_id").alias("ord"))
    return K.refresh(rows).select("endpoint", "name", "snapshot_ts", "ord")


@query("d19_route_report", X.with_sql("""
select p.request_id, p.provider, p.model_name, coalesce(h.healthy, false) as provider_healthy,
  not coalesce(h.healthy, false) and fallback_allowed as would_fallback,
  case when not coalesce(h.healthy, false) then concat('Primary provider ''', p.provider,
    case when fallback_allowed then ''' unhealthy, would fallback' else ''' unhealthy, no fallback available' end) end as reason
from provided p left join health h on h.provider = p.provider""", _PROVIDER_SQL, X.HEALTH_SQL))
def d19(spark, sf):
    out = R.route_report(provided(spark, sf), H.current_health(X.checks(spark, sf)), X.endpoints(spark))
    return out.select("request_id", "provider", "model_name", "provider_healthy", "would_fallback", "reason")


@query("d21_config_violations", X.with_sql("""
select 'model_default' as relation, 'ghost*' as owner, 'ghost-box' as endpoint, 0::bigint as request_count
union all select 'priority', '2', 'phantom', 0
union all select 'rule', environment, 'retired-box', count(*) from audit group by environment""", X.AUDIT_SQL))
def d21(spark, sf):
    """Violations of the configuration, the routing rules taken from the environments of the log."""
    audit = X.audit(spark, sf)
    rules = audit.select(F.col("environment").alias("task")).distinct().select(
        "task", F.lit("retired-box").alias("provider"), F.array(F.lit("lab-vllm")).alias("fallback_providers")
    )
    bad = R.config_violations(X.endpoints(spark), X.model_defaults(spark), X.priorities(spark), X.environments(spark), rules)
    used = audit.groupBy(F.col("environment").alias("owner")).agg(F.count("*").alias("request_count"))
    return bad.join(used, "owner", "left").select("relation", "owner", "endpoint", F.coalesce("request_count", F.lit(0)).alias("request_count"))


@query("d22_available_models", X.with_sql("""
select concat(c.endpoint, '/', c.name) as id, c.endpoint as owned_by, k.capabilities from catalog c
join health h on h.provider = c.endpoint and h.healthy join capabilities k on k.endpoint = c.endpoint""", CAPABILITIES_SQL, X.HEALTH_SQL))
def d22(spark, sf):
    out = K.available_models(X.catalog(spark, sf), H.current_health(X.checks(spark, sf)), capabilities(spark, sf))
    return out.withColumn("capabilities", F.array_join("capabilities", ","))


@query("d22_tag_listing", X.with_sql("""
select name, name as model, coalesce(size_bytes, 0)::bigint as size, '' as digest, coalesce(family, '') as family,
  coalesce(parameter_size, '') as parameter_size, coalesce(quantization, '') as quantization_level from catalog""", X.CATALOG_SQL))
def d22_tags(spark, sf):
    return K.tag_listing(X.catalog(spark, sf))


@query("d23_provider_status", X.with_sql("""
select e.name, e.type, e.url, e.enabled, e.ord::bigint as ord, coalesce(h.healthy, false) as healthy, coalesce(h.status, 'unknown') as status,
  coalesce((select string_agg(name, ',' order by name) from catalog c where c.endpoint = e.name), '') as models, coalesce(k.capabilities, '') as capabilities
from endpoints e left join health h on h.provider = e.name left join capabilities k on k.endpoint = e.name""", CAPABILITIES_SQL, X.ENDPOINTS_SQL, X.HEALTH_SQL))
def d23(spark, sf):
    out = K.provider_status(X.endpoints(spark), H.current_health(X.checks(spark, sf)), X.catalog(spark, sf), capabilities(spark, sf))
    return out.withColumn("models", F.array_join("models", ",")).withColumn("capabilities", F.array_join("capabilities", ","))
