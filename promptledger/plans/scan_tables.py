"""Scan, alert and PII tables derived from the conversations, with the SQL that rebuilds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptledger.functions.guard import parse_hazard_verdict
from promptledger.functions.injection import PATTERNS
from promptledger.functions.once import dealt
from promptledger.functions.pii import PII_PATTERNS
from promptledger.functions.threats import THREAT_LEVELS
from promptledger.operators import scan_store, scans
from promptledger.plans import fixtures as X
from promptledger.session import scratch_path


def tasks(spark: SparkSession) -> int:
    """Tasks that texts are dealt over: the small tables hold all their texts in one file."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def analyzed(spark: SparkSession, sf: str) -> DataFrame:
    return scans.analyze(dealt(X.requests(spark, sf), "request_id", tasks(spark)))


def store(spark: SparkSession, sf: str) -> str:
    """A new scan store over all requests."""
    path = scratch_path(spark, "scan-store")
    scan_store.update(X.requests(spark, sf), path, was_scrubbed=True, partitions=tasks(spark))
    return path


def stored_alerts(spark: SparkSession, path: str) -> DataFrame:
    return scans.alerts(scan_store.analyzed(spark, path))


def stored_scans(spark: SparkSession, sf: str, path: str) -> DataFrame:
    rows = scans.scan_rows(scan_store.analyzed(spark, path), guard_verdicts(spark, sf))
    return scans.apply_labels(rows, X.label_events(spark, sf))


def alert_rows(spark: SparkSession, sf: str) -> DataFrame:
    return scans.alerts(analyzed(spark, sf))


def guard_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return X.guard_output(spark, sf).withColumn("verdict", parse_hazard_verdict(F.col("guard_raw_response")))


def scan_rows(spark: SparkSession, sf: str) -> DataFrame:
    return scans.scan_rows(analyzed(spark, sf), guard_verdicts(spark, sf))


def labelled_scans(spark: SparkSession, sf: str) -> DataFrame:
    return scans.apply_labels(scan_rows(spark, sf), X.label_events(spark, sf))


def pii_events(spark: SparkSession, sf: str) -> DataFrame:
    return scans.pii_events(dealt(X.requests(spark, sf), "request_id", tasks(spark)), was_scrubbed=True)


# The same pattern texts for the SQL engine.
INJECTION_SQL_PATTERNS = tuple((p.name, p.category, THREAT_LEVELS.index(p.level), p.regex) for p in PATTERNS)
PII_SQL_PATTERNS = PII_PATTERNS


def spans_sql(source: str, key: str, text: str, regex: str, rank: int, name: str) -> str:
    """All matches of one pattern: key, rank, name, start, end, value."""
    return f"""
  select {key}, {rank} as rank, '{name}' as name, hit as value,
    list_sum(list_transform(gaps[1:n], lambda g: length(g)))::bigint
      + coalesce(list_sum(list_transform(hits[1:n - 1], lambda h: length(h))), 0)::bigint as start_pos
  from (select {key}, hits, gaps, unnest(hits) as hit, generate_subscripts(hits, 1) as n
        from (select {key}, regexp_extract_all({text}, '{regex}') as hits, regexp_split_to_array({text}, '{regex}') as gaps
              from {source}) a) b"""


def pii_hits_sql(source: str, key: str, text: str) -> str:
    """CTEs ``pii_all`` and ``pii_kept`` (overlaps removed, left to right)."""
    union = " union all ".join(
        spans_sql(source, key, text, regex, rank, name) for rank, (name, regex) in enumerate(PII_SQL_PATTERNS)
    )
    return f"""
pii_all as (
  select *, start_pos + length(value) as end_pos, row_number() over (partition by {key} order by start_pos, rank) as pos
  from ({union}) u),
pii_walk as (
  select {key}, pos, end_pos as last_end, true as kept from pii_all where pos = 1
  union all
  select a.{key}, a.pos, case when a.start_pos >= w.last_end then a.end_pos else w.last_end end, a.start_pos >= w.last_end
  from pii_walk w join pii_all a on a.{key} = w.{key} and a.pos = w.pos + 1),
pii_kept as (
  select a.*, row_number() over (partition by a.{key} order by a.pos) as kept_no
  from pii_all a join pii_walk w on a.{key} = w.{key} and a.pos = w.pos where w.kept)"""


def injection_hits_sql(source: str, key: str, text: str, extra: str = "", flags: str = "(?i)") -> str:
    """CTE ``hits``: one row per match. ``extra`` adds key columns."""
    keys = key + extra
    union = " union all ".join(
        f"select *, '{category}' as category, {level} as level_ord from ({spans_sql(source, keys, text, flags + regex, rank, name)})"
        for rank, (name, category, level, regex) in enumerate(INJECTION_SQL_PATTERNS)
    )
    return f"hits as ({union})"


_LEVEL = "case {} when 4 then 'critical' when 3 then 'high' when 2 then 'medium' when 1 then 'low' else 'none' end"

INVISIBLE_SQL = r"[\x{200B}\x{200C}\x{200D}\x{2060}-\x{2064}\x{FEFF}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}\x{E0000}-\x{E007F}]"

SCANS_SQL = f"""{X.REQUESTS_SQL},
{injection_hits_sql('messages', 'request_id', 'content', ', message_index')},
used_hits as (
  select h.* from hits h join requests r using (request_id) where not (r.task = 'embeddings' and h.category = 'delimiter_attack')),
verdicts as (
  select request_id, max(level_ord) as threat_ord, count(*) as match_count,
    first(name order by message_index, rank, start_pos) as first_name
  from used_hits group by request_id),
{X.GUARD_SQL}, {X.LABELS_SQL},
scan_base as (
  select r.request_id, r.event_us, r.client_id, r.model, r.task, r.combined,
    coalesce(v.threat_ord, 0) as threat_ord, {_LEVEL.format('coalesce(v.threat_ord, 0)')} as regex_threat_level,
    coalesce(v.match_count, 0) as regex_match_count, v.first_name,
    case g.guard_raw_response when 'unsafe' then false when concat('unsafe', chr(10), 'S1') then false else true end as guard_safe,
    coalesce(g.guard_raw_response, 'maybe') = 'maybe' as guard_skipped,
    case when g.guard_raw_response like '%S1' then 'S1' end as guard_category_code,
    case when g.guard_raw_response like '%S1' then 'Violent Crimes' end as guard_category_name,
    g.guard_raw_response
  from requests r left join verdicts v using (request_id) left join guard_output g using (request_id)),
scans as (
  select b.*, l.label, l.label_category, l.labeled_us,
    not b.guard_skipped and (b.threat_ord > 0) <> (not b.guard_safe) as is_disagreement
  from scan_base b left join latest_labels l using (request_id)),
alerts as (
  select request_id, event_us, client_id, 'unicode_manipulation' as alert_type, 'warning' as severity,
    concat('Found ', length(combined) - length(regexp_replace(combined, '{INVISIBLE_SQL}', '', 'g')), ' suspicious Unicode characters') as description
  from scan_base where nfc_normalize(regexp_replace(combined, '{INVISIBLE_SQL}', '', 'g')) <> combined
  union all
  select request_id, event_us, client_id, concat('injection_', regex_threat_level),
    case threat_ord when 4 then 'critical' when 3 then 'warning' else 'info' end,
    concat(case threat_ord when 4 then 'Critical' when 3 then 'High-threat' else 'Medium-threat' end, ' injection pattern detected: ', first_name)
  from scan_base where threat_ord >= 2)"""

PII_EVENTS_SQL = f"""recursive {X.REQUESTS_SQL},
keyed_messages as (select *, concat(request_id, '/', message_index) as mkey from messages),
{pii_hits_sql('keyed_messages', 'mkey', 'content')},
pii_events as (
  select m.request_id, r.event_us, r.client_id, r.model, r.task, k.name as pii_type, m.message_index, m.role as message_role,
    k.start_pos as position_start, k.end_pos as position_end, sha256(k.value) as value_hash, true as was_scrubbed
  from pii_kept k join keyed_messages m using (mkey) join requests r on r.request_id = m.request_id)"""
