"""Security scans: building, alerts, listings, labels, training rows, PII events."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptledger.functions.guard import has_guard, is_disagreement
from promptledger.functions.injection import scan_injection_messages
from promptledger.functions.once import evaluate_once
from promptledger.functions.pii import detections
from promptledger.functions.sanitize import sanitize
from promptledger.functions.spans import unicode_regex
from promptledger.functions.threats import at_least
from promptledger.operators.audit import since_hours
from promptledger.operators.paging import page

# Fixed value: how exported rows name their origin.
TRAINING_SOURCE = "gateway_production"


# --- building ----------------------------------------------------------------------------------


def combined_content(messages: Column) -> Column:
    """All message texts, one per line."""
    texts = F.filter(messages, lambda m: m["content"].isNotNull())
    return F.array_join(F.transform(texts, lambda m: m["content"]), "\n")


def analyze(requests: DataFrame) -> DataFrame:
    """Sanitizer and injection verdicts of requests with a ``messages`` array."""
    clean = sanitize(evaluate_once(requests, "_combined", combined_content(F.col("messages"))), "_combined")
    scanned = scan_injection_messages(clean, embedding_task=F.coalesce(F.col("task") == "embeddings", F.lit(False)))
    return scanned.drop("_combined", "sanitized")


def _alert(kind: str, severity: str, text: Column, details: Column) -> Column:
    return F.struct(F.lit(kind).alias("alert_type"), F.lit(severity).alias("severity"), text.alias("description"), details.alias("details"))


def alerts(analyzed: DataFrame) -> DataFrame:
    """One row per alert: altered Unicode, and at most one injection alert named after the first match."""
    return detailed_alerts(analyzed).drop("details")


def detailed_alerts(analyzed: DataFrame) -> DataFrame:
    """Alerts with ``details`` as JSON: removals per kind, or all matches. The sentences are fixed values."""
    first = F.coalesce(F.get("matches", F.lit(0))["pattern"], F.lit("unknown"))

    def injection(level: str, severity: str, head: str) -> Column:
        text = F.concat(F.lit(head), first)
        return F.when(F.col("threat_level") == level, _alert(f"injection_{level}", severity, text, F.to_json(F.col("matches"))))

    removed = F.to_json(F.struct(*[F.col(f"removed_{kind}").alias(kind) for kind in ("zero_width", "directional", "control_char")]))

    found = F.array_compact(
        F.array(
            F.when(
                F.col("modified"),
                _alert(
                    "unicode_manipulation",
                    "warning",
                    F.concat(F.lit("Found "), F.col("total_removals"), F.lit(" suspicious Unicode characters")),
                    removed,
                ),
            ),
            injection("critical", "critical", "Critical injection pattern detected: "),
            injection("high", "warning", "High-threat injection pattern detected: "),
            injection("medium", "info", "Medium-threat injection pattern detected: "),
        )
    )
    return analyzed.select("request_id", "event_ts", "client_id", F.inline(found))


def scan_rows(analyzed: DataFrame, guard: DataFrame | None = None) -> DataFrame:
    """Rows of the scan table. ``guard``: request_id and the ``verdict`` struct, where a guard ran."""
    out = analyzed.select(
        "request_id", "event_ts", "client_id", "model", "task", "messages",
        F.col("threat_level").alias("regex_threat_level"),
        F.col("match_count").alias("regex_match_count"),
        F.when(F.size("matches") > 0, F.col("matches")).alias("regex_matches"),
    )
    if guard is None:
        verdict = F.lit(None).cast("struct<safe:boolean,skipped:boolean,category_code:string,category_name:string,confidence:string,error:string>")
        out = out.withColumn("_v", verdict).withColumn("guard_raw_response", F.lit(None).cast("string"))
        out = out.withColumn("guard_inference_ms", F.lit(None).cast("double"))
    else:
        spent = F.col("guard_inference_ms") if "guard_inference_ms" in guard.columns else F.lit(None).cast("double")
        out = out.join(
            guard.select("request_id", F.col("verdict").alias("_v"), "guard_raw_response", spent.alias("guard_inference_ms")), "request_id", "left"
        )
    return (
        out.withColumn("guard_safe", F.col("_v.safe"))
        .withColumn("guard_skipped", F.col("_v.skipped"))
        .withColumn("guard_category_code", F.col("_v.category_code"))
        .withColumn("guard_category_name", F.col("_v.category_name"))
        .withColumn("guard_confidence", F.col("_v.confidence"))
        .withColumn("guard_error", F.col("_v.error"))
        .withColumn(
            "is_disagreement",
            is_disagreement(F.col("regex_threat_level"), F.col("guard_safe"), F.col("guard_skipped")),
        )
        .drop("_v")
    )


def first_write_wins(rows: DataFrame, order: Sequence[str] = ("event_ts", "seq")) -> DataFrame:
    """One row per request: the earliest. Copies are reduced before the shuffle, however many there are."""
    everything = F.struct(*[F.col(c) for c in rows.columns])
    first = rows.groupBy("request_id").agg(F.min_by(everything, F.struct(*order)).alias("_row"))
    return first.select("_row.*")


def skip_trusted(requests: DataFrame, trusted: DataFrame) -> DataFrame:
    """Requests whose source is not on the allowlist."""
    return requests.join(trusted.select("source_ip").distinct(), "source_ip", "left_anti")


def trusted_report(requests: DataFrame, trusted: DataFrame) -> DataFrame:
    marks = trusted.select("source_ip").distinct().withColumn("_hit", F.lit(True))
    joined = requests.join(marks, "source_ip", "left")
    return joined.agg(
        F.count_if(F.col("_hit").isNull()).alias("analyzed_count"),
        F.count_if(F.col("_hit").isNotNull()).alias("skipped_count"),
    )


# --- listings ----------------------------------------------------------------------------------


def list_scans(
    scans: DataFrame,
    limit: int = 50,
    offset: int = 0,
    label: str | None = None,
    disagreements_only: bool = False,
    unlabeled_only: bool = False,
    min_threat_level: str | None = None,
) -> DataFrame:
    """One page of scans, newest first, with the number of all matching ones. Starts jobs (see ``paging``)."""
    rows = scans.filter(at_least(F.col("regex_threat_level"), min_threat_level))
    if label:
        rows = rows.filter(F.col("label") == label)
    if disagreements_only:
        rows = rows.filter("is_disagreement")
    if unlabeled_only:
        rows = rows.filter(F.col("label").isNull())
    found, total = page(rows, limit, offset)
    return found.select("*", F.lit(total).cast("bigint").alias("total_matches"))


def scan_by_id(scans: DataFrame, request_id: str) -> DataFrame:
    return scans.filter(F.col("request_id") == request_id)


def recent_alerts(alert_rows: DataFrame, limit: int = 100) -> DataFrame:
    return alert_rows.orderBy(F.desc("event_ts"), "request_id", "alert_type").limit(limit)


def recent_results(
    scans: DataFrame, limit: int = 50, guard_only: bool = False, disagreements_only: bool = False
) -> DataFrame:
    rows = scans
    ran = has_guard(F.col("guard_safe"), F.col("guard_skipped"))
    if guard_only:
        rows = rows.filter(ran)
    if disagreements_only:
        rows = rows.filter(ran & ((F.col("regex_threat_level") != "none") != ~F.col("guard_safe")))
    return rows.orderBy(F.desc("event_ts"), "request_id").limit(limit)


# --- statistics --------------------------------------------------------------------------------


def label_stats(scans: DataFrame) -> DataFrame:
    total, labeled = F.count(F.lit(1)), F.count("label")
    open_case = F.col("is_disagreement") & F.col("label").isNull()
    return scans.agg(
        total.alias("total_scans"),
        labeled.alias("labeled"),
        (total - labeled).alias("unlabeled"),
        F.count_if(F.col("label") == "safe").alias("safe"),
        F.count_if(F.col("label") == "unsafe").alias("unsafe"),
        F.count_if("is_disagreement").alias("disagreements"),
        F.count_if(open_case).alias("unlabeled_disagreements"),
        F.round(F.when(total > 0, labeled / total * 100).otherwise(0.0), 1).alias("label_progress_pct"),
    )


def run_stats(scans: DataFrame, alert_rows: DataFrame, allowlisted: DataFrame | None = None) -> DataFrame:
    """Counters of a scan run."""
    ran = F.col("guard_safe").isNotNull()
    skipped = F.coalesce(F.col("guard_skipped"), F.lit(False))
    out = scans.agg(
        F.count(F.lit(1)).alias("requests_analyzed"),
        F.count_if(ran).alias("guard_scans"),
        F.count_if(ran & skipped).alias("guard_skipped"),
        F.count_if(ran & ~skipped & ~F.col("guard_safe")).alias("guard_unsafe"),
    )
    out = out.withColumn("alerts_generated", alert_rows.agg(F.count(F.lit(1))).scalar())
    none = F.lit(0).cast("bigint")
    return out.withColumn(
        "requests_allowlisted", none if allowlisted is None else allowlisted.agg(F.count(F.lit(1))).scalar()
    )


def alerts_by_severity(alert_rows: DataFrame) -> DataFrame:
    return alert_rows.groupBy("severity").agg(F.count(F.lit(1)).alias("alert_count"))


# --- labels ------------------------------------------------------------------------------------


#: What a label may be.
LABELS = ("safe", "unsafe")


def valid_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(F.coalesce(F.col("label").isin(*LABELS), F.lit(False)))


def rejected_labels(labels: DataFrame) -> DataFrame:
    """Label rows that name no known label, with the ``reason``."""
    reason = F.when(F.coalesce("label", F.lit("")) == "", F.lit("label_missing")).otherwise(F.lit("label_unknown"))
    return labels.filter(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False))).withColumn("reason", reason)


def latest_labels(labels: DataFrame, order: Sequence[str] = ("labeled_at", "seq")) -> DataFrame:
    """The label table is append-only; the last label of a request counts."""
    everything = F.struct(*[F.col(c) for c in labels.columns])
    return labels.groupBy("request_id").agg(F.max_by(everything, F.struct(*order)).alias("_row")).select("_row.*")


def apply_labels(scans: DataFrame, labels: DataFrame) -> DataFrame:
    """Scans with their current label columns; rows of ``rejected_labels`` change nothing."""
    labels = valid_labels(labels)
    kept = [c for c in ("label", "label_category", "labeled_by", "labeled_at", "label_notes") if c in labels.columns]
    current = latest_labels(labels).select("request_id", *kept)
    return scans.drop(*kept).join(current, "request_id", "left")


def bulk_label_report(scans: DataFrame, labels: DataFrame) -> DataFrame:
    """Per requested id whether a scan was found."""
    known = scans.select("request_id").distinct().withColumn("_hit", F.lit(True))
    wanted = labels.select("request_id").distinct()
    return wanted.join(known, "request_id", "left").select("request_id", F.col("_hit").isNotNull().alias("labeled"))


# --- training rows -----------------------------------------------------------------------------


def finetune_rows(scans: DataFrame, labeled_only: bool = True) -> DataFrame:
    """Non-blank messages with the target text; an unlabeled row gets the target ``safe``."""
    rows = scans.filter(F.col("label").isNotNull()) if labeled_only else scans
    spoken = F.filter(
        F.col("messages"), lambda m: m["content"].isNotNull() & F.rlike(m["content"], F.lit(unicode_regex(r"\S")))
    )
    unsafe = F.col("label") == "unsafe"
    named = unsafe & (F.coalesce(F.col("label_category"), F.lit("")) != "")
    target = (
        F.when(named, F.concat(F.lit("unsafe\n"), F.col("label_category")))
        .when(unsafe, F.lit("unsafe"))
        .otherwise(F.lit("safe"))
    )
    return rows.select(
        spoken.alias("messages"),
        target.alias("target"),
        F.struct(
            "request_id", "regex_threat_level", "guard_safe", "is_disagreement",
            F.lit(TRAINING_SOURCE).alias("source"),
        ).alias("metadata"),
    )


RAW_COLUMNS = (
    "request_id", "messages", "label", "label_category", "label_notes", "regex_threat_level", "regex_match_count",
    "regex_matches", "guard_safe", "guard_category_code", "guard_confidence", "is_disagreement", "client_id",
    "model", "event_ts",
)


def raw_rows(scans: DataFrame, labeled_only: bool = True) -> DataFrame:
    rows = scans.filter(F.col("label").isNotNull()) if labeled_only else scans
    return rows.select(*RAW_COLUMNS)


def oldest_first(scans: DataFrame, limit: int | None = None) -> DataFrame:
    """Oldest rows first: all, or as many as asked for."""
    ordered = scans.orderBy("event_ts", "request_id")
    return ordered if limit is None else ordered.limit(limit)


def export_training(rows: DataFrame, path: str) -> None:
    """JSON lines, one file per task."""
    rows.write.mode("errorifexists").json(path)


# --- PII events --------------------------------------------------------------------------------


def pii_events(requests: DataFrame, was_scrubbed: bool = False) -> DataFrame:
    """One row per detection in requests with a ``messages`` array; the value leaves only as a hash."""
    turns = requests.select(
        "request_id", "event_ts", "client_id", "model", "task",
        F.posexplode("messages").alias("message_index", "_m"),
    )
    found = evaluate_once(turns, "_d", detections(F.col("_m.content")))
    return found.select(
        "request_id", "event_ts", "client_id", "model", "task", "message_index",
        F.col("_m.role").alias("message_role"),
        F.explode("_d").alias("_hit"),
    ).select(
        "request_id", "event_ts", "client_id", "model", "task",
        F.col("_hit.pii_type").alias("pii_type"),
        "message_index", "message_role",
        F.col("_hit.start").alias("position_start"),
        F.col("_hit.end").alias("position_end"),
        F.sha2("_hit.value", 256).alias("value_hash"),
        F.lit(was_scrubbed).alias("was_scrubbed"),
    )


def part_pii_events(requests: DataFrame, was_scrubbed: bool = False) -> DataFrame:
    """The same for messages whose content is an array of parts: ``messages array<struct<role,parts array<struct<type,text>>>>``.

    Positions count inside the part ``part_index``.
    """
    about = ["request_id", "event_ts", "client_id", "model", "task"]
    turns = requests.select(*about, F.posexplode("messages").alias("message_index", "_m"))
    parts = turns.select(*about, "message_index", F.col("_m.role").alias("message_role"), F.posexplode("_m.parts").alias("part_index", "_p"))
    found = evaluate_once(parts.filter(F.col("_p.type") == "text"), "_d", detections(F.col("_p.text")))
    return found.select(*about, "message_index", "message_role", "part_index", F.explode("_d").alias("_hit")).select(
        *about, F.col("_hit.pii_type").alias("pii_type"), "message_index", "message_role", "part_index",
        F.col("_hit.start").alias("position_start"), F.col("_hit.end").alias("position_end"),
        F.sha2("_hit.value", 256).alias("value_hash"), F.lit(was_scrubbed).alias("was_scrubbed"),
    )


def list_pii_events(
    events: DataFrame, limit: int = 50, pii_type: str | None = None, client_id: str | None = None
) -> DataFrame:
    rows = events
    if pii_type:
        rows = rows.filter(F.col("pii_type") == pii_type)
    if client_id:
        rows = rows.filter(F.col("client_id") == client_id)
    return rows.orderBy(F.desc("event_ts"), "request_id", "message_index", "position_start").limit(limit)


def pii_stats(
    events: DataFrame, hours: int = 24, as_of: datetime | None = None, approximate: bool = False
) -> DataFrame:
    """Totals of a period. Distinct counts are exact unless approximation is asked for."""
    rows = since_hours(events, hours, as_of)
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    total = F.count(F.lit(1))
    return rows.agg(
        total.alias("total_detections"),
        F.count_if("was_scrubbed").alias("scrubbed_count"),
        (total - F.count_if("was_scrubbed")).alias("flagged_only_count"),
        distinct("request_id").alias("unique_requests"),
        distinct("value_hash").alias("unique_values"),
    )


def pii_by_type(events: DataFrame, hours: int = 24, as_of: datetime | None = None) -> DataFrame:
    return since_hours(events, hours, as_of).groupBy("pii_type").agg(F.count(F.lit(1)).alias("detections"))
