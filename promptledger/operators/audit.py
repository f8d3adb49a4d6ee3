"""The audit log: rows, listings, statistics, daily rollups, retention."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptledger.functions.requests import filled, tokens_per_second, total_tokens
from promptledger.operators.ordered import _join_on, exact_percentiles
from promptledger.operators.paging import page
from promptledger.session import cut_lineage

RETENTION_DAYS = 90


# --- time ranges -------------------------------------------------------------------------------


def as_of_column(df: DataFrame, as_of: datetime | None, ts: str = "event_ts") -> Column:
    """The reference time: given, or the latest timestamp of the table."""
    if as_of is not None:
        return F.lit(as_of).cast("timestamp")
    return df.agg(F.max(ts)).scalar()


def since_hours(df: DataFrame, hours: int, as_of: datetime | None = None, ts: str = "event_ts") -> DataFrame:
    """Rows of the last hours, the lower end included; no upper end."""
    cutoff = as_of_column(df, as_of, ts) - F.make_interval(hours=F.lit(hours))
    recent = df.filter(F.col(ts) >= cutoff)
    return recent.filter(F.col("event_date") >= F.to_date(cutoff)) if "event_date" in df.columns else recent


def _where(df: DataFrame, **equal: str | None) -> DataFrame:
    for name, value in equal.items():
        if value:
            df = df.filter(F.col(name) == value)
    return df


# --- writing -----------------------------------------------------------------------------------


def audit_rows(
    requests: DataFrame, store_request_body: bool = False, store_response_body: bool = False
) -> DataFrame:
    """Complete audit rows: token total, speed, error text (empty counts as none), event date, bodies only when allowed."""
    out = (
        requests.withColumn("total_tokens", total_tokens(F.col("prompt_tokens"), F.col("completion_tokens")))
        .withColumn("event_date", F.to_date("event_ts"))
    )
    if "error_message" in out.columns:
        out = out.withColumn("error_message", filled(F.col("error_message")))
    if "tokens_per_second" not in out.columns:
        out = out.withColumn("tokens_per_second", tokens_per_second(F.col("completion_tokens"), F.col("latency_ms")))
    return keep_bodies(out, store_request_body, store_response_body)


def keep_bodies(df: DataFrame, store_request_body: bool, store_response_body: bool) -> DataFrame:
    """Privacy switch: null the bodies that must not be stored."""
    for name, keep in (("request_body", store_request_body), ("response_body", store_response_body)):
        if name in df.columns and not keep:
            df = df.withColumn(name, F.lit(None).cast(df.schema[name].dataType))
    return df


def append_audit(rows: DataFrame, path: str) -> None:
    """Append to the audit table, one folder per day; rows of a day are spread over many tasks."""
    rows.write.mode("append").partitionBy("event_date").parquet(path)


# --- listings ----------------------------------------------------------------------------------


def recent_requests(
    audit: DataFrame,
    limit: int = 100,
    client_id: str | None = None,
    environment: str | None = None,
    status: str | None = None,
) -> DataFrame:
    rows = _where(audit, client_id=client_id, environment=environment, status=status)
    return rows.orderBy(F.desc("event_ts"), "request_id").limit(limit)


def request_page(
    audit: DataFrame,
    limit: int = 50,
    offset: int = 0,
    client_id: str | None = None,
    environment: str | None = None,
    status: str | None = None,
) -> DataFrame:
    """One page of summaries, newest first, with the number of all matching rows. Starts jobs (see ``paging``)."""
    rows, total = page(_where(audit, client_id=client_id, environment=environment, status=status), limit, offset)
    return rows.select(
        "request_id", "event_ts", "client_id", "user_id", "environment", "task", "model", "endpoint", "status",
        "latency_ms", "prompt_tokens", "completion_tokens", "total_tokens", "error_code",
        F.lit(total).cast("bigint").alias("total_matches"),
    )


def request_by_id(audit: DataFrame, request_id: str) -> DataFrame:
    return audit.filter(F.col("request_id") == request_id)


# --- statistics --------------------------------------------------------------------------------

_SUCCESS = "status = 'success'"


def _usage_measures() -> list[Column]:
    success = F.count_if(F.expr(_SUCCESS))
    return [
        F.count(F.lit(1)).alias("request_count"),
        success.alias("success_count"),
        (F.count(F.lit(1)) - success).alias("error_count"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms"),
    ]


def period_stats(
    audit: DataFrame, hours: int = 24, client_id: str | None = None, as_of: datetime | None = None
) -> DataFrame:
    """All totals of a period in one pass."""
    rows = _where(since_hours(audit, hours, as_of), client_id=client_id)
    total, success = F.count(F.lit(1)), F.count_if(F.expr(_SUCCESS))
    return rows.agg(
        total.alias("total_requests"),
        success.alias("success_count"),
        (total - success).alias("error_count"),
        F.round(F.when(total > 0, success / total * 100).otherwise(0.0), 2).alias("success_rate"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms"),
        F.round(F.min("latency_ms"), 2).alias("min_latency_ms"),
        F.round(F.max("latency_ms"), 2).alias("max_latency_ms"),
        F.round(F.coalesce(F.sum("estimated_cost_usd"), F.lit(0.0)), 4).alias("total_cost_usd"),
    )


def requests_by_endpoint(audit: DataFrame, hours: int = 24, as_of: datetime | None = None) -> DataFrame:
    """Requests per endpoint and their share of all, in percent."""
    rows = since_hours(audit, hours, as_of)
    counts = rows.groupBy("endpoint").agg(F.count(F.lit(1)).alias("request_count"))
    total = counts.agg(F.sum("request_count")).scalar()
    return counts.withColumn("share_pct", F.col("request_count") / total * 100)


def top_models(audit: DataFrame, hours: int = 24, n: int = 10, as_of: datetime | None = None) -> DataFrame:
    counts = since_hours(audit, hours, as_of).groupBy("model").agg(F.count(F.lit(1)).alias("request_count"))
    return counts.orderBy(F.desc("request_count"), "model").limit(n)


def usage_by(audit: DataFrame, dimension: str, hours: int = 24, as_of: datetime | None = None) -> DataFrame:
    """Usage per model or per endpoint."""
    rows = since_hours(audit, hours, as_of)
    return rows.groupBy(dimension).agg(*_usage_measures()).orderBy(F.desc("request_count"), dimension)


# --- rollups -----------------------------------------------------------------------------------


def daily_rollup(audit: DataFrame, day: str | None = None) -> DataFrame:
    """Usage per day, client, endpoint and model; one day when asked."""
    rows = audit.withColumn("usage_date", F.to_date("event_ts"))
    if day is not None:
        start = F.lit(day).cast("timestamp")
        rows = rows.filter((F.col("event_ts") >= start) & (F.col("event_ts") < start + F.expr("interval 1 day")))
    return rows.groupBy("usage_date", "client_id", "endpoint", "model").agg(
        F.count(F.lit(1)).alias("request_count"),
        F.count_if(F.expr(_SUCCESS)).alias("success_count"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum("estimated_cost_usd"), F.lit(0.0)).alias("total_cost_usd"),
        F.avg("latency_ms").alias("avg_latency_ms"),
    )


FULL_ROLLUP_KEYS = ("usage_date", "client_id", "user_id", "environment", "endpoint", "model")
LATENCY_PERCENTILES: Mapping[str, float] = {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95, "p99_latency_ms": 0.99}


def full_daily_rollup(
    audit: DataFrame, keys: tuple[str, ...] = FULL_ROLLUP_KEYS, approximate: bool = False
) -> DataFrame:
    """Every declared dimension and measure. Percentiles are exact unless approximation is asked for."""
    rows = audit.withColumn("usage_date", F.to_date("event_ts"))
    success = F.count_if(F.expr(_SUCCESS))
    measures = [
        F.count(F.lit(1)).alias("request_count"),
        success.alias("success_count"),
        (F.count(F.lit(1)) - success).alias("error_count"),
        F.count_if(F.col("stream")).alias("stream_count"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("total_prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("total_completion_tokens"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum("estimated_cost_usd"), F.lit(0.0)).alias("total_cost_usd"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.min("latency_ms").alias("min_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
        F.avg("time_to_first_token_ms").alias("avg_ttft_ms"),
        F.avg("tokens_per_second").alias("avg_tokens_per_second"),
    ]
    if approximate:
        measures += [F.percentile_approx("latency_ms", p).alias(n) for n, p in LATENCY_PERCENTILES.items()]
        return rows.groupBy(*keys).agg(*measures)
    percentiles = exact_percentiles(rows, keys, "latency_ms", LATENCY_PERCENTILES)
    return _join_on(rows.groupBy(*keys).agg(*measures), percentiles, keys, "left")


def write_daily_rollup(rollup: DataFrame, path: str) -> None:
    """Replace exactly the days that the rollup holds; other days stay."""
    (
        rollup.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("usage_date")
        .parquet(path)
    )


def daily_usage(
    rollup: DataFrame, days: int = 30, client_id: str | None = None, as_of: datetime | None = None
) -> DataFrame:
    """Usage per day from the rollup. The cutoff keeps its time of day, so a partly covered first day is out."""
    midnight = F.col("usage_date").cast("timestamp")
    now = F.lit(as_of).cast("timestamp") if as_of is not None else rollup.agg(
        F.max("usage_date").cast("timestamp")
    ).scalar()
    rows = _where(rollup, client_id=client_id).filter(midnight >= now - F.make_interval(days=F.lit(days)))
    return (
        rows.groupBy("usage_date")
        .agg(
            F.sum("request_count").alias("request_count"),
            F.sum("success_count").alias("success_count"),
            F.sum("total_tokens").alias("total_tokens"),
            F.sum("total_cost_usd").alias("total_cost_usd"),
        )
        .orderBy("usage_date")
    )


# --- retention ---------------------------------------------------------------------------------


def retained(audit: DataFrame, days: int = RETENTION_DAYS, as_of: datetime | None = None) -> DataFrame:
    """Rows that are young enough. On a table with ``event_date`` folders older days are not even listed."""
    cutoff = as_of_column(audit, as_of) - F.make_interval(days=F.lit(days))
    kept = audit.filter(F.col("event_ts") >= cutoff)
    return kept.filter(F.col("event_date") >= F.to_date(cutoff)) if "event_date" in audit.columns else kept


def purge_report(audit: DataFrame, days: int = RETENTION_DAYS, as_of: datetime | None = None) -> DataFrame:
    """Rows a purge removes and keeps."""
    old = F.col("event_ts") < as_of_column(audit, as_of) - F.make_interval(days=F.lit(days))
    return audit.agg(F.count_if(old).alias("deleted_count"), F.count_if(~old).alias("kept_count"))


def purge(audit: DataFrame, path: str, days: int = RETENTION_DAYS, as_of: datetime | None = None) -> None:
    """Write the retained rows as a new table version; whole old days are never read when ``as_of`` is given."""
    retained(audit, days, as_of).write.mode("errorifexists").partitionBy("event_date").parquet(path)


def purge_in_place(spark: SparkSession, path: str, days: int = RETENTION_DAYS, as_of: datetime | None = None) -> list[date]:
    """Drop the day folders of a table at ``path`` that are older than the retention; returns the days that changed.

    Whole old days are dropped without being read, and only the day that the cutoff cuts is written again. ``as_of`` defaults to the
    newest row, looked up in the newest day.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(folder) if f.isDirectory()]
    held = sorted(date.fromisoformat(n.removeprefix("event_date=")) for n in names if n.startswith("event_date=") and n != "event_date=__HIVE_DEFAULT_PARTITION__")
    if not held:
        return []
    table = spark.read.parquet(path)
    if as_of is None:
        as_of = table.filter(F.col("event_date") == F.lit(held[-1])).agg(F.max("event_ts")).first()[0]
    cutoff = as_of - timedelta(days=days)
    changed = [d for d in held if d < cutoff.date()]
    for day in changed:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"event_date={day}"), True)
    cut = table.filter(F.col("event_date") == F.lit(cutoff.date()))
    if cutoff.date() in held and not cut.filter(F.col("event_ts") < F.lit(cutoff)).isEmpty():
        kept = cut_lineage(cut.filter(F.col("event_ts") >= F.lit(cutoff)))
        if kept.isEmpty():
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"event_date={cutoff.date()}"), True)
        else:
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)
        changed.append(cutoff.date())
    return changed


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of every table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def start_ts(event_ts: Column, latency_ms: Column) -> Column:
    """Start of a request whose row was written at completion."""
    micros = F.round(F.coalesce(latency_ms, F.lit(0.0)) * 1000).cast("bigint")
    return F.timestamp_micros(F.unix_micros(event_ts) - micros)


