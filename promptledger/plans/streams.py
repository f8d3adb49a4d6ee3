"""G: the continuous operators, run over everything that is there, result as a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptledger.operators import audit as A
from promptledger.operators import budget as B
from promptledger.plans import fixtures as X
from promptledger.plans.ingest import _ASSEMBLED_SQL, data_line_rows
from promptledger.plans.registry import ORACLES, query
from promptledger.plans.scan_tables import PII_EVENTS_SQL, SCANS_SQL
from promptledger.plans.windows import DAILY_LIMIT, LIMITER_SQL, LIMITS, budget_requests
from promptledger.session import scratch_path
from promptledger.sources.chunks import data_lines
from promptledger.streaming import limits as L
from promptledger.streaming import scan as S
from promptledger.streaming import usage as U
from promptledger.streaming.budgets import replay_budget_stream
from promptledger.streaming.sinks import run_available


CLOSING = "closing-row"


def event_stream(spark, sf):
    """The events table as a stream of audit rows, with a last row that moves the watermark past all others."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = A.audit_rows(raw.selectExpr(*X.AUDIT))
    return rows.unionByName(table_stream(spark, closing_row(X.audit(spark, sf), "event_ts").select(rows.columns), "closing"))


def closing_row(rows, time, **values):
    """One row of the same columns, two days after the newest one; its own window never closes."""
    late = rows.agg(F.max(time) + F.expr("interval 2 days")).scalar()
    one = rows.sparkSession.range(1).select(*(
        (late if f.name == time else F.lit(values.get(f.name, CLOSING if f.dataType.typeName() == "string" else None))).cast(f.dataType).alias(f.name) for f in rows.schema))
    return one


def table_stream(spark, rows, name):
    """Any table as a stream, by way of the shared folder."""
    path = scratch_path(spark, name)
    rows.write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


#: Rows of a wave on average. It decides how many micro-batches there are, never a result.
WAVE_ROWS = 1_500_000
#: Where no key's rows are held together, a micro-batch can be larger.
SPREAD_WAVE_ROWS = 6_000_000


def out_of_order(rows, time, late="9 minutes", wave_rows=WAVE_ROWS):
    """A table in waves, four at least and more with more rows; rows near a wave's end come up to ``late`` too late, a last row closes.

    The waves are written once, each to a folder of its own, so that taking one in reads no other.
    """
    seen = F.unix_micros(time) + F.pmod(F.xxhash64("request_id"), F.lit(1000)) * F.expr(f"unix_micros(timestamp '1970-01-01' + interval {late})") / 1000
    count, first, last = rows.agg(F.count(F.lit(1)), F.min(seen), F.max(seen)).first()
    waves = max(4, -(-count // wave_rows))
    part = F.floor((seen - F.lit(first)) / F.lit(last - first + 1) * waves).cast("int")
    path = scratch_path(rows.sparkSession, "waves")
    rows.withColumn("_wave", part).filter("_wave is not null").hint("rebalance", "_wave").write.partitionBy("_wave").parquet(path)
    staged = rows.sparkSession.read.schema(f"{rows.schema.toDDL()}, _wave int").parquet(path)
    return [*(staged.filter(F.col("_wave") == k).drop("_wave") for k in range(waves)), closing_row(rows, time)]


def fed(spark, waves, name, started):
    """Write one wave after the other and let the stream that ``started`` makes of their folder take each in; returns its checkpoint."""
    path = scratch_path(spark, name)
    for wave in waves:
        wave.write.mode("append").parquet(f"{path}/in")
        run_available(started(spark.readStream.schema(wave.schema).parquet(f"{path}/in"), path), f"{path}/checkpoint")
    return path


def collected_in_waves(spark, waves, name, made):
    """What the stream ``made`` of the waves' stream writes."""
    schema = []

    def started(stream, path):
        out = made(stream)
        schema[:] = [out.schema]
        return out.writeStream.format("parquet").option("path", f"{path}/out")

    path = fed(spark, waves, name, started)
    return spark.read.schema(schema[0]).parquet(f"{path}/out")


def collected(spark, stream, name):
    """Run a stream to its end and read what it wrote."""
    path = scratch_path(spark, name)
    run_available(stream.writeStream.format("parquet").option("path", f"{path}/out"), f"{path}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def _screened(spark, sf):
    path = scratch_path(spark, "screen")
    run_available(S.screen(table_stream(spark, X.requests(spark, sf), "requests"), path), f"{path}/checkpoint")
    return path


@query("g1_stream_scans", X.with_sql("select request_id, regex_threat_level, regex_match_count from scans", SCANS_SQL))
def g1(spark, sf):
    rows = spark.read.parquet(f"{_screened(spark, sf)}/scans")
    return rows.select("request_id", "regex_threat_level", "regex_match_count")


@query("g1_stream_alerts", X.with_sql("select request_id, alert_type, severity, description from alerts", SCANS_SQL))
def g1_alerts(spark, sf):
    return spark.read.parquet(f"{_screened(spark, sf)}/alerts").select("request_id", "alert_type", "severity", "description")


@query("g1_stream_pii", X.with_sql("select request_id, pii_type, position_start, value_hash from pii_events", PII_EVENTS_SQL))
def g1_pii(spark, sf):
    return spark.read.parquet(f"{_screened(spark, sf)}/pii_events").select("request_id", "pii_type", "position_start", "value_hash")


@query("g2_stream_first_writes", X.with_sql("""
select request_id, seq, epoch_us(event_ts) as event_ts from copies qualify row_number() over (partition by request_id order by event_ts, seq) = 1""",
    X.AUDIT_SQL, """copies as (
  select request_id, event_ts, 1::bigint as seq from audit
  union all select request_id, event_ts, 0 from audit where event_id % 3 = 0
  union all select request_id, event_ts - interval 5 minute, 2 from audit where event_id % 4 = 0
  union all select request_id, event_ts + interval 5 minute, 3 from audit where event_id % 5 = 0)"""))
def g2(spark, sf):
    """Up to four copies of a request, some earlier than the first to come and in later files."""
    rows = X.audit(spark, sf).select("event_id", "request_id", "event_ts")
    copies = [("1", "true", "0"), ("0", "event_id % 3 = 0", "0"), ("2", "event_id % 4 = 0", "-5"), ("3", "event_id % 5 = 0", "5")]
    every = reduce(DataFrame.union, [
        rows.filter(where).selectExpr("request_id", f"event_ts + interval {minutes} minutes as event_ts", f"cast({seq} as bigint) as seq") for seq, where, minutes in copies])
    return collected_in_waves(spark, out_of_order(every, "event_ts"), "first-writes", U.first_writes).select("request_id", "seq", "event_ts")


@query("g3_stream_daily_usage", X.with_sql("""
select event_date::varchar as usage_date, client_id, endpoint, model, count(*) as request_count,
  count(*) filter (where status = 'success') as success_count, sum(total_tokens)::bigint as total_tokens,
  round(coalesce(sum(estimated_cost_usd), 0), 6) as total_cost_usd, round(avg(latency_ms), 6) as avg_latency_ms
from audit group by all""", X.AUDIT_SQL))
def g3(spark, sf):
    return collected(spark, U.daily_usage(event_stream(spark, sf)), "daily-usage")


@query("g4_stream_limiter", X.with_sql("""
select key, request_id, us as start_us, limit_hit is null as allowed, limit_hit,
  case when limit_hit is not null then round(greatest(0.1::double, (oldest - us) / 1000000.0), 6) end as retry_after from walk""", LIMITER_SQL))
def g4(spark, sf):
    rows = X.audit(spark, sf).select(F.col("client_id").alias("key"), "request_id", F.col("event_ts").alias("start_ts"))
    return collected_in_waves(spark, out_of_order(rows, "start_ts"), "limiter", lambda stream: L.limit_stream(stream, LIMITS))


@query("g5_stream_budget", X.with_sql("""
select key, request_id, us as start_us, day as usage_day, tier, used_before <= 40000 as admitted, used_before from walk""",
    f"""recursive {X.AUDIT_SQL}, {X.TIERS_SQL},
turns as (
  select a.client_id as key, a.request_id, epoch_us(a.event_ts) as us, epoch_us(a.event_ts) // 86400000000 as day, coalesce(r.tier, 'unclassified') as tier,
    cast(trunc(a.total_tokens * r.cost_multiplier) as bigint) as cost, row_number() over (partition by a.client_id order by a.event_ts, a.request_id) as n
  from audit a join resolved r on r.model = a.model),
walk as (
  select *, 0::bigint as used_before from turns where n = 1
  union all
  select t.*, case when t.day = w.day then case when w.used_before <= 40000 then w.used_before + w.cost else w.used_before end else 0 end
  from walk w join turns t on t.key = w.key and t.n = w.n + 1)"""))
def g5(spark, sf):
    batch = X.audit(spark, sf)
    tiers = B.resolve_tiers(batch, X.assignments(spark), X.tiers(spark))
    waves = out_of_order(batch.select("client_id", "request_id", "event_ts", "model", "total_tokens"), "event_ts")

    def budget(rows):
        priced = B.with_tiers(rows, tiers).select(
            F.col("client_id").alias("key"), "request_id", F.col("event_ts").alias("start_ts"), "tier",
            B.weighted(F.col("total_tokens"), F.col("cost_multiplier")).alias("cost"), F.lit(0).cast("bigint").alias("estimate"),
        )
        return L.budget_stream(priced, DAILY_LIMIT)

    return collected_in_waves(spark, waves, "budget", budget).drop("tier_tokens")


@query("g5_stream_tier_caps", ORACLES["e4_budget_replay"])
def g5_tiers(spark, sf):
    """The batch replay's decisions, tier caps included, from a stream whose rows come out of order."""
    waves = out_of_order(budget_requests(spark, sf), "start_ts", wave_rows=SPREAD_WAVE_ROWS)
    path = fed(spark, waves, "tier-caps", lambda stream, path: replay_budget_stream(stream, path, DAILY_LIMIT))
    return spark.read.parquet(f"{path}/decisions").drop("batch_id")


@query("g6_stream_assembly", X.with_sql("""
select request_id, content_hash, chunk_count, finish_reason, total_tokens from assembled""",
    f"assembled as ({_ASSEMBLED_SQL})"))
def g6(spark, sf):
    rows = data_lines(data_line_rows(spark, sf))
    chunks = table_stream(spark, rows.unionByName(closing_row(rows, "chunk_ts")), "chunks")
    return collected(spark, U.assemble_chunks(chunks), "assembled").select(
        "request_id", F.sha2("content", 256).alias("content_hash"), "chunk_count", "finish_reason", "total_tokens"
    )


@query("g7_stream_request_rate", X.with_sql("""
select client_id, start_us as window_start, start_us + 60000000 as window_end, count(*) as request_count from (
  select client_id, event_ts, (epoch_us(event_ts) // 10000000 - k) * 10000000 as start_us from audit, range(6) r(k)) x group by client_id, start_us""", X.AUDIT_SQL))
def g7(spark, sf):
    return collected(spark, U.request_rate(event_stream(spark, sf)), "request-rate")


@query("g8_stream_rollup", X.with_sql("""
select event_date::varchar as usage_date, client_id, endpoint, model, count(*) as request_count,
  count(*) filter (where status = 'success') as success_count, sum(total_tokens)::bigint as total_tokens,
  round(coalesce(sum(estimated_cost_usd), 0), 6) as total_cost_usd, round(avg(latency_ms), 6) as avg_latency_ms
from audit group by all""", X.AUDIT_SQL))
def g8_rollup(spark, sf):
    """Every row in three waves; every fiftieth comes with the last one, days late, and still counts on its own day."""
    rows = X.audit(spark, sf)
    wave = F.expr("case when event_id % 50 = 0 then 2 when event_ts < timestamp '2024-01-16' then 0 else 1 end")
    path = fed(spark, [rows.filter(wave == k) for k in range(3)], "rollup", U.rollup_stream)
    return U.rollup_of_sums(spark, path)


@query("g8_stream_late_rows", X.with_sql("""
select 'late' as kind, count(*) as row_count from waves where wave = 2 and event_ts < (select max(event_ts) - interval 10 minute from waves where wave = 1)
union all
select 'on_time', count(*) from waves where not (wave = 2 and event_ts < (select max(event_ts) - interval 10 minute from waves where wave = 1))
union all
select 'groups', count(distinct (event_date, client_id, endpoint, model)) from waves where not (wave = 2 and event_ts < (select max(event_ts) - interval 10 minute from waves where wave = 1))""",
    X.AUDIT_SQL, "waves as (select *, case when event_ts < timestamp '2024-01-21' and event_id % 50 <> 0 then 1 else 2 end as wave from audit)"))
def g8(spark, sf):
    """Two waves; every fiftieth early row comes with the second one."""
    path = scratch_path(spark, "late-rows")
    rows = X.audit(spark, sf).withColumn(
        "wave", F.expr("case when event_ts < timestamp '2024-01-21' and event_id % 50 <> 0 then 1 else 2 end")
    )
    for wave in (1, 2):
        rows.filter(F.col("wave") == wave).drop("wave").write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.drop("wave").schema).parquet(f"{path}/in")
        run_available(U.split_late(stream, path), f"{path}/checkpoint")
    late = spark.read.parquet(f"{path}/late").agg(F.count("*").alias("row_count")).select(F.lit("late").alias("kind"), "row_count")
    rollup = U.on_time_rollup(spark, path)
    groups = rollup.agg(F.count("*").alias("row_count")).select(F.lit("groups").alias("kind"), "row_count")
    return late.unionByName(rollup.agg(F.sum("request_count").alias("row_count")).select(F.lit("on_time").alias("kind"), "row_count")).unionByName(groups)
