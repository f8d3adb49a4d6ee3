"""Continuous ingest, usage windows and late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from promptledger.operators.audit import daily_rollup
from promptledger.streaming.sinks import write_batch


def first_writes(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The earliest row (event_ts, seq) per request id among copies at most ``delay`` apart.

    A row is emitted when the watermark has passed its last copy by ``delay``.
    """
    everything = F.struct(*[F.col(c) for c in rows.columns])
    kept = (
        rows.withWatermark("event_ts", delay)
        .groupBy(F.session_window("event_ts", delay).alias("_copies"), "request_id")
        .agg(F.min_by(everything, F.struct("event_ts", "seq")).alias("_row"))
    )
    return kept.select("_row.*")


def daily_usage(audit: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The daily rollup over event-time windows; a day is emitted when the watermark has passed it."""
    day = F.window("event_ts", "1 day")
    return (
        audit.withWatermark("event_ts", delay)
        .groupBy(day.alias("day"), "client_id", "endpoint", "model")
        .agg(
            F.count(F.lit(1)).alias("request_count"),
            F.count_if(F.col("status") == "success").alias("success_count"),
            F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
            F.coalesce(F.sum("estimated_cost_usd"), F.lit(0.0)).alias("total_cost_usd"),
            F.avg("latency_ms").alias("avg_latency_ms"),
        )
        .withColumn("usage_date", F.to_date("day.start"))
        .drop("day")
    )


def request_rate(audit: DataFrame, length: str = "60 seconds", step: str = "10 seconds", delay: str = "10 minutes") -> DataFrame:
    """Requests per client in sliding windows."""
    return (
        audit.withWatermark("event_ts", delay)
        .groupBy(F.window("event_ts", length, step).alias("w"), "client_id")
        .agg(F.count(F.lit(1)).alias("request_count"))
        .select("client_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "request_count")
    )


def assemble_chunks(chunks: DataFrame, gap: str = "30 seconds", delay: str = "1 minute") -> DataFrame:
    """Responses from a stream of chunks: a request ends when nothing came for ``gap``.

    Input: request_id, idx, delta, chunk_ts, finish_reason, token counts.
    """
    ordered = F.array_sort(F.collect_list(F.struct("idx", "delta")))
    usage = F.struct("idx", "prompt_tokens", "completion_tokens", "total_tokens")
    out = (
        chunks.withWatermark("chunk_ts", delay)
        .groupBy(F.session_window("chunk_ts", gap).alias("s"), "request_id")
        .agg(
            F.array_join(F.transform(ordered, lambda c: c["delta"]), "").alias("content"),
            F.min(F.when(F.col("delta") != "", F.col("chunk_ts"))).alias("first_token_ts"),
            F.count(F.lit(1)).alias("chunk_count"),
            F.max(F.when(F.col("total_tokens").isNotNull(), usage)).alias("u"),
            F.max(F.when(F.col("finish_reason").isNotNull(), F.struct("idx", "finish_reason"))).alias("f"),
        )
    )
    return out.select(
        "request_id", "content", "first_token_ts", "chunk_count", "f.finish_reason",
        "u.prompt_tokens", "u.completion_tokens", "u.total_tokens",
    )


def split_late(audit: DataFrame, path: str, delay: str = "10 minutes") -> DataStreamWriter:
    """On-time rows and late ones go to two tables, one folder per batch; ``on_time_rollup`` sums up the first.

    A row is late when it is older than the newest row of all earlier batches minus ``delay``. Each batch leaves the newest
    time so far next to the data, so a batch reads one mark and a restart continues with it.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = None
        if batch_id > 0:
            before = spark.read.schema("newest timestamp").parquet(f"{path}/high_water/batch_id={batch_id - 1}").first()["newest"]
        late = F.lit(False) if before is None else F.col("event_ts") < F.lit(before) - F.expr(f"interval {delay}")
        write_batch(batch.filter(~late), f"{path}/on_time", batch_id)
        write_batch(batch.filter(late), f"{path}/late", batch_id)
        newest = F.greatest(F.max("event_ts"), F.lit(before).cast("timestamp"))
        write_batch(batch.agg(newest.alias("newest")), f"{path}/high_water", batch_id)

    return audit.writeStream.foreachBatch(handle)


def on_time_rollup(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """The daily rollup over the on-time rows of all batches: one row per day and group, however many batches brought it."""
    return daily_rollup(spark.read.parquet(f"{path}/on_time"), day)


_GROUP = ("usage_date", "client_id", "endpoint", "model")
_SUMS = ("request_count", "success_count", "total_tokens", "total_cost_usd", "latency_sum", "latency_count")


def rollup_stream(audit: DataFrame, path: str) -> DataStreamWriter:
    """Keep the daily rollup of everything that came, late rows included: each batch adds its own sums to the days it touches.

    Sums are kept by day and batch, so a batch reads no earlier data and writes only its own days, and one that is run again
    replaces itself. ``rollup_of_sums`` merges them.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        sums = batch.withColumn("usage_date", F.to_date("event_ts")).groupBy(*_GROUP).agg(
            F.count(F.lit(1)).alias("request_count"),
            F.count_if(F.col("status") == "success").alias("success_count"),
            F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
            F.coalesce(F.sum("estimated_cost_usd"), F.lit(0.0)).alias("total_cost_usd"),
            F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("latency_sum"),
            F.count("latency_ms").alias("latency_count"),
        )
        out = sums.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("usage_date", "batch_id").parquet(f"{path}/sums")

    return audit.writeStream.foreachBatch(handle)


def rollup_of_sums(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """The daily rollup from the sums of all batches, or one day of it; other days' folders are not read."""
    parts = spark.read.parquet(f"{path}/sums")
    parts = parts if day is None else parts.filter(F.col("usage_date") == F.lit(day).cast("date"))
    merged = parts.groupBy(*_GROUP).agg(*[F.sum(c).alias(c) for c in _SUMS])
    average = F.when(F.col("latency_count") > 0, F.col("latency_sum") / F.col("latency_count"))
    return merged.withColumn("avg_latency_ms", average).drop("latency_sum", "latency_count")

