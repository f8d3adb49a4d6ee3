"""Counters, histograms and concurrency derived from the audit log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptledger.functions.errors import error_category
from promptledger.functions.identifiers import clean_metric_label
from promptledger.operators.ordered import running, time_bucket

# Upper bounds of the histogram buckets.
LATENCY_BOUNDS = (5, 10, 25, 50, 75, 100, 150, 200, 300, 400, 500, 750, 1000, 1500, 2000, 3000, 5000, 7500, 10000, 15000, 30000, 60000)
TTFT_BOUNDS = (5, 10, 25, 50, 75, 100, 150, 200, 300, 500, 750, 1000, 2000, 5000)
TOKENS_PER_SECOND_BOUNDS = (1, 5, 10, 20, 30, 40, 50, 75, 100, 150, 200, 300, 500)


def with_labels(audit: DataFrame) -> DataFrame:
    """Cleaned label columns: provider, model, task, status."""
    return audit.select(
        clean_metric_label(F.col("endpoint")).alias("provider"),
        clean_metric_label(F.col("model")).alias("model"),
        clean_metric_label(F.col("task")).alias("task"),
        clean_metric_label(F.col("status")).alias("status"),
        clean_metric_label(F.col("error_code")).alias("error_type"),
        F.col("error_code").isNotNull().alias("has_error"),
        "prompt_tokens", "completion_tokens", "latency_ms", "time_to_first_token_ms", "tokens_per_second",
    )


def counters(audit: DataFrame) -> DataFrame:
    """Request and token counters per label set."""
    return with_labels(audit).groupBy("provider", "model", "task", "status").agg(
        F.count(F.lit(1)).alias("requests_total"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("tokens_prompt_total"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("tokens_completion_total"),
        F.count_if("has_error").alias("errors_total"),
    )


def error_counters(audit: DataFrame) -> DataFrame:
    rows = with_labels(audit).filter("has_error")
    return rows.groupBy("provider", "error_type").agg(F.count(F.lit(1)).alias("errors_total"))


def histogram(df: DataFrame, labels: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """Rows (labels, le, cumulative count, sum, count); ``+Inf`` last. One pass, one small shuffle."""
    observed = df.filter(F.col(value).isNotNull())
    summed = observed.groupBy(*labels).agg(
        *[F.count_if(F.col(value) <= F.lit(float(b))).alias(f"_b{i}") for i, b in enumerate(bounds)],
        F.count(value).alias("observation_count"),
        F.sum(value).alias("observation_sum"),
    )
    buckets = [
        F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{i}").alias("cumulative_count")) for i, b in enumerate(bounds)
    ]
    buckets.append(F.struct(F.lit("+Inf").alias("le"), F.col("observation_count").alias("cumulative_count")))
    return summed.select(*labels, "observation_count", "observation_sum", F.inline(F.array(*buckets)))


def concurrency(requests: DataFrame, provider: str = "endpoint") -> DataFrame:
    """In-flight requests per provider after each moment something started or ended.

    Needs ``start_ts`` and ``end_ts``. Starts and ends at one moment are netted before the shuffle.
    """
    moves = requests.select(
        provider,
        F.inline(
            F.array(
                F.struct(F.col("start_ts").alias("moment"), F.lit(1).alias("delta")),
                F.struct(F.col("end_ts").alias("moment"), F.lit(-1).alias("delta")),
            )
        ),
    )
    net = moves.groupBy(provider, "moment").agg(F.sum("delta").alias("delta"))
    return running(net, [provider], [F.col("moment")], time_bucket(F.col("moment")), sums={"in_flight": F.col("delta")}).drop("delta")


def peak_concurrency(requests: DataFrame, provider: str = "endpoint") -> DataFrame:
    return concurrency(requests, provider).groupBy(provider).agg(F.max("in_flight").alias("peak_in_flight"))


def error_breakdown(audit: DataFrame) -> DataFrame:
    """Errors per provider, code and category."""
    rows = audit.filter(F.col("error_code").isNotNull())
    return rows.groupBy(
        F.col("endpoint").alias("provider"), "error_code", error_category(F.col("error_code")).alias("category")
    ).agg(F.count(F.lit(1)).alias("error_count"))
