"""Provider health over check results, and outages of the guard model."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptledger.operators.ordered import running, time_bucket

OUTAGE_RUN = 5


def health_history(checks: DataFrame) -> DataFrame:
    """State after every check (provider, check_ts, seq, healthy).

    Consecutive failures are failures so far minus failures at the last healthy check, so both are
    plain running aggregates.
    """
    order = [F.col("check_ts"), F.col("seq")]
    bucket = time_bucket(F.col("check_ts"))
    counted = running(
        checks, ["provider"], order, bucket,
        sums={"_failures": F.when(F.col("healthy"), 0).otherwise(1)},
    )
    marked = running(
        counted, ["provider"], order, bucket,
        maxes={
            "_at_healthy": F.when(F.col("healthy"), F.col("_failures")),
            "last_healthy": F.when(F.col("healthy"), F.col("check_ts")),
        },
    )
    out = marked.withColumn(
        "consecutive_failures", F.col("_failures") - F.coalesce("_at_healthy", F.lit(0))
    )
    return out.drop("_failures", "_at_healthy")


def current_health(checks: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Latest state per provider; every measure is a plain aggregate."""
    now = F.lit(as_of).cast("timestamp") if as_of is not None else checks.agg(F.max("check_ts")).scalar()
    last_good = checks.filter("healthy").groupBy("provider").agg(F.max(F.struct("check_ts", "seq")).alias("_good"))
    # One row per provider: shuffled, all checks of a provider would be sorted in one task.
    rows = checks.join(F.broadcast(last_good), "provider", "left")
    after = F.col("_good").isNull() | (F.struct("check_ts", "seq") > F.col("_good"))
    out = rows.groupBy("provider").agg(
        F.max("check_ts").alias("last_check"),
        F.max("_good.check_ts").alias("last_healthy"),
        F.count_if(after).alias("consecutive_failures"),
    )
    healthy = (F.col("consecutive_failures") == 0) & F.col("last_healthy").isNotNull()
    return out.select(
        "provider", "last_check", "last_healthy", "consecutive_failures",
        healthy.alias("healthy"),
        F.when(healthy, "healthy").otherwise("unhealthy").alias("status"),
        ((F.unix_micros(now) - F.unix_micros("last_healthy")) / 1e6).alias("seconds_since_healthy"),
    )


def outages(calls: DataFrame, minimum: int = OUTAGE_RUN) -> DataFrame:
    """Runs of consecutive failed calls (provider, call_ts, seq, ok): start, end, length."""
    numbered = running(
        calls, ["provider"], [F.col("call_ts"), F.col("seq")], time_bucket(F.col("call_ts")),
        sums={"_run": F.when(F.col("ok"), 1).otherwise(0)},
    )
    return (
        numbered.filter(~F.col("ok"))
        .groupBy("provider", "_run")
        .agg(
            F.min("call_ts").alias("outage_start"),
            F.max("call_ts").alias("outage_end"),
            F.count(F.lit(1)).alias("failed_calls"),
        )
        .filter(F.col("failed_calls") >= minimum)
        .drop("_run")
    )
