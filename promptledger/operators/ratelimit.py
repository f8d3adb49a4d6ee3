"""Sliding-window rate limits over request logs: demand, and the exact replay of decisions."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptledger.functions.requests import or_default
from promptledger.operators.ordered import _join_on

MICROS = 1_000_000


@dataclass(frozen=True)
class RateLimits:
    """Requests per window; a window holds requests younger than its length."""

    burst: int = 10
    per_minute: int = 60
    per_hour: int = 1000
    # Window lengths in seconds.
    burst_window: int = 10
    minute_window: int = 60
    hour_window: int = 3600

    @property
    def windows(self) -> tuple[tuple[str, int, int], ...]:
        return (
            ("burst", self.burst_window, self.burst),
            ("minute", self.minute_window, self.per_minute),
            ("hour", self.hour_window, self.per_hour),
        )


def _demand_counts(rows: DataFrame, limits: RateLimits) -> DataFrame:
    """Requests of the key in each window up to now, the current one included.

    Every request gives a point at its moment and one probe at the lower end of each window; a running count over the points gives the
    requests in the window as a difference, so the time grows with the rows however dense they are. Keys are cut into
    stretches of four long windows; the last window of a stretch is copied to the next one, so counts are complete and no key has to fit
    into one task. One shuffle by (key, stretch) serves the counts, the differences and the places.
    """
    reach = limits.hour_window * MICROS
    stretch = 4 * reach
    own = F.floor(F.col("_us") / F.lit(stretch))
    late = F.col("_us") % F.lit(stretch) >= stretch - reach
    numbered = rows.withColumn("_own", own).withColumn("_row", F.monotonically_increasing_id())
    spread = numbered.select(
        "key", "_us", "_own", "_row", F.struct(*rows.columns).alias("_all"), F.explode(F.when(late, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))).alias("_stretch"))
    here, nothing = F.col("_stretch") == F.col("_own"), F.lit(None).cast(spread.schema["_all"].dataType)
    one = F.struct(F.lit("own").alias("kind"), F.col("_us").alias("at"), F.lit(1).alias("n"), F.when(here, F.col("_all")).alias("all"))
    probes = [
        F.when(here, F.struct(F.lit(name).alias("kind"), (F.col("_us") - seconds * MICROS).alias("at"), F.lit(0).alias("n"), nothing.alias("all")))
        for name, seconds, _ in limits.windows
    ]
    points = spread.select("key", "_stretch", "_own", "_us", "_row", F.explode(F.array_compact(F.array(one, *probes))).alias("p"))
    upto = F.sum("p.n").over(Window.partitionBy("key", "_stretch").orderBy("p.at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    counted = points.withColumn("_upto", upto).filter("_stretch = _own").groupBy("key", "_stretch", "_us", "_row").agg(
        F.first("p.all", ignorenulls=True).alias("_all"),
        *[F.max(F.when(F.col("p.kind") == kind, F.col("_upto"))).alias(f"_{kind}") for kind in ("own", *[w[0] for w in limits.windows])]
    )
    # Requests of the same moment count for each other; in a replay only those with a smaller id came first.
    moment = Window.partitionBy("key", "_stretch", "_us")
    later = F.count(F.lit(1)).over(moment) - F.row_number().over(moment.orderBy("_all.request_id"))
    return counted.select("_all.*", *[(F.col("_own") - F.col(f"_{name}")).alias(f"{name}_demand") for name, _, _ in limits.windows], later.alias("_later"))


def demand(requests: DataFrame, limits: RateLimits = RateLimits()) -> DataFrame:
    """Requests per key in the last burst window, minute and hour, and what is left of each limit."""
    rows = _demand_counts(requests.withColumn("_us", F.unix_micros("start_ts")), limits)
    for name, _, limit in limits.windows:
        rows = rows.withColumn(f"{name}_remaining", F.greatest(F.lit(0), F.lit(limit) - F.col(f"{name}_demand")))
    return rows.drop("_us", "_later")


def decide(accepted: list[int], now: int, rpm: int, limits: RateLimits) -> tuple[str | None, float | None, list[int]]:
    """Decision for one request: limit hit, seconds to wait, requests seen per window.

    ``accepted`` holds the accepted times of the key in order, in microseconds; times older than
    the longest window are dropped and ``now`` is added when it is accepted.
    """
    gone = bisect_right(accepted, now - limits.hour_window * MICROS)
    if gone:
        del accepted[:gone]
    hit, retry, counts = None, None, []
    for name, seconds, limit in limits.windows:
        first = bisect_right(accepted, now - seconds * MICROS)
        counts.append(len(accepted) - first)
        if hit is None and counts[-1] >= (rpm if name == "minute" else limit):
            hit = name
            retry = max(0.1, seconds - (now - accepted[first]) / MICROS)
    if hit is None:
        accepted.append(now)
    return hit, retry, counts


def _fold(limits: RateLimits):
    """Replay sorted rows, one stretch after the other.

    State is the accepted times of the last hour of the current stretch, so memory is bounded by
    the hourly limit however long a stretch is.
    """

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stretch, accepted = None, []
        for batch in batches:
            out = []
            for key, cluster, now, rpm in zip(batch["key"], batch["_cluster"], batch["_us"], batch["_rpm"]):
                if (key, cluster) != stretch:
                    stretch, accepted = (key, cluster), []
                hit, retry, counts = decide(accepted, int(now), int(rpm), limits)
                out.append((hit is None, hit, retry, *counts))
            decided = pd.DataFrame(
                out, columns=["allowed", "limit_hit", "retry_after", "burst_count", "minute_count", "hour_count"],
                index=batch.index,
            )
            yield pd.concat([batch[["key", "request_id", "start_ts"]], decided, batch["_history"]], axis=1)

    return replay


DECISION = (
    "key string, request_id string, start_ts timestamp, allowed boolean, limit_hit string, retry_after double, "
    "burst_count bigint, minute_count bigint, hour_count bigint"
)


def replay_limits(requests: DataFrame, limits: RateLimits = RateLimits()) -> DataFrame:
    """Decision for every request (request_id, key, start_ts, optional rpm_override).

    Only accepted requests occupy a window, so decisions depend on earlier ones. They can only
    differ from plain counting near moments when demand exceeds a limit. Those moments are found
    with window counts, neighbouring busy hours are joined to stretches, and just the rows of
    these stretches, cut to key, time and id, are folded in order; quiet time separates stretches,
    so a stretch starts with nothing unknown. All other requests are accepted without leaving the JVM.
    """
    override = F.col("rpm_override") if "rpm_override" in requests.columns else F.lit(None).cast("int")
    rows = requests.select(
        "key", "request_id", "start_ts",
        F.unix_micros("start_ts").alias("_us"),
        or_default(override, limits.per_minute).cast("int").alias("_rpm"),
    )
    hour = F.floor(F.col("_us") / F.lit(limits.hour_window * MICROS))
    counted = _demand_counts(rows, limits).withColumn("_hour", hour)
    busy = (
        (F.col("burst_demand") > limits.burst)
        | (F.col("minute_demand") > F.col("_rpm"))
        | (F.col("hour_demand") > limits.per_hour)
    )
    # Hours with excess demand, plus the hour before (history) and after (their counts still see it).
    hours = counted.filter(busy).select("key", "_hour").distinct()
    near = hours.select("key", F.explode(F.array(F.col("_hour") - 1, F.col("_hour"), F.col("_hour") + 1)).alias("_hour")).distinct()
    by_hour = Window.partitionBy("key").orderBy("_hour")
    jump = F.when(F.col("_hour") - F.lag("_hour").over(by_hour) > 1, 1).otherwise(0)
    # The first hour of a stretch is only history: what its own windows see lies before the stretch,
    # where demand was below the limits, so for its requests plain counting is right.
    history = (F.col("_jump") == 1) | F.lag("_hour").over(by_hour).isNull()
    stretches = (
        near.withColumn("_jump", jump)
        .withColumn("_history", history)
        .withColumn("_cluster", F.sum("_jump").over(by_hour))
        .drop("_jump")
    )

    placed = counted.join(stretches, ["key", "_hour"], "left")
    quiet = placed.filter(F.coalesce("_history", F.lit(True))).select(
        "key", "request_id", "start_ts",
        F.lit(True).alias("allowed"),
        F.lit(None).cast("string").alias("limit_hit"),
        F.lit(None).cast("double").alias("retry_after"),
        *[(F.col(f"{n}_demand") - F.col("_later") - 1).alias(f"{n}_count") for n, _, _ in limits.windows],
    )
    contended = (
        _join_on(rows.withColumn("_hour", hour), stretches, ["key", "_hour"])
        .select("key", "_cluster", "_us", "request_id", "start_ts", "_rpm", "_history")
        .repartition("key", "_cluster")
        .sortWithinPartitions("key", "_cluster", "_us", "request_id")
        .mapInPandas(_fold(limits), DECISION + ", _history boolean")
        .filter(~F.col("_history"))
        .drop("_history")
        .withColumn("retry_after", F.when(F.col("limit_hit").isNotNull(), F.col("retry_after")))
    )
    return quiet.unionByName(contended)


def remaining(limit: Column | int, count: Column) -> Column:
    """What an accepted request leaves of a limit."""
    return (limit if isinstance(limit, Column) else F.lit(limit)) - count - 1
