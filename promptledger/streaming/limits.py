"""Continuous rate limits and budgets: keyed state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from promptledger.operators.ratelimit import MICROS, RateLimits, decide

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

LIMIT_DECISION = "key string, request_id string, start_us bigint, allowed boolean, limit_hit string, retry_after double"
BUDGET_STATE = (
    "key string, request_id string, start_us bigint, usage_day bigint, tier string, admitted boolean, "
    "used_before bigint, tier_tokens bigint"
)
DAY_US = 86_400 * MICROS


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


class _InTimeOrder(StatefulProcessor):
    """Keeps rows in state until the watermark has passed them and decides them in order of time and id.

    A row that comes late, but within the delay, is thus decided in its place, whatever batch brings it. State holds the
    rows of a key that are younger than the watermark; a source that reads few files per trigger bounds them.
    """

    ROW = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.ROW)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            frame = frame[self.columns()].astype(object).where(frame[self.columns()].notna(), None)
            self.pending.appendList([tuple(r) for r in frame.itertuples(index=False)])
            earliest = int(frame["start_us"].min())
            first = earliest if first is None else min(first, earliest)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, ready = [], []
        for r in self.pending.get() if self.pending.exists() else ():
            (ready if int(r[0]) < passed else waiting).append(tuple(r))
        if waiting:
            self.pending.put(waiting)
            self.handle.registerTimer(min(int(r[0]) for r in waiting) // 1000 + 1)
        else:
            self.pending.clear()
        if ready:
            yield self.decided(key[0], sorted(ready, key=lambda r: (int(r[0]), r[1])), passed)
        self.forget(passed)

    @classmethod
    def columns(cls) -> list[str]:
        return [part.split()[0] for part in cls.ROW.split(", ")]

    def decided(self, key: str, ready: list[tuple], passed: int) -> pd.DataFrame:
        raise NotImplementedError

    def forget(self, passed: int) -> None:
        """Drop state that no later row can need."""

    def close(self) -> None:
        pass


class _Limiter(_InTimeOrder):
    """Accepted times of the last hour per key, in order."""

    ROW = "start_us bigint, request_id string, rpm int"

    def __init__(self, limits: RateLimits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.accepted = handle.getListState("accepted", "us bigint")

    def decided(self, key: str, ready: list[tuple], passed: int) -> pd.DataFrame:
        accepted = [int(t[0]) for t in self.accepted.get()] if self.accepted.exists() else []
        out = []
        for us, request_id, rpm in ready:
            hit, retry, _ = decide(accepted, int(us), int(rpm or self.limits.per_minute), self.limits)
            out.append((key, request_id, int(us), hit is None, hit, retry))
        if accepted:
            self.accepted.put([(t,) for t in accepted])
            self.handle.registerTimer((accepted[-1] + self.limits.hour_window * MICROS) // 1000 + 1)
        else:
            self.accepted.clear()
        return pd.DataFrame(out, columns=["key", "request_id", "start_us", "allowed", "limit_hit", "retry_after"])

    def forget(self, passed: int) -> None:
        if self.accepted.exists() and all(int(t[0]) + self.limits.hour_window * MICROS <= passed for t in self.accepted.get()):
            self.accepted.clear()


def limit_stream(requests: DataFrame, limits: RateLimits = RateLimits(), delay: str = "10 minutes") -> DataFrame:
    """Decisions on a stream of requests (key, request_id, start_ts, optional rpm_override).

    A decision is emitted when the watermark has passed the request, so rows up to ``delay`` late count in their place.
    """
    use_rocksdb(requests.sparkSession)
    rpm = F.col("rpm_override").cast("int") if "rpm_override" in requests.columns else F.lit(None).cast("int")
    rows = requests.withWatermark("start_ts", delay).select(
        "key", "request_id", "start_ts", F.unix_micros("start_ts").alias("start_us"), rpm.alias("rpm")
    )
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Limiter(limits), outputStructType=LIMIT_DECISION, outputMode="Append", timeMode="EventTime"
    )


class _Budget(_InTimeOrder):
    """Weighted tokens per tier of the current UTC day, one key at a time."""

    ROW = "start_us bigint, request_id string, tier string, cost bigint, estimate bigint"

    def __init__(self, daily_limit: int):
        self.daily_limit = daily_limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.by_tier = handle.getMapState("by_tier", "day bigint, tier string", "tokens bigint")

    def decided(self, key: str, ready: list[tuple], passed: int) -> pd.DataFrame:
        used: dict[tuple[int, str], int] = {(int(k[0]), k[1]): int(v[0]) for k, v in self.by_tier.iterator()}
        totals: dict[int, int] = {}
        for (day, _), tokens in used.items():
            totals[day] = totals.get(day, 0) + tokens
        out = []
        for us, request_id, tier, cost, estimate in ready:
            day, cost = int(us) // DAY_US, int(cost or 0)
            before = totals.get(day, 0)
            admitted = self.daily_limit <= 0 or before + int(estimate or 0) <= self.daily_limit
            slot = (day, tier)
            if admitted and cost > 0:
                used[slot] = used.get(slot, 0) + cost
                totals[day] = before + cost
            out.append((key, request_id, int(us), day, tier, admitted, before, used.get(slot, 0)))
        # Every call on state is a round trip, and later rows start at ``passed`` or after it.
        for (day, tier), tokens in used.items():
            if day >= passed // DAY_US:
                self.by_tier.updateValue((day, tier), (tokens,))
        for day in totals:
            if day >= passed // DAY_US:
                self.handle.registerTimer((day + 1) * DAY_US // 1000)
        return pd.DataFrame(
            out,
            columns=["key", "request_id", "start_us", "usage_day", "tier", "admitted", "used_before", "tier_tokens"],
        )

    def forget(self, passed: int) -> None:
        for day, tier in [k for k, _ in self.by_tier.iterator()]:
            if int(day) < passed // DAY_US:
                self.by_tier.removeKey((day, tier))


def budget_stream(requests: DataFrame, daily_limit: int, delay: str = "10 minutes") -> DataFrame:
    """Key budgets on a stream (key, request_id, start_ts, tier, cost, estimate), reset at midnight UTC.

    A request is decided when the watermark has passed it, and charged right when it is admitted. Tier caps, which hold over
    all keys, and charges at the end of a request are ``streaming.budgets.replay_budget_stream``'s.
    """
    use_rocksdb(requests.sparkSession)
    rows = requests.withWatermark("start_ts", delay).select(
        "key", "request_id", "start_ts", F.unix_micros("start_ts").alias("start_us"),
        F.coalesce("tier", F.lit("unclassified")).alias("tier"), "cost", "estimate",
    )
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Budget(daily_limit), outputStructType=BUDGET_STATE, outputMode="Append", timeMode="EventTime"
    )
