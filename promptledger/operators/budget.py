"""Token budgets: tiers, weighted ledgers, states, and the exact replay of admissions."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from datetime import date

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptledger.functions.globs import glob_match
from promptledger.functions.requests import or_default
from promptledger.operators.ordered import has_dense, running, time_bucket
from promptledger.session import cut_lineage, scratch_path

# Fixed values.
DEFAULT_DAILY_LIMIT = 1_000_000
DEFAULT_COST_MULTIPLIER = 5.0
UNCLASSIFIED = "unclassified"


# --- tiers -------------------------------------------------------------------------------------


def resolve_tiers(
    models: DataFrame,
    assignments: DataFrame,
    tiers: DataFrame,
    default_multiplier: float = DEFAULT_COST_MULTIPLIER,
) -> DataFrame:
    """Tier of every distinct model: exact name first, then glob, each in declared order.

    ``assignments`` (ord, pattern, tier) and ``tiers`` (name, cost_multiplier, daily_limit) are
    configuration of at most a few hundred rows and travel as one array; case is ignored. A match
    that names a missing tier ends the search without a tier.
    """
    rules = assignments.agg(F.array_sort(F.collect_list(F.struct("ord", "pattern", "tier")))).scalar()
    known = tiers.agg(
        F.map_from_entries(F.collect_list(F.struct("name", F.struct("name", "cost_multiplier", "daily_limit"))))
    ).scalar()
    distinct = models.select("model").filter(F.col("model") != "").distinct().withColumn("_rules", rules)
    exact = F.filter("_rules", lambda r: F.lower(r["pattern"]) == F.lower(F.col("model")))
    by_glob = F.filter("_rules", lambda r: glob_match(F.col("model"), r["pattern"], fold_case=True))
    chosen = F.coalesce(F.get(exact, F.lit(0)), F.get(by_glob, F.lit(0)))["tier"]
    out = distinct.withColumn("_known", known).withColumn("_tier", F.try_element_at("_known", chosen))
    return out.select(
        "model",
        F.col("_tier.name").alias("tier"),
        F.coalesce(F.col("_tier.cost_multiplier"), F.lit(float(default_multiplier))).alias("cost_multiplier"),
        F.col("_tier.daily_limit").alias("tier_daily_limit"),
        F.col("_tier").isNotNull().alias("classified"),
    )


def with_tiers(requests: DataFrame, resolved: DataFrame, default_multiplier: float = DEFAULT_COST_MULTIPLIER) -> DataFrame:
    out = requests.join(resolved, "model", "left")
    return out.withColumn(
        "cost_multiplier", F.coalesce("cost_multiplier", F.lit(float(default_multiplier)))
    ).withColumn("classified", F.coalesce("classified", F.lit(False)))


def weighted(tokens: Column, multiplier: Column) -> Column:
    """Weight of one record, cut to a whole number."""
    return (tokens * multiplier).cast("bigint")


def classification_report(
    catalog_models: DataFrame, classified: DataFrame, default_multiplier: float = DEFAULT_COST_MULTIPLIER
) -> DataFrame:
    """Every model of the catalog or of the classification, with defaults where none is known."""
    names = catalog_models.select("model").distinct()
    joined = names.join(classified.withColumn("_known", F.lit(True)), "model", "full_outer")
    return joined.select(
        "model",
        "tier",
        F.coalesce("cost_multiplier", F.lit(float(default_multiplier))).alias("cost_multiplier"),
        F.coalesce("classified", F.lit(False)).alias("classified"),
    ).orderBy("model")


# --- ledger ------------------------------------------------------------------------------------


def charges(requests: DataFrame, include_stream: bool = True) -> DataFrame:
    """Rows that are charged: positive tokens; streamed ones can be left out."""
    rows = requests.filter(F.col("tokens") > 0)
    if not include_stream:
        rows = rows.filter(~F.coalesce("stream", F.lit(False)))
    return (
        rows.withColumn("weighted_tokens", weighted(F.col("tokens"), F.col("cost_multiplier")))
        .withColumn("tier", F.coalesce("tier", F.lit(UNCLASSIFIED)))
        .withColumn("usage_day", F.to_date("event_ts"))
    )


def ledger(charged: DataFrame) -> DataFrame:
    """Running weighted total and request count per key and UTC day."""
    return running(
        charged,
        ["key", "usage_day"],
        [F.col("event_ts"), F.col("request_id")],
        time_bucket(F.col("event_ts")),
        sums={"running_tokens": F.col("weighted_tokens"), "running_requests": F.lit(1)},
    )


def ledger_by_tier(charged: DataFrame) -> DataFrame:
    return charged.groupBy("key", "usage_day", "tier").agg(
        F.sum("weighted_tokens").alias("weighted_tokens"), F.count(F.lit(1)).alias("request_count")
    )


def budget_state(charged: DataFrame, daily_limit: int = DEFAULT_DAILY_LIMIT, overrides: DataFrame | None = None) -> DataFrame:
    """Used, remaining, reset time, percent and colour band per key and day.

    ``overrides`` (key, daily_limit_override): 0 counts as not set; a limit of 0 means unlimited.
    """
    used = charged.groupBy("key", "usage_day").agg(
        F.sum("weighted_tokens").alias("tokens_used"), F.count(F.lit(1)).alias("request_count")
    )
    return _state(used, daily_limit, overrides)


def budget_view(charged: DataFrame, daily_limit: int = DEFAULT_DAILY_LIMIT, overrides: DataFrame | None = None) -> DataFrame:
    """The state per key and day with ``tier_usage``, the weighted tokens by tier (a map of one entry per tier)."""
    used = ledger_by_tier(charged).groupBy("key", "usage_day").agg(
        F.sum("weighted_tokens").alias("tokens_used"),
        F.sum("request_count").alias("request_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("tier", "weighted_tokens")))).alias("tier_usage"),
    )
    return _state(used, daily_limit, overrides)


def _state(used: DataFrame, daily_limit: int, overrides: DataFrame | None) -> DataFrame:
    if overrides is None:
        used = used.withColumn("daily_limit", F.lit(daily_limit).cast("bigint"))
    else:
        used = used.join(overrides, "key", "left").withColumn(
            "daily_limit", or_default(F.col("daily_limit_override"), daily_limit).cast("bigint")
        ).drop("daily_limit_override")
    limited = F.col("daily_limit") > 0
    left = F.greatest(F.lit(0), F.col("daily_limit") - F.col("tokens_used"))
    out = used.withColumn("tokens_remaining", F.when(limited, left).otherwise(F.lit(0)))
    out = out.withColumn(
        "used_pct", F.when(limited, F.col("tokens_used") / F.col("daily_limit") * 100).otherwise(F.lit(0.0))
    )
    band = F.when(F.col("used_pct") > 90, "red").when(F.col("used_pct") > 70, "yellow").otherwise("green")
    return out.withColumn("band", band).withColumn("resets_at", F.date_add("usage_day", 1).cast("timestamp"))


def tier_totals(charged: DataFrame) -> DataFrame:
    """Raw tokens per capped or uncapped tier and day against the cap."""
    rows = charged.filter("classified")
    out = rows.groupBy("tier", "usage_day").agg(
        F.sum("tokens").alias("raw_tokens"), F.max("tier_daily_limit").alias("tier_daily_limit")
    )
    over = F.coalesce(
        (F.col("tier_daily_limit") > 0) & (F.col("raw_tokens") > F.col("tier_daily_limit")), F.lit(False)
    )
    return out.withColumn("over_cap", over)


def tier_running(charged: DataFrame) -> DataFrame:
    """Running raw tokens per tier and day over all keys."""
    return running(
        charged.filter("classified"),
        ["tier", "usage_day"],
        [F.col("event_ts"), F.col("request_id")],
        time_bucket(F.col("event_ts")),
        sums={"running_raw_tokens": F.col("tokens")},
    )


def drop_stale(usage: DataFrame, as_of_day: date | None = None) -> DataFrame:
    """Ledger rows of the reference day only."""
    day = F.lit(as_of_day) if as_of_day is not None else usage.agg(F.max("usage_day")).scalar()
    return usage.filter(F.col("usage_day") == day)


def usage_by_key(charged: DataFrame, daily_limit: int = DEFAULT_DAILY_LIMIT) -> DataFrame:
    """Per key: use by tier as a map (one entry per tier), totals; largest first."""
    per_tier = charged.groupBy("key", "tier").agg(
        F.sum("weighted_tokens").alias("_tokens"), F.count(F.lit(1)).alias("_requests")
    )
    out = per_tier.groupBy("key").agg(
        F.sum("_tokens").alias("tokens_used"),
        F.sum("_requests").alias("request_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("tier", "_tokens")))).alias("tier_usage"),
    )
    left = F.greatest(F.lit(0), F.lit(daily_limit) - F.col("tokens_used")) if daily_limit > 0 else F.lit(0)
    return (
        out.withColumn("daily_limit", F.lit(daily_limit).cast("bigint"))
        .withColumn("tokens_remaining", left.cast("bigint"))
        .orderBy(F.desc("tokens_used"), "key")
    )


# --- admission replay --------------------------------------------------------------------------

#: ``asked``: a request to be decided; the others are charges that are known to be admitted.
_REPLAY = ("request_id", "key", "tier", "tier_daily_limit", "start_ts", "end_ts", "raw", "cost", "raw_estimate", "estimate", "state", "asked")
#: Rounds that bracket what is used before the rest is folded. It decides how much is folded, never a result.
ROUNDS = 2


def _capped() -> Column:
    return F.coalesce(F.col("tier_daily_limit") > 0, F.lit(False))


def _used_at_start(rows: DataFrame, checks: Column, dense: bool = True) -> DataFrame:
    """The checked rows, with the least and most that the key and the tier can have used when each starts.

    Every request gives its charge and its check to the account of its key, and to that of its capped tier if it has one; all
    accounts of all days are summed in one pass. The row travels with its key's check, and the tier's sums are joined to it.
    """
    none = F.lit(0).cast("bigint")

    def used(rows: DataFrame, kind: str, amount: str, carried: list[Column]) -> DataFrame:
        spends = (F.col("state") != "denied") & (F.col(amount) > 0)
        sure = F.when(F.col("state") == "admitted", F.col(amount)).otherwise(none)

        def entry(at: str, is_check: bool, low: Column, high: Column) -> Column:
            return F.struct(
                F.col(kind).alias("owner"), F.to_date(at).alias("day"), F.col(at).alias("at"), F.lit(is_check).alias("is_check"),
                low.alias("low"), high.alias("high"), *([F.when(F.lit(is_check), F.struct(*carried)).alias("row")] if carried else []))

        moves = F.array_compact(F.array(
            F.when(spends, entry("end_ts", False, sure, F.col(amount))), F.when(checks, entry("start_ts", True, none, none))))
        return running(
            rows.select("request_id", F.inline(moves)),
            ["owner", "day"],
            [F.col("at"), F.col("request_id"), (~F.col("is_check")).cast("int")],
            time_bucket(F.col("at")),
            sums={f"{kind}_low": F.col("low"), f"{kind}_high": F.col("high")},
            dense=dense,
        ).filter("is_check")

    by_key = used(rows, "key", "cost", [F.col(c) for c in _REPLAY]).select("row.*", "key_low", "key_high")
    by_tier = used(rows.filter(_capped()), "tier", "raw", []).select(F.col("request_id").alias("_of"), "tier_low", "tier_high")
    return by_key.join(by_tier, F.col("request_id").eqNullSafe(F.col("_of")), "left").drop("_of")


def _has_dense_account(rows: DataFrame) -> bool:
    """Whether an account has more moves in one time bucket than are put in order together, whatever is decided."""

    def moves(kind: str) -> list[Column]:
        return [F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("owner"), F.col(at).alias("at")) for at in ("start_ts", "end_ts")]

    every = F.when(_capped(), F.array(*moves("key"), *moves("tier"))).otherwise(F.array(*moves("key")))
    return has_dense(rows.select(F.inline(every)), ["kind", "owner"], time_bucket(F.col("at")))


def _stored(rows: DataFrame) -> DataFrame:
    """The rows by way of the shared folder, by column, so that each pass reads what it needs."""
    path = scratch_path(rows.sparkSession, "replay")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _components(open_rows: DataFrame) -> DataFrame:
    """``open_rows`` with ``component``: rows whose decisions can depend on each other have the same one.

    An account (a key or a capped tier on a day) is live if one of its checks is undecided by it. Rows that check or charge the
    same live account belong together. Live days of one account that a row spans are one run; runs of tiers, at most
    tiers times days, are joined where a run of a key or a row touches several, by one small task.
    """
    days = {"checked": F.to_date("start_ts"), "charged": F.to_date("end_ts")}

    def runs(kind: str, undecided: str, used: Column) -> tuple[DataFrame, Column]:
        owner = F.concat(F.lit(f"{kind}:"), F.coalesce(F.concat(F.lit("="), F.col(kind)), F.lit("")))
        mine = open_rows.filter(used).select("request_id", owner.alias("_owner"), F.col(undecided).alias("_undecided"), *[d.alias(n) for n, d in days.items()])
        live = mine.filter("_undecided").select(F.col("_owner").alias("_o"), F.col("checked").alias("_day")).distinct()
        touched = mine.select("request_id", "_owner", F.explode(F.array_distinct(F.array("checked", "charged"))).alias("_at"))
        touched = touched.join(live, (F.col("_owner") == F.col("_o")) & (F.col("_at") == F.col("_day")))
        spans = touched.groupBy("request_id", "_owner").agg(F.min("_day").alias("_first"), F.max("_day").alias("_last"))
        by_day = spans.groupBy("_owner", "_first").agg(F.max("_last").alias("_upto"))
        before = Window.partitionBy("_owner").orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
        upto_now = Window.partitionBy("_owner").orderBy("_first").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        starts = F.when(F.coalesce(F.max("_upto").over(before) < F.col("_first"), F.lit(True)), F.col("_first"))
        named = by_day.withColumn("_start", starts).select("_owner", "_first", F.concat("_owner", F.lit("|"), F.max("_start").over(upto_now)).alias(f"{kind}_run"))
        return spans.join(named, ["_owner", "_first"]).select("request_id", f"{kind}_run")

    keys = runs("key", "key_undecided", F.lit(True))
    tiers = runs("tier", "tier_undecided", _capped())
    placed = cut_lineage(open_rows.join(keys, "request_id", "left").join(tiers, "request_id", "left"))
    pairs = placed.filter("key_run is not null and tier_run is not null").select("key_run", "tier_run").distinct()
    joined = pairs.groupBy("key_run").agg(F.min("tier_run").alias("a"), F.collect_set("tier_run").alias("b"))
    links = joined.select("a", F.explode("b").alias("b")).distinct()

    def roots(edges: pd.DataFrame) -> pd.DataFrame:
        above: dict[str, str] = {}

        def root(x: str) -> str:
            while above.setdefault(x, x) != x:
                above[x] = x = above[above[x]]
            return x

        for a, b in zip(edges["a"], edges["b"], strict=True):
            one, two = sorted((root(a), root(b)))
            above[two] = one
        return pd.DataFrame({"tier_run": list(above), "root": [root(x) for x in above]})

    found = links.groupBy().applyInPandas(roots, "tier_run string, root string")
    of_keys = pairs.join(found, "tier_run").groupBy("key_run").agg(F.min("root").alias("key_root"))
    return (
        placed.join(found, "tier_run", "left").join(of_keys, "key_run", "left")
        .withColumn("component", F.coalesce("key_root", "root", "tier_run", "key_run", "request_id"))
        .drop("key_run", "tier_run", "root", "key_root")
    )


def _fold(daily_limit: int):
    """Decide the rows of one component after the other, in order of their checks.

    ``key_low`` and ``tier_low`` hold what all others have used for sure. State is what admitted rows of the component add to it on
    the current day, and those that have not ended yet.
    """

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, day, used, running_now = None, 0, {}, []
        names = ("component", "_start", "request_id", "key", "tier", "_capped", "_day", "_end", "_end_day", "key_low", "tier_low", "estimate", "raw_estimate", "cost", "raw", "tier_daily_limit")
        for batch in batches:
            states = []
            for c, start, rid, key, tier, capped, on, end, end_day, key_low, tier_low, estimate, raw_estimate, cost, raw, cap in zip(
                *(batch.column(n).to_pylist() for n in names), strict=True
            ):
                if c != component:
                    component, day, used, running_now = c, on, {}, []
                while running_now and running_now[0][:2] < (start, rid):
                    for account, amount in heapq.heappop(running_now)[2]:
                        used[account] = used.get(account, 0) + amount
                if on != day:
                    day, used = on, {a: n for a, n in used.items() if a[2] >= on}
                over = daily_limit > 0 and estimate is not None and key_low + used.get(("key", key, on), 0) + estimate > daily_limit
                over = over or capped and tier_low + used.get(("tier", tier, on), 0) + raw_estimate > cap
                states.append("denied" if over else "admitted")
                if not over:
                    charges = [(("key", key, end_day), cost or 0)] + ([(("tier", tier, end_day), raw)] if capped else [])
                    heapq.heappush(running_now, (end, rid, charges))
            columns = [batch.column(n) if n != "state" else pa.array(states, pa.string()) for n in _REPLAY]
            yield pa.RecordBatch.from_arrays(columns, list(_REPLAY))

    return decide


def replay_admissions(
    requests: DataFrame, daily_limit: int = DEFAULT_DAILY_LIMIT, enforce_pre_request: bool = True
) -> DataFrame:
    """Which requests a daily budget would have admitted, exactly.

    Input: request_id (unique), key, tier, tier_daily_limit, cost_multiplier, tokens,
    estimated_tokens, start_ts, end_ts. A request is checked at its start against what had been
    charged by then and is charged at its end, only if admitted: weighted tokens against the key
    limit, raw tokens against the tier cap, which is shared by all keys. Moments that coincide are ordered by request id.

    Whether a request is admitted depends on earlier decisions, but only where an account is contested. ``ROUNDS`` rounds
    bracket the use that every open request can see between sure and possible charges, over all days, keys and tiers together; requests on
    which both bounds agree are decided. The first admits all outside of contested stretches, the second denies those that
    exceed a limit in any case. What is still open then are the requests near a limit: those that share a contested account, directly or
    through others, are folded in order of time with bounded state. The number of jobs does not depend on the data.
    """
    return decisions(replay(open_requests(requests), daily_limit if enforce_pre_request else 0), daily_limit if enforce_pre_request else 0)


def open_requests(requests: DataFrame) -> DataFrame:
    """Requests as rows of a replay."""
    return requests.select(
        "request_id", "key", "tier", "tier_daily_limit", "start_ts", "end_ts",
        F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("bigint").alias("raw"),
        weighted(F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)), F.col("cost_multiplier")).alias("cost"),
        F.coalesce("estimated_tokens", F.lit(0)).cast("bigint").alias("raw_estimate"),
        weighted(F.coalesce("estimated_tokens", F.lit(0)), F.col("cost_multiplier")).alias("estimate"),
        F.lit("open").alias("state"), F.lit(True).alias("asked"),
    )


def _over(side: str, limit: int) -> tuple[Column, Column]:
    """Whether the key's limit and the tier's cap would be exceeded."""
    key_over = F.lit(limit > 0) & (F.col(f"key_{side}") + F.col("estimate") > F.lit(limit))
    tier_over = _capped() & (F.col(f"tier_{side}") + F.col("raw_estimate") > F.col("tier_daily_limit"))
    return F.coalesce(key_over, F.lit(False)), F.coalesce(tier_over, F.lit(False))


def replay(rows: DataFrame, limit: int) -> DataFrame:
    """The asked ones of ``rows``, each admitted or denied, with what key and tier had used before (``key_low``, ``tier_low``).

    A ``limit`` of 0 leaves keys without one.
    """
    is_open = F.col("state") == "open"
    low, high = _over("low", limit), _over("high", limit)
    current = _stored(rows)
    copies = current.filter(is_open).groupBy("request_id").agg(F.count(F.lit(1)).alias("copies"))
    if not copies.filter("copies > 1").isEmpty() or not current.filter(is_open & (F.col("end_ts") < F.col("start_ts"))).isEmpty():
        raise ValueError("request_id must be unique and end_ts must not be before start_ts")
    dense = _has_dense_account(current)
    for _ in range(ROUNDS):
        decided = F.when(low[0] | low[1], "denied").when(~high[0] & ~high[1], "admitted").otherwise("open")
        seen = _stored(_used_at_start(current, is_open, dense).withColumn("state", decided).select(*_REPLAY))
        current = seen.unionByName(current.filter(~is_open))

    near = _used_at_start(current, is_open, dense).withColumns({"key_undecided": high[0] & ~low[0], "tier_undecided": high[1] & ~low[1]})
    placed = _components(_stored(near)).withColumns({
        "_start": F.unix_micros("start_ts"), "_end": F.unix_micros("end_ts"), "_capped": _capped(),
        "_day": F.unix_date(F.to_date("start_ts")), "_end_day": F.unix_date(F.to_date("end_ts")),
    })
    folded = placed.repartition("component").sortWithinPartitions("component", "_start", "request_id").mapInArrow(_fold(limit), current.schema)
    current = _stored(folded).unionByName(current.filter(~is_open))

    return _used_at_start(current, F.col("asked"), dense)


def decisions(final: DataFrame, limit: int) -> DataFrame:
    """Result columns of a replay."""
    key_over, tier_over = _over("low", limit)
    kind = F.when(key_over, F.lit("daily_key_limit")).when(
        tier_over, F.concat(F.lit("daily_tier_limit:"), F.col("tier"))
    )
    return final.select(
        "request_id", "key", "tier", "start_ts",
        (F.col("state") == "admitted").alias("admitted"),
        kind.alias("budget_type"),
        F.col("key_low").alias("key_used"),
        F.col("tier_low").alias("tier_used"),
        F.col("estimate").alias("weighted_estimate"),
        F.when(F.col("state") == "admitted", F.col("cost")).otherwise(F.lit(0)).alias("charged_tokens"),
    )
