"""Continuous budgets with tier caps: every micro-batch is a batch replay that starts from the balances of the one before.

A request is decided when the newest start seen is ``delay`` past its own, so late rows count in their place; rows that come later than
that are set aside under ``late``. Between batches a folder keeps the requests that wait, the admitted ones whose charge
is still to come, and what every key and capped tier has used on days that later requests can see. A batch that is run again
replaces what it wrote. Caps hold over all keys; no key or tier has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from promptledger.operators.budget import DEFAULT_DAILY_LIMIT, decisions, open_requests, replay
from promptledger.session import cut_lineage
from promptledger.streaming.sinks import write_batch

BALANCE = "owner_key string, owner_tier string, tier_daily_limit bigint, day date, cost bigint, raw bigint"


def _us(name: str) -> Column:
    return F.unix_micros(name)


def _charges(admitted: DataFrame) -> DataFrame:
    """What admitted requests add to the accounts of their last day."""
    none = F.lit(None).cast("string")
    no_cap, nothing = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
    of_key = F.struct(F.col("key").alias("owner_key"), none.alias("owner_tier"), no_cap.alias("tier_daily_limit"), F.col("cost"), nothing.alias("raw"))
    of_tier = F.struct(none.alias("owner_key"), F.col("tier").alias("owner_tier"), F.col("tier_daily_limit"), nothing.alias("cost"), F.col("raw"))
    return admitted.select(F.to_date("end_ts").alias("day"), F.inline(F.array(of_key, of_tier))).select("owner_key", "owner_tier", "tier_daily_limit", "day", "cost", "raw")


def _opening(balances: DataFrame, schema) -> DataFrame:
    """Balances as charges at the start of their day, before everything else of that moment."""
    midnight = F.col("day").cast("timestamp")
    made = {
        "request_id": F.lit(""), "key": F.col("owner_key"), "tier": F.col("owner_tier"), "start_ts": midnight, "end_ts": midnight,
        "raw_estimate": F.lit(0), "estimate": F.lit(0), "state": F.lit("admitted"), "asked": F.lit(False),
    }
    return balances.select(*[made.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema])


def replay_budget_stream(requests: DataFrame, path: str, daily_limit: int = DEFAULT_DAILY_LIMIT, delay_seconds: int = 600) -> DataStreamWriter:
    """Writer of the decisions on a stream of requests (columns as for ``operators.budget.replay_admissions``) to ``path``/decisions."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = cut_lineage(open_requests(batch))
        before = f"{path}/{{}}/batch_id={batch_id - 1}"
        first = batch_id == 0
        kept = {name: None if first else spark.read.schema(new.schema).parquet(before.format(name)) for name in ("waiting", "running")}
        balances = spark.createDataFrame([], BALANCE) if first else spark.read.schema(BALANCE).parquet(before.format("balances"))
        last = None if first else spark.read.parquet(before.format("horizon")).first()[0]
        newest = new.agg(F.max(_us("start_ts"))).first()[0]
        horizon = max((x for x in (last, None if newest is None else newest - delay_seconds * 1_000_000) if x is not None), default=None)

        too_late = F.lit(False) if last is None else F.coalesce(_us("start_ts") < last, F.lit(False))
        rows = new.filter(~too_late)
        rows = rows if first else rows.unionByName(kept["waiting"])
        is_ready = F.lit(False) if horizon is None else F.coalesce(_us("start_ts") < horizon, F.lit(False))
        carried = _opening(balances, new.schema)
        carried = carried if first else carried.unionByName(kept["running"])
        final = cut_lineage(replay(rows.filter(is_ready).unionByName(carried), daily_limit))
        admitted = final.filter("state = 'admitted'").select(*new.columns).withColumn("asked", F.lit(False))
        admitted = admitted if first else admitted.unionByName(kept["running"])
        runs_on = F.lit(True) if horizon is None else _us("end_ts") >= horizon
        total = balances.unionByName(_charges(admitted.filter(~runs_on))).groupBy("owner_key", "owner_tier", "tier_daily_limit", "day").agg(
            F.sum("cost").alias("cost"), F.sum("raw").alias("raw"))
        if horizon is not None:
            total = total.filter((F.col("day") >= F.to_date(F.timestamp_micros(F.lit(horizon)))) & ((F.col("cost") > 0) | (F.col("raw") > 0)))
        for name, table in (
            ("late", new.filter(too_late)), ("decisions", decisions(final, daily_limit)), ("waiting", rows.filter(~is_ready)),
            ("running", admitted.filter(runs_on)), ("balances", total), ("horizon", spark.createDataFrame([(horizon,)], "horizon_us bigint")),
        ):
            write_batch(table, f"{path}/{name}", batch_id)

    return requests.writeStream.foreachBatch(step)
