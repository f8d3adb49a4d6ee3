"""Scans kept by day: every day's texts are matched once, listings and statistics read the results.

A store is a folder with the tables ``scans`` (requests with their verdicts and matches) and ``pii_events``, partitioned by day, and
``days``, the days that are complete. ``update`` scans days that the store lacks and names them last, so a run that was lost repeats
whole days and replaces what it had written. A day that gets late requests is named in ``again`` and replaced.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptledger.functions.once import dealt
from promptledger.operators import scans

_DAYS = "event_day date"


def stored_days(spark: SparkSession, path: str) -> list[date]:
    """Days that are complete. The folder is made if there is none."""
    spark.createDataFrame([], _DAYS).write.mode("append").parquet(f"{path}/days")
    return sorted(r[0] for r in spark.read.schema(_DAYS).parquet(f"{path}/days").distinct().collect())


def update(requests: DataFrame, path: str, again: Iterable[date] = (), was_scrubbed: bool = False, partitions: int | None = None) -> list[date]:
    """Scan the requests of days that the store lacks, or that are wanted ``again``; returns these days.

    ``partitions`` deals requests over so many tasks by their id before the scan.
    """
    spark = requests.sparkSession
    have = set(stored_days(spark, path)) - set(again)
    dated = requests.withColumn("event_day", F.to_date("event_ts"))
    new = sorted(r[0] for r in dated.select("event_day").distinct().collect() if r[0] is not None and r[0] not in have)
    if not new:
        return []
    rows = dealt(dated.filter(F.col("event_day").isin(new)), "request_id", partitions)
    for name, made in (("scans", scans.analyze(rows)), ("pii_events", scans.pii_events(rows, was_scrubbed).withColumn("event_day", F.to_date("event_ts")))):
        # Rows of a day are put together first: a task that holds all days writes a file for each, and their number is tasks times days.
        made.hint("rebalance", "event_day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_day").parquet(f"{path}/{name}")
    spark.createDataFrame([(d,) for d in new], _DAYS).coalesce(1).write.mode("append").parquet(f"{path}/days")
    return new


def _read(spark: SparkSession, path: str, name: str, since: date | None) -> DataFrame:
    rows = spark.read.parquet(f"{path}/{name}")
    return (rows if since is None else rows.filter(F.col("event_day") >= F.lit(since))).drop("event_day")


def analyzed(spark: SparkSession, path: str, since: date | None = None) -> DataFrame:
    """What ``scans.analyze`` gave; no text is matched again. ``since`` reads the folders from that day on."""
    return _read(spark, path, "scans", since)


def pii_events(spark: SparkSession, path: str, since: date | None = None) -> DataFrame:
    return _read(spark, path, "pii_events", since)
