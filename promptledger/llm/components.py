"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptledger.llm.common import stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hang the larger (or smaller) neighbours of every node on its smallest one."""
    both = edges.select("a", "b") if small else edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # In small stars a > b always holds, so a's neighbours are its smaller ones.
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    joined = both.join(least, "a")
    if small:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
    else:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node in ``edges`` (columns a, b of one ordered type)."""
    now = stored(
        edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b")).distinct()
        seen = mark
        now = stored(_star(_star(now, small=False), small=True), "edges")
