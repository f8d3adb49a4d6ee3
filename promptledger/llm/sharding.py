"""Sharding by proportional stratified interleaving.

Rows of each source are put in the order of a seeded hash and ranked; the rank as a fraction of the source's size is the
row's place in the whole sequence. Every stretch of that sequence holds the sources in their proportions, so equal cuts
give shards of equal row counts (at most one apart) that all match the mixture.

No window holds a source or the sequence: ranks are counted inside narrow ranges of the hash, then of the fraction, and
shifted by the number of rows in the ranges before.

Cases: null and empty texts, null sources and null ids are rows like any other (a null source is one source); texts of any length are
only hashed; rows that tie by hash are ordered by id, and rows that repeat id and text follow each other in either order; fewer rows than
shards leave the last shards empty; an empty table gives an empty result; other columns of any name are carried as they are, but for
``place``, ``shard`` and ``slot``, which are the result's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptledger.llm.common import HASH_BITS, spread_hash, stored

#: Rows that one range holds on average; it decides the number of ranges only, never a result.
ROWS_PER_RANGE = 8192
SOURCE_BITS = 32


def _before(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows in the ranges before each range."""
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    return counts.withColumn("__before", F.sum("__n").over(w.orderBy(order)) - F.col("__n"))


def interleave(docs: DataFrame, shards: int, seed: str = "0", carry: Sequence[str] = (), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id``, ``source``, ``place`` (from 0), ``shard`` and ``slot`` (from 0 in each shard) of every row, with the columns in ``carry``."""
    rows = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), spread_hash(seed, F.col(doc_id), F.col(text)).alias("__hash"),
            *(F.col(f"`{c}`") for c in carry if c not in ("doc_id", "source", "place", "shard", "slot")),
        ),
        "interleave",
    )
    total = rows.count()
    bits = max(4, (total // ROWS_PER_RANGE).bit_length())
    ranges = 1 << bits

    ranged = rows.withColumn("__range", F.shiftright("__hash", HASH_BITS - bits))
    counts = ranged.groupBy("source", "__range").agg(F.count("*").alias("__n"))
    offsets = _before(counts, ["source"], "__range").withColumn("__of_source", F.sum("__n").over(W.partitionBy("source"))).select(
        F.col("source").alias("__s"), F.col("__range").alias("__r"), "__before", "__of_source")
    rank = F.row_number().over(W.partitionBy("source", "__range").orderBy("__hash", "doc_id")) + F.col("__before")
    # A source's ranks start at its own fraction of a step, so that small sources do not all meet in the middle.
    start = F.conv(F.substring(F.md5(F.coalesce(F.col("source"), F.lit(""))), 1, SOURCE_BITS // 4), 16, 10).cast("double") / float(1 << SOURCE_BITS)
    placed = (
        ranged.join(offsets, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")))
        .withColumn("__rank", rank)
        .withColumn("__fraction", (F.col("__rank") - 1 + start) / F.col("__of_source"))
        .drop("__s", "__r", "__range", "__before", "__of_source", "__rank")
        .withColumn("__range", F.floor(F.col("__fraction") * ranges))
    )
    placed = stored(placed, "fractions")
    before = _before(placed.groupBy("__range").agg(F.count("*").alias("__n")), [], "__range").select(F.col("__range").alias("__r"), "__before")
    place = F.row_number().over(W.partitionBy("__range").orderBy("__fraction", F.col("source").asc_nulls_last(), "__hash", "doc_id")) + F.col("__before") - 1
    return (
        placed.join(before, F.col("__range") == F.col("__r"))
        .withColumn("place", place)
        .withColumn("shard", F.expr(f"place * {shards} div {max(total, 1)}").cast("int"))
        .withColumn("slot", F.col("place") - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}"))
        .drop("__r", "__range", "__before", "__fraction", "__hash")
    )


def write_shards(docs: DataFrame, path: str, shards: int, seed: str = "0") -> None:
    """Write all columns of ``docs`` as one folder per shard; rows are sorted by slot inside each file."""
    out = interleave(docs, shards, seed, carry=docs.columns)
    out.repartitionByRange("place").sortWithinPartitions("place").write.partitionBy("shard").parquet(path)
