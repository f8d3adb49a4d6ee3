"""Mixing sources to target weights by hash thresholds.

Every document gets a hash. A source gives its documents whole as often as its target allows, and once more those whose
hash lies below a threshold. The threshold is found without sorting: sizes are summed by source and leading hash digit,
the digit in which the running sum crosses the wanted words is kept, and only its rows are summed by the next digit.
Thresholds for several budgets are nested: a smaller mix is contained in a larger one.

Cases: null and empty texts have size 0 and are kept with ``taken`` 0; a null source is a source of its own, ordered last; an empty
table gives an empty mix. Rows that repeat id, source and text share one hash and are taken alike, as are others that tie by hash;
sources that tie in their level are ordered by name. No limit applies to documents, sources or sizes: texts of any length are
counted whole. ``mixed_documents`` keeps all columns. Sources are counted in thousands, so their table may be ordered in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptledger.llm.common import HASH_BITS, spread_hash, stored

#: Bits of the hash that one histogram resolves.
DIGIT_BITS = 15
TOP = 1 << HASH_BITS


def sized(docs: DataFrame, size: Column, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The narrow table of the mix: id, source, size and hash, written once to the shared folder."""
    return stored(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.cast("bigint").alias("size"),
            spread_hash(F.col(doc_id), F.col(text)).alias("hash"),
        ),
        "mix-sizes",
    )


def source_targets(rows: DataFrame, weights: Sequence[float], budgets: Mapping[str, float], max_repeats: float = 2.0) -> DataFrame:
    """Target of each source in each budget (a multiple of all sizes).

    Weights repeat over the sources in code-point order, null last. No target exceeds ``max_repeats`` times its source's
    size; what is cut off goes to the other sources by weight. With sources ordered by size per weight those at their cap
    come first, so the common level (words per unit of weight) is the largest that any start of the uncapped part gives.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size")).select("*", weight.alias("weight"))
    shares = F.explode(F.array(*(F.struct(F.lit(k).alias("budget"), F.lit(float(v)).alias("share")) for k, v in budgets.items())))
    every = W.partitionBy("budget")
    ascending = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    return (
        sizes.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
        .select("*", shares.alias("b")).select("source", "source_size", "weight", "cap", "b.*")
        .withColumn("total", F.col("share") * F.sum("source_size").over(every))
        .withColumn("capped", F.sum("cap").over(ascending) - F.col("cap"))
        .withColumn("weights", F.sum("weight").over(every) - F.sum("weight").over(ascending) + F.col("weight"))
        .withColumn("level", F.max((F.col("total") - F.col("capped")) / F.col("weights")).over(every))
        .select("budget", "source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))
    )


def _crossed(sums: DataFrame) -> DataFrame:
    """Of each budget and source, the digit in which the running sum reaches the wanted words."""
    run = W.partitionBy("budget", "source").orderBy("digit")
    return (
        sums.withColumn("upto", F.col("before") + F.sum("words").over(run))
        .withColumn("was", F.col("upto") - F.col("words"))
        .filter((F.col("was") < F.col("wanted")) & (F.col("upto") >= F.col("wanted")))
        .select("budget", "source", "wanted", F.col("was").alias("before"), F.col("digit").alias("prefix"), "words")
    )


def hash_thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``full`` (whole passes over the source) and ``threshold`` (hashes below it are taken once more) per budget and source."""
    goals = targets.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn(
        "wanted", F.col("target") - F.col("full") * F.col("source_size")
    )
    state = goals.select("budget", F.col("source").alias("of"), "wanted", F.lit(0.0).alias("before"))
    on = F.col("source").eqNullSafe(F.col("of"))
    for shift in range(HASH_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        digit = F.shiftright("hash", shift)
        if shift == HASH_BITS - DIGIT_BITS:
            sums = rows.groupBy("source", digit.alias("digit")).agg(F.sum("size").alias("words")).join(state, on)
        else:
            inside = rows.withColumn("top", F.shiftright("hash", shift + DIGIT_BITS))
            sums = (
                inside.join(state, on & (F.col("top") == F.col("prefix")))
                .groupBy("budget", "source", "wanted", "before", digit.alias("digit")).agg(F.sum("size").alias("words"))
            )
        state = _crossed(sums).withColumnRenamed("source", "of")
    # The last digit is one hash value; its documents come in if more than half of them fits.
    inclusive = (2 * F.col("before") + F.col("words") < 2 * F.col("wanted")).cast("bigint")
    found = state.select(F.col("budget").alias("b"), "of", (F.col("prefix") + inclusive).alias("found"))
    return goals.join(found, on & (F.col("budget") == F.col("b")), "left").select(
        "budget", "source", "source_size", "target", "full",
        F.coalesce("found", F.when(F.col("wanted") > 0, TOP).otherwise(0)).alias("threshold"),
    )


def mix(rows: DataFrame, weights: Sequence[float], budgets: Mapping[str, float], max_repeats: float = 2.0) -> DataFrame:
    """``copies`` and ``taken`` (size times copies) of each row of ``sized`` in each budget, decided by one comparison a row."""
    limits = hash_thresholds(rows, source_targets(rows, weights, budgets, max_repeats)).withColumnRenamed("source", "of")
    copies = F.col("full") + (F.col("hash") < F.col("threshold")).cast("bigint")
    return rows.join(limits, F.col("source").eqNullSafe(F.col("of"))).select(
        "budget", "doc_id", "source", "hash", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken")
    )


def mixed_documents(docs: DataFrame, size: Column, weights: Sequence[float], share: float, max_repeats: float = 2.0) -> DataFrame:
    """The documents of one mix, each as often as it is taken, with their own columns only.

    The decision is made on the narrow table; texts are read once more and meet only the table of thresholds.
    """
    rows = sized(docs, size)
    limits = stored(hash_thresholds(rows, source_targets(rows, weights, {"mix": share}, max_repeats)).select(
        F.col("source").alias("__of"), F.col("full").alias("__full"), F.col("threshold").alias("__threshold")), "mix-limits")
    copies = F.col("__full") + (spread_hash(F.col("doc_id"), F.col("text")) < F.col("__threshold")).cast("bigint")
    return (
        docs.join(limits, F.col("source").eqNullSafe(F.col("__of")))
        .withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
        .select(*(f"`{c}`" for c in docs.columns))
    )
