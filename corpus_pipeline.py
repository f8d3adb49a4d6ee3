"""The corpus pipeline: toxicity, line dedup, near duplicates, mixing to target weights, piece ids.

Every stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and returns a DataFrame that is
written as Parquet and read again as the next one's input. All but the last return the columns of ``documents``. Rows of null
id are documents like any other; of a class of near duplicates they are the last choice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptledger.llm import jaccard, line_dedup, mixing, sentencepiece, toxicity
from promptledger.llm.common import scratch, word_count
from promptledger.llm.queries import MIX_REPEATS, MIX_SHARE, MIX_WEIGHTS, TOXIC_FROM, held_out, prepared

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A line run of this many words that occurs earlier goes.
MIN_RUN_WORDS = 50
#: Near duplicates share four fifths of their five-word shingles.
SHINGLE_WORDS, SIMILAR = 5, (80, 100)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels that are not held out, scores below the threshold."""
    prepared(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    return toxicity.score(docs.select(*COLUMNS), model, out="__toxic").filter(F.col("__toxic") < TOXIC_FROM).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs; a document of which nothing is left was a copy and goes."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS), MIN_RUN_WORDS, removed="__removed")
    return out.filter((F.col("__removed") == 0) | (F.col("text") != "")).withColumn(
        "n_chars", F.when(F.col("__removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the one of the smallest id, nulls last, then of the smallest hash of its text.

    Each row is decided by itself, also where an id is null or repeated. Texts without words are in no class; of these, rows that
    repeat an id and a text are one.
    """
    prepared(spark)
    rows = docs.select(*COLUMNS)
    of_text = F.xxhash64("text")
    key = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), of_text.alias("of_text"))
    classes = jaccard.near_duplicates(rows.select(key.alias("doc_id"), "text"), SHINGLE_WORDS, *SIMILAR)
    odd = (
        classes.groupBy(F.col("doc_id.id").alias("__id"), F.col("doc_id.of_text").alias("__of_text"))
        .agg(F.bool_or(F.col("doc_id") != F.col("component_id")).alias("__later"),
             (F.count(F.when((F.col("n_shingles") > 0) | ~F.col("doc_id.unknown"), 1)) > 1).alias("__twice")).filter("__later or __twice")
    )
    kept = rows.join(odd, F.col("doc_id").eqNullSafe(F.col("__id")) & (of_text == F.col("__of_text")), "left").filter("__later is null or not __later")
    return kept.filter("__twice is null or not __twice").select(*COLUMNS).unionByName(
        kept.filter("__twice").select(*COLUMNS).dropDuplicates(["doc_id", "text"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs.select(*COLUMNS), word_count(F.col("text")), MIX_WEIGHTS, MIX_SHARE, MIX_REPEATS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix, and whether they decode to its text."""
    prepared(spark)
    out = sentencepiece.round_trip(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "source", F.size("ids").cast("bigint").alias("n_ids"), "ids", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Learned scores and piece ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    prepared(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
