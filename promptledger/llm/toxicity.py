"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of its lower-cased characters, hashed to ``2 ** bits`` buckets. Of the training
rows, each bucket gets the log ratio of its document frequency among toxic and among clean rows. Buckets whose ratio
stands out from its own standard error are kept; a logistic regression is fitted on their ratios as feature values.

The fit uses a bounded sample of labelled rows (``toxic_rows`` and ``clean_rows``, chosen by hash; rows are weighted so that
the class balance stays that of all labels). N-gram counts of the sample are Spark aggregates; the regression runs in one
task on the kept buckets only, whose size the same bounds limit. Scoring reads every whole text.

Cases: null and empty texts score as a text without n-grams; very long texts are hashed whole, piece by piece; null labels and ids do
not train; of several labels of one id the highest counts, and of several rows of one id one trains (the least hash of a text), so the
bounds hold for rows; equal scores are no ties to break; with no labels or one class only, scores are the smoothed share of toxic
labels; an empty table gives no rows; other columns are kept, but for an older one of the score's name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptledger.llm.common import HASH_BITS, spread_hash, stored

ORDERS, BITS = (3, 4, 5), 20
#: Bounds of the training sample.
TOXIC_ROWS, CLEAN_ROWS = 8_000, 16_000
#: A kept bucket's log ratio, in standard errors and absolutely.
LEAST_Z, LEAST_RATIO = 4.0, 0.7
#: Characters hashed at once; bounds memory for very long texts.
PIECE = 1 << 20
#: Rows whose features are held at once, and features that a training step holds at once.
ROWS_TOGETHER, STRETCH = 256, 1 << 20


@dataclass(frozen=True)
class ToxicityModel:
    orders: tuple[int, ...]
    bits: int
    buckets: np.ndarray
    values: np.ndarray
    intercept: float


def gram_buckets(text: str | None, orders: Sequence[int], bits: int, mask: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of the n-grams of a whole text (only those in ``mask``); white space and both ends are blanks."""
    chars = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    longest, found = max(orders), []
    for start in range(0, len(chars), PIECE):
        piece = chars[start : start + PIECE + longest - 1]
        piece = np.where(piece <= 32, np.uint32(32), piece) * np.uint32(2654435761)
        for n in orders:
            size = min(len(piece) - n + 1, PIECE)
            if size <= 0:
                continue
            h = np.full(size, n, np.uint32)
            for k in range(n):
                h *= np.uint32(16777619)
                h ^= piece[k : k + size]
            h ^= h >> np.uint32(15)
            h *= np.uint32(2246822519)
            h >>= np.uint32(32 - bits)
            found.append(h if mask is None else h[mask[h]])
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32)


def _with_buckets(rows: DataFrame, orders: Sequence[int], bits: int) -> DataFrame:
    """Adds ``buckets`` to (toxic, weight, text)."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_TOGETHER):
                part = batch.slice(start, ROWS_TOGETHER)
                lists = [gram_buckets(t, orders, bits).astype(np.int32) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("toxic"), part.column("weight"), pa.array(lists, pa.list_(pa.int32()))], ["toxic", "weight", "buckets"])

    return rows.select("toxic", "weight", "text").mapInArrow(features, "toxic int, weight double, buckets array<int>")


def _regression(cols: np.ndarray, sizes: np.ndarray, values: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-4, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weighted logistic regression with ridge penalty, by Adam steps over the whole sample.

    Row i has the next ``sizes[i]`` of the features ``cols``; feature j has the value ``values[j]``. Rows are walked in stretches, so
    beside ``cols`` only a stretch is held.
    """
    features = len(values)
    w, m, s, b = np.zeros(features), np.zeros(features), np.zeros(features), 0.0
    weight = weight / weight.sum()
    upto = np.cumsum(sizes)
    cuts = np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, STRETCH)).tolist() + [len(y)]
    stretches = [(lo, hi, int(upto[lo] - sizes[lo]), int(upto[hi - 1])) for lo, hi in zip([0, *cuts], cuts) if lo < hi]
    for step in range(1, rounds + 1):
        own, z, grad = w * values, np.full(len(y), b), np.zeros(features)
        error = np.empty(len(y))
        for lo, hi, start, end in stretches:
            part = cols[start:end].astype(np.int64)
            z[lo:hi] += np.bincount(np.repeat(np.arange(hi - lo), sizes[lo:hi]), own[part], hi - lo)
            error[lo:hi] = weight[lo:hi] * (1 / (1 + np.exp(-np.clip(z[lo:hi], -60, 60))) - y[lo:hi])
            grad += np.bincount(part, np.repeat(error[lo:hi], sizes[lo:hi]), features)
        grad = grad * values + decay * w
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        b -= 0.5 * error.sum()
    return w, b


def fit(docs: DataFrame, labels: DataFrame, usable: Column, orders: Sequence[int] = ORDERS, bits: int = BITS, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> ToxicityModel:
    """Learn from the rows of ``labels`` (doc_id, toxic) for which ``usable`` holds."""
    known = labels.filter(usable & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    positive, negative = sizes.get(1, 0), sizes.get(0, 0)
    prior = float(np.log((positive + 1) / (negative + 1)))
    empty = ToxicityModel(tuple(orders), bits, np.empty(0, np.int64), np.empty(0), prior)
    if not positive or not negative:
        return empty
    share = F.when(F.col("toxic") == 1, min(1.0, toxic_rows / positive)).otherwise(min(1.0, clean_rows / negative))
    # At most about toxic_rows + clean_rows ids, so it may be broadcast; copies of an id are reduced before the shuffle of its one text.
    sample = known.withColumn("weight", 1 / share).filter(spread_hash("sample", F.col("doc_id")) < share * float(1 << HASH_BITS))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic", "weight").agg(
        F.min(F.struct(F.xxhash64("text"), "text")).getField("text").alias("text"))
    rows = stored(texts.select("toxic", "weight", "text"), "toxicity-sample")
    n = rows.agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).first()
    if not n["p"] or n["p"] == n["n"]:
        return empty
    pos, neg = F.col("pos"), F.col("df") - F.col("pos")
    ratio = F.log((pos + 1) / (n["p"] + 2)) - F.log((neg + 1) / (n["n"] - n["p"] + 2))
    kept = (
        _with_buckets(rows, orders, bits).select("toxic", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("df"), F.sum("toxic").alias("pos"))
        .filter(F.col("df") >= 3).select("bucket", ratio.alias("ratio"), F.sqrt(1 / (pos + 1) + 1 / (neg + 1)).alias("error"))
        .filter((F.abs("ratio") >= LEAST_RATIO) & (F.abs("ratio") >= LEAST_Z * F.col("error"))).orderBy("bucket").toPandas()
    )
    buckets, ratios = kept["bucket"].to_numpy(np.int64), kept["ratio"].to_numpy(float)
    if not len(buckets):
        return empty

    # Texts are hashed again for the kept buckets: a row's buckets are many times its text.
    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, mask = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, bool)
        place[buckets], mask[buckets] = np.arange(len(buckets)), True
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_TOGETHER):
                part = batch.slice(start, ROWS_TOGETHER)
                lists = [place[gram_buckets(t, orders, bits, mask)] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("toxic"), part.column("weight"), pa.array(lists, pa.list_(pa.int32()))], ["toxic", "weight", "places"])

    def train(sample: pa.Table) -> pa.Table:
        places = sample.column("places").combine_chunks()
        flat, sizes = places.flatten().to_numpy(), places.value_lengths().to_numpy()
        toxic, weight = sample.column("toxic").to_numpy(), sample.column("weight").to_numpy()
        ends = np.cumsum(sizes)
        # One order, whatever order the rows come in.
        content = [xxhash.xxh64_intdigest(flat[end - size : end].tobytes()) for end, size in zip(ends.tolist(), sizes.tolist(), strict=True)]
        order = np.lexsort((np.array(content, np.uint64), weight, toxic))
        cols = np.concatenate([np.empty(0, np.int32), *(flat[ends[i] - sizes[i] : ends[i]] for i in order)])
        w, b = _regression(cols, sizes[order], ratios, toxic[order].astype(float), weight[order].astype(float))
        return pa.table({"bucket": pa.array(np.append(buckets, -1), pa.int64()), "value": pa.array(np.append(w * ratios, b), pa.float64())})

    model = (
        rows.mapInArrow(restrict, "toxic int, weight double, places array<int>")
        .groupBy().applyInArrow(train, "bucket long, value double").toPandas().sort_values("bucket")
    )
    return ToxicityModel(tuple(orders), bits, model["bucket"].to_numpy()[1:], model["value"].to_numpy()[1:], float(model["value"].iloc[0]))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` with the score of each whole text; an older column of the name ``out`` gives way."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != out]

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        mask = np.zeros(1 << m.bits, bool)
        value = np.zeros(1 << m.bits, np.float32)
        mask[m.buckets] = True
        value[m.buckets] = m.values
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_TOGETHER):
                part = batch.slice(start, ROWS_TOGETHER)
                sums = [value[gram_buckets(t, m.orders, m.bits, mask)].sum(dtype=float) for t in part.column(text).to_pylist()]
                score = 1 / (1 + np.exp(-np.clip(np.array(sums) + m.intercept, -60, 60)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(score)], [*kept, out])

    return docs.mapInArrow(scores, T.StructType([*(docs.schema[c] for c in kept), T.StructField(out, T.DoubleType())]))
