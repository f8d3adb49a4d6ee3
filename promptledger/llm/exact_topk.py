"""Exact top-k by norm-sorted inner products.

Vectors are cut into blocks by descending length. An orthogonal rotation (the singular vectors of all data, from their summed
second moments) moves most of the inner product into the first coordinates. The block of the longest vectors gives every
query a first k-th best score; in all other blocks, vectors are skipped as soon as the product of lengths, or the sum over the
first coordinates plus the product of the remaining lengths (Cauchy-Schwarz), cannot reach it. What is left is multiplied
exactly in whole numbers. Bounds are widened by more than the rounding error of their sums.

Cases: vectors that are null or hold null or non-finite components, and rows without id, take no part; every other vector does, however
large its whole numbers are. Where sums fit neither a double nor a long exactly, double sums with their largest error choose the few
that can be among the best, and these are multiplied in whole numbers of any size. A score beyond a long is returned as the nearest long
and ranked by its exact value (``beyond``). Vectors are compared with those of their own dimension, also the empty ones (score 0); a
query's own row is every row with its id; repeated rows count once; ties go to smaller ids; an empty table or one without queries gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptledger.llm import vectors
from promptledger.llm.common import stored

#: Coordinates summed before the bound is tested, and vectors tested together.
HEAD, STEP = 16, 512
#: ``beyond`` orders scores that no long holds; null for all others.
_HITS = "qid long, vid long, score long, beyond binary"
_MOST = (1 << 63) - 1
#: Exact scores as unsigned big-endian numbers: wide enough for products of any two doubles.
_SHIFT, _BYTES = 1 << 2200, 280


def second_moments(rows: DataFrame, dim: int) -> np.ndarray:
    """Sum of the outer products of all vectors, each scaled to components of at most 1: one partial sum per task, added cell by cell in Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)
            v = v / np.maximum(np.abs(v).max(1, keepdims=True), 1)
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["cell", "value"])

    cells = rows.select("v").mapInArrow(partial, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(dim * dim)
    out[cells["cell"].to_numpy()] = cells["value"].to_numpy()
    return out.reshape(dim, dim)


def _lengths(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, initial=1)
    with np.errstate(over="ignore"):
        return top * np.sqrt(((x / top[:, None]) ** 2).sum(1))


def _whole(v: np.ndarray) -> list[int]:
    return [int(x) for x in v]


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if scores.dtype != object:
        return vectors.best(scores, ids, k)
    return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)


def _as_float(score: int) -> float:
    try:
        return float(score)
    except OverflowError:
        return np.finfo(float).max if score > 0 else -np.inf


class _Block:
    """Vectors of whole numbers: as doubles for bounds and small products, as they are for exact ones."""

    def __init__(self, raw: list[np.ndarray], ids: np.ndarray, rotation: np.ndarray) -> None:
        self.raw, self.ids = raw, ids
        self.near = vectors.matrix(raw)
        self.norm = _lengths(self.near)
        with np.errstate(over="ignore", invalid="ignore"):
            turned = self.near @ rotation
            self.head, self.rest = turned[:, :HEAD], _lengths(turned[:, HEAD:]) if turned.shape[1] > HEAD else np.zeros(len(ids))
        self.largest = np.abs(self.near).max(1, initial=0)
        self.dim = self.near.shape[1]


def _scores(q: _Block, live: np.ndarray, d: _Block, columns: np.ndarray, possible: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Exact scores of the ``possible`` columns for each live query: (place in ``live``, columns, scores)."""
    with np.errstate(over="ignore"):
        size = np.outer(q.largest[live], d.largest[columns]).max(1, initial=0) * q.dim
    for fits, kind in ((size < 2**53, float), ((size >= 2**53) & (size < 2**62), np.int64)):
        rows = np.flatnonzero(fits)
        if len(rows):
            products = (q.near[live[rows]].astype(kind) @ d.near[columns].astype(kind).T).astype(np.int64)
            for row, product in zip(rows, products, strict=True):
                near = np.flatnonzero(possible[row])
                yield row, columns[near], product[near]
    for row in np.flatnonzero(~(size < 2**62)):
        near = np.flatnonzero(possible[row])
        i = live[row]
        with np.errstate(over="ignore", invalid="ignore"):
            about = d.near[columns[near]] @ q.near[i]
            error = 1e-12 * (1 + q.norm[i]) * (1 + d.norm[columns[near]])
            least = about - error
            if len(near) > k and np.isfinite(least).all():
                near = near[about + error >= np.partition(least, len(near) - k)[len(near) - k]]
        mine = _whole(q.raw[i])
        exact = [sum(a * b for a, b in zip(mine, _whole(d.raw[c]), strict=True)) for c in columns[near]]
        yield row, columns[near], np.array(exact, object)


def search_block(q: _Block, floor: np.ndarray, d: _Block, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Up to k hits (query ids, vector ids, scores) for each query in one block; ``floor`` are scores that a hit must reach."""
    order = np.lexsort((d.ids, -d.norm))
    slack = 1e-9 * (1 + q.norm)
    held: list[list[np.ndarray]] = [[np.empty(0, np.int64), np.empty(0, np.int64)] for _ in q.ids]
    floor = floor.astype(float).copy()
    for at in range(0, len(order), STEP):
        part = order[at : at + STEP]
        longest = d.norm[part[0]]
        with np.errstate(over="ignore", invalid="ignore"):
            live = np.flatnonzero(~(q.norm * longest * (1 + 1e-12) + slack * (1 + longest) < floor))
            if not len(live):
                break  # lengths only fall
            bound = q.head[live] @ d.head[part].T + np.outer(q.rest[live], d.rest[part]) + np.outer(slack[live], 1 + d.norm[part])
            possible = ~(bound < floor[live, None])
        some = possible.any(1)
        live, possible = live[some], possible[some]
        columns = np.flatnonzero(possible.any(0))
        if not len(columns):
            continue
        for row, found, scores in _scores(q, live, d, part[columns], possible[:, columns], k):
            i = live[row]
            all_scores = np.concatenate([held[i][0], scores])
            all_ids = np.concatenate([held[i][1], d.ids[found]])
            top = _top(all_scores, all_ids, k)
            held[i] = [all_scores[top], all_ids[top]]
            if len(top) == k:
                floor[i] = max(floor[i], _as_float(held[i][0][-1]))
    for i, (scores, found) in enumerate(held):
        yield np.full(len(found), q.ids[i]), found, scores


def _frame(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """Hits as rows; a score at the end of the longs or beyond carries its exact value."""
    qid, vid = (np.concatenate([f[i] for f in found] or [np.empty(0, np.int64)]) for i in (0, 1))
    scores = [int(s) for f in found for s in f[2]]
    return pd.DataFrame({
        "qid": qid, "vid": vid, "score": np.array([max(-_MOST - 1, min(_MOST, s)) for s in scores], np.int64),
        "beyond": pd.Series([None if -_MOST - 1 < s < _MOST else (s + _SHIFT).to_bytes(_BYTES, "big") for s in scores], dtype=object)})


def search(rows: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the k best rows for each query among all others.

    ``rows`` are (vec_id, v); v is an array of longs, or of doubles without a fraction.
    """
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite).select("vec_id", "v")
    distinct = stored(vectors.distinct_vectors(rows, k + 1).withColumn("dim", F.size("v")), "distinct-vectors")
    asked = stored(
        rows.filter(is_query).distinct().join(distinct.select("v", "vid", "dim"), "v").select(F.col("vec_id").alias("query_id"), F.col("vid").alias("qid"), "dim"), "asked")
    nothing = F.lit(None).cast("binary").alias("beyond")
    hits = asked.filter("dim = 0").select("qid", F.col("qid").alias("vid"), F.lit(0).cast("long").alias("score"), nothing).distinct()
    for dim, count in sorted(tuple(r) for r in distinct.filter("dim > 0").groupBy("dim").count().collect()):
        hits = hits.union(_search_dimension(distinct.filter(F.col("dim") == dim), asked.filter(F.col("dim") == dim), dim, count, k + 1))
    return vectors.ranked(hits, asked.select("query_id", "qid"), distinct, k, "beyond")


def _search_dimension(distinct: DataFrame, asked: DataFrame, dim: int, count: int, k: int) -> DataFrame:
    values, axes = np.linalg.eigh(second_moments(distinct, dim))
    rotation = np.ascontiguousarray(axes[:, np.argsort(-values)])
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    blocks = distinct.select("vid", "v", square.alias("square")).repartitionByRange(-(-count // vectors.DATA_BLOCK), F.desc("square"), "vid")
    data = stored(blocks.select("vid", "v", F.spark_partition_id().alias("db")), "norm-blocks")
    longest = data.agg(F.min("db")).first()[0]
    ids = asked.select("qid").distinct()
    parts = -(-ids.count() // vectors.QUERY_BLOCK) or 1
    queries = stored(
        ids.join(distinct, F.col("qid") == F.col("vid")).select("qid", "v", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int").alias("qb")), "queries")

    def run(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return _frame([])
        floor = q["floor"].fillna(-np.inf).to_numpy(float) if "floor" in q else np.full(len(q), -np.inf)
        blocks = (_Block(list(x["v"]), x[i].to_numpy(), rotation) for x, i in ((q, "qid"), (d, "vid")))
        return _frame(list(search_block(next(blocks), floor, next(blocks), k)))

    first = stored(vectors.block_pairs(queries, data.filter(F.col("db") == longest).withColumn("db", F.lit(0)), run, _HITS), "first-hits")
    floors = first.groupBy("qid").agg(F.when((F.count("*") >= k) & (F.min("score") > -_MOST - 1), F.min("score")).alias("floor"))
    others = data.filter(F.col("db") != longest)
    return first.union(vectors.block_pairs(queries.join(floors, "qid", "left"), others, run, _HITS))
