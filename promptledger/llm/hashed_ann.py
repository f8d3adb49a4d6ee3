"""Approximate nearest neighbours by largest inner product: multi-index hashing over learned binary codes.

*Codes.* A component is appended that makes all vectors equally long, so that the angle to a query orders inner products. A
rotation learned on a bounded sample (principal axes, then iterative quantization) turns a vector into signs.
*Index.* Every vector's code is cut into substrings, and each substring is indexed in every block of vectors.
*Probing.* If two codes differ in at most r places, then in some substring they differ in at most its share of r (the shares plus
one add up to more than r): looking up all substring values that near gives every code within r. These are filtered by
their full distance and ranked by inner products of the original vectors in double precision. A query with fewer than k codes
within r in a block takes the next nearest codes there, so the result has k rows where there are as many candidates.
*Radius.* It is the smallest at which a bounded number of calibration queries, compared with all vectors exactly, finds the
wanted share of its neighbours (``target_recall``).

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without id, take no part; vectors are
compared with those of their own dimension; a query's own row is every row with its id; repeated rows count once; ties go to smaller
ids; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptledger.llm import vectors
from promptledger.llm.common import HASH_BITS, spread_hash, stored

#: Bounds of the samples that the codes and the radius are fitted on.
SAMPLE_ROWS, CALIBRATION_QUERIES = 20_000, 100
TARGET_RECALL = 0.96
BITS, SUBSTRINGS, ROUNDS = 64, 8, 30
_HITS = "qid long, vid long, score double"


@dataclass(frozen=True)
class Codes:
    """Sign codes of vectors augmented to the length ``longest``."""

    turn: np.ndarray
    longest: float

    def of(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        extra = np.zeros(len(v)) if query else np.sqrt(np.maximum(self.longest**2 - (v * v).sum(1), 0))
        bits = np.column_stack([v, extra]) @ self.turn > 0
        padded = np.zeros((len(v), BITS), bool)
        padded[:, : bits.shape[1]] = bits
        return np.packbits(padded, axis=1).view(np.uint64).ravel()


def learn(sample: np.ndarray, longest: float) -> Codes:
    """Iterative quantization: the rotation of the principal axes that brings the sample nearest to its own signs."""
    full = np.column_stack([sample, np.sqrt(np.maximum(longest**2 - (sample * sample).sum(1), 0))])
    values, axes = np.linalg.eigh(full.T @ full)
    axes = axes[:, np.argsort(-values)][:, :BITS]
    flat = full @ axes
    turn = np.linalg.qr(np.random.default_rng(0).normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(ROUNDS):
        u, _, vt = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
        turn = (u @ vt).T
    return Codes(axes @ turn, longest)


def distances(code: np.uint64, codes: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code)


class BlockIndex:
    """Substring directories of one block of codes."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.parts = codes.view(np.uint8).reshape(len(codes), SUBSTRINGS)
        self.order = [np.argsort(self.parts[:, j], kind="stable") for j in range(SUBSTRINGS)]
        self.start = [np.searchsorted(self.parts[o, j], np.arange(257)) for j, o in enumerate(self.order)]
        self.near: dict[tuple[int, int, int], np.ndarray] = {}

    def _probe(self, j: int, value: int, radius: int) -> np.ndarray:
        """Rows whose substring j differs from ``value`` in at most ``radius`` places."""
        found = self.near.get((j, value, radius))
        if found is None:
            values = np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8)) <= radius) ^ value
            found = np.concatenate([self.order[j][self.start[j][x] : self.start[j][x + 1]] for x in values])
            self.near[j, value, radius] = found
        return found

    def within(self, code: np.uint64, radius: int, least: int) -> np.ndarray:
        """Rows of every code within ``radius``; if fewer than ``least``, the nearest ones beyond as well."""
        marked = np.zeros(len(self.codes), bool)
        share, more = divmod(radius + 1, SUBSTRINGS)
        for j, value in enumerate(np.array([code]).view(np.uint8)):
            if (own := share - 1 + (j < more)) >= 0:
                marked[self._probe(j, int(value), own)] = True
        rows = np.flatnonzero(marked)
        rows = rows[distances(code, self.codes[rows]) <= radius]
        if len(rows) < min(least, len(self.codes)):
            far = distances(code, self.codes)
            rows = np.flatnonzero(far <= np.partition(far, min(least, len(far)) - 1)[min(least, len(far)) - 1])
        return rows


def search(rows: DataFrame, is_query: Column, k: int = 20, target_recall: float = TARGET_RECALL) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the k nearest rows found for each query among all others; ``rows`` are (vec_id, embedding)."""
    v = F.col("embedding").cast("array<double>")
    valid = rows.select("vec_id", v.alias("v")).filter(F.col("vec_id").isNotNull() & vectors.finite(F.col("v")) & F.exists("v", lambda x: x != 0))
    distinct = stored(vectors.distinct_vectors(valid, k + 1).withColumn("dim", F.size("v")), "distinct-vectors")
    asked = stored(
        valid.filter(is_query).distinct().join(distinct.select("v", "vid", "dim"), "v").select(F.col("vec_id").alias("query_id"), F.col("vid").alias("qid"), "dim"), "asked")
    hits = rows.sparkSession.createDataFrame([], _HITS)
    for dim, count in sorted(tuple(r) for r in distinct.groupBy("dim").count().collect()):
        hits = hits.union(_search_dimension(distinct.filter(F.col("dim") == dim), asked.filter(F.col("dim") == dim), count, k + 1, target_recall))
    return vectors.ranked(hits, asked.select("query_id", "qid"), distinct, k)


def _bounded(df: DataFrame, seed: str, most: int, count: int) -> DataFrame:
    """About ``most`` rows chosen by the hash of their id."""
    return df if count <= most else df.filter(spread_hash(seed, F.col("vid")) < int(most / count * (1 << HASH_BITS)))


def _search_dimension(distinct: DataFrame, asked: DataFrame, count: int, k: int, target_recall: float) -> DataFrame:
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    longest = float(np.sqrt(distinct.agg(F.max(squares)).first()[0]))
    codes = learn(vectors.matrix(_bounded(distinct.select("vid", "v"), "codes", SAMPLE_ROWS, count).orderBy("vid").toPandas()["v"]), longest)

    def add_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("vid"), batch.column("v"), pa.array(codes.of(v).view(np.int64))], ["vid", "v", "code"])

    indexed = distinct.select("vid", "v").mapInArrow(add_codes, "vid long, v array<double>, code long")
    blocks = -(-count // vectors.DATA_BLOCK)
    index = stored(indexed.withColumn("db", F.pmod(F.xxhash64("vid"), F.lit(blocks)).cast("int")), "code-index")
    ids = asked.select("qid").distinct()
    parts = -(-ids.count() // vectors.QUERY_BLOCK) or 1
    queries = stored(
        ids.join(distinct, F.col("qid") == F.col("vid")).select("qid", "v", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int").alias("qb")), "queries")
    radius = calibrated_radius(index, queries, codes, k, target_recall)

    def run(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({"qid": [], "vid": [], "score": []}).astype({"qid": "int64", "vid": "int64", "score": float})
        asked_vectors, data, vids = vectors.matrix(q["v"]), vectors.matrix(d["v"]), d["vid"].to_numpy()
        block = BlockIndex(d["code"].to_numpy().view(np.uint64))
        found = []
        for qid, v, code in zip(q["qid"], asked_vectors, codes.of(asked_vectors, query=True), strict=True):
            near = block.within(code, radius, k)
            scores = (data[near] * v).sum(1)
            top = vectors.best(scores, vids[near], k)
            found.append((np.full(len(top), qid), vids[near[top]], scores[top]))
        return pd.DataFrame(dict(zip(("qid", "vid", "score"), (np.concatenate(x) for x in zip(*found, strict=True)), strict=True)))

    return vectors.block_pairs(queries, index, run, _HITS)


def calibrated_radius(index: DataFrame, queries: DataFrame, codes: Codes, k: int, target_recall: float) -> int:
    """Smallest Hamming radius that holds the wanted share of the exact neighbours of some queries."""
    total = queries.count()
    some = _bounded(queries.withColumnRenamed("qid", "vid"), "radius", CALIBRATION_QUERIES, total).orderBy("vid").toPandas()
    if not len(some):
        return BITS
    asked, own = vectors.matrix(some["v"]), some["vid"].to_numpy()
    asked_codes = codes.of(asked, query=True)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)] for _ in own]
        for batch in batches:
            vids, code = batch.column("vid").to_numpy(), batch.column("code").to_numpy().view(np.uint64)
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            scores = asked @ v.T
            for i in range(len(own)):
                part = [np.concatenate(x) for x in zip(held[i], (scores[i], vids, distances(asked_codes[i], code).astype(np.int64)), strict=True)]
                top = vectors.best(part[0], part[1], k)
                held[i] = [x[top] for x in part]
        rows = [(i, *x) for i, h in enumerate(held) for x in zip(*(y.tolist() for y in h), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["q", "score", "vid", "distance"])

    nearest = index.select("vid", "v", "code").mapInArrow(exact, "q long, score double, vid long, distance long")
    # At most CALIBRATION_QUERIES times k rows reach the driver, however many tasks there are.
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vid"))
    nearest = nearest.withColumn("place", place).filter(F.col("place") <= k).toPandas()
    nearest = nearest[nearest["vid"].to_numpy() != own[nearest["q"].to_numpy()]]
    nearest = nearest.sort_values(["q", "place"]).groupby("q").head(k - 1)
    if not len(nearest):
        return BITS
    return int(np.quantile(nearest["distance"], target_recall, method="higher"))
