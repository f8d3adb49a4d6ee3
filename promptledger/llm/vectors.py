"""What vector searches share: valid vectors, copies of a vector as one, block pairs, and the best hits with ties by id.

Copies of one vector have equal scores everywhere, so a search sees each distinct vector once, with the smallest ids of its
copies: as many as a result can hold, plus one for the query itself. That keeps a vector in a third of all rows one row, and
it loses nothing, since ties go to smaller ids.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors and queries in a block on average; it decides the number of tasks only.
DATA_BLOCK, QUERY_BLOCK = 8192, 4096
_SALTS = 64


def finite(vector: Column) -> Column:
    """Not null, not empty, and every component a finite number."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & good, F.lit(False))


def whole(x: Column) -> Column:
    """The largest whole number up to ``x``, as a double; from 2 ** 53 on every double is whole."""
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """``vid`` (smallest id), ``v`` and ``members`` (its ``keep`` smallest ids) of the distinct vectors of (vec_id, v)."""
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(_SALTS))
    some = W.partitionBy("v", "salt").orderBy("vec_id")
    few = rows.distinct().withColumn("salt", salt).withColumn("k", F.row_number().over(some)).filter(F.col("k") <= keep)
    return (
        few.withColumn("k", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).filter(F.col("k") <= keep)
        .groupBy("v").agg(F.min("vec_id").alias("vid"), F.sort_array(F.collect_list("vec_id")).alias("members"))
    )


def block_pairs(queries: DataFrame, data: DataFrame, search: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``search`` for every pair of a query block (column qb) with a data block (column db), each pair one task's group."""
    ends = queries.agg(F.max("qb")).first()[0], data.agg(F.max("db")).first()[0]
    if None in ends:
        return queries.sparkSession.createDataFrame([], schema)
    every = [F.explode(F.sequence(F.lit(0), F.lit(int(e)))) for e in ends]
    left = queries.select("*", every[1].alias("db")).groupBy("qb", "db")
    right = data.select("*", every[0].alias("qb")).groupBy("qb", "db")
    return left.cogroup(right).applyInPandas(search, schema)


def matrix(column: pd.Series | list) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column]) if len(column) else np.empty((0, 0))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def ranked(hits: DataFrame, queries: DataFrame, distinct: DataFrame, k: int, finer: str | None = None) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` from hits (qid, vid, score) of distinct vectors.

    ``queries`` has ``query_id`` and ``qid``, the distinct vector it is a copy of. ``finer`` names a column that orders equal scores.
    """
    more = [finer] if finer else []
    by = [F.desc("score"), *map(F.desc, more)]
    top = hits.withColumn("k", F.row_number().over(W.partitionBy("qid").orderBy(*by, "vid"))).filter(F.col("k") <= k + 1).drop("k")
    members = top.join(distinct.select("vid", "members"), "vid").select("qid", "score", *more, F.explode("members").alias("vec_id"))
    out = queries.join(members, "qid").filter(F.col("vec_id") != F.col("query_id"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(*by, "vec_id"))
    return out.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
