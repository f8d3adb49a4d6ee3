"""Vector searches against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptledger.llm import exact_topk, hashed_ann
from promptledger.llm.queries import QUERIES


def brute(rows, is_query, k):
    out = []
    for q, v in rows:
        if is_query(q):
            hits = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v)))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(hits[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [3, 2**20])
def test_exact_topk_equals_brute_force(spark, spread):
    rng = random.Random(4)
    rows = [(i, [rng.randrange(-spread, spread + 1) * (1 + i % 7) for _ in range(24)]) for i in range(900)]
    rows += [(1000 + i, rows[10][1]) for i in range(300)] + [(2000 + i, [rng.randrange(5) for _ in range(3)]) for i in range(40)] + [(3000, [0] * 24)]
    rows += [(4050, []), (4060, [])]
    bad = [(None, [1] * 24), (4000, None), (4100, [None] * 24)]
    df = spark.createDataFrame([(i, v, "x", 1.0, 7) for i, v in rows + bad + rows[:3]], "vec_id long, v array<long>, label string, score double, vid long")
    got = sorted(tuple(r) for r in exact_topk.search(df, F.col("vec_id") % 50 == 0, 5).collect())
    assert got == brute(rows, lambda i: i % 50 == 0, 5)


LARGEST = 2**63 - 1


@pytest.mark.parametrize("most", [2**33, 2**62, 2.0**60, 2.0**120, 2.0**1020])
def test_scores_beyond_a_long_are_ranked_exactly(spark, most):
    rng = random.Random(6)
    small = [(i, [rng.randrange(-900, 900) for _ in range(20)]) for i in range(300)]
    large = [(300 + i, [int(rng.uniform(-most, most)) for _ in range(20)]) for i in range(40)] + [(400, [int(most)] * 20), (450, [int(most)] * 20), (500, [-int(most)] * 20)]
    kind = "long" if isinstance(most, int) else "double"
    rows = [(i, [float(x) if kind == "double" else x for x in v]) for i, v in small + large]
    want = [(q, n, i, max(-LARGEST - 1, min(LARGEST, s))) for q, n, i, s in brute([(i, list(map(int, v))) for i, v in rows], lambda i: i % 50 == 0, 5)]
    got = sorted(tuple(r) for r in exact_topk.search(spark.createDataFrame(rows, f"vec_id long, v array<{kind}>"), F.col("vec_id") % 50 == 0, 5).collect())
    assert got == want


def test_sums_never_wrap(spark):
    rows = spark.createDataFrame([(50, [2**31 - 1] * 4), (51, [2**31 - 1] * 4), (52, [1] * 4)], "vec_id long, v array<long>")
    got = [tuple(r) for r in exact_topk.search(rows, F.col("vec_id") % 50 == 0, 5).collect()]
    assert got == [(50, 1, 51, LARGEST), (50, 2, 52, 4 * (2**31 - 1))]


def test_exact_topk_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact_topk.vectors, "DATA_BLOCK", 100)
    monkeypatch.setattr(exact_topk.vectors, "QUERY_BLOCK", 8)
    rng = random.Random(5)
    rows = [(i, [rng.randrange(-9, 10) for _ in range(20)]) for i in range(700)]
    got = sorted(tuple(r) for r in exact_topk.search(spark.createDataFrame(rows, "vec_id long, v array<long>"), F.col("vec_id") % 20 == 0, 5).collect())
    assert got == brute(rows, lambda i: i % 20 == 0, 5)


def test_searches_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, v array<long>")
    assert exact_topk.search(empty, F.lit(True)).count() == 0
    floats = spark.createDataFrame([(1, [1.0, float("nan")]), (2, None), (3, [0.0, 0.0]), (4, [1.0, float("inf")]), (None, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert hashed_ann.search(floats, F.lit(True)).count() == 0
    two = spark.createDataFrame([(20, [1.0, 2.0]), (21, [2.0, -1.0]), (21, [2.0, -1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in hashed_ann.search(two, F.col("vec_id") % 20 == 0).collect()] == [(20, 1, 21, 0.0)]
    none = spark.createDataFrame([(21, [2.0, -1.0])], "vec_id long, embedding array<float>")
    assert hashed_ann.search(none, F.col("vec_id") % 20 == 0).count() == 0


def test_index_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**63, 500, dtype=np.uint64)
    for i in range(1, 500):  # some close codes
        if i % 3 == 0:
            codes[i] = codes[i - 1] ^ np.uint64(1 << int(rng.integers(63)))
    index = hashed_ann.BlockIndex(codes)
    for radius in (0, 1, 5, 9, 20, 28):
        for q in codes[:20]:
            want = np.flatnonzero(hashed_ann.distances(q, codes) <= radius)
            got = index.within(q, radius, 1)
            assert list(got) == list(want)
    assert len(index.within(codes[0], 0, 20)) >= 20


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_against_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = {}
    for r in QUERIES["op7_nearest"](spark, path).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = (r["rank"], r["score"])
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = v @ v[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:20]
        found = got[ids[q]]
        assert len(found) == min(20, len(ids) - 1) and sorted(r for r, _ in found.values()) == list(range(1, len(found) + 1))
        assert all(abs(score - v[np.flatnonzero(ids == i)[0]] @ v[q]) < 1e-9 for i, (_, score) in found.items())
        hit, total = hit + sum(ids[i] in found for i in order), total + len(order)
    assert hit >= 0.9 * total


def test_vectors_of_unequal_length_and_copies(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(600, 16)) * rng.uniform(0.1, 5, (600, 1))
    v[200:400] = v[0]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    got = {}
    for r in hashed_ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    want = {}
    for q, _, i, _ in brute(rows, lambda i: i % 20 == 0, 20):
        want.setdefault(q, set()).add(i)
    assert sum(len(want[q] & {i for _, i in got[q]}) for q in want) >= 0.9 * 20 * len(want)
