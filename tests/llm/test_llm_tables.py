"""Mixing, sharding, WARC and the queries that SQL can express."""

import io
import random
from collections import Counter, defaultdict

import pytest
from compare import compare, duck
from helpers import DOCS, EXTRA, awkward_docs, empty_docs
from pyspark.sql import functions as F

from promptledger.llm import mixing, sharding, warc
from promptledger.llm.common import word_count
from promptledger.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, con, name):
    ok, message = compare(spark, con, SF, name, QUERIES[name], ORACLES[name])
    assert ok, message


def test_mix_keeps_every_row_and_nears_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), "en", rng.choice(["a"] * 6 + ["b", "c", "d"]), 0) for i in range(3000)]
    sized = mixing.sized(spark.createDataFrame(rows, DOCS), word_count(F.col("text")))
    out = mixing.mix(sized, (5, 2, 1), {"small": 0.5, "large": 1.5}).collect()
    assert len(out) == 6000
    taken, target, most = defaultdict(int), {}, {}
    copies = {}
    for r in out:
        taken[r["budget"], r["source"]] += r["taken"]
        target[r["budget"], r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
        copies[r["budget"], r["doc_id"]] = r["copies"]
    for k, v in target.items():
        assert abs(taken[k] - v) <= 60
    assert all(copies["small", i] <= copies["large", i] for i in range(3000))  # budgets are nested
    sizes = {r["source"]: r["source_size"] for r in out}
    assert sum(v for (b, _), v in target.items() if b == "large") == pytest.approx(1.5 * sum(sizes.values()))
    assert all(v <= 2 * sizes[s] + 1e-6 for (_, s), v in target.items())


def test_mix_awkward(spark):
    out = mixing.mix(mixing.sized(awkward_docs(spark), word_count(F.col("text"))), (5, 2, 1), {"mix": 1.5}).collect()
    assert len(out) == 11 and sum(r["doc_id"] == 2 for r in out) == 2
    assert {r["source"] for r in out} == {"s1", "s2", "s3", "é", None}
    assert mixing.mix(mixing.sized(empty_docs(spark), word_count(F.col("text"))), (1,), {"m": 1.5}).count() == 0
    docs = awkward_docs(spark)
    mixed = mixing.mixed_documents(docs, word_count(F.col("text")), (5, 2, 1), 1.5)
    assert mixed.columns == docs.columns and mixed.count() > 0


def test_shards_match_the_mixture(spark):
    rows = [(i, f"text {i}", "en", "hot" if i % 3 == 0 else f"s{i % 10}", 0) for i in range(5000)]
    out = sharding.interleave(spark.createDataFrame(rows, DOCS), 7, carry=("text",)).collect()
    per = Counter(r["shard"] for r in out)
    assert sorted(per) == list(range(7)) and max(per.values()) - min(per.values()) <= 1
    for s in range(7):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(per[s]))
    for source, n in Counter(r["source"] for r in out).items():
        inside = Counter(r["shard"] for r in out if r["source"] == source)
        assert max(inside.values()) - min(inside[s] for s in range(7)) <= 2, (source, n)
    assert sorted(r["place"] for r in out) == list(range(5000))
    again = sharding.interleave(spark.createDataFrame(rows[::-1], DOCS).repartition(9), 7).collect()
    assert {(r["doc_id"], r["place"]) for r in again} == {(r["doc_id"], r["place"]) for r in out}


def test_shards_awkward(spark, tmp_path):
    out = sharding.interleave(awkward_docs(spark), 16).collect()
    assert len(out) == 11 and all(r["slot"] == 0 for r in out)
    assert sharding.interleave(empty_docs(spark), 16).count() == 0
    odd = awkward_docs(spark, EXTRA + ", range long, before long, fraction double, rank int, s string, r long, slot long")
    sharding.write_shards(odd, str(tmp_path / "odd"), 3)
    back = spark.read.parquet(str(tmp_path / "odd"))
    assert back.count() == 11 and set(odd.columns) <= set(back.columns) and sorted(Counter(r["shard"] for r in back.collect()).values()) == [3, 4, 4]
    sharding.write_shards(spark.createDataFrame([(i, "t", "en", "s", 1) for i in range(40)], DOCS), str(tmp_path / "x"), 4)
    assert Counter(r["shard"] for r in spark.read.parquet(str(tmp_path / "x")).collect()) == {0: 10, 1: 10, 2: 10, 3: 10}


PAGES = "page_id long, url string, html string"


def test_warc_round_trip(spark):
    big = "é" * 700 + "x"
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, "http://a\r\nX: y", big), (3, None, None), (4, "http://b", ""), (5, "u", "small"), (6, "u", "small"),
            (None, "n", big), (9, "again", big), (10, "http://long", "0123456789" * 40_000)]
    out = warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()
    assert len(out) == 10 and all(r["digest_ok"] and r["problem"] is None for r in out)
    by_url = {r["target_uri"]: r for r in out}
    assert [by_url[u]["record_type"] for u in ("http://a/1", "http://a/2", "n", "again")] == ["revisit", "revisit", "revisit", "response"]
    assert by_url["http://a/1"]["refers_to"] == 9 and by_url["http://a/1"]["payload_bytes"] == 1401
    assert bytes(by_url["again"]["payload"]).decode() == big and by_url["http://a/1"]["payload"] is None
    assert by_url["n"]["page_id"] is None and by_url["http://long"]["payload_bytes"] == 400_000
    assert sum(r["record_type"] == "response" and r["payload_bytes"] == 5 for r in out) == 2
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_reader_finds_damage(spark, tmp_path):
    good = [warc.record_bytes(i, "u", b"payload %d" % i * 50_000, 11, warc.hashlib.sha1(b"payload %d" % i * 50_000).hexdigest(), None) for i in range(3)]
    whole = b"".join(good)
    assert [r["page_id"] for r in warc.read_records(io.BytesIO(whole), True)] == [0, 1, 2]
    cut = list(warc.read_records(io.BytesIO(whole[:-20]), True))
    assert [r["record_type"] for r in cut] == ["response", "response", "damaged"]
    assert list(warc.read_records(io.BytesIO(b"not gzip at all"), True))[0]["record_type"] == "damaged"
    wrong = warc.record_bytes(1, "u", b"other", 5, "0" * 40, None)
    assert [r["digest_ok"] for r in warc.read_records(io.BytesIO(wrong), False)] == [False]
    (tmp_path / "a.warc.gz").write_bytes(whole)
    assert warc.read_binary(spark, str(tmp_path)).count() == 3
