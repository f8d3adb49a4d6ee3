"""The stages of the corpus pipeline on small tables, and all of them on the smallest data set."""

import random
from collections import Counter

import corpus_pipeline as pipeline
import pytest
from helpers import DOCS, awkward_docs, empty_docs, sentence
from pyspark.sql import functions as F

from promptledger.llm import sentencepiece, toxicity
from promptledger.llm.common import scratch
from promptledger.llm.queries import held_out

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def with_labels(spark, labels):
    path = scratch(spark, "pipeline-test")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_toxic_documents_go(spark):
    rng = random.Random(1)
    bad = {i for i in range(1200) if i % 5 == 0}
    rows = [(i, " ".join(sentence(rng, 30, 500) + (["vilhatewordx", "scumgrr"] if i in bad else [])), "en", "s", 9) for i in range(1200)]
    path = with_labels(spark, [(i, 1, int(i in bad)) for i in range(1200)])
    docs = spark.createDataFrame(rows, DOCS)
    out = pipeline.drop_toxic(spark, docs, path)
    assert out.columns == list(pipeline.COLUMNS)
    kept = {r["doc_id"] for r in out.collect()}
    assert len(kept & bad) < 0.02 * len(bad) and len(kept - bad) > 0.99 * (1200 - len(bad))
    # The same rows by the score of a model that saw only the labels that are not held out.
    model = toxicity.fit(docs, spark.read.parquet(f"{path}/labels.parquet"), ~held_out())
    assert kept == {r["doc_id"] for r in toxicity.score(docs, model).filter("score < 0.7").collect()}


def without_repeats(rows, least=50):
    """Lines of every later copy of a run that just reaches ``least`` words, in order of documents."""
    seen, gone = set(), {}
    for doc, text in rows:
        lines = [(n, line.strip(" \t\r\x0b\x0c")) for n, line in enumerate((text or "").split("\n"))]
        lines = [(n, line, len(line.split())) for n, line in lines if line]
        runs = []
        for a in range(len(lines)):
            words, b = 0, a
            while b < len(lines) and words < least:
                words, b = words + lines[b][2], b + 1
            if words >= least:
                runs.append((a, b))
        for a, b in runs:
            key = tuple(line for _, line, _ in lines[a:b])
            if key in seen:
                gone.setdefault(doc, set()).update(n for n, _, _ in lines[a:b])
            seen.add(key)
    return gone


def test_repeated_lines_go_and_the_rest_stays(spark):
    rng = random.Random(2)
    shared = [" ".join(sentence(rng, 30)) for _ in range(3)]
    short = " ".join(sentence(rng, 20))
    rows = []
    for i in range(60):
        lines = [" ".join(sentence(rng, rng.randrange(5, 15))) for _ in range(4)]
        if i % 3 == 0:
            lines[2:2] = shared[: 2 + i % 2]
        if i % 4 == 0:
            lines.append(short)
        rows.append((i, "\n".join(lines), "en", "s", 1))
    rows += [(100, "\n".join(shared), "en", "s", 1), (101, None, "en", "s", None), (102, "", "en", "s", 0)]
    out = {r["doc_id"]: r for r in pipeline.drop_repeated_lines(spark, spark.createDataFrame(rows, DOCS), SF).collect()}
    gone = without_repeats([r[:2] for r in rows])
    assert gone and 100 not in out and set(out) == {r[0] for r in rows} - {100}
    for i, text, *_ in rows[:60]:
        want = "\n".join(line for n, line in enumerate(text.split("\n")) if n not in gone.get(i, ()))
        assert out[i]["text"] == want and out[i]["n_chars"] == (len(want) if i in gone else 1)
    assert out[101]["text"] is None and out[102]["text"] == ""


def test_mix_takes_whole_documents_near_the_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(sentence(rng, rng.randrange(1, 40))), "en", rng.choice(["a"] * 5 + ["b", "c"]), 0) for i in range(2000)]
    out = pipeline.mix_sources(spark, spark.createDataFrame(rows, DOCS), SF).collect()
    copies = Counter(r["doc_id"] for r in out)
    assert set(map(tuple, out)) <= set(rows) and max(copies.values()) <= 2
    size = {r[0]: len(r[1].split()) for r in rows}
    taken = sum(size[r["doc_id"]] for r in out)
    assert taken == pytest.approx(1.5 * sum(size.values()), rel=0.02)


def test_pieces_decode_to_the_text(spark):
    docs = awkward_docs(spark).select(*pipeline.COLUMNS)
    model = sentencepiece.load_model(sentencepiece.default_model_path())
    out = pipeline.encode_pieces(spark, docs, SF).collect()
    assert len(out) == 11 and all(r["round_trip"] for r in out)
    texts = Counter(r["text"] for r in docs.collect())
    assert Counter(None if r["ids"] is None else model.decode(r["ids"]) for r in out) == texts
    assert all(r["n_ids"] == len(r["ids"]) for r in out if r["ids"] is not None)


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_stages_take_awkward_and_empty_tables(spark, name, stage):
    path = with_labels(spark, [(1, 1, 1), (2, 1, 0), (6, 1, 0)])
    awkward = stage(spark, awkward_docs(spark).select(*pipeline.COLUMNS), path)
    assert awkward.count() > 0
    if name != pipeline.STAGES[-1][0]:
        assert awkward.columns == list(pipeline.COLUMNS)
    assert stage(spark, empty_docs(spark), path).count() == 0


def test_run_applies_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = pipeline.run(spark, SF)
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "mix_sources", "sentencepiece"]
    here = docs.select(*pipeline.COLUMNS)
    for _, stage in pipeline.STAGES:
        here = stage(spark, here, SF)
        path = scratch(spark, "by-hand")
        here.write.parquet(path)
        here = spark.read.parquet(path)
    assert rows_of(out) == rows_of(here) and out.count() > 0.9 * docs.count()
    assert out.filter(~F.col("round_trip")).isEmpty()
