"""Piece ids, toxicity, line dedup, near duplicates and page texts against brute force."""

import math
import random
import re
import time
import tracemalloc
from pathlib import Path

import pytest
from helpers import DOCS, LONG, awkward_docs, empty_docs, sentence
from pyspark.sql import functions as F

from promptledger.llm import html_main, jaccard, line_dedup, sentencepiece, toxicity


@pytest.fixture(scope="module")
def model():
    return sentencepiece.load_model(sentencepiece.default_model_path())


def texts_of(sf="/root/testdata/sf0.001"):
    import duckdb

    return [r[0] for r in duckdb.sql(f"select text from '{sf}/documents.parquet' order by doc_id").fetchall()]


def test_pieces_score_as_well_as_the_library(model):
    import sentencepiece as library
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(sentencepiece.default_model_path(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    for i, p in enumerate(proto.pieces):
        p.score = model.scores[i] / sentencepiece.SCALE
    other = library.SentencePieceProcessor(model_proto=proto.SerializeToString())
    same = 0
    samples = [line for t in texts_of() for line in t.split("\n")][:1500] + ["日本語 \U0001f600 é", "  two  blanks ", "x" * 3000, "1234567"]
    for text, ids in zip(samples, model.encode_all(samples), strict=True):
        theirs = other.encode(text)
        same += ids == theirs
        if ids != theirs:  # equal or nearly equal paths only
            assert sum(model.scores[i] for i in ids) / sentencepiece.SCALE == pytest.approx(sum(model.scores[i] for i in theirs) / sentencepiece.SCALE, abs=1e-2)
    assert same >= 0.98 * len(samples)


def test_many_words_at_once_equal_one_by_one(model):
    rng = random.Random(3)
    words = ["".join(rng.choice("▁abcthe日é\U0001f6009\n") for _ in range(rng.randrange(1, 30))) for _ in range(2000)] + [""]
    assert list(model._viterbi_all(words)) == [model._viterbi(w) for w in words]


def test_pieces_round_trip(spark, model):
    docs = awkward_docs(spark)
    out = sentencepiece.decode(sentencepiece.encode(docs)).collect()
    assert len(out) == 11 and all(r["decoded"] == r["text"] for r in out)
    assert [r["ids"] for r in out if r["text"] is None] == [None, None] and [r["ids"] for r in out if r["text"] == ""] == [[]]
    assert sentencepiece.encode(empty_docs(spark)).columns[-1] == "ids"
    assert all(model.decode(model.encode(t)) == t for t in [*texts_of(), "▁", "a▁▁b", " ", "  x", "\x00", LONG])
    both = sentencepiece.round_trip(docs.withColumn("round_trip", F.lit("old")))
    assert sorted((r["doc_id"] is None, r["doc_id"], r["ids"] or [], r["round_trip"]) for r in both.collect() if r["doc_id"]) == \
        sorted((False, r["doc_id"], r["ids"] or [], True) for r in out if r["doc_id"])
    assert "text" not in both.columns and sentencepiece.round_trip(empty_docs(spark)).count() == 0


def test_texts_together_equal_one_by_one(model, monkeypatch):
    """Words cut from bytes, remembered words and array decoding give what one text at a time gives."""
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "the", " ", " ", "  ", "\t", "\n", "\r\n", "é", "▁", "日本", "\U0001f600", "\x00", "zzz" * 30, "."]) for _ in range(rng.randrange(40))) for _ in range(600)]
    monkeypatch.setattr(sentencepiece, "REMEMBERED", 50)
    alone = [[i for w in model._split(t) for i in ([model.byte_ids[b] for b in "▁".encode()] if w == sentencepiece.LITERAL else model._viterbi(w))] if t else [] for t in texts]
    for size in (1, 7, 600):
        got = [ids for a in range(0, len(texts), size) for ids in model.encode_all(texts[a:a + size])]
        assert got == alone
    import pyarrow as pa

    lists = pa.array([None, *alone, [model.byte_ids[0xE9], 5]], pa.list_(pa.int32()))
    assert model.decode_some(lists[:-1]).to_pylist() == [None, *texts]
    assert model.decode_some(lists).to_pylist()[-1] == model.decode([model.byte_ids[0xE9], 5])  # bytes that are no text
    assert model.decode_some(lists.slice(3, 9)).to_pylist() == texts[2:11]


TOXIC = ["idiot", "scumlike", "vequ", "veju"]


def toxic_rows(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = sentence(rng, rng.randrange(5, 120), 400)
        toxic = int(rng.random() < 0.2)
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(TOXIC) + rng.choice(["", "a", "eux"]))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, toxic))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows(1500, 5)
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = F.col("doc_id") % 3 == 1
    model = toxicity.fit(docs, marks, ~held)
    out = toxicity.score(docs.filter(held), model).join(marks, "doc_id").collect()
    right = sum((r["score"] >= 0.7) == bool(r["toxic"]) for r in out)
    assert right >= 0.98 * len(out) and all(0 <= r["score"] <= 1 for r in out)
    # A held-out label changes nothing.
    flipped = marks.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, flipped, ~held)
    assert again.intercept == pytest.approx(model.intercept) and list(again.buckets) == list(model.buckets)


def test_toxicity_ratios_and_scores_computed_again(spark):
    rows, labels = toxic_rows(400, 8)
    mark = dict(labels)
    model = toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    assert model.bits == 20

    def bucket(gram):  # one n-gram, one step of 32-bit arithmetic after another
        h = len(gram)
        for c in gram:
            h = (h * 16777619 % 2**32) ^ (ord(" " if ord(c) <= 32 else c) * 2654435761 % 2**32)
        return (((h ^ (h >> 15)) * 2246822519) % 2**32) >> 12

    seen = {i: {bucket(t[a:a + n]) for n in (3, 4, 5) for t in [f" {text.lower()} "] for a in range(len(t) - n + 1)} for i, text, *_ in rows}
    toxic = [i for i, y in labels if y]
    kept = {}
    for b in set().union(*seen.values()):
        df = sum(b in s for s in seen.values())
        pos = sum(b in seen[i] for i in toxic)
        ratio = math.log((pos + 1) / (len(toxic) + 2)) - math.log((df - pos + 1) / (len(rows) - len(toxic) + 2))
        if df >= 3 and abs(ratio) >= 0.7 and abs(ratio) >= 4 * math.sqrt(1 / (pos + 1) + 1 / (df - pos + 1)):
            kept[b] = ratio
    assert sorted(kept) == list(model.buckets)
    # The weights are at the minimum of the penalised loss over features that are the ratios.
    weight = {b: v / kept[b] for b, v in zip(model.buckets, model.values, strict=True)}
    score = {i: 1 / (1 + math.exp(-model.intercept - sum(weight[b] * kept[b] for b in s if b in kept))) for i, s in seen.items()}
    for b in list(kept)[:50]:
        assert abs(sum((score[i] - mark[i]) * kept[b] for i in seen if b in seen[i]) / len(rows) + 1e-4 * weight[b]) < 2e-2
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows, DOCS), model).collect()}
    assert all(got[i] == pytest.approx(score[i], abs=1e-5) for i in got)


def test_one_labelled_id_on_many_rows_trains_once(spark, monkeypatch):
    rows, labels = toxic_rows(300, 9)
    rows += [(labels[0][0], f"copy number {i % 50}", "en", "s", 0) for i in range(4000)]
    held = []
    stored = toxicity.stored
    monkeypatch.setattr(toxicity, "stored", lambda df, name: held.append(stored(df, name)) or held[-1])
    toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True), toxic_rows=100, clean_rows=100)
    assert held[0].count() < 260


def test_toxicity_awkward(spark):
    docs = awkward_docs(spark)
    marks = spark.createDataFrame([(1, 1), (1, None), (3, 0), (6, 0), (None, 1), (99, 0)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, marks, F.lit(True))).collect()
    assert len(out) == 11 and all(0 <= r["score"] <= 1 for r in out)
    nothing = toxicity.fit(docs, marks.limit(0), F.lit(True))
    assert {r["score"] for r in toxicity.score(docs, nothing).collect()} == {0.5}
    assert toxicity.score(empty_docs(spark), nothing).count() == 0


def test_very_long_texts_are_hashed_whole(monkeypatch):
    text = "abc déf " * 50
    whole = toxicity.gram_buckets(text, (3, 4, 5), 18)
    monkeypatch.setattr(toxicity, "PIECE", 7)
    assert list(toxicity.gram_buckets(text, (3, 4, 5), 18)) == list(whole)


def brute_line_dedup(rows, least):
    """Delete a line if it lies in a run of at least ``least`` words that occurs earlier."""
    docs = {}
    for i, text in rows:
        docs[i] = [(n, line.strip(" \t\r\x0b\x0c")) for n, line in enumerate(text.split("\n"))]
    kept = {i: [(n, line, len(re.findall(r"[^\x20\x09-\x0D]+", line))) for n, line in d if line] for i, d in docs.items()}
    seen, gone = {}, {i: set() for i in docs}
    for i in sorted(docs):
        d = kept[i]
        for a in range(len(d)):
            words = 0
            for b in range(a, len(d)):
                words += d[b][2]
                if words >= least:
                    content = tuple(x[1] for x in d[a : b + 1])
                    if content in seen:
                        gone[i].update(x[0] for x in d[a : b + 1])
                    else:
                        seen[content] = (i, a)
    out = {}
    for i, text in rows:
        left = "\n".join(line for n, line in enumerate(text.split("\n")) if n not in gone[i])
        out[i] = text if not gone[i] else left if re.search(r"[^\s]", left) else ""
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(11)
    pool = [" ".join(sentence(rng, rng.randrange(1, 9))) for _ in range(12)]
    rows = []
    for i in range(120):
        lines = [rng.choice(pool) if rng.random() < 0.8 else " ".join(sentence(rng, 4)) for _ in range(rng.randrange(1, 30))]
        if rng.random() < 0.3:
            lines.insert(rng.randrange(len(lines)), rng.choice(["", "  ", "\t"]))
        rows.append((i, "\n".join(lines)))
    rows += [(200 + i, rows[5][1]) for i in range(30)] + [(300, "\n".join([pool[0]] * 64)), (301, "\n".join([pool[0]] * 64) + "\r\nend")]
    got = {r[0]: r[1] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()}
    assert got == brute_line_dedup(rows, 20)


def test_line_dedup_awkward(spark):
    docs = awkward_docs(spark)
    out = line_dedup.dedup_lines(docs, 5, removed="removed").collect()
    assert len(out) == 11 and {c for c in out[0].asDict()} == {*docs.columns, "removed"}
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append((r["text"], r["removed"]))
    assert by[1] == [("a b c d e f g", 0)] and by[2] == [("", 1), ("", 1)]
    assert by[3] == [(None, 0)] and by[4] == [("", 0)] and by[5] == [(" \n\t ", 0)] and by[6] == [(LONG, 0)]
    assert line_dedup.dedup_lines(empty_docs(spark)).count() == 0


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_components(rows, k, numerator, denominator):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and denominator * len(sets[a] & sets[b]) >= numerator * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return [(i, len(sets[a]), i if not sets[a] else least.get(find(a))) for a, (i, _) in enumerate(rows)]


@pytest.mark.parametrize(("k", "numerator", "denominator"), [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_near_duplicates_equal_brute_force(spark, k, numerator, denominator):
    rng = random.Random(k)
    base = sentence(rng, 150)
    chains = [sentence(rng, rng.randrange(3, 90)) for _ in range(15)]
    rows = []
    for _ in range(130):  # one large group of near copies, some too far from others
        words = list(base)
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        rows.append(" ".join(words))
    for words in chains:
        for _ in range(rng.randrange(1, 9)):
            words = words[:]  # each step edits the copy before it
            for _ in range(rng.randrange(0, 3)):
                at = rng.randrange(len(words))
                rng.choice([lambda w=words, a=at: w.insert(a, "ins"), lambda w=words, a=at: w.pop(a) if len(w) > 1 else None, lambda w=words, a=at: w.append("end")])()
            rows.append(" ".join(words))
    rows += ["a b", "A B", "a", "", " ", base[0], *[" ".join(sentence(rng, 40)) for _ in range(40)]] + [" ".join(base[:60] + sentence(rng, 60)) for _ in range(25)]
    rows += rows[:20]
    rng.shuffle(rows)
    rows = list(enumerate(rows, 1))
    got = sorted(tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, numerator, denominator).collect())
    assert got == sorted(brute_components(rows, k, numerator, denominator))


def test_near_duplicates_awkward(spark):
    got = sorted((tuple(r) for r in jaccard.near_duplicates(awkward_docs(spark)).collect()), key=repr)
    rows = [(r["doc_id"], r["text"]) for r in awkward_docs(spark).collect()]
    assert got == sorted(brute_components(rows, 5, 80, 100), key=repr)
    assert jaccard.near_duplicates(empty_docs(spark)).count() == 0
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.near_duplicates(none).collect()) == [(1, 0, 1), (2, 0, 2)]


def test_long_texts_hash_as_whole(monkeypatch):
    import pyarrow as pa

    from promptledger.llm import shingles

    texts = pa.array(["one two three four five six seven " * 40, None, "a b", "", "X" * 300])
    whole = [(r, n, o.tolist(), t.tolist()) for r, n, o, t in shingles.shingle_sets(texts, 4, shingles.WordHasher())]
    monkeypatch.setattr(shingles, "PIECE", 50)
    parts = [(r + o, t) for r, n, own, tok in shingles.shingle_sets(texts, 4, shingles.WordHasher()) for o, t in zip(own.tolist(), tok.tolist(), strict=True)]
    assert parts == [(r + o, t) for r, n, own, tok in whole for o, t in zip(own, tok, strict=True)]


def test_one_row_of_each_class_stays(spark):
    """Null and repeated ids keep no near duplicates."""
    import corpus_pipeline

    rng = random.Random(4)
    a, b, c, d = (" ".join(sentence(rng, 60)) for _ in range(4))
    rows = [(None, a), (None, a), (None, a + " more"), (None, b), (7, b), (7, b + " more"), (3, c), (3, d), (1, c), (9, d + " more"), (9, "short"), (9, "short"), (None, "short"), (None, "short"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = sorted((tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id", "text").collect()), key=repr)
    of_a = [t for i, t in out if i is None and t in (a, a + " more")]
    of_b = [t for i, t in out if i == 7]
    assert len(of_a) == 1 and len(of_b) == 1 and of_b[0] in (b, b + " more")
    assert out == sorted([(None, of_a[0]), (7, of_b[0]), (1, c), (3, d), (9, "short"), (None, None)], key=repr)


PAGES = "page_id long, url string, html string, text string, fixed string"


def page(i, body, extra=""):
    return (f"<html><head><title>t{i}</title></head><body><div class='top'><a href=/>Home</a></div><div class='wrap'><div class='story'><h2>Title {i}</h2>{body}"
            f"<p>Posted on our site</p></div><div class='rail'>short {i}</div></div>{extra}<footer>foot</footer></body></html>")


def test_slots_of_unmarked_pages(spark):
    rng = random.Random(2)
    rows = [(i, f"http://h.example/{i}", page(i, "".join(f"<p>{' '.join(sentence(rng, 40))}</p>" for _ in range(rng.randrange(1, 4)))), "x", None) for i in range(30)]
    rows += [(100, "http://h.example/100", rows[0][2], None, None), (101, None, None, None, None), (102, "odd url", "", None, None), (103, "http://solo/", "<p>only<p>two", None, None)]
    out = {r["page_id"]: r["text"] for r in html_main.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert len(out) == 34
    for i in range(30):
        want = [f"Title {i}", *re.findall(r"<p>(.*?)</p>", rows[i][2])]
        assert out[i] == "\n".join(w for w in want if w != "Posted on our site"), i
    assert out[100] == out[0] and out[101] == out[102] == "" and out[103] == "only\ntwo"
    assert html_main.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_slots_of_per_page_classes(spark):
    """No row of the templates grows with its host where every page names its own places."""
    rows = [(i, "http://wp.example/", f"<body class='postid-{i}'><div class=top>Home</div><article class='post-{i}'><p>text {i} {'w ' * i}</p></article></body>", None, None)
            for i in range(40)]
    pages = spark.createDataFrame(rows, PAGES)
    for r in html_main.templates(pages).collect():
        assert max((len(v) for v in r.asDict().values() if isinstance(v, list)), default=0) <= 3
    assert {r["page_id"]: r["text"] for r in html_main.extract(pages).collect()} == {i: f"text {i} {'w ' * i}".strip() for i in range(40)}


@pytest.mark.parametrize("n", [5, 9, 10, 20])
def test_template_text_at_any_page_count(spark, n):
    """Blocks that repeat on all pages, twice a page or in a place of some pages go; what near copies share stays."""
    rng = random.Random(n)
    own = [[" ".join(sentence(rng, 30)) for _ in range(3)] for _ in range(n)]
    rows = [(i, "http://few.example/", f"<article><p>Read this first</p><p>{a}</p><p>Go on</p><p>{b}</p><p>Go on</p>{'<div class=offer>Only today</div>' if i < max(5, n // 4) else ''}<p>{c}</p></article>", None, None)
            for i, (a, b, c) in enumerate(own)]
    copied = [" ".join(sentence(rng, 30)) for _ in range(9)]
    rows += [(100 + i, "http://copies.example/", f"<article><p>{'<p>'.join([*copied[:i % 9], f'changed {i}', *copied[i % 9:]])}</article>", None, None) for i in range(n)]
    out = {r["page_id"]: r["text"].split("\n") for r in html_main.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert [out[i] for i in range(n)] == own
    assert all(out[100 + i] == [*copied[:i % 9], f"changed {i}", *copied[i % 9:]] for i in range(n))


@pytest.mark.parametrize("n", [2, 3, 4, 12])
def test_articles_that_share_a_paragraph_keep_it(spark, n):
    rng = random.Random(n)
    shared = " ".join(sentence(rng, 30))
    own = [[" ".join(sentence(rng, 30)), *([shared] if i < 4 else []), " ".join(sentence(rng, 30))] for i in range(n)]
    rows = [(i, "http://share.example/", f"<nav>Home</nav><article><p>{'<p>'.join(o)}</article>", None, None) for i, o in enumerate(own)]
    out = {r["page_id"]: r["text"].split("\n") for r in html_main.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert [out[i] for i in range(n)] == own


@pytest.mark.parametrize(("html", "text"), [
    ("<form id=aspnetForm><nav><a>Home</a><a>More</a></nav><div><h1>T</h1><p>the whole long text of it</div></form>", "T\nthe whole long text of it"),
    ("<form><nav>menu</nav><article><p>the text</article><footer>no</footer></form>", "the text"),
    ("<nav><a>Home</a><article><p>the text</article>", "the text"), ("<nav><a>Home</a><a>Other</a></nav><p>short", "short"),
    ("<article><form><p>the whole long text</p></form><form>mail</form></article>", "the whole long text"), ("<aside>side side side side</aside><article>text</article>", "text"),
])
def test_tags_on_wrappers(html, text):
    assert html_main.main_text(html) == text


@pytest.mark.parametrize("html", [
    "<p>a" + "<span>x" * 50_000, "<div>x" * 50_000, "<span>x" * 40_000 + "</b>" * 40_000, "<span>" * 30_000 + "<div>x</div>" * 30_000, "<a '" * 250_000, "<a" * 400_000,
    "<a '\"<b \">" * 80_000, "<i>x</i>" * 50_000, "<!-- " * 50_000, "<p x='" * 50_000 + '"<p y="' * 50_000,
])
def test_long_and_odd_pages_take_linear_time(html):
    begin = time.process_time()
    tracemalloc.start()
    html_main.page_tokens(html[: len(html) // 8])
    small = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    html_main.page_tokens(html)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 << 20 and most < 14 * small + (4 << 20)
    begin = time.process_time()
    html_main.page_tokens(html)
    assert time.process_time() - begin < 4


def test_page_texts_against_a_second_parser():
    """Every given page has one article of paragraphs: the standard library's parser must find the same blocks there."""
    import duckdb
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.out, self.blocks = 0, 0, [""]

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            self.out += tag in ("script", "style")
            if tag in ("h1", "h2", "p", "li", "ul", "article", "section", "div", "blockquote"):
                self.blocks.append("")
            if tag == "br" and self.inside:
                self.blocks[-1] += " "

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            self.out -= tag in ("script", "style")
            if tag in ("h1", "h2", "p", "li", "ul", "article", "section", "div", "blockquote"):
                self.blocks.append("")

        def handle_data(self, data):
            if self.inside and not self.out:
                self.blocks[-1] += data

    pages = duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet' where html is not null").fetchall()
    checked = 0
    for (page,) in pages:
        if page.count("<article") != 1 or page.count("</article>") != 1:
            continue
        parser = Article()
        parser.feed(page)
        want = "\n".join(b for b in (" ".join(b.split()) for b in parser.blocks) if b)
        assert html_main.main_text(page) == want
        checked += 1
    assert checked > 0.8 * len(pages)


def test_text_around_the_slot_stays(spark):
    rng = random.Random(5)
    own = [[" ".join(sentence(rng, n)) for n in (3, 12, 80)] for _ in range(8)]
    rows = [(i, "http://entry.example/", f"<body><div class=top>Home</div><div class=post><h1>{a}</h1><p>{b}</p><div class=entry>{c}</div></div><div class=views>{i} views</div>", None, None)
            for i, (a, b, c) in enumerate(own)]
    many = " ".join(sentence(rng, 500))
    rows += [(50, "http://entry.example/", f"<body><div class=top>Home</div><div class=post><div class=entry>One line</div></div><div class=gallery>{many}</div>", None, None),
             (51, "http://solo.example/", rows[0][2], None, None), (52, "http://solo2.example/", f"<article>One line</article><div class=gallery>{many}</div>", None, None)]
    out = {r["page_id"]: r["text"].split("\n") for r in html_main.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert [out[i] for i in range(8)] == own
    assert out[50] == out[52] == ["One line", many]
    assert out[51] == ["Home", *own[0], "0 views"]


@pytest.mark.parametrize(("html", "text"), [
    ("<div class='content-sidebar-wrap'><main class='no-sidebar'><p>the whole text</main></div><div class=sidebar>side</div>", "the whole text"),
    ("<article class='post comments-open'><p>the whole text<div class=comments>bad</div></article>", "the whole text"),
    ("<div id='search-results'><article><p>the whole text</article></div><div class=ads>buy</div>", "the whole text"),
    ("<div class='has-sidebar'><h1>The</h1><p>whole text</div><div class=sidebar>side</div>", "The\nwhole text"),
    ("<div class='header-wrap'><p>the whole text</div><div class=header>side</div>", "the whole text"),
    ("<div class=ad>a long advert before it</div><article>short</article><div class=comments><article>no</article></div>", "short"),
    ("<p>the <span class=share>share</span> text", "the text"), ("<main><div class='has-sidebar'><p>the text</div><div class=widget>w</div></main>", "the text"),
])
def test_names_on_wrappers(html, text):
    assert html_main.main_text(html) == text


@pytest.mark.parametrize(("html", "text"), [
    ("<article><h1>A &amp; B</h1><p>x\n <b>y</b>&nbsp;z<br>w<p>next<script>var t='</p>';</script> part</article><footer>no</footer>", "A & B\nx y z w\nnext part"),
    ("<main><header><h1>Head</h1><p>by me</p></header><p class='ad'>buy<p>real<ul><li>one<li>two</ul><section class='comments'><article>no</article></section></main>", "Head\nreal\none\ntwo"),
    ("<nav>a</nav><div id='cookie-notice'>b</div><form>c</form><aside>d</aside><p>text", "text"),
    ("plain < text > & more <", "plain < text > & more <"), ("", ""), ("<", "<"), ("<!-- x", ""), ("<p>&#x41;&eacute;&notacode;", "Aé¬acode;"),
])
def test_main_text(html, text):
    assert html_main.main_text(html) == text


def test_long_texts_that_share_halves_store_what_they_hold(spark, monkeypatch):
    """Three long texts share halves, two link: stored cells are in proportion to the words."""
    rng = random.Random(12)
    x, y, z = ([f"w{rng.randrange(10**9)}" for _ in range(30_000)] for _ in range(3))
    texts = [x + y, x + z, y + z, x + y[:-900] + z[:300]]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    held = {}
    stored = jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, name: held.setdefault(name, []).append(stored(df, name)) or held[name][-1])
    out = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    assert out == {0: 0, 1: 1, 2: 2, 3: 0}
    cells = [df.agg(F.sum(F.coalesce(F.size("prefix"), F.lit(0)) + 1)).first()[0] or 0 for df in held["open-units"]]
    assert max(cells) <= 2 * sum(map(len, texts))
    assert all(df.count() <= 12 for df in held["open-pairs"])


def test_long_and_short_prefixes_give_the_same_classes(spark, monkeypatch):
    rng = random.Random(13)
    base = [sentence(rng, 60) for _ in range(12)]
    rows = []
    for i in range(240):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "other"
        rows.append((i, " ".join(words), "en", "s", 0))
    docs = spark.createDataFrame(rows, DOCS)
    want = sorted(map(tuple, jaccard.near_duplicates(docs).collect()))
    for most in (0, 8):
        monkeypatch.setattr(jaccard, "CARRIED", most)
        assert sorted(map(tuple, jaccard.near_duplicates(docs).collect())) == want


def test_page_tokens_are_stored_side_by_side(spark, monkeypatch):
    """Rows of a token are neighbours in the stored files, which makes these smaller."""
    plans, stored = {}, html_main.stored
    monkeypatch.setattr(html_main, "stored", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and stored(df, name))
    html_main.extract(spark.createDataFrame([(1, "https://a.example/1", "<p>one</p>"), (2, "https://a.example/2", "<p>two</p>")], "page_id long, url string, html string")).collect()
    assert re.match(r"Sort \[host#\d+ ASC NULLS FIRST, token#\d+L ASC NULLS FIRST\], false", plans["page-tokens"])


def test_only_sets_with_enough_shared_shingles_are_stored_and_copies_once(spark, monkeypatch):
    """However full a filter of small size would be; exact copies in other batches carry no shingles again."""
    rng = random.Random(14)
    pool = [f"w{i}" for i in range(10**6)]
    alone = [" ".join(rng.choices(pool, k=300)) for _ in range(60)]
    near = [rng.choices(pool, k=300) for _ in range(40)]
    near = [" ".join(w[:at] + ["new"] + w[at + 1 :]) for w in near for at in (150, 151)]
    texts = alone + near + alone[:20] * 3 + [None, "", "a b"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).repartition(6)
    monkeypatch.setattr(jaccard, "BLOOM_BITS", 12, raising=False)
    held, stored = {}, jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, name: held.setdefault(name, stored(df, name)))
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect()}
    first = {t: i for i, t in reversed([*enumerate(texts)])}
    assert out == {i: (0 if not t else 1 if t == "a b" else 296, i if not t else first[t] // 2 * 2 if 60 <= i < 140 else first[t]) for i, t in enumerate(texts)}
    carried = held["shingle-sets"].filter("tokens is not null").agg(F.count("*"), F.countDistinct("sid"), F.sum(F.size("tokens")) - F.sum("n")).first()
    assert tuple(carried) == (100, 100, 0)


def test_near_duplicates_leave_no_shuffle_files(spark):
    """Only the shuffles of the returned rows may stay, which were not run yet."""
    was = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*.data")}
    before = files()
    jaccard.near_duplicates(spark.createDataFrame([(i, f"one two three four five six seven eight nine ten {i % 3}", "en", "s", 0) for i in range(30)], DOCS))
    until = time.time() + 10
    while (left := files() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == was


def test_chunks_hold_what_their_texts_hold(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from promptledger.llm import shingles

    rng = random.Random(15)
    texts = pa.array([" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 1, 3, 40, 400]))) or None for _ in range(300)])
    whole = [(r + o, t) for r, _, own, tok in shingles.shingle_sets(texts, 4, shingles.WordHasher()) for o, t in zip(own.tolist(), tok.tolist(), strict=True)]
    monkeypatch.setattr(shingles, "PIECE", 500)
    monkeypatch.setattr(jaccard, "ROWS_TOGETHER", 100)
    monkeypatch.setattr(jaccard, "TOKENS_TOGETHER", 3000)
    chunks = [*jaccard._chunks(texts, 4, shingles.WordHasher())]
    assert [(r + o, t) for r, _, own, tok in chunks for o, t in zip(own.tolist(), tok.tolist(), strict=True)] == whole
    assert [c[0] for c in chunks] == [0, *np.cumsum([c[1] for c in chunks])[:-1]] and sum(c[1] for c in chunks) == 300
    assert len(chunks) > 6 and max(len(c[3]) for c in chunks) <= 3000
    for owners in ([], [0], [0, 0, 3, 70, 300, 300, 2048], [40_000, 65_535]):
        assert jaccard._unpacked(jaccard._packed(np.array(owners, np.int64))).tolist() == owners
