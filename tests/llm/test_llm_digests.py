"""Merkle manifests, collocations and token counts against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import DOCS, LONG, awkward_docs, empty_docs, sentence
from pyspark.sql import functions as F

from promptledger.llm import merkle, phrases, token_counts
from promptledger.llm.common import scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- manifest ----------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def manifest_of(rows, changed):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[4])))
        trees[s] = levels([leaf_of(r, r[4]) for r in by[s]])
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for number, s in enumerate(order):
        for i, r in enumerate(by[s]):
            digest = leaf_of(r, r[4].translate(LOWER) if changed(r[0]) and r[4] is not None else r[4])
            siblings = ""
            for path, at in ((trees[s], i), (top, number)):
                for level in path[:-1]:
                    kids = level[at // 16 * 16:at // 16 * 16 + 16]
                    siblings += "".join(kids[:at % 16] + kids[at % 16 + 1:])
                    digest, at = H(*kids[:at % 16], digest, *kids[at % 16 + 1:]), at // 16
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], H(siblings), digest, digest == top[-1][0]))
    return sorted(out, key=repr)


def fifth(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def changed_text():
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))


def source_sizes(sizes):
    return [(i * 7, f"s{n:02}", "en", i, f"Text {i}") for n, size in enumerate(sizes) for i in range(size)]


@pytest.mark.parametrize("rows", [
    source_sizes([1]), source_sizes([17]), source_sizes([1, 2, 16, 17, 256, 257, 300]), source_sizes([3] * 20 + [40]),
    [(i, None if i % 3 else "hot", None, None, None if i % 5 else "Aa") for i in range(600)], [(7, "s", "en", 1, "Same")] * 70 + [(None, "s", "en", 1, "x")] * 3,
], ids=str)
def test_manifest_equals_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    got = merkle.manifest(docs, changed_text()).collect()
    assert sorted(map(tuple, got), key=repr) == manifest_of(rows, fifth)


def test_manifest_awkward(spark):
    docs = awkward_docs(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    out = merkle.manifest(docs, changed_text(), carry=("doc_id", "hash", "key", "tokens"))
    assert out.columns[:4] == ["doc_id", "hash", "key", "tokens"]
    assert sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in out.collect()), key=repr) == manifest_of(rows, fifth)
    assert all(r["verified"] for r in merkle.manifest(docs).collect())
    assert merkle.manifest(empty_docs(spark), changed_text()).count() == 0


# --- collocations ------------------------------------------------------------------------------


def collocations_of(rows, longest=5, least=100, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if a >= least and len(p) > 1}
        covered = {p[i:i + k] for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if a >= count[p[i:i + k]]}
        rows = []
        for p, a in candidates.items():
            if p not in covered:
                score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def test_collocations_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_WORDS", 400)
    monkeypatch.setattr(phrases, "BUCKET_WORDS", 300)
    rng = random.Random(3)
    phrase = ["in the long run", "a b a b a", "New York", "x x x x x x"]
    rows = []
    for i in range(400):
        words = sentence(rng, rng.randrange(0, 60), 40)
        for _ in range(rng.randrange(4)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(phrase))
        text = "".join(w + rng.choice([" "] * 12 + ["\t", "  ", ". ", ",", "\n", " ? ", "\r\n"]) for w in words)
        rows.append((rng.choice(["en", "en", "fr", None]), None if i % 50 == 0 else text))
    rows += [("hot", "one very common line, again and again")] * 300
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert sorted(map(tuple, phrases.collocations(docs, min_count=7).collect())) == collocations_of(rows, least=7)
    assert sorted(map(tuple, phrases.collocations(docs, longest=3, min_count=20, top=5).collect())) == collocations_of(rows, 3, 20, 5)


def test_collocations_awkward(spark):
    docs = awkward_docs(spark)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, phrases.collocations(docs, min_count=2).collect())) == collocations_of(rows, least=2)
    assert phrases.collocations(empty_docs(spark), min_count=1).count() == 0
    long = spark.createDataFrame([("en", LONG + " " + LONG)], "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(long, min_count=2).collect())) == collocations_of([("en", LONG + " " + LONG)], least=2)


def test_words_and_pieces():
    import pyarrow as pa

    texts = ["Ab  cD\té.x", None, "", "...", "É a", "\x00 b\x0bc", " "]
    words, new = phrases.words_of(pa.array(texts, pa.string()).slice(0, 7))
    assert words.to_pylist() == ["ab", "cd", "é", "x", "É", "a", "\x00", "b", "c"]
    assert new.tolist() == [True, False, False, True, True, False, True, False, True]


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_index_extends_in_both_directions(depth):
    rng = np.random.default_rng(depth)
    text = np.r_[0, rng.integers(0, 4, 300)].astype(np.int32)
    forward, backward = (phrases.Index(phrases.transform(t, 4)) for t in (text, text[::-1]))
    grams = {(int(s),): (int(a), int(b), int(c)) for s, a, b, c in zip(range(4), *(lambda w: (w.lo, w.mirrored, w.size))(forward.words()), strict=True) if s}
    for step in range(depth):
        keys = list(grams)
        of = phrases.Intervals(*(np.array([grams[k][i] for k in keys]) for i in range(3)))
        number, symbol, found = backward.extend(of.turned()) if step % 2 else forward.extend(of)
        found = found.turned() if step % 2 else found
        grams = {(keys[i] + (int(s),) if step % 2 else (int(s),) + keys[i]): (int(a), int(b), int(c)) for i, s, a, b, c in zip(number, symbol, found.lo, found.mirrored, found.size, strict=True)}
        size = step + 2
        want = Counter(tuple(map(int, text[i:i + size])) for i in range(len(text) - size + 1) if (text[i:i + size] > 0).all())
        assert {k: v[2] for k, v in grams.items()} == want


# --- token counts ------------------------------------------------------------------------------


def library_counts(texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(token_counts.default_tokenizer()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_counts_and_their_cache(spark, monkeypatch):
    odd = ["<|endoftext|> inside <|endoftext|>", "  \n\n  x", "it's we'LL 'tis", "日本語 Привет ß ǆ", "àé", "\x1c\x1d \x85\xa0 .", "\U0001f600" * 9, "", None]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(odd)] + [(100 + i, "one text in many copies", "en", "s", 0) for i in range(2000)]
    docs = spark.createDataFrame(rows, DOCS).unionByName(awkward_docs(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    texts = [r["text"] for r in docs.collect()]
    want = sorted(zip((len((t or "").encode()) for t in texts), library_counts(texts), strict=True))
    cache = scratch(spark, "token-cache-test")
    encoded = []
    encode = token_counts._encoded
    monkeypatch.setattr(token_counts, "_encoded", lambda t, *rest: encoded.append(t.count()) or encode(t, *rest))
    for _ in range(2):
        out = token_counts.count_tokens(docs, cache)
        assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_bytes", "n_tokens"]
        assert sorted((r["n_bytes"], r["n_tokens"]) for r in out.collect()) == want
    assert encoded == [len({t or "" for t in texts})]  # distinct texts, once
    more = docs.unionByName(spark.createDataFrame([(1, "a new text", "en", "s", 0)], DOCS))
    assert token_counts.count_tokens(more, cache).count() == docs.count() + 1 and encoded[1:] == [1]
    # A count that was appended twice changes nothing; another tokenizer has its own counts.
    spark.read.parquet(cache).write.parquet(cache, mode="append")
    assert token_counts.count_tokens(docs, cache).count() == docs.count()
    token_counts.count_tokens(docs.limit(3), cache, token_counts.default_tokenizer("piece_bpe_32k.model"))
    assert spark.read.parquet(cache).select("version").distinct().count() == 2


def test_token_counts_awkward(spark):
    docs = awkward_docs(spark).withColumns({"content": F.lit(1), "n_tokens": F.lit("old"), "version": F.lit(2)})
    out = token_counts.count_tokens(docs)
    assert out.count() == 11 and dict(out.dtypes)["n_tokens"] == "bigint" and {r["content"] for r in out.collect()} == {1}
    assert {r["doc_id"]: r["n_tokens"] for r in out.collect()}[6] == library_counts([LONG])[0]
    assert token_counts.count_tokens(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"])
def test_other_tokenizers(spark, name):
    texts = ["Hello  World", "</s> <s>", "", "é日本"]
    path = token_counts.default_tokenizer(name)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer=path).collect()}
    with open(path, "rb") as f:
        assert [got[i] for i in range(4)] == token_counts.counter(token_counts._kind(path), f.read())(texts)
    assert got[2] == 0 and min(got[0], got[3]) > 0


def test_plain_characters_are_cut_as_the_library_cuts_them():
    import regex
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(token_counts.default_tokenizer()).pre_tokenizer.pre_tokenize_str
    words = regex.compile(token_counts.BYTE_LEVEL)
    for c in map(chr, range(token_counts.PLAIN_UPTO + 1)):
        for text in (f"a{c}b", f"1{c} {c}'s", f"{c}{c} .{c}. ", f" {c}", f"{c}\n{c}1"):
            assert words.findall(text) == [text[a:b] for _, (a, b) in cut(text)]
