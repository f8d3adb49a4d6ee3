"""Token counts behind a digest cache.

Content is normalised (a null is the empty text, broken UTF-8 is repaired; nothing that a tokenizer could tell apart changes) and
named by its SHA-256 digest. A tokenizer version is the digest of its file, its library and that library's version. Counts are kept
in Parquet files of (version, content, n_tokens): the distinct digests of a table are joined to them, each distinct text that is
missing is encoded once and appended, and every row looks its count up. Copies, in one run or in later ones, are never encoded again.

Texts of copies are reduced to one before they are shuffled, and only where something is missing; where few are, Spark's size check
turns the test for them into a filter of the scan. A digest in a third of all rows is one row of each task there. Counts are joined to
narrow rows of digests: the digests of more than a ``HOT_SHARE``th of all rows, of which there are fewer than that, by broadcast, all
others by shuffle.

The cache is only appended to, by whole Parquet jobs, and read as one count per digest, so a lost or repeated append, or two runs that
count the same text at once, change nothing.

Cases: a null or empty text has no tokens; texts of any length are whole (``BATCH_BYTES`` only bounds how many are encoded together);
strings of special tokens inside a text count as the tokenizer's library does by default; ties cannot arise; repeated rows each get
their count; an empty table gives no rows and appends nothing; other columns of any name are kept and replaced only by a result's.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import os
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptledger.llm.common import scratch, stored, text_or_empty

CACHE_SCHEMA = "version string, content binary, n_tokens long"
#: Texts encoded together; bounds memory, never a result.
BATCH_BYTES = 1 << 20
#: A digest of more than this share of all rows is joined by broadcast; there are fewer than this many.
HOT_SHARE = 1000
#: Words remembered per Python worker.
REMEMBERED = 1 << 18
#: Fixed value: how byte-level merge tokenizers cut a text into the words that they merge inside.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose classes two libraries agree on (a test asks for each); texts with others are encoded whole.
PLAIN_UPTO = 0x36F
#: Library of each kind of tokenizer file.
LIBRARIES = {".json": "tokenizers", ".model": "sentencepiece", ".tiktoken": "tiktoken"}


def default_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _kind(path: str) -> str:
    kind = os.path.splitext(path)[1]
    if kind not in LIBRARIES:
        raise ValueError(f"no library for {path}")
    return kind


def version_of(path: str, content: bytes) -> str:
    """Digest of what decides a count: the file, its library and the library's version."""
    library = LIBRARIES[_kind(path)]
    return hashlib.sha256(b"\0".join([content, library.encode(), importlib.metadata.version(library).encode()])).hexdigest()


def counter(kind: str, content: bytes) -> Callable[[list[str]], list[int]]:
    """Counts of a list of texts by the library of that kind of file, without begin, end or other added tokens."""
    if kind == ".json":
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(content.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()


        def count(texts: list[str]) -> list[int]:
            return list(map(len, tokenizer.encode_batch_fast(texts, add_special_tokens=False)))

        return _by_words(count, list(tokenizer.get_added_tokens_decoder().values())) if _cuts_at_words(content) else count
    if kind == ".model":
        from sentencepiece import SentencePieceProcessor

        pieces = SentencePieceProcessor(model_proto=content)
        return lambda texts: list(map(len, pieces.encode(texts, num_threads=1)))
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
    coding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(coding.encode_ordinary(t)) for t in texts]


def _cuts_at_words(content: bytes) -> bool:
    """Whether a tokenizer only merges inside the words of ``BYTE_LEVEL``."""
    file = json.loads(content)
    cut = file.get("pre_tokenizer") or {}
    return (
        file.get("normalizer") is None and file["model"].get("type") == "BPE" and not file["model"].get("dropout")
        and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    )


def _by_words(count: Callable[[list[str]], list[int]], added: list[Any]) -> Callable[[list[str]], list[int]]:
    """Counts as sums over words, each encoded once by ``count`` and remembered. Texts with rarer characters or with the string of an
    ``added`` token are encoded whole."""
    import regex

    words = regex.compile(BYTE_LEVEL)
    whole = regex.compile("|".join([f"[^\0-{chr(PLAIN_UPTO)}]", *(regex.escape(t.content) for t in added)]))
    known: dict[str, int] = {}

    def counts(texts: list[str]) -> list[int]:
        if len(known) > REMEMBERED:
            known.clear()
        cut = [None if whole.search(t) else words.findall(t) for t in texts]
        new = list({w for c in cut if c for w in c}.difference(known))
        known.update(zip(new, count(new), strict=True))
        rest = iter(count([t for t, c in zip(texts, cut, strict=True) if c is None]))
        return [next(rest) if c is None else sum(map(known.__getitem__, c)) for c in cut]

    return counts


def normalised(text: Column) -> Column:
    return F.make_valid_utf8(text_or_empty(text))


def content_digest(text: Column) -> Column:
    """SHA-256 of the normalised content, 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def cached(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts, one row per (version, content)."""
    return spark.read.schema(CACHE_SCHEMA).parquet(cache).groupBy("version", "content").agg(F.min("n_tokens").alias("n_tokens"))


#: The counter that a Python worker made last; it and the words it remembers serve the worker's next tasks.
_COUNTERS: dict[str, Callable[[list[str]], list[int]]] = {}


def _encoded(texts: DataFrame, kind: str, file: Any, version: str) -> DataFrame:
    """(version, content, n_tokens) of (content, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if version not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[version] = counter(kind, file.value)
        count = _COUNTERS[version]
        for batch in batches:
            counts: list[int] = []
            part: list[str] = []
            room = BATCH_BYTES
            for text in batch.column("text"):
                part.append(text.as_py())
                room -= len(part[-1])
                if room <= 0:
                    counts += count(part)
                    part, room = [], BATCH_BYTES
            counts += count(part) if part else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * batch.num_rows, pa.string()), batch.column("content"), pa.array(counts, pa.int64())], ["version", "content", "n_tokens"])

    return texts.select("content", "text").mapInArrow(run, CACHE_SCHEMA)


def count_tokens(docs: DataFrame, cache: str | None = None, tokenizer: str | None = None, text: str = "text",
                 n_tokens: str = "n_tokens", n_bytes: str = "n_bytes", content: str | None = None) -> DataFrame:
    """``docs`` without its text, with the UTF-8 length and the number of tokens of the whole text (and its digest, if named).

    ``cache`` is a folder that driver and executors share; without one the counts last for this call. ``tokenizer`` is a file of one
    of ``LIBRARIES``. Starts jobs: the digests, the missing digests and the append.
    """
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    with open(path, "rb") as f:
        data = f.read()
    kind, version, cache = _kind(path), version_of(path, data), cache or scratch(spark, "token-cache")
    lengths = F.octet_length(text_or_empty(F.col(text))).cast("long")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (text, n_tokens, n_bytes, content)]
    rows = stored(docs.select(F.struct(*kept, F.lit(True).alias("__row")).alias("__kept"), lengths.alias("__bytes"),
                              content_digest(F.col(text)).alias("__content")), "token-digests")
    copies = stored(rows.groupBy("__content").agg(F.count(F.lit(1)).alias("__copies")), "token-contents")
    total = copies.agg(F.sum("__copies")).first()[0] or 0
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)  # the folder exists from here on

    def stored_counts() -> DataFrame:
        mine = cached(spark, cache).filter(F.col("version") == version)
        return mine.select(F.col("content").alias("__content"), F.col("n_tokens").alias("__tokens"))

    missing = stored(copies.join(stored_counts(), "__content", "left_anti").select(F.col("__content").alias("content")), "token-misses")
    if not missing.isEmpty():
        texts = (
            docs.select(content_digest(F.col(text)).alias("content"), normalised(F.col(text)).alias("text"))
            .groupBy("content").agg(F.first("text").alias("text")).join(missing, "content", "left_semi")
        )
        _encoded(texts, kind, spark.sparkContext.broadcast(data), version).write.mode("append").parquet(cache)

    counts = copies.join(stored_counts(), "__content")
    hot = counts.filter(F.col("__copies") * HOT_SHARE > total).select("__content", F.col("__tokens").alias("__hot"))
    cold = counts.filter(F.col("__copies") * HOT_SHARE <= total).select("__content", F.col("__tokens").alias("__cold"))
    # Fewer than HOT_SHARE digests are hot; the rest of the rows have no hot key.
    first = rows.join(F.broadcast(hot), "__content", "left")
    mine = [F.col(f"__kept.`{c}`").alias(c) for c in docs.columns if c not in (text, n_tokens, n_bytes, content)]
    mine += [F.col("__content").alias(content)] if content else []

    def out(df: DataFrame, tokens: str) -> DataFrame:
        return df.select(*mine, F.col("__bytes").alias(n_bytes), F.col(tokens).alias(n_tokens))

    return out(first.filter("__hot is not null"), "__hot").unionByName(out(first.filter("__hot is null").join(cold, "__content"), "__cold"))
