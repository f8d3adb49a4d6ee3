"""N-gram Jaccard join by grouped prefixes: classes of texts whose word shingle sets overlap enough.

Two texts link when ``intersection * denominator >= union * numerator``. The result is one row per document with its class,
the documents reachable by links; no link between different texts is lost and no group of copies is expanded into pairs.

1. *Shared shingles.* Every shingle of a chunk of texts goes once, as 32 bits in one of many ranges of its hash, to the task that
   owns the range. Back come the texts of the chunk whose shingles other chunks hold too, so each text counts its shared ones.
2. *Possible sets.* A text links with another only if so many of its shingles are shared. All others are alone. Of the rest,
   equal sets become one row (copies are joined again at the end), with their shingles. The row that carries them is known to
   all tasks by 32 bits of a hash of set and id; where copies have equal ids, or hashes meet, more than one does.
3. *Prefixes.* Shingles are ordered by document frequency among these sets. Two sets that link have a common shingle among the
   first ``n - ceil(t * n) + 1`` of each; those in one set only come first and can't be common, so they are only counted.
4. *Groups.* Sets of one size with one prefix are one group. Groups meet by prefix shingle and are filtered by the bound that
   size and place of the common shingle put on the overlap.
5. *Verification.* First every member is compared with one representative of its group, and that with the group that
   is nearest to it: this joins most classes with one comparison a set. What missed its class meets the groups that share most
   of its prefix. Then all pairs of groups whose members are still in different classes are expanded and verified.

Cases: null texts, empty ones and those without words have the size 0 and link with nothing; very long texts are whole, and what is
stored for them is in proportion to their words; rows that repeat a text are one class; a class with known ids has the smallest as its
id, one of null ids only has null; ties in the order of shingles are broken by hash and change no result; an empty table gives no
rows; other columns are not read. Shingles and sets are 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptledger.llm.common import dropping_shuffles, stored
from promptledger.llm.components import components
from promptledger.llm.shingles import WordHasher, mix, shingle_sets

#: Shingles in a range on average; decides the number of ranges only.
RANGE_SIZE = 1 << 21
BYTES_PER_WORD = 4
#: Groups that a member without class meets before all others; it decides the order of the work only.
PROBES = 16
#: Prefixes up to this length are carried by their shingles; it bounds what is stored for a shingle, never a result.
CARRIED = 2048
#: Texts of a chunk, and shingles after which it ends; a longer text is a chunk of its own.
ROWS_TOGETHER, TOKENS_TOGETHER = 2048, 1 << 20
#: Parts by which chunks' lists of sets are dealt.
LISTS = 4096


def _chunks(texts: pa.Array, size: int, hasher: WordHasher) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """What ``shingle_sets`` gives, for stretches put together."""
    for start in range(0, len(texts), ROWS_TOGETHER):
        found, held, begin, end = [], 0, start, start
        for row, rows, owner, tokens in shingle_sets(texts.slice(start, ROWS_TOGETHER), size, hasher):
            if held and held + len(tokens) > TOKENS_TOGETHER:
                yield begin, end - begin, *map(np.concatenate, zip(*found, strict=True))
                found, held, begin = [], 0, start + row
            found.append((owner + (start + row - begin), tokens))
            held, end = held + len(tokens), start + row + rows
        yield begin, end - begin, *map(np.concatenate, zip(*found, strict=True))


def _set_ids(rows: int, owner: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of shingles of each row, and a hash of their set."""
    n, sums = np.bincount(owner, minlength=rows), np.zeros(rows, np.uint64)
    if len(tokens):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sums[owner[first]] = np.add.reduceat(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), first)
    return n, mix(sums + n.astype(np.uint64))


def _seen_again(values: np.ndarray) -> np.ndarray:
    """Which of the 32-bit numbers occur more than once."""
    keys = np.sort(values.astype(np.uint64) << np.uint64(32) | np.arange(len(values), dtype=np.uint64))
    equal = keys[1:] >> np.uint64(32) == keys[:-1] >> np.uint64(32)
    again = np.zeros(len(values), bool)
    again[(keys & np.uint64(0xFFFFFFFF))[np.r_[False, equal] | np.r_[equal, False]].astype(np.int64)] = True
    return again


def _packed(owners: np.ndarray) -> bytes:
    """Ascending numbers below 65,536 as steps: all low bytes, then all high ones, which are nearly always 0."""
    return np.diff(owners, prepend=0).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    low, high = np.frombuffer(blob, np.uint8).reshape(2, -1).astype(np.int64)
    return np.cumsum(low | high << 8)


def _marks(sid: np.ndarray, key: np.ndarray) -> np.ndarray:
    """32 bits for the rows of one set and id."""
    return (mix(sid ^ mix(key.view(np.uint64))) >> np.uint64(32)).astype(np.uint32)


def possible_sets(docs: DataFrame, size: int, numerator: int, denominator: int, range_bits: int) -> np.ndarray:
    """Marks, in order, of a row (key, text) of each set so many of whose shingles occur in other texts that it may have a partner."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for row, rows, owner, tokens in _chunks(batch.column("text"), size, hasher):
                if not len(tokens):
                    continue
                n, sid = _set_ids(rows, owner, tokens)
                key = keys[row : row + rows]
                chunk = int(np.bitwise_xor.reduce(mix(mix(sid ^ mix(key.view(np.uint64))) + np.arange(rows, dtype=np.uint64))).astype(np.int64))
                order = np.argsort(tokens, kind="stable")
                equal = tokens[order][1:] == tokens[order][:-1]
                # What the chunk itself holds twice is shared: it is told once, and the rest is asked for.
                alone, told = np.ones(len(tokens), bool), order[np.r_[False, equal] & ~np.r_[equal, False]]
                alone[order[np.r_[False, equal] | np.r_[equal, False]]] = False
                hits = np.bincount(owner[~alone], minlength=rows)
                sent, whose = np.r_[tokens[alone], tokens[told]], np.r_[owner[alone], np.full(len(told), rows)]
                of = (sent >> np.uint64(64 - range_bits)).astype(np.int32)
                low = (sent >> np.uint64(32 - range_bits) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                by = np.argsort(of, kind="stable")
                of, low, whose = of[by], low[by], whose[by]
                names, start = np.unique(of, return_index=True)
                lists = [(low[a:b].tobytes(), _packed(whose[a:b])) for a, b in zip(start, [*start[1:], len(of)], strict=True)]
                lows, owners = zip((sid.tobytes(), np.r_[n, hits, key].tobytes()), *lists, strict=True)
                part = pa.array(np.r_[-1 - chunk % LISTS, names].astype(np.int32))
                chunks, width = pa.array(np.full(len(part), chunk)), pa.array(np.full(len(part), rows, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part, chunks, width, pa.array(lows, pa.binary()), pa.array(owners, pa.binary())], ["part", "chunk", "rows", "low", "owner"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["part"].iloc[0] < 0:
            return pdf[["chunk", "rows", "low", "owner"]]
        again, at, hits = _seen_again(np.frombuffer(b"".join(pdf["low"]), np.uint32)), 0, []
        for rows, blob in zip(pdf["rows"], pdf["owner"], strict=True):
            owners = _unpacked(blob)
            hits.append(_packed(owners[again[at : at + len(owners)] & (owners < rows)]))
            at += len(owners)
        return pd.DataFrame({"chunk": pdf["chunk"], "rows": pdf["rows"], "low": None, "owner": hits})

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        is_list = pdf["low"].notna()
        one = pdf[is_list].iloc[0]
        n, hits, key = np.frombuffer(one["owner"], np.int64).reshape(3, -1)
        for blob in pdf["owner"][~is_list]:
            hits = hits + np.bincount(_unpacked(blob), minlength=one["rows"])
        found = (n > 0) & (hits * denominator >= n * numerator)
        return pd.DataFrame({"sid": np.frombuffer(one["low"], np.int64)[found], "key": key[found]})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = _marks(batch.column("sid").to_numpy().view(np.uint64), batch.column("key").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([marks.tobytes()], pa.binary())], ["marks"])

    answers = docs.mapInArrow(deal, "part int, chunk long, rows int, low binary, owner binary").groupBy("part").applyInPandas(
        answer, "chunk long, rows int, low binary, owner binary")
    found = answers.groupBy("chunk").applyInPandas(count, "sid long, key long").groupBy("sid").agg(F.min("key").alias("key"))
    return np.unique(np.frombuffer(b"".join(r["marks"] for r in found.mapInArrow(pack, "marks binary").collect()), np.uint32))


def _sets(docs: DataFrame, size: int, marks: np.ndarray) -> DataFrame:
    """``doc_id``, ``n``, ``sid`` of every row (doc_id, key, text); with ``tokens``, its shingles, where it is marked."""
    possible = docs.sparkSession.sparkContext.broadcast(marks)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            known: set[int] = set()
            for row, rows, owner, tokens in shingle_sets(batch.column("text"), size, hasher):
                n, sid = _set_ids(rows, owner, tokens)
                # Equal sets of one batch carry their shingles once.
                own = _marks(sid, batch.column("key").to_numpy()[row : row + rows])
                place = np.minimum(np.searchsorted(possible.value, own), max(len(possible.value) - 1, 0))
                sent = (n > 0) & (possible.value[place] == own) if len(possible.value) else np.zeros(rows, bool)
                for i in np.flatnonzero(sent):
                    sent[i] = (s := int(sid[i])) not in known
                    known.add(s)
                values = tokens[sent[owner]].view(np.int64)
                ends = np.cumsum(np.r_[0, np.where(sent, n, 0)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array(~sent))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, rows), pa.array(n.astype(np.int64)), pa.array(sid.view(np.int64)), lists], ["doc_id", "n", "sid", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(sets, f"doc_id {kind}, n long, sid long, tokens array<long>")


def _needed(n_a: str, n_b: str, numerator: int, denominator: int) -> Column:
    """Least intersection with which sets of these sizes link."""
    return F.expr(f"({numerator} * ({n_a} + {n_b}) + {numerator + denominator - 1}) div {numerator + denominator}")


def _verified(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Those of the pairs (a, b) of set ids that link."""
    one = sets.select(F.col("sid").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("tokens_a"))
    two = sets.select(F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("tokens_b"))
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return pairs.join(one, "a").join(two, "b").filter(common >= _needed("n_a", "n_b", numerator, denominator)).select("a", "b")


def links(sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """``node`` and ``component`` of the distinct sets (sid, n, tokens) that link with another."""
    shingles = sets.select("sid", "n", F.explode("tokens").alias("token"))
    shared = shingles.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    need = F.expr(f"({numerator} * n + {denominator - 1}) div {denominator}")
    ordered = shingles.join(shared, "token").groupBy("sid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    prefixed = (
        ordered.withColumn("e", F.size("t")).withColumn("need", need).filter("e >= need")
        .select("sid", "n", "e", F.transform(F.slice("t", 1, F.expr("cast(e - need + 1 as int)")), lambda x: x["token"]).alias("prefix"))
        .withColumn("gid", F.xxhash64("n", "prefix"))
    )
    prefixed = stored(prefixed, "prefixes")
    groups = stored(
        prefixed.groupBy("gid").agg(F.first("n").alias("n"), F.first("e").alias("e"), F.first("prefix").alias("prefix"), F.min("sid").alias("rep")), "groups")
    postings = stored(groups.select("gid", "n", "e", "rep", F.posexplode("prefix").alias("pos", "token")), "postings")
    fits = F.least(F.col("a.e") - F.col("a.pos"), F.col("b.e") - F.col("b.pos")) >= _needed("a.n", "b.n", numerator, denominator)

    # Of the sets of about one size that share a shingle, the one with the fewest unshared ones is the nearest to the others.
    width = F.floor(F.log("n") / math.log(denominator / numerator)) if numerator < denominator else F.col("n")
    sized = postings.withColumn("width", width.cast("long"))
    hub = (
        sized.groupBy("token", "width").agg(F.max(F.struct((F.col("e") - F.col("n")).alias("less"), "e", "n", "gid", "rep", "pos")).alias("hub"))
        .select("token", F.explode(F.array(*(F.col("width") + d for d in (-1, 0, 1)))).alias("width"), "hub.*")
    )
    near = (
        sized.alias("a").join(hub.alias("b"), ["token", "width"]).filter((F.col("a.gid") != F.col("b.gid")) & fits)
        .groupBy(F.col("a.gid").alias("gid"), F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), "b.less").agg(F.count("*").alias("k"))
        .groupBy("gid", "a").agg(F.max_by("b", F.struct("less", "k", "b")).alias("b")).select("a", "b")
    )
    own = prefixed.join(groups.select("gid", "rep"), "gid").filter("sid != rep").select(F.col("sid").alias("a"), F.col("rep").alias("b"))
    first = components(_verified(near.union(own), sets, numerator, denominator))
    first = stored(first, "first-classes")

    # Members that missed their class are compared with the groups that share most of their prefix.
    classed = _classed(prefixed, first)
    near_units = _open_pairs(postings, groups, classed, fits)
    reps = classed.groupBy("gid", "class").agg(F.min("sid").alias("rep"))
    rank = F.row_number().over(W.partitionBy("gid_a", "class_a").orderBy(F.desc("k"), F.xxhash64("gid_a", "gid_b"), "class_b"))
    probes = (
        near_units.withColumn("rank", rank).filter(F.col("rank") <= PROBES)
        .join(reps.select(F.col("gid").alias("gid_a"), F.col("class").alias("class_a"), F.col("rep").alias("a")), ["gid_a", "class_a"])
        .join(reps.select(F.col("gid").alias("gid_b"), F.col("class").alias("class_b"), F.col("rep").alias("b")), ["gid_b", "class_b"]).select("a", "b")
    )
    second = stored(_joined(first, _verified(probes, sets, numerator, denominator)), "second-classes")

    # All that is left is compared, member by member.
    classed = _classed(prefixed, second)
    in_a = classed.select(F.col("sid").alias("a"), F.col("gid").alias("gid_a"), F.col("class").alias("class_a"))
    in_b = classed.select(F.col("sid").alias("b"), F.col("gid").alias("gid_b"), F.col("class").alias("class_b"))
    rest = _open_pairs(postings, groups, classed, fits).join(in_a, ["gid_a", "class_a"]).join(in_b, ["gid_b", "class_b"]).select("a", "b")
    return _joined(second, _verified(rest, sets, numerator, denominator))


def _joined(classes: DataFrame, more: DataFrame) -> DataFrame:
    """Classes (node, component) with further links between them."""
    return components(classes.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def _classed(prefixed: DataFrame, classes: DataFrame) -> DataFrame:
    return stored(
        prefixed.select("sid", "gid").join(classes, F.col("sid") == F.col("node"), "left").select("sid", "gid", F.coalesce("component", "sid").alias("class")), "classed")


def _open_pairs(postings: DataFrame, groups: DataFrame, classed: DataFrame, fits: Column) -> DataFrame:
    """Pairs of units (the members of one group in one class) of different classes that may link, with the number of shared prefix shingles.

    Of the units of a shingle, those of its most frequent class are only met by the others. Two units with prefixes of up to ``CARRIED``
    shingles meet once, at the first shingle that their prefixes share. Longer prefixes are not carried: there units meet at
    every shared shingle, in rows of ids only, and these are counted. So what is stored is in proportion to the words.
    """
    units = postings.select("token", "gid", "n", "e", "pos").join(classed.select("gid", "class").distinct(), "gid").withColumn("unit", F.xxhash64("gid", "class"))
    major = (
        units.groupBy("token", "class").agg(F.count("*").alias("k")).groupBy("token")
        .agg(F.count("*").alias("classes"), F.max_by("class", F.struct("k", "class")).alias("major")).filter("classes > 1").select("token", "major")
    )
    carried = groups.select("gid", F.when(F.size("prefix") <= CARRIED, F.col("prefix")).alias("prefix"))
    open_units = stored(units.join(major, "token").join(carried, "gid"), "open-units")
    once = (F.col("b.class") == F.col("b.major")) | (F.col("a.unit") < F.col("b.unit"))
    shared = F.array_intersect("a.prefix", "b.prefix")
    is_short = F.col("a.prefix").isNotNull() & F.col("b.prefix").isNotNull()
    met = open_units.filter("class != major").alias("a").join(
        open_units.alias("b"),
        (F.col("a.token") == F.col("b.token")) & (F.col("a.class") != F.col("b.class")) & once & fits & F.coalesce(F.get(shared, F.lit(0)) == F.col("a.token"), ~is_short))
    pair = [F.col("a.gid").alias("gid_a"), F.col("a.class").alias("class_a"), F.col("b.gid").alias("gid_b"), F.col("b.class").alias("class_b")]
    found = met.select(*pair, F.when(is_short, F.size(shared)).otherwise(1).alias("k"))
    return stored(found.groupBy("gid_a", "class_a", "gid_b", "class_b").agg(F.sum("k").cast("int").alias("k")), "open-pairs")


def near_duplicates(docs: DataFrame, size: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs`` (doc_id, text); by default five words and 0.8."""
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("key"))
    with dropping_shuffles(docs.sparkSession):
        volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        range_bits = min(20, max(4, (volume // BYTES_PER_WORD // RANGE_SIZE).bit_length()))
        marks = possible_sets(texts.select("key", "text"), size, numerator, denominator, range_bits)
        rows = stored(_sets(texts, size, marks), "shingle-sets")
        sets = stored(
            rows.filter("tokens is not null").groupBy("sid").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")), "distinct-sets")
        linked = links(sets, numerator, denominator)
        firsts = rows.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("first"))
        classes = stored(
            firsts.join(linked, F.col("sid") == F.col("node"), "left").select("sid", "first", F.coalesce("component", "sid").alias("class")), "classes")
    least = classes.groupBy("class").agg(F.min("first").alias("component_id"))
    named = classes.join(least, "class").select("sid", "component_id")
    return (
        rows.select("doc_id", "n", "sid").join(named, "sid", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )
