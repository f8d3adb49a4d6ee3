"""Phrase collocation mining: an FM-index over word ids per shard, interval extension in both directions, counts summed across shards.

Texts are cut into pieces at punctuation and line ends and pieces into words; A-Z count as a-z. Texts are put into shards of
``SHARD_WORDS`` words as they are read, no text is shuffled. Phrases of k words are found level by level, and a phrase lives on only if
its count over all shards reaches ``min_count``:

* level 1: every shard's dictionary; level 2: left extensions of all frequent words in an index of depth one;
* then each shard's text is broken between words that are no frequent pair, and an index of depth ``longest - 1`` of what is left is
  stored (both Burrows-Wheeler transforms, for either direction). Levels 3, 5, ... extend intervals to the right, 4, 6, ... to the left.

A part of a frequent phrase is at least as frequent, so nothing frequent is lost, and per level only extensions of frequent phrases are
shuffled, one count a shard and phrase however often it occurs. A shard's counts travel packed, one block for each bucket of phrases;
there are so many buckets that one holds ``BUCKET_WORDS`` counts at most on average, and a bucket's blocks are summed in one task. Ids
are numbers given to words and phrases, never hashes. A longer phrase that contains a shorter one is at most as
frequent as the extension by one word on its way, so the extensions alone tell which phrases a longer one covers.

Cases: a null text has no words; a null language is ``NO_LANG``; texts are whole, of any length (a shard is closed behind the text that
fills it); ties of score and count are ordered by phrase; repeated rows count as often as they occur; an empty table gives no rows; other
columns are not read. Products are decimals of 38 digits, which hold up to 10^17 words of a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptledger.llm.common import stored

NO_LANG = "und"
#: Words of a shard; bounds a task's memory.
SHARD_WORDS = 2 << 20
#: Words of the corpus for each bucket of phrases; decides the number of tasks that sum counts.
BUCKET_WORDS = 1 << 21
#: Bits of a place in a shard, of a shard's number in its task, and of a phrase's number in its bucket.
PLACE_BITS, NUMBER_BITS, IN_BUCKET_BITS = 30, 13, 32

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b" \t")] = 1
_CLASS[list(SEPARATORS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32

_SHARDS = "shard long, size int, ids binary, dictionaries array<struct<lang:string, start:int, words:array<string>, counts:array<int>>>"
_BLOCKS = "bucket int, shard long, size int, base binary, ext binary, n binary, lo binary, mirrored binary"
#: Frequent phrases: packed, those of a shard for its task, and each once with its total (no shard).
_PHRASES = "shard long, size int, id binary, base binary, ext binary, n binary, lo binary, mirrored binary, phrases array<struct<id:long,base:long,ext:long,total:long>>"
_INDEX = "shard long, size int, symbols binary, forward binary, backward binary"


# --- words -------------------------------------------------------------------------------------


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts, and for each whether a piece starts with it."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    first = ends[:-1] - ends[0]
    kind = _CLASS[raw]
    inside = kind == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = first[first < len(raw)]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    breaks = np.cumsum(kind == 2, dtype=np.int64)
    text = np.zeros(len(raw), np.int64)
    text[first] = 1
    piece = breaks[starts] + np.cumsum(text)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = piece[1:] != piece[:-1]
    at = np.empty(len(starts) + 1, np.int64)
    at[:-1] = np.cumsum(inside)[starts] - 1
    at[-1] = np.count_nonzero(inside)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(_LOWER[raw[inside]])), new


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.astype(np.int32).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=4 * size, codec="zstd"), np.int32) if size else np.zeros(0, np.int32)


def _shard(number: int, parts: dict[str, list[tuple[pa.Array, np.ndarray]]]) -> pa.RecordBatch:
    """Word numbers of all texts, 0 before each piece, and the dictionary of every language; numbers start at 1 and never repeat."""
    ids, dictionaries, start = [], [], 0
    for lang, found in parts.items():
        new = np.concatenate([n for _, n in found])
        coded = pa.chunked_array([w for w, _ in found]).combine_chunks()
        coded = (coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        out = np.zeros(len(codes) + np.count_nonzero(new), np.int32)
        out[np.arange(len(codes)) + np.cumsum(new)] = codes + start + 1
        ids.append(out)
        counts = np.bincount(codes, minlength=len(coded.dictionary)).astype(np.int32)
        dictionaries.append((lang, start, coded.dictionary.cast(pa.string()), pa.array(counts)))
        start += len(counts)
    text = np.concatenate([*ids, np.zeros(1, np.int32)])
    langs, starts, words, counts = zip(*dictionaries, strict=True)
    cuts = pa.array(np.cumsum([0, *map(len, counts)]).astype(np.int32))
    each = pa.StructArray.from_arrays(
        [pa.array(langs, pa.string()), pa.array(starts, pa.int32()), pa.ListArray.from_arrays(cuts, pa.concat_arrays(words)), pa.ListArray.from_arrays(cuts, pa.concat_arrays(counts))],
        ["lang", "start", "words", "counts"])
    rows = pa.ListArray.from_arrays(pa.array([0, len(langs)], pa.int32()), each)
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([len(text)], pa.int32()), pa.array([_packed(text)], pa.binary()), rows], ["shard", "size", "ids", "dictionaries"])


def _to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, size, parts = TaskContext.get().partitionId() << NUMBER_BITS, 0, {}
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            langs = part.column("lang")
            for lang in pc.unique(langs).to_pylist():
                words, new = words_of(part.column("text").filter(pc.equal(langs, lang)))
                if len(words):
                    parts.setdefault(lang, []).append((words, new))
                    size += len(words)
            if size >= SHARD_WORDS:
                yield _shard(number, parts)
                number, size, parts = number + 1, 0, {}
    if size:
        yield _shard(number, parts)


# --- index -------------------------------------------------------------------------------------


def transform(text: np.ndarray, depth: int) -> np.ndarray:
    """Burrows-Wheeler transform of the cyclic ``text``, its rows in order of their first ``depth`` symbols (a power of two)."""
    rank, width = text.astype(np.int64), 1
    while width < depth:
        pair = rank * (int(rank.max(initial=0)) + 1) + np.roll(rank, -width)
        rank = np.unique(pair, return_inverse=True)[1]
        width *= 2
    return np.roll(text, 1)[np.argsort(rank, kind="stable")]


@dataclass
class Intervals:
    """Rows that start with a phrase, in an index and in the index of the reversed text."""

    lo: np.ndarray
    mirrored: np.ndarray
    size: np.ndarray

    def take(self, chosen: np.ndarray) -> Intervals:
        return Intervals(self.lo[chosen], self.mirrored[chosen], self.size[chosen])

    def turned(self) -> Intervals:
        return Intervals(self.mirrored, self.lo, self.size)


class Index:
    """One direction of an FM-index: the transform and, for every row, the row that its symbol leads to."""

    def __init__(self, last: np.ndarray) -> None:
        self.last = last
        by_symbol = np.argsort(last, kind="stable")
        self.leads_to = np.empty(len(last), np.int64)
        self.leads_to[by_symbol] = np.arange(len(last))
        self.sizes = np.bincount(last, minlength=1)

    def words(self) -> Intervals:
        """The interval of every symbol, the same in both directions; that of a break is taken for empty."""
        starts, sizes = np.cumsum(self.sizes) - self.sizes, self.sizes.copy()
        sizes[0] = 0
        return Intervals(starts, starts.copy(), sizes)

    def extend(self, of: Intervals) -> tuple[np.ndarray, np.ndarray, Intervals]:
        """All extensions by one symbol in front: number of the extended interval, symbol, interval. A break extends nothing."""
        begin = np.cumsum(of.size) - of.size
        rows = np.repeat(of.lo - begin, of.size) + np.arange(int(of.size.sum()))
        number = np.repeat(np.arange(len(of.size)), of.size)
        wide = len(self.sizes)
        pair, first, count = np.unique(number * wide + self.last[rows], return_index=True, return_counts=True)
        number, symbol = pair // wide, pair % wide
        upto = np.cumsum(count) - count
        # In the other direction the extensions of one interval follow each other in order of the symbol.
        mirrored = of.mirrored[number] + upto - begin[number]
        real = symbol > 0
        return number[real], symbol[real], Intervals(self.leads_to[rows[first[real]]], mirrored[real], count[real])


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte: all lowest bytes first, so that equal high bytes vanish in the compression."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), codec="zstd", asbytes=True)


def _numbers(data: bytes, size: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, decompressed_size=width * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, size).T).view(kind).ravel()


def _bucket(base: np.ndarray, ext: np.ndarray, buckets: int) -> np.ndarray:
    mixed = base.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ext.astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(buckets)).astype(np.int64)


def _blocks(shard: int, base: np.ndarray, ext: np.ndarray, found: Intervals, buckets: int, placed: bool = True) -> pa.Table:
    """Counts of a shard's phrases (with their intervals, if ``placed``), one row for each bucket."""
    bucket = _bucket(base, ext, buckets)
    order = np.argsort(bucket, kind="stable")
    used, first = np.unique(bucket[order], return_index=True)
    cuts = np.split(order, first[1:]) if len(used) else []
    packed = [[_planes(values[cut].astype(kind)) for cut in cuts] for values, kind in (
        (base, np.int64), (ext, np.int64), (found.size, np.int32), *(((found.lo, np.int32), (found.mirrored, np.int32)) if placed else ()))]
    nothing = [None] * len(cuts)
    return pa.table({
        "bucket": pa.array(used.astype(np.int32)), "shard": pa.array(np.full(len(cuts), shard, np.int64)), "size": pa.array(list(map(len, cuts)), pa.int32()),
        **{name: pa.array(column, pa.binary()) for name, column in zip(("base", "ext", "n", "lo", "mirrored"), [*packed, nothing, nothing])}})


_NONE = np.zeros(0, np.int64)


def _no_blocks() -> pa.Table:
    return _blocks(0, _NONE, _NONE, Intervals(_NONE, _NONE, _NONE), 1)


_KINDS = {"id": np.int64, "base": np.int64, "ext": np.int64, "n": np.int32, "lo": np.int32, "mirrored": np.int32}


def _opened(blocks: pa.Table, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The packed columns of some blocks, one block after another; zeros where nothing was packed."""
    size = blocks.column("size").to_pylist()
    return {name: np.concatenate([np.zeros(0, _KINDS[name]), *(
        np.zeros(n, _KINDS[name]) if data is None else _numbers(data, n, _KINDS[name]) for data, n in zip(blocks.column(name).to_pylist(), size, strict=True))]) for name in names}


def _summed(min_count: int):
    def total(blocks: pa.Table) -> pa.Table:
        """The phrases of one bucket that reach ``min_count`` over all shards."""
        rows = _opened(blocks, ("base", "ext", "n", "lo", "mirrored"))
        shard = np.repeat(blocks.column("shard").to_numpy(), blocks.column("size").to_numpy())
        order = np.lexsort((rows["ext"], rows["base"]))
        new = np.ones(len(order), bool)
        new[1:] = (rows["base"][order[1:]] != rows["base"][order[:-1]]) | (rows["ext"][order[1:]] != rows["ext"][order[:-1]])
        totals = np.add.reduceat(rows["n"][order].astype(np.int64), np.flatnonzero(new))
        number = np.cumsum(new) - 1
        keep = totals[number] >= min_count
        order, number, new = order[keep], number[keep], new[keep]
        ids = (np.int64(blocks.column("bucket")[0].as_py()) << IN_BUCKET_BITS) + number
        once = {"id": ids[new], "base": rows["base"][order[new]], "ext": rows["ext"][order[new]], "total": totals[number[new]]}
        each = pa.StructArray.from_arrays([pa.array(x) for x in once.values()], list(once))
        by_shard = np.argsort(shard[order], kind="stable")
        order, ids = order[by_shard], ids[by_shard]
        used, first = np.unique(shard[order], return_index=True)
        cuts = np.split(np.arange(len(order)), first[1:]) if len(used) else []
        packed = {name: [_planes((ids if name == "id" else rows[name][order])[cut]) for cut in cuts] + [None] for name in _KINDS}
        return pa.table({
            "shard": pa.array([*used.tolist(), None], pa.int64()), "size": pa.array([*map(len, cuts), 0], pa.int32()),
            **{name: pa.array(column, pa.binary()) for name, column in packed.items()},
            "phrases": pa.ListArray.from_arrays(pa.array([0] * len(used) + [0, len(each)], pa.int32()), each)})

    return total


def _frequent_text(shards: pa.Table, words: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of a shard, its text with only frequent words (numbered anew from 1, in order of their ids), and those ids."""
    text = _unpacked(shards.column("ids")[0].as_py(), shards.column("size")[0].as_py())
    ids = _column(words, "id")
    order = np.argsort(ids)
    symbol = np.zeros(int(text.max(initial=0)) + 1, np.int32)
    symbol[_column(words, "place")[order]] = np.arange(1, len(ids) + 1)
    text = symbol[text]
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] > 0) | (text[:-1] > 0)
    return shards.column("shard")[0].as_py(), text[keep], ids[order]


def _pairs(buckets: int):
    def pairs(shards: pa.Table, words: pa.Table) -> pa.Table:
        """Level 2: what stands before each frequent word."""
        if not (shards.num_rows and words.num_rows):
            return _no_blocks()
        shard, text, ids = _frequent_text(shards, words)
        index = Index(transform(text, 1))
        number, symbol, found = index.extend(index.words())
        return _blocks(shard, ids[number - 1], ids[symbol - 1], found, buckets, placed=False)

    return pairs


def _index_of(depth: int):
    def build(shards: pa.Table, marks: pa.Table) -> pa.Table:
        """The stored index of a shard: its text broken between words that are no frequent pair."""
        words = marks.filter(pc.is_valid(marks.column("place")))
        pairs = marks.filter(pc.is_null(marks.column("place")))
        empty = not (shards.num_rows and pairs.num_rows)
        if empty:
            return pa.table({"shard": pa.array([], pa.int64()), "size": pa.array([], pa.int32()), **{n: pa.array([], pa.binary()) for n in ("symbols", "forward", "backward")}})
        shard, text, ids = _frequent_text(shards, words)
        wide, pair = len(ids) + 1, _opened(pairs, ("base", "ext"))
        frequent = (np.searchsorted(ids, pair["ext"]) + 1) * wide + np.searchsorted(ids, pair["base"]) + 1
        linked = np.isin(text[:-1].astype(np.int64) * wide + text[1:], frequent)
        before, behind = np.r_[False, linked], np.r_[linked, False]
        kept = before | behind
        starts = (~before)[kept]
        symbols, codes = np.unique(text[kept], return_inverse=True)
        broken = np.zeros(len(codes) + np.count_nonzero(starts), np.int32)
        broken[np.arange(len(codes)) + np.cumsum(starts)] = codes + 1
        return pa.table({
            "shard": pa.array([shard], pa.int64()), "size": pa.array([len(broken)], pa.int32()), "symbols": pa.array([ids[symbols - 1].astype(np.int64).tobytes()], pa.binary()),
            "forward": pa.array([_packed(transform(broken, depth))], pa.binary()), "backward": pa.array([_packed(transform(broken[::-1], depth))], pa.binary())})

    return build


def _extensions(level: int, buckets: int):
    def extend(stored_index: pa.Table, phrases: pa.Table) -> pa.Table:
        """A level's phrases from the frequent ones of the level below."""
        if not (stored_index.num_rows and phrases.num_rows):
            return _no_blocks()
        row = {name: stored_index.column(name)[0].as_py() for name in stored_index.column_names}
        ids = np.frombuffer(row["symbols"], np.int64)
        ways = [Index(_unpacked(row[name], row["size"])) for name in ("forward", "backward")]
        known = _opened(phrases, tuple(_KINDS))
        named = known["id"]
        if level == 3:
            # The pairs' intervals in this index: extensions of its words that are frequent pairs.
            number, symbol, found = ways[0].extend(ways[0].words())
            wide = len(ids) + 1
            pair = (np.searchsorted(ids, known["ext"]) + 1) * wide + np.searchsorted(ids, known["base"]) + 1
            order = np.argsort(pair)
            mine = symbol * wide + number
            at = np.minimum(np.searchsorted(pair[order], mine), len(pair) - 1)
            hit = pair[order][at] == mine
            of, named = found.take(hit), named[order][at[hit]]
        else:
            of = Intervals(*(known[c].astype(np.int64) for c in ("lo", "mirrored", "n")))
        to_the_right = level % 2 == 1
        number, symbol, found = ways[1].extend(of.turned()) if to_the_right else ways[0].extend(of)
        return _blocks(row["shard"], named[number], ids[symbol - 1], found.turned() if to_the_right else found, buckets)

    return extend


# --- levels ------------------------------------------------------------------------------------


def _id(place: str) -> Column:
    return F.shiftleft(F.col("shard"), PLACE_BITS) + F.col(place)


def _frequent_words(rows: DataFrame, min_count: int) -> DataFrame:
    """Rows of the words that reach ``min_count`` over all shards, with that ``total`` and one ``id`` for all shards."""
    same = W.partitionBy("lang", "word")
    return rows.withColumn("total", F.sum("n").over(same)).filter(F.col("total") >= min_count).withColumn("id", F.min(_id("place")).over(same))


def _by_shard(left: DataFrame, right: DataFrame, tasks: int, apply, schema: str) -> DataFrame:
    one, two = (df.repartition(tasks, "shard").groupBy("shard") for df in (left, right))
    return one.cogroup(two).applyInArrow(apply, schema)


def frequent_phrases(docs: DataFrame, longest: int = 5, min_count: int = 100) -> tuple[DataFrame, DataFrame]:
    """(lang, words, k, n) of all phrases of 1 to ``longest`` words that occur ``min_count`` times in a language, and (lang, n) with
    all words of each language. ``docs`` has lang and text. Starts jobs: each level is stored."""
    spark = docs.sparkSession
    shards = stored(docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text").mapInArrow(_to_shards, _SHARDS), "phrase-shards")
    count, size = shards.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks, buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count), -(-size // BUCKET_WORDS) or 1
    each = shards.select("shard", F.explode("dictionaries").alias("d"))
    sizes = each.groupBy(F.col("d.lang").alias("lang")).agg(F.sum(F.aggregate("d.counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    words = each.select("shard", F.col("d.lang").alias("lang"), F.col("d.start").alias("start"), F.posexplode(F.arrays_zip("d.words", "d.counts")).alias("at", "w")).select(
        "shard", (F.col("start") + F.col("at") + 1).alias("place"), "lang", F.col("w.words").alias("word"), F.col("w.counts").cast("long").alias("n"))
    words = stored(_frequent_words(words, min_count), "phrase-words")
    named = [stored(words.filter(F.col("id") == _id("place")).select("id", "lang", F.array("word").alias("words"), F.lit(1).alias("k"), F.col("total").alias("n")), "phrase-names-1")]

    texts, index, here = shards.select("shard", "size", "ids"), None, None
    for level in range(2, longest + 1):
        if level == 2:
            found = _by_shard(texts, words.select("shard", "place", "id"), tasks, _pairs(buckets), _BLOCKS)
        else:
            if level == 3:
                depth = 1 << (longest - 2).bit_length()
                marks = words.select("shard", "place", "id").unionByName(here.select("shard", "size", "base", "ext"), allowMissingColumns=True)
                index = stored(_by_shard(texts, marks, tasks, _index_of(depth), _INDEX), "phrase-index")
            found = _by_shard(index, here.drop("phrases"), tasks, _extensions(level, buckets), _BLOCKS)
        rows = stored(found.repartition(max(tasks, buckets), "bucket").groupBy("bucket").applyInArrow(_summed(min_count), _PHRASES), f"phrase-level-{level}")
        here = rows.filter("shard is not null")
        base, ext = named[-1].select(F.col("id").alias("base"), "lang", "words"), named[0].select(F.col("id").alias("ext"), F.col("words").alias("more"))
        both = F.concat("words", "more") if level % 2 else F.concat("more", "words")
        heads = rows.filter("shard is null").select(F.inline("phrases"))
        named.append(stored(heads.join(base, "base").join(ext, "ext").select("id", "lang", both.alias("words"), F.lit(level).alias("k"), F.col("total").alias("n")), f"phrase-names-{level}"))
    return reduce(DataFrame.unionByName, named).drop("id"), sizes


def collocations(docs: DataFrame, longest: int = 5, min_count: int = 100, top: int = 2000, scale: int = 1000, cover: int = 100) -> DataFrame:
    """Each language's ``top`` phrases of at least two words: (lang, rank, phrase, a, l, r, n, score).

    ``score`` is the lowest, over all cuts, of floor(scale * a * n / (l * r)) with the counts of the phrase, of all words and of both
    parts. A phrase is dropped if a longer one that contains it has ``cover`` percent of its count.
    """
    named, sizes = frequent_phrases(docs, longest, min_count)
    named = stored(named.select("lang", F.array_join("words", " ").alias("phrase"), "words", "k", F.col("n").alias("a")), "phrase-counts")
    counts = named.select(F.col("lang").alias("of"), F.col("phrase").alias("part"), "a")
    part = lambda lo, hi: F.array_join(F.slice("words", lo, hi), " ")

    def looked_up(rows: DataFrame, key: str, name: str) -> DataFrame:
        side = counts.withColumnRenamed("a", name)
        return rows.join(side, (F.col("lang") == F.col("of")) & (F.col(key) == F.col("part"))).drop("of", "part", key)

    cuts = named.filter("k > 1").select("lang", "phrase", "words", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("front"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    cuts = looked_up(looked_up(cuts, "front", "l"), "rest", "r").join(sizes, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    product = (F.lit(scale).cast("decimal(10,0)") * exact("a")).cast("decimal(29,0)") * exact("n")
    cuts = cuts.withColumn("product", product.cast("decimal(38,0)")).withColumn("parts", (exact("l") * exact("r")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("product div parts"))
    worst = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("w")).select("lang", "phrase", "w.a", "w.l", "w.r", "w.n", "w.score")

    long = named.filter("k > 2")
    around = long.select("lang", "a", F.explode(F.array(part(F.lit(1), F.col("k") - 1), part(F.lit(2), F.col("k") - 1))).alias("phrase"))
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = worst.join(around, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("around") < cover * F.col("a"), F.lit(True)))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
