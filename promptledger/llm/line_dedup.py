"""Line deduplication by a suffix array over line ids.

The rule: a line goes if it lies in a run of consecutive lines with at least ``min_words`` words whose whole content occurs
earlier, that is in a document with a smaller id or further up in the same one. Blank lines neither count nor break a run;
line ends and blanks around a line do not matter. Everything else of a text stays as it is.

Lines that occur once break all repeats, so only stretches of repeated lines are kept. Their suffixes are sorted by prefix
doubling: the rank after round k orders the suffixes by their first ``2 ** k`` lines; a round counts the pairs (rank, rank
``2 ** k`` lines further on) and moves a rank up by the positions with the same rank and a smaller second one. All suffixes
whose first L lines agree are one interval of the suffix array with a longest common prefix of at least L, and two overlapping
ranks name it. Each line starts and ends one shortest run of enough words; these runs cover every longer one, and they have at
most ``min_words`` lines, so the rounds are bounded. Of each interval the earliest run stays and the others are marked.

Only DataFrame functions are used. Counts and first places are aggregated before rows meet, so a line, passage or document in
a third of all rows is one row there.

Cases: null texts stay null, empty ones empty; a text that loses every line that is not blank becomes empty; null ids come
last in the order; rows that repeat id and text count as one document and all get its result; texts may be of any length.
Equal runs tie by document and place, of which the first stays; an empty table gives no rows; other columns are kept, of whatever name,
but for the one that counts removed lines. Line ids are 96-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptledger.functions.once import evaluate_once
from promptledger.llm.common import WORD, stored

MIN_WORDS = 50
DOC = ("doc", "key")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


def _key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.col(text))


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per line that is not blank: its place among those (``pos``) and among all lines (``line_no``)."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct(i.alias("no"), _trimmed(x).alias("line"))), lambda s: s["line"] != "")
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), _key(doc_id, text).alias("key"), F.posexplode(lines).alias("pos", "s"))
    line = F.col("s.line")
    return rows.select(
        "doc", "key", "pos", F.col("s.no").alias("line_no"), F.xxhash64(line).alias("h"), F.hash(line).alias("g"),
        F.regexp_count(line, F.lit(WORD)).cast("long").alias("words"))


def _same_doc(a: str, b: str) -> Column:
    return F.col(f"{a}.doc").eqNullSafe(F.col(f"{b}.doc")) & (F.col(f"{a}.key") == F.col(f"{b}.key"))


def _first_ranks(lines: DataFrame) -> DataFrame:
    """Rank of each repeated line id: the number of positions with smaller ids, counted in ranges of the id."""
    ids = lines.groupBy("h", "g").agg(F.count("*").alias("n")).filter("n > 1").withColumn("range", F.shiftrightunsigned("h", 52))
    before = ids.groupBy("range").agg(F.sum("n").alias("m")).select("range", (F.sum("m").over(W.partitionBy(F.lit(0)).orderBy("range")) - F.col("m")).alias("before"))
    inside = F.sum("n").over(W.partitionBy("range").orderBy("h", "g")) - F.col("n")
    return ids.withColumn("inside", inside).join(before, "range").select("h", "g", (F.col("before") + F.col("inside")).alias("r0"))


def _repeated_stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """Positions of repeated lines in stretches of at least ``min_words`` words, with the shortest runs that start and end there."""
    doc = W.partitionBy(*DOC)
    stretch = W.partitionBy(*DOC, "stretch")
    rows = (
        lines.join(_first_ranks(lines), ["h", "g"]).drop("h", "g").dropDuplicates([*DOC, "pos"])
        .withColumn("stretch", F.col("pos") - F.row_number().over(doc.orderBy("pos")))
        .withColumn("end", F.sum("words").over(stretch.orderBy("pos")))
        .withColumn("start", F.col("end") - F.col("words"))
        .withColumn("all", F.sum("words").over(stretch)).filter(F.col("all") >= min_words)
    )
    after = F.min("pos").over(stretch.orderBy("start").rangeBetween(min_words, W.unboundedFollowing))
    upto = F.max("pos").over(stretch.orderBy("end").rangeBetween(W.unboundedPreceding, -min_words))
    return (
        rows.withColumn("from", F.min("pos").over(stretch)).withColumn("to", F.max("pos").over(stretch))
        .withColumn("forward", F.coalesce(after, F.when(F.col("all") - F.col("start") >= min_words, F.col("to") + 1)) - F.col("pos"))
        .withColumn("back", F.coalesce(upto + 1, F.when(F.col("end") >= min_words, F.col("from"))))
        .select(*DOC, "pos", "line_no", "r0", "forward", "back")
    )


def suffix_ranks(rows: DataFrame, rounds: int) -> DataFrame:
    """Adds ``r1`` .. ``r{rounds}`` to positions with ``r0``: ``rk`` orders suffixes by their first ``2 ** k`` lines."""
    for k in range(rounds):
        rank, step = f"r{k}", 1 << k
        ahead = F.max(rank).over(W.partitionBy(*DOC).orderBy("pos").rangeBetween(step, step))
        rows = rows.withColumn("second", F.coalesce(ahead, F.lit(-1).cast("long")))
        pairs = rows.groupBy(rank, "second").agg(F.count("*").alias("n"))
        moved = F.col(rank) + F.sum("n").over(W.partitionBy(rank).orderBy("second")) - F.col("n")
        rows = stored(rows.join(pairs.select(rank, "second", moved.alias(f"r{k + 1}")), [rank, "second"]).drop("second"), f"suffix-ranks-{k + 1}")
    return rows


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``key`` and ``line_no`` (from 0, of all lines) of every line to delete."""
    lines = stored(_lines(docs, doc_id, text), "lines")
    rows = stored(_repeated_stretches(lines, min_words), "stretches")
    longest = rows.agg(F.max(F.greatest("forward", F.col("pos") - F.col("back") + 1))).first()[0] or 1
    rounds = longest.bit_length() - 1
    ranked = suffix_ranks(rows, rounds)
    runs = (
        ranked.filter("forward is not null").select(*DOC, "pos", F.col("forward").alias("length"))
        .union(ranked.filter("back is not null").select(*DOC, F.col("back").alias("pos"), (F.col("pos") - F.col("back") + 1).alias("length")))
        .distinct()
    )
    level = F.floor(F.log2("length")).cast("int")
    runs = runs.withColumn("level", level).withColumn("tail", F.col("pos") + F.col("length") - F.expr("1 << level"))
    ranks = ranked.select(*DOC, "pos", F.array(*(f"r{k}" for k in range(rounds + 1))).alias("ranks"))
    at = F.col("w.level") + 1
    named = (
        runs.alias("w").join(ranks.alias("a"), _same_doc("w", "a") & (F.col("w.pos") == F.col("a.pos")))
        .select("w.*", F.element_at("a.ranks", at).alias("name_a")).alias("w")
        .join(ranks.alias("b"), _same_doc("w", "b") & (F.col("w.tail") == F.col("b.pos")))
        .select("w.doc", "w.key", "w.pos", "w.length", "name_a", F.element_at("b.ranks", at).alias("name_b"))
    )
    named = stored(named.withColumn("place", F.struct(F.col("doc").isNull().alias("last"), "doc", "key", "pos")), "runs")
    name = ["length", "name_a", "name_b"]
    first = named.groupBy(*name).agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = named.join(first, name).filter(F.col("place") != F.col("first"))
    reach = copies.groupBy(*DOC, "pos").agg(F.max(F.col("pos") + F.col("length")).alias("reach"))
    covered = F.max("reach").over(W.partitionBy("p.doc", "p.key").orderBy("p.pos"))
    return (
        ranked.alias("p").join(reach.alias("m"), _same_doc("p", "m") & (F.col("p.pos") == F.col("m.pos")), "left")
        .select("p.doc", "p.key", "p.line_no", (covered > F.col("p.pos")).alias("gone")).filter("gone").drop("gone")
    )


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", removed: str | None = None) -> DataFrame:
    """``docs`` with the later copies of repeated runs deleted from ``text``; ``removed`` names a column for the number of deleted lines."""
    gone = repeated_lines(docs, min_words, doc_id, text).groupBy(*DOC).agg(F.sort_array(F.collect_list("line_no")).alias("__gone"))
    joined = docs.withColumn("__key", _key(doc_id, text)).alias("d").join(
        gone.alias("g"), F.col(f"d.{doc_id}").eqNullSafe(F.col("g.doc")) & (F.col("d.__key") == F.col("g.key")), "left"
    ).select("d.*", "__gone")
    split = evaluate_once(joined, "__lines", F.when(F.col("__gone").isNotNull(), F.split(F.col(text), "\n")))
    ends = F.concat("__gone", F.array(F.size("__lines")))
    starts = F.concat(F.array(F.lit(-1)), F.col("__gone"))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice("__lines", a + 2, b - a - 1)))
    whole = F.array_join(kept, "\n")
    new = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.when(whole.rlike(r"[^\s]"), whole).otherwise(""))
    out = split.withColumn(text, new)
    if removed:
        out = out.withColumn(removed, F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
    return out.drop("__key", "__gone", "__lines")
