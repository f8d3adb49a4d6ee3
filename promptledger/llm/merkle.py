"""Merkle dataset manifest: a hash tree over the rows of every source, proofs, and the check of rows against the root.

A leaf is the digest of a row's fields. The leaves of a source ascend by id; while more than one node remains, every ``FAN`` consecutive
nodes become one. What remains is the source's subroot; subroots in order of source (null first, by UTF-8 bytes) become the root likewise.

Every node carries the interval of leaf places that it covers. Sources cover neighbouring intervals, so leaves, source trees and the tree
over the sources are labelled by one line of places, and containment of intervals is descent. A node of level L starts in the bucket
``place // FAN ** L`` of its tree; runs of leaves are joined to their ancestors by bucket and kept where the interval holds theirs. The
siblings on a way to the root are a parent's children without the one whose interval holds the leaf. The joins run over runs (a
``FAN``th of the rows), never over rows with their proofs, and a run's children are at most ``FAN``.

Places come from range partitions (``ranking``): a source of any size is spread, its rows are only ever met in runs. Each level is
stored; there are as many as ``log(rows, FAN)``.

Cases: null fields count as ``-``; rows of null id come first in their source; rows that tie by id are ordered by their leaf, and equal rows
each have their own place and proof; texts are whole; an empty text is a value of length 0; an empty table gives no rows; the columns
``carry`` are kept, of whatever name. A source of one row has its leaf as subroot, and a row without siblings the proof of the empty text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptledger.llm.common import stored
from promptledger.llm.ranking import placed

#: Children of a node.
FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(parts: list[Column]) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as it enters a leaf: its length in bytes, a colon, the value; a null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: dict[str, Column]) -> Column:
    return digest_of([field(value) for value in fields.values()])


def _nodes_above(n: Column, level: int) -> Column:
    """Nodes that ``n`` leaves have at a level."""
    return F.ceil(n / F.lit(FAN**level)).cast("long")


def _joined(children: Column) -> Column:
    return F.sha2(F.array_join(F.transform(children, lambda c: c["digest"]), "").cast("binary"), 256)


def _parents(nodes: DataFrame, level: int, name: str) -> DataFrame:
    """Nodes of a level (tree, n, at, lo, hi, digest, kids) from the nodes below; trees that are complete already have none."""
    below = nodes.filter(_nodes_above(F.col("n"), level - 1) > 1)
    up = below.groupBy("tree", "n", F.floor(F.col("at") / FAN).alias("up")).agg(
        F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("kids"))
    return stored(up.select("tree", "n", F.col("up").alias("at"), F.get("kids", F.lit(0))["lo"].alias("lo"),
                            F.element_at("kids", -1)["hi"].alias("hi"), _joined(F.col("kids")).alias("digest"), "kids"), name)


def _tree(leaves: DataFrame, first: list[DataFrame], largest: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Levels of parents above ``leaves`` (tree, n, at, lo, hi, digest), and the one top node of every tree (tree, digest, lo, hi).

    ``first`` may bring the first level ready-made; ``largest`` is the number of leaves of the largest tree.
    """
    levels, below, level = list(first), leaves, 1
    while FAN ** (level - 1) < largest:
        if len(levels) < level:
            levels.append(_parents(below, level, f"{name}-{level}"))
        below, level = levels[level - 1], level + 1
    tops = [leaves.filter("n = 1"), *(p.filter((_nodes_above(F.col("n"), i) == 1) & (_nodes_above(F.col("n"), i - 1) > 1)) for i, p in enumerate(levels, 1))]
    return levels, reduce(DataFrame.unionByName, [t.select("tree", "digest", "lo", "hi") for t in tops])


def _descend(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """``nodes`` with the ``ways`` of their parent (same tree and bucket, its interval holds theirs) and the parent's children before them.

    A key has one parent and at most ``FAN`` nodes.
    """
    side = parents.select(F.col("tree").alias("__tree"), F.col("at").alias("__at"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"),
                          F.col("kids").alias("__kids"), F.col("ways").alias("__ways"), F.col("subroot").alias("subroot"))
    on = (F.col("tree") == F.col("__tree")) & (F.floor(F.col("at") / FAN) == F.col("__at")) & (F.col("__lo") <= F.col("lo")) & (F.col("hi") <= F.col("__hi"))
    return nodes.join(side, on).withColumn("ways", F.array_prepend("__ways", F.transform("__kids", _bare))).drop("__tree", "__at", "__lo", "__hi", "__kids", "__ways")


def _bare(node: Column) -> Column:
    return F.struct(node["lo"].alias("lo"), node["hi"].alias("hi"), node["digest"].alias("digest"))


def manifest(docs: DataFrame, suspect: Column | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of (doc_id, source, lang, n_chars, text): leaf, subroot, root, proof_sha256, folded_root, verified.

    ``suspect`` is the text as it is found when rows are checked (default: unchanged). Its leaf is folded with the siblings of the
    manifest; ``verified`` tells whether that gives the root. Starts jobs.
    """
    spark = docs.sparkSession
    as_made = {name: F.col(f"`{name}`") for name in FIELDS}
    found = leaf(as_made | {"text": suspect}) if suspect is not None else F.col("__leaf")
    rows = docs.withColumn("__leaf", leaf(as_made)).select(
        F.col("source").alias("__source"), F.col("doc_id").alias("__id"), "__leaf", found.alias("__found"),
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("__carry"))
    rows = placed(rows, [F.col("__source"), F.col("__id"), F.col("__leaf")], "__place", "__part", "merkle-leaves")

    # Sources: the interval that each covers, and its number. A (partition, source) cell is no larger than a partition.
    cells = rows.groupBy("__part", "__source").agg(F.min("__place").alias("lo"), (F.max("__place") + 1).alias("hi"))
    sources = placed(cells.groupBy("__source").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), [F.col("__source")], "tree", "__piece", "merkle-sources")
    sources = stored(sources.select("__source", "tree", "lo", "hi", (F.col("hi") - F.col("lo")).alias("n")), "merkle-intervals")
    largest, trees = sources.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    of_cell = cells.select(F.col("__part").alias("__p"), F.col("__source").alias("__s")).join(
        sources.withColumnRenamed("__source", "__of"), F.col("__s").eqNullSafe(F.col("__of"))).drop("__of")

    at = F.col("__place") - F.col("lo")
    runs = rows.join(of_cell, (F.col("__part") == F.col("__p")) & F.col("__source").eqNullSafe(F.col("__s"))).groupBy(
        "tree", "n", F.floor(at / FAN).alias("at"), F.col("lo").alias("base")
    ).agg(F.array_sort(F.collect_list(F.struct(
        F.col("__place").alias("lo"), (F.col("__place") + 1).alias("hi"), F.col("__leaf").alias("digest"), F.col("__found").alias("found"), F.col("__carry").alias("carry")))).alias("kids"))
    alone = F.col("n") == 1
    runs = stored(runs.select(
        "tree", "n", "at", F.get("kids", F.lit(0))["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"),
        F.when(alone, F.get("kids", F.lit(0))["digest"]).otherwise(_joined(F.col("kids"))).alias("digest"), "kids"), "merkle-runs")

    levels, subroots = _tree(runs.filter("n = 1"), [runs.filter("n > 1")], largest, "merkle-level")
    tops = stored(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), F.col("tree").alias("at"), "lo", "hi", "digest"), "merkle-subroots")
    over, roots = _tree(tops, [], trees, "merkle-top")

    # From the root down: the children of every ancestor, lowest first. A source's top node takes over where the tree of sources ends.
    none = F.expr("cast(array() as array<array<struct<lo:bigint,hi:bigint,digest:string>>>)")
    here = None
    for parents in reversed([tops, *over]):
        nodes = parents.withColumn("subroot", F.lit(None).cast("string"))
        here = nodes.withColumn("ways", none) if here is None else _descend(nodes.drop("subroot"), here)
    of_tree = stored(here.select(F.col("at").alias("__tree"), F.col("ways").alias("__ways"), F.col("digest").alias("__subroot")), "merkle-ways")

    def crowned(nodes: DataFrame) -> DataFrame:
        with_ways = nodes.join(of_tree, F.col("tree") == F.col("__tree"))
        return with_ways.withColumnsRenamed({"__ways": "ways", "__subroot": "subroot"}).drop("__tree")

    below = None
    for i, nodes in reversed(list(enumerate(levels, 1))):
        top = crowned(nodes.filter(_nodes_above(F.col("n"), i) == 1))
        below = top if below is None else top.unionByName(_descend(nodes.filter(_nodes_above(F.col("n"), i) > 1), below))
    root = roots.select("digest").first()
    out = below.withColumn("ways", F.array_prepend("ways", F.transform("kids", _bare))).unionByName(crowned(runs.filter(alone)))
    each = out.select("subroot", "ways", F.explode("kids").alias("k"))

    place = F.col("k.lo")
    holds = lambda c: (c["lo"] <= place) & (place < c["hi"])
    siblings = F.transform("ways", lambda way: F.array_join(F.transform(F.filter(way, lambda c: ~holds(c)), lambda c: c["digest"]), ""))
    folded = F.aggregate("ways", F.col("k.found"), lambda below, way: F.sha2(
        F.array_join(F.transform(way, lambda c: F.when(holds(c), below).otherwise(c["digest"])), "").cast("binary"), 256))
    top = F.lit(root[0] if root else None).cast("string")
    checked = each.select(
        "k.carry", F.col("k.digest").alias("leaf"), "subroot", top.alias("root"),
        F.sha2(F.array_join(siblings, "").cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    results = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    return checked.select(*[F.col(f"carry.`{c}`").alias(c) for c in carry], *results, (F.col("folded_root") == F.col("root")).alias("verified"))
