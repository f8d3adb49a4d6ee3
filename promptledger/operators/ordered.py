"""Ordered aggregates that do not pull a whole key into one task.

A running total over a key is split in two: totals per (key, bucket of time) give the offset of each group of buckets, and rows
are only ordered inside their group. A bucket that alone holds more rows than a group is split further, at rows drawn by the
hash of their order, wherever these lie: in a second, a moment, or among the ids of one moment. So a key that holds a third of all
rows, even within one second, is spread over as many tasks as it has groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE_US = 60_000_000
#: Rows of a key that are put in order together; it decides the number of groups only.
ROWS_TOGETHER = 100_000
#: A dense bucket is cut into pieces of a group's rows divided by this on average, so that hardly one exceeds a group.
PIECES = 8
#: Cuts that are compared one by one; more are found by comparing every such one first.
_STRIDE = 32


def time_bucket(ts: Column, width_us: int = 5 * MINUTE_US) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(width_us))


def _join_on(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns that may be null."""
    right = right.select(*[F.col(n).alias(f"_r_{n}") if n in names else F.col(n) for n in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names])
    return left.join(right, on, how).drop(*[f"_r_{n}" for n in names])


def _piece(cuts: Column, place: Column) -> Column:
    """How many of the sorted ``cuts`` are not above ``place``."""
    upto = lambda some: F.size(F.filter(some, lambda c: c <= place))
    heads = F.transform(F.sequence(F.lit(0), F.size(cuts) - 1, F.lit(_STRIDE)), lambda i: F.get(cuts, i))
    before = F.greatest(upto(heads) - 1, F.lit(0)) * _STRIDE
    return before + upto(F.slice(cuts, before + 1, F.lit(_STRIDE)))


def has_dense(rows: DataFrame, keys: Sequence[str], bucket: Column) -> bool:
    """Whether a bucket of a key has more rows than are put in order together. Starts a job."""
    return not rows.groupBy(*keys, bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > ROWS_TOGETHER).isEmpty()


def grouped(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Sequence[str] = (), maxes: Sequence[str] = (), dense: bool = True
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of sparse and of dense buckets, with the group that each is ordered in and the totals before that group.

    ``rows`` has ``_bucket`` and a value ``_v_<name>`` for each sum and maximum. Sparse rows get ``_group``, dense ones ``_group`` and
    ``_piece``; ``_o_<name>`` is the sum or maximum of all groups of the key before. Without ``dense`` all rows are sparse.
    """
    names = [*sums, *maxes]

    def reduced(df: DataFrame, by: list[str]) -> DataFrame:
        return df.groupBy(*by).agg(
            F.count(F.lit(1)).alias("_n"), *[F.sum(f"_v_{n}").alias(f"_o_{n}") for n in sums], *[F.max(f"_v_{n}").alias(f"_o_{n}") for n in maxes])

    def before(totals: DataFrame, by: list[str], upto: str, *more: Column) -> DataFrame:
        window = Window.partitionBy(*by).orderBy(upto).rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(
            *by, upto, "_n", F.coalesce(F.sum("_n").over(window), F.lit(0)).alias("_rows"), *more,
            *[F.sum(f"_o_{n}").over(window).alias(f"_o_{n}") for n in sums], *[F.max(f"_o_{n}").over(window).alias(f"_o_{n}") for n in maxes])

    totals = reduced(rows, [*keys, "_bucket"])
    started = before(totals, list(keys), "_bucket").withColumn("_group", F.floor(F.col("_rows") / ROWS_TOGETHER))
    first = Window.partitionBy(*keys, "_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_group = [F.first(f"_o_{n}").over(first).alias(f"_o_{n}") for n in names]
    if not dense:
        return _join_on(rows, started.select(*keys, "_bucket", "_group", *of_group), [*keys, "_bucket"]), None
    place = F.struct(*[o.alias(f"c{i}") for i, o in enumerate(order)])
    drawn = rows.filter(F.pmod(F.xxhash64(*order), F.lit(max(1, ROWS_TOGETHER // PIECES))) == 0).select(*keys, "_bucket", place.alias("_cut"))
    many = totals.filter(F.col("_n") > ROWS_TOGETHER).select(*keys, "_bucket")
    cuts = _join_on(drawn, many, [*keys, "_bucket"]).groupBy(*keys, "_bucket").agg(F.array_sort(F.collect_set("_cut")).alias("_cuts"))

    offsets = started.select(
        *keys, "_bucket", "_group", "_n", *of_group, *[F.col(f"_o_{n}").alias(f"_d_{n}") for n in names])
    placed = _join_on(rows, _join_on(offsets, cuts, [*keys, "_bucket"], "left"), [*keys, "_bucket"])
    # Behind a dense bucket a new group starts, so its group holds none but itself and sparse ones before it.
    own = [f"_d_{n}" for n in names]
    sparse = placed.filter(F.col("_cuts").isNull()).drop("_cuts", "_n", *own)
    piece = _piece(F.col("_cuts"), place).alias("_piece")
    dense_rows = placed.filter((F.col("_n") > ROWS_TOGETHER) & F.col("_cuts").isNotNull()).select("*", piece).drop("_cuts", "_n", *[f"_o_{n}" for n in names])
    inside = before(reduced(dense_rows, [*keys, "_bucket", "_piece"]), [*keys, "_bucket"], "_piece").drop("_n", "_rows")
    dense_rows = _join_on(dense_rows, inside, [*keys, "_bucket", "_piece"])
    for n in sums:
        dense_rows = dense_rows.withColumn(f"_o_{n}", F.coalesce(F.col(f"_o_{n}"), F.lit(0)) + F.coalesce(F.col(f"_d_{n}"), F.lit(0)))
    for n in maxes:
        dense_rows = dense_rows.withColumn(f"_o_{n}", F.greatest(f"_o_{n}", f"_d_{n}"))
    return sparse, dense_rows.drop(*own)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    dense: bool = True,
) -> DataFrame:
    """Add running sums and maxima per key, the current row included.

    ``bucket`` must grow with the order; rows with equal order share a bucket. Neighbouring buckets are put together up to
    ``ROWS_TOGETHER`` rows and larger ones are cut, so a task's share is set by the number of rows and not by how dense they are in time;
    only rows that are equal in all of ``order`` cannot be parted. A caller that knows of ``has_dense`` that no bucket is
    larger says so with ``dense=False`` and saves the passes that look for them.
    """
    sums, maxes = dict(sums or {}), dict(maxes or {})
    rows = df.withColumn("_bucket", bucket)
    for name, value in {**sums, **maxes}.items():
        rows = rows.withColumn(f"_v_{name}", value)

    def summed(part: DataFrame, by: list[str]) -> DataFrame:
        inside = Window.partitionBy(*keys, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        for n in sums:
            part = part.withColumn(n, F.coalesce(F.col(f"_o_{n}"), F.lit(0)) + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)))
        for n in maxes:
            part = part.withColumn(n, F.greatest(F.col(f"_o_{n}"), F.max(f"_v_{n}").over(inside)))
        return part.drop("_bucket", "_group", "_piece", *[f"_{kind}_{n}" for n in [*sums, *maxes] for kind in "vo"])

    sparse, cut = grouped(rows, keys, order, list(sums), list(maxes), dense)
    out = summed(sparse, ["_group"])
    return out if cut is None else out.unionByName(summed(cut, ["_bucket", "_piece"]))


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float]
) -> DataFrame:
    """Exact interpolated percentiles per key, one row per key that has a value.

    Equal values are counted before the shuffle. Counts per value bucket tell in which buckets the
    wanted ranks lie; only values of these buckets are put in order, so no group is held in memory.
    """
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bucket", F.floor(F.asinh("_value") * 32))
    )
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counted.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_size")).select(
        *keys, "_bucket", "_size",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(whole).alias("_total"),
    )
    last = F.col("_total") - 1
    ranks = {n: (F.floor(F.lit(p) * last), F.ceil(F.lit(p) * last)) for n, p in wanted.items()}
    holds = [(F.col("_before") <= r) & (r < F.col("_before") + F.col("_size")) for pair in ranks.values() for r in pair]
    needed = buckets.filter(reduce(lambda a, b: a | b, holds))

    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = _join_on(counted, needed, [*keys, "_bucket"]).withColumn(
        "_upto", F.col("_before") + F.sum("_n").over(inside)
    )
    found = [
        F.max(F.when((F.col("_upto") - F.col("_n") <= r) & (r < F.col("_upto")), F.col("_value"))).alias(f"_{n}_{side}")
        for n, pair in ranks.items()
        for side, r in zip(("lo", "hi"), pair)
    ]
    summed = placed.groupBy(*keys).agg(F.max("_total").alias("_total"), *found)
    results = []
    for n, p in wanted.items():
        low, high = F.col(f"_{n}_lo"), F.col(f"_{n}_hi")
        results.append((low + (high - low) * (F.lit(p) * last - F.floor(F.lit(p) * last))).alias(n))
    return summed.select(*keys, *results)
