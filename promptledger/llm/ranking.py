"""Places of rows in a total order, by range partitions and their sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptledger.llm.common import stored

#: A row's number inside its partition is in the low bits of Spark's increasing id.
_LOW = (1 << 33) - 1


def placed(df: DataFrame, order: list[Column], place: str, part: str, name: str) -> DataFrame:
    """``df`` with each row's 0-based place in ``order`` (nulls first) and the number of its range partition.

    Rows that tie in ``order`` are dealt over partitions by a random number, so a row in any number of copies is no hot key. The
    sorted rows are stored, which fixes the places. Only one count per partition is put in order in one task.
    """
    by = [*order, F.rand(0)]
    rows = stored(
        df.repartitionByRange(*by).sortWithinPartitions(*by)
        .withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id().bitwiseAND(_LOW)), name)
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(F.col(part).alias("__at_part"), F.coalesce(before, F.lit(0)).alias("__start"))
    # One row per partition of the shuffle.
    return rows.join(F.broadcast(starts), F.col(part) == F.col("__at_part")).withColumn(place, F.col(place) + F.col("__start")).drop("__at_part", "__start")
