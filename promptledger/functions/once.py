"""Keep an expensive expression from being evaluated more than once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters and projections only refer to.

    A plain projected column is copied into every filter that the optimizer pushes below it, so a
    regex scan would run again for each of them. The output of a generator is not pushed through.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def dealt(df: DataFrame, key: str, partitions: int | None) -> DataFrame:
    """Rows dealt over ``partitions`` tasks by the hash of ``key``, before texts are scanned; None leaves them where they are.

    For tables whose files hold more text than one task should scan. Dealing shuffles the texts once, so it is for files that cannot
    be split; it depends on the argument only, never on sizes, and results do not depend on it.
    """
    return df if partitions is None else df.repartition(partitions, key)
