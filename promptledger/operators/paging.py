"""Pages of long listings, newest first, without sorting what lies before them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A time range that holds a page's end is narrowed while it has more rows than this.
ROWS_SORTED = 100_000
#: Widths of the ranges, each a whole number of the next: days, hours, minutes, seconds, milliseconds, moments (microseconds).
WIDTHS = (86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1_000, 1)
#: Rows without a time come last, as if of this moment.
_NEVER = -(1 << 62)


def _us(ts: str):
    return F.coalesce(F.unix_micros(ts), F.lit(_NEVER))


def _counts(rows: DataFrame, ts: str, width: int) -> list[tuple[int, int]]:
    """(start of range, rows), newest first: a number for each day of the table, or for each part of one range."""
    start = F.floor(_us(ts) / F.lit(width)) if width > 1 else _us(ts)
    found = rows.groupBy(start.cast("long").alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted(((r["at"] * width, r["n"]) for r in found), reverse=True)


def _range_of(rows: DataFrame, ts: str, days: list[tuple[int, int]], place: int) -> tuple[int, int, int]:
    """Start and width of a range that holds the row at ``place``, and the number of newer rows before the range."""
    counts, skipped = days, 0
    for width, finer in zip(WIDTHS, (*WIDTHS[1:], None), strict=True):
        for at, n in counts:
            if skipped + n > place:
                break
            skipped += n
        if finer is None or n <= ROWS_SORTED or at <= _NEVER // 2:
            return at, width, skipped
        counts = _counts(rows.filter((_us(ts) >= at) & (_us(ts) < at + width)), ts, finer)
    raise AssertionError


def page(rows: DataFrame, limit: int, offset: int = 0, ts: str = "event_ts", ties: Sequence[str] = ("request_id",)) -> tuple[DataFrame, int]:
    """One page of ``rows``, newest first, and the number of all rows.

    Counts by day tell where the page begins and ends; where such a day holds many rows it is counted by hour, and so on. Only the
    rows of the ranges in between are sorted, so a page at any offset costs counts and about ``limit + 2 * ROWS_SORTED`` rows; only one
    moment with more rows is sorted as a whole. Starts one job, and two at most for each further width.
    """
    days = _counts(rows, ts, WIDTHS[0])
    total = sum(n for _, n in days)
    if offset >= total or limit <= 0:
        return rows.limit(0), total
    newest, width, skipped = _range_of(rows, ts, days, offset)
    oldest, _, _ = _range_of(rows, ts, days, min(offset + limit, total) - 1)
    near = rows.filter((_us(ts) < newest + width) & (_us(ts) >= oldest))
    return near.orderBy(F.desc(ts), *ties).offset(offset - skipped).limit(limit), total
