"""Ordered threat levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, lowest first.
THREAT_LEVELS = ("none", "low", "medium", "high", "critical")


def _levels() -> Column:
    return F.array(*[F.lit(x) for x in THREAT_LEVELS])


def threat_order(level: Column) -> Column:
    """0 for none up to 4 for critical; unknown levels count as 0."""
    return F.greatest(F.coalesce(F.array_position(_levels(), level), F.lit(1)) - 1, F.lit(0)).cast("int")


def threat_name(order: Column) -> Column:
    return F.get(_levels(), order)


def at_least(level: Column, minimum: str | None) -> Column:
    """Filter for a minimum level; an unknown minimum filters nothing."""
    low = (minimum or "").lower()
    if low not in THREAT_LEVELS:
        return F.lit(True)
    return level.isin(*THREAT_LEVELS[THREAT_LEVELS.index(low):])
