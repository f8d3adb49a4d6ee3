"""Positions of every regex match in a text, in code points.

Spark can return all matches and all gaps between them, but no positions; a position is
the total length of what stands before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns are written in Python's regex language. Java's Unicode mode differs in three shorthands:
# its words include combining marks and joiners, and its whitespace lacks the separators 1C to 1F.
_WORD = r"\p{L}\p{N}_"
_IN_CLASS = {"s": r"\s\x1C-\x1F", "w": _WORD}
_OUTSIDE = {
    "s": r"[\s\x1C-\x1F]",
    "S": r"[^\s\x1C-\x1F]",
    "w": f"[{_WORD}]",
    "W": f"[^{_WORD}]",
    "b": f"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))",
}


def unicode_regex(pattern: str, ignore_case: bool = False) -> str:
    """Java form of a Python pattern over Unicode text."""
    out, inside, escaped = [], False, False
    for c in pattern:
        if escaped:
            out.append((_IN_CLASS if inside else _OUTSIDE).get(c, "\\" + c))
            escaped = False
        elif c == "\\":
            escaped = True
        else:
            inside = (inside or c == "[") and c != "]"
            out.append(c)
    return ("(?iU)" if ignore_case else "(?U)") + "".join(out)


SPAN_ARRAY = "array<struct<start:int,end:int,text:string>>"


#: Items folded at once. An array that grows by one is copied each time, so it only grows to this length.
BLOCK = 128


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold_kept(items: Column, kind: str, first: Column, step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """Walk over ``items`` with a running value; ``step(value, item)`` gives the next value, whether to keep something, and what.

    ``kind`` is the type of the kept array. Items are walked in blocks, so the time grows with their number.
    """

    def one(acc: Column, item: Column) -> Column:
        value, keep, made = step(acc["value"], item)
        grown = F.struct(value.alias("value"), F.concat(acc["kept"], F.array(made).cast(kind)).alias("kept"))
        return F.when(keep, grown).otherwise(F.struct(value.alias("value"), acc["kept"].alias("kept")))

    def block(acc: Column, part: Column) -> Column:
        start = F.struct(acc["value"].alias("value"), F.array().cast(kind).alias("kept"))
        return let(
            F.aggregate(part, start, one),
            lambda done: F.struct(done["value"].alias("value"), F.concat(acc["blocks"], F.array(done["kept"])).alias("blocks")),
        )

    def walk(every: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(every) - 1) / BLOCK)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(every, b * BLOCK + 1, BLOCK))
        start = F.struct(first.alias("value"), F.array().cast(f"array<{kind}>").alias("blocks"))
        return F.flatten(F.aggregate(parts, start, block, lambda acc: acc["blocks"]))

    return let(items, walk)


def match_pieces(text: Column, pattern: str) -> Column:
    """``array<struct<gap,hit>>``: what stands before each match, and the match; the last gap has no hit."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.arrays_zip(F.split(text, F.lit(pattern), -1).alias("gap"), found.alias("hit"))


def spans_of(pieces: Column) -> Column:
    """``array<struct<start,end,text>>`` of the matches in pieces."""

    def step(pos: Column, piece: Column) -> tuple[Column, Column, Column]:
        begin = pos + F.length(piece["gap"])
        stop = begin + F.coalesce(F.length(piece["hit"]), F.lit(0))
        span = F.struct(begin.alias("start"), stop.alias("end"), piece["hit"].alias("text"))
        return stop, piece["hit"].isNotNull(), span

    return fold_kept(pieces, SPAN_ARRAY, F.lit(0), step)
