"""Personal data: detection with positions, overlap removal, scrubbing, hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptledger.functions.once import evaluate_once
from promptledger.functions.spans import fold_kept, let, match_pieces, spans_of, unicode_regex

# Type names and patterns, in priority order.
PII_PATTERNS: tuple[tuple[str, str], ...] = (
    ("SSN", r"\b\d{3}[-\s]\d{2}[-\s]\d{4}\b"),
    ("CREDIT_CARD", r"\b(?:\d{4}[-\s]){3}\d{4}\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("PHONE", r"\b(?:\+1[-.\s]?)?\(?[2-9]\d{2}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"),
)

# What a text must contain before a pattern is worth trying: two neighbouring digits (all numbers
# above have a run of three), an at sign, or a digit on both sides of a full stop.
_TWO_DIGITS = r"\p{Nd}\p{Nd}"
_DOTTED_DIGITS = r"\p{Nd}\.\p{Nd}"

DETECTION_ARRAY = "array<struct<start:int,rank:int,end:int,pii_type:string,value:string>>"


def _worth_trying(text: Column, pii_type: str) -> Column:
    if pii_type == "EMAIL":
        return F.contains(text, F.lit("@"))
    return F.rlike(text, F.lit(_DOTTED_DIGITS if pii_type == "IP_ADDRESS" else _TWO_DIGITS))


def all_matches(text: Column) -> Column:
    """Every match of every pattern, in order of start and then of pattern priority."""
    found = []
    for rank, (pii_type, written) in enumerate(PII_PATTERNS):
        pattern = unicode_regex(written)
        hit = _worth_trying(text, pii_type) & F.rlike(text, F.lit(pattern))
        about = F.struct(F.lit(rank).alias("rank"), F.lit(pii_type).alias("pii_type"), match_pieces(text, pattern).alias("pieces"))
        found.append(F.when(hit, about))

    def matches(p: Column) -> Column:
        return F.transform(
            spans_of(p["pieces"]),
            lambda span: F.struct(span["start"].alias("start"), p["rank"], span["end"].alias("end"), p["pii_type"], span["text"].alias("value")),
        )

    return F.array_sort(F.flatten(F.transform(F.array_compact(F.array(*found)), matches)))


def _without_overlaps(matches: Column) -> Column:
    def step(last_end: Column, m: Column) -> tuple[Column, Column, Column]:
        keep = m["start"] >= last_end
        return F.when(keep, m["end"]).otherwise(last_end), keep, m

    return fold_kept(matches, DETECTION_ARRAY, F.lit(-1), step)


def detections(text: Column) -> Column:
    """Kept detections as ``array<struct<start,rank,end,pii_type,value>>``; empty when clean."""
    maybe = F.contains(text, F.lit("@")) | F.rlike(text, F.lit(_TWO_DIGITS + "|" + _DOTTED_DIGITS))
    return F.when(maybe, _without_overlaps(all_matches(text))).otherwise(F.array().cast(DETECTION_ARRAY))


#: Characters of a block that a text is cut into before stretches of it are taken out.
_BLOCK = 4096


def _stretch(blocks: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end`` of the text that the blocks make up."""
    first, last = F.floor(start / _BLOCK).cast("int"), F.floor((end - 1) / _BLOCK).cast("int")

    def part(block: Column, i: Column) -> Column:
        low = F.when(i == 0, start - first * _BLOCK).otherwise(0)
        high = F.when(i == last - first, end - last * _BLOCK).otherwise(_BLOCK)
        return F.when((low == 0) & (high == _BLOCK), block).otherwise(F.substring(block, low + 1, high - low))

    return F.when(end > start, F.array_join(F.transform(F.slice(blocks, first + 1, last - first + 1), part), "")).otherwise("")


def scrubbed(text: Column, found: Column) -> Column:
    """Text with each detection replaced by its type in brackets; null when there is none.

    The text is cut into blocks once, and what stands between two detections is taken from the blocks it lies in: time and
    memory are in proportion to the text.
    """

    def built(blocks: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(found, lambda d: d["end"]))
        ends = F.concat(F.transform(found, lambda d: d["start"]), F.array(F.length(text)))
        names = F.concat(F.transform(found, lambda d: F.concat(F.lit("["), d["pii_type"], F.lit("]"))), F.array(F.lit("")))
        pieces = F.arrays_zip(starts.alias("a"), ends.alias("b"), names.alias("name"))
        return F.array_join(F.transform(pieces, lambda p: F.concat(_stretch(blocks, p["a"], p["b"]), p["name"])), "")

    return F.when(F.size(found) > 0, let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)), built))


def scan_pii(df: DataFrame, text: str) -> DataFrame:
    """Add ``detections`` of the whole text."""
    return evaluate_once(df, "detections", detections(F.col(text)))


def scrub_pii(df: DataFrame, text: str) -> DataFrame:
    """Add ``scrubbed_text``: null when clean."""
    return df.withColumn("scrubbed_text", scrubbed(F.col(text), F.col("detections")))


def summary(found: Column) -> tuple[Column, Column, Column]:
    """has_pii, detection_count, pii_types (sorted, distinct)."""
    types = F.array_sort(F.array_distinct(F.transform(found, lambda d: d["pii_type"])))
    return F.size(found) > 0, F.size(found), types


def scan_message_array(df: DataFrame, messages: str = "messages", scrub: bool = False) -> DataFrame:
    """Add ``message_detections`` (one array per message); with ``scrub`` replace the contents."""
    out = evaluate_once(
        df,
        "message_detections",
        F.transform(F.col(messages), lambda m: F.coalesce(detections(m["content"]), F.array().cast(DETECTION_ARRAY))),
    )
    if scrub:
        out = out.withColumn(
            messages,
            F.transform(
                F.col(messages),
                lambda m, i: m.withField(
                    "content",
                    F.coalesce(scrubbed(m["content"], F.get(F.col("message_detections"), i)), m["content"]),
                ),
            ),
        )
    return out


def scan_parts(df: DataFrame, parts: str, scrub: bool = False) -> DataFrame:
    """The same over content parts ``array<struct<type,text>>``; parts that are not text pass unchanged."""
    def found(p: Column) -> Column:
        return F.when(p["type"] == "text", detections(p["text"])).otherwise(F.array().cast(DETECTION_ARRAY))

    out = evaluate_once(df, "part_detections", F.transform(F.col(parts), found))
    if scrub:
        out = out.withColumn(
            parts,
            F.transform(
                F.col(parts),
                lambda p, i: p.withField(
                    "text", F.coalesce(scrubbed(p["text"], F.get(F.col("part_detections"), i)), p["text"])
                ),
            ),
        )
    return out


def scrub_route(route: Column, routes: list[str], enabled: bool = True) -> Column:
    """Whether a route is scrubbed: an empty list means every route."""
    if not enabled:
        return F.lit(False)
    return F.lit(True) if not routes else F.coalesce(route.isin(*routes), F.lit(False))
