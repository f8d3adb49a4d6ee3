"""Removal of invisible characters and Unicode normalization (NFC)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptledger.functions.once import evaluate_once

# The character classes that are removed, as Java regex classes.
ZERO_WIDTH = r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{2061}\x{2062}\x{2063}\x{2064}\x{FEFF}]"
DIRECTIONAL = r"[\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"
CONTROL = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]"
TAGS = r"[\x{E0000}-\x{E007F}]"

# Only these can change under NFC or compose with what stands before them: marks, conjoining vowels and finals, and the blocks
# that hold characters with another canonical form. Other scripts, emoji and typographic signs don't go to Python.
_MAY_CHANGE_UNDER_NFC = (
    r"[\p{M}\x{0374}\x{037E}\x{0387}\x{0958}-\x{095F}\x{09DC}-\x{09DF}\x{0A33}-\x{0A5E}\x{0B5C}\x{0B5D}\x{0F43}-\x{0FB9}"
    r"\x{1161}-\x{1175}\x{11A8}-\x{11C2}\x{1F71}-\x{1FFD}\x{2000}\x{2001}\x{2126}\x{212A}\x{212B}\x{2329}\x{232A}\x{2ADC}"
    r"\x{F900}-\x{FAFF}\x{FB1D}-\x{FB4E}\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1D}]"
)


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfc_all(texts: pd.Series) -> pd.Series:
    def each(items):
        if items is None:
            return None
        return [None if s is None else unicodedata.normalize("NFC", s) for s in items]

    return texts.map(each)


def nfc(text: Column) -> Column:
    """NFC form; rows that cannot change are not sent to Python as text."""
    return F.coalesce(_nfc(F.when(F.rlike(text, F.lit(_MAY_CHANGE_UNDER_NFC)), text)), text)


def _classes(zero_width: bool, directional: bool, control: bool, tags: bool) -> dict[str, list[str]]:
    chosen = {
        "zero_width": [ZERO_WIDTH] if zero_width else [],
        "directional": [DIRECTIONAL] if directional else [],
        "control_char": ([CONTROL] if control else []) + ([TAGS] if tags else []),
    }
    return {kind: classes for kind, classes in chosen.items() if classes}


def _join(classes: list[str]) -> str:
    """One class of all, which a regex engine tests faster than alternatives."""
    return "[" + "".join(c[1:-1] for c in classes) + "]"


def strip_invisible(text: Column, zero_width=True, directional=True, control=True, tags=True) -> Column:
    chosen = [c for classes in _classes(zero_width, directional, control, tags).values() for c in classes]
    return F.regexp_replace(text, F.lit(_join(chosen)), F.lit("")) if chosen else text


def sanitize(
    df: DataFrame,
    text: str,
    zero_width: bool = True,
    directional: bool = True,
    control: bool = True,
    tags: bool = True,
    normalize: bool = True,
) -> DataFrame:
    """Add ``sanitized``, ``modified``, ``nfc_only`` and one removal count per kind.

    Tag characters are counted as control characters. Clean text skips every replacement.
    """
    source = F.col(text)
    chosen = _classes(zero_width, directional, control, tags)
    every = [c for classes in chosen.values() for c in classes]
    dirty = F.rlike(source, F.lit(_join(every))) if every else F.lit(False)

    out = evaluate_once(df, "_dirty", dirty)
    for kind in ("zero_width", "directional", "control_char"):
        count = F.lit(0)
        if kind in chosen:
            count = F.when(F.col("_dirty"), F.regexp_count(source, F.lit(_join(chosen[kind])))).otherwise(0)
        out = out.withColumn(f"removed_{kind}", count.cast("bigint"))
    stripped = F.when(F.col("_dirty"), strip_invisible(source, zero_width, directional, control, tags))
    out = out.withColumn("_stripped", F.coalesce(stripped, source))
    out = out.withColumn("sanitized", nfc(F.col("_stripped")) if normalize else F.col("_stripped"))
    total = F.col("removed_zero_width") + F.col("removed_directional") + F.col("removed_control_char")
    return (
        out.withColumn("total_removals", total)
        .withColumn("modified", F.coalesce(F.col("sanitized") != source, F.lit(False)))
        .withColumn("nfc_only", F.col("modified") & (F.col("total_removals") == 0))
        .drop("_dirty", "_stripped")
    )


def sanitize_messages(df: DataFrame, messages: str = "messages") -> DataFrame:
    """Sanitize the content of every message of an array; null content stays null.

    No explode: the contents travel to Python as one array, and only where NFC may matter.
    """
    original = F.transform(F.col(messages), lambda m: m["content"])
    out = df.withColumn("_contents", F.transform(original, lambda c: strip_invisible(c)))
    needs_nfc = F.exists(F.col("_contents"), lambda c: F.rlike(c, F.lit(_MAY_CHANGE_UNDER_NFC)))
    out = out.withColumn(
        "_clean", F.coalesce(_nfc_all(F.when(needs_nfc, F.col("_contents"))), F.col("_contents"))
    )
    return out.withColumn(
        messages,
        F.transform(F.col(messages), lambda m, i: m.withField("content", F.get(F.col("_clean"), i))),
    ).drop("_contents", "_clean")
