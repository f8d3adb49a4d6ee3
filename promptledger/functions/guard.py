"""Verdicts of guard models: input preparation, output parsing, agreement with the regex scan."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptledger.functions.spans import unicode_regex

# Safety categories of the two guard model families.
HAZARD_CATEGORIES = {
    "S1": "Violent Crimes",
    "S2": "Non-Violent Crimes",
    "S3": "Sex-Related Crimes",
    "S4": "Child Sexual Exploitation",
    "S5": "Defamation",
    "S6": "Specialized Advice",
    "S7": "Privacy",
    "S8": "Intellectual Property",
    "S9": "Indiscriminate Weapons",
    "S10": "Hate",
    "S11": "Suicide & Self-Harm",
    "S12": "Sexual Content",
    "S13": "Elections",
}
RISK_CATEGORIES = {
    "jailbreak": "Jailbreaking",
    "harm": "General Harm",
    "social_bias": "Social Bias",
    "violence": "Violence",
    "profanity": "Profanity",
    "sexual_content": "Sexual Content",
    "unethical_behavior": "Unethical Behavior",
}

VERDICT = "struct<safe:boolean,skipped:boolean,category_code:string,category_name:string,confidence:string,error:string>"

_STRIP = unicode_regex(r"\A\s+|\s+\z")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_STRIP), F.lit(""))


def _lookup(names: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for x in chain(*names.items())]), key)


def category_name(code: Column) -> Column:
    """Display name of a category code of either family, the code itself when unknown."""
    return F.coalesce(_lookup({**HAZARD_CATEGORIES, **RISK_CATEGORIES}, code), code)


def _verdict(safe, skipped, code=None, name=None, confidence=None, error=None) -> Column:
    def text(x):
        return F.lit(None).cast("string") if x is None else x

    return F.struct(
        F.lit(safe).alias("safe"),
        F.lit(skipped).alias("skipped"),
        text(code).alias("category_code"),
        text(name).alias("category_name"),
        text(confidence).alias("confidence"),
        text(error).alias("error"),
    )


def parse_hazard_verdict(raw: Column) -> Column:
    """``safe`` / ``unsafe`` with an optional category code on the second line.

    Anything else, a missing output included, counts as safe and skipped.
    """
    clean = _strip(raw)
    word = F.lower(clean)
    line = F.upper(_strip(F.get(F.split(clean, "\n"), F.lit(1))))
    known = F.when(line.isin(*HAZARD_CATEGORIES), line)
    return (
        F.when(raw.isNull(), _verdict(True, True, error=F.lit("no_response")))
        .when(word == "safe", _verdict(True, False))
        .when(word.startswith("unsafe"), _verdict(False, False, known, _lookup(HAZARD_CATEGORIES, known)))
        .otherwise(_verdict(True, True, error=F.lit("unexpected_format")))
    )


def parse_risk_verdict(raw: Column, category: Column) -> Column:
    """``Yes`` / ``No`` for one category, with an optional confidence tag."""
    confidence = F.regexp_extract(raw, unicode_regex(r"<confidence>\s*(\w+)\s*</confidence>"), 1)
    confidence = F.when(confidence != "", confidence)
    word = F.lower(_strip(F.get(F.split(raw, "<", -1), F.lit(0))))
    name = F.coalesce(_lookup(RISK_CATEGORIES, category), category)
    return (
        F.when(raw.isNull(), _verdict(True, True, error=F.lit("no_response")))
        .when(word == "no", _verdict(True, False, confidence=confidence))
        .when(word == "yes", _verdict(False, False, category, name, confidence))
        .otherwise(_verdict(True, True, error=F.lit("unexpected_format")))
    )


def combine_risk_verdicts(answers: Column) -> Column:
    """One verdict from ``array<struct<category,raw>>`` in asking order: the first flagged category wins.

    An odd answer to one category does not skip the whole; ``odd_categories`` counts them.
    """
    parsed = F.transform(
        answers,
        lambda a: F.struct(
            a["category"].alias("category"),
            a["raw"].alias("raw"),
            parse_risk_verdict(F.coalesce(a["raw"], F.lit("")), a["category"]).alias("v"),
        ),
    )
    flags = F.transform(parsed, lambda p: ~p["v"]["safe"])
    first = F.array_position(flags, F.lit(True)).cast("int")
    asked = F.when(first > 0, F.slice(parsed, F.lit(1), first)).otherwise(parsed)
    hit = F.when(first > 0, F.get(parsed, first - 1)["v"])
    raw = F.array_join(F.transform(asked, lambda p: F.concat(p["category"], F.lit("="), F.coalesce(p["raw"], F.lit("")))), "; ")
    return F.struct(
        (first == 0).alias("safe"),
        F.lit(False).alias("skipped"),
        hit["category_code"].alias("category_code"),
        hit["category_name"].alias("category_name"),
        hit["confidence"].alias("confidence"),
        raw.alias("raw_response"),
        F.size(F.filter(asked, lambda p: p["v"]["skipped"])).alias("odd_categories"),
    )


def guard_messages(messages: Column) -> Column:
    """Messages as the guard sees them: text only, every role but assistant becomes user."""
    kept = F.filter(messages, lambda m: m["content"].isNotNull())
    return F.transform(
        kept,
        lambda m: F.struct(
            F.when(m["role"] == "assistant", F.lit("assistant")).otherwise(F.lit("user")).alias("role"),
            m["content"].alias("content"),
        ),
    )


def guard_family(model: Column) -> Column:
    name = F.lower(model)
    return F.when(name.contains("granite") & name.contains("guardian"), F.lit("risk")).otherwise(F.lit("hazard"))


def has_guard(safe: Column, skipped: Column) -> Column:
    return safe.isNotNull() & ~F.coalesce(skipped, F.lit(False))


def is_disagreement(threat_level: Column, safe: Column, skipped: Column) -> Column:
    """Regex and guard contradict each other; never when the guard did not run or was skipped."""
    return F.when(has_guard(safe, skipped), (threat_level != "none") != ~safe).otherwise(F.lit(False))
