"""Prompt-injection patterns over texts and message arrays."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptledger.functions.once import evaluate_once
from promptledger.functions.spans import let, match_pieces, spans_of, unicode_regex
from promptledger.functions.threats import threat_name, threat_order

MATCH_ARRAY = "array<struct<pattern:string,category:string,text:string,position:int,level:string>>"


@dataclass(frozen=True)
class InjectionPattern:
    """``needles``: lower-case words of which a matching text must contain one (empty: unknown).

    ``long_run``: every match has at least 50 characters without whitespace.
    """

    name: str
    category: str
    level: str
    regex: str
    needles: tuple[str, ...] = ()
    long_run: bool = False


# Name, level and expression of each pattern, in match order; the needles are ours.
PATTERNS: tuple[InjectionPattern, ...] = (
    InjectionPattern("ignore_previous", "instruction_override", "high", r"ignore\s+(all\s+)?(the\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|rules?|guidelines?)", ("ignore",)),
    InjectionPattern("disregard_previous", "instruction_override", "high", r"disregard\s+(all\s+)?(the\s+)?(previous|prior|above|earlier)", ("disregard",)),
    InjectionPattern("forget_context", "instruction_override", "high", r"forget\s+(everything|all|what)\s+(you|i|we)\s+(said|told|know)", ("forget",)),
    InjectionPattern("override_instructions", "instruction_override", "high", r"override\s+(your|the|all)?\s*(instructions?|rules?|guidelines?)", ("override",)),
    InjectionPattern("new_instructions", "instruction_override", "medium", r"new\s+(instructions?|rules?|guidelines?)\s*:", ("instruction", "rule", "guideline")),
    InjectionPattern("from_now_on", "instruction_override", "medium", r"from\s+now\s+on\s*,?\s*(you|ignore|forget|pretend)", ("now",)),
    InjectionPattern("stop_being_ai", "instruction_override", "high", r"stop\s+being\s+(an?\s+)?(ai|assistant|helpful)", ("being",)),
    InjectionPattern("fake_delimiter", "delimiter_attack", "high", r"<\|?(system|assistant|user|human|bot)\|?>", ("system", "assistant", "user", "human", "bot")),
    InjectionPattern("instruction_tag", "delimiter_attack", "high", r"\[SYSTEM\]|\[INST\]|\[/INST\]", ("system]", "inst]")),
    InjectionPattern("code_block_system", "delimiter_attack", "medium", r"```\s*(system|instructions?|config)", ("```",)),
    InjectionPattern("separator_attack", "delimiter_attack", "medium", r"={3,}\s*(system|new\s+instructions?)", ("===",)),
    InjectionPattern("markdown_separator", "delimiter_attack", "medium", r"---+\s*(system|instructions?)", ("---",)),
    InjectionPattern("pretend_not_ai", "roleplay_escape", "high", r"(pretend|imagine|act\s+as\s+if)\s+(you\s+are|to\s+be)\s+(not|no\s+longer)\s+(an?\s+)?(ai|assistant|bound)", ("pretend", "imagine", "act")),
    InjectionPattern("jailbreak_persona", "roleplay_escape", "critical", r"you\s+are\s+(now\s+)?(DAN|jailbroken|uncensored|unfiltered)", ("dan", "jailbroken", "uncensored", "unfiltered")),
    InjectionPattern("enable_mode", "roleplay_escape", "critical", r"enable\s+(developer|debug|admin|god)\s+mode", ("enable",)),
    InjectionPattern("bypass_restrictions", "roleplay_escape", "critical", r"bypass\s+(your|the|all|my)?\s*(safety\s+)?(restrictions?|filters?|rules?|safeguards?|guidelines?)", ("bypass",)),
    InjectionPattern("hypothetical_framing", "roleplay_escape", "low", r"in\s+this\s+(hypothetical|fictional|imaginary)\s+scenario", ("scenario",)),
    InjectionPattern("decode_request", "encoding_tricks", "medium", r"(decode|decrypt|decipher)\s+(this|the\s+following)\s*(base64|rot13|hex)?", ("decode", "decrypt", "decipher")),
    InjectionPattern("encoded_content", "encoding_tricks", "medium", r"the\s+(following|above|below)\s+is\s+(encoded|encrypted|base64)", ("encoded", "encrypted", "base64")),
    InjectionPattern("possible_base64", "encoding_tricks", "low", r"[A-Za-z0-9+/]{50,}={0,2}", long_run=True),
    InjectionPattern("fake_real_instructions", "context_manipulation", "high", r"(the\s+real|your\s+actual|secret)\s+instructions?\s+(are|is|say)", ("instruction",)),
    InjectionPattern("test_framing", "context_manipulation", "low", r"this\s+is\s+(a\s+)?test\s+(of|to\s+check)", ("test",)),
    InjectionPattern("ignore_safety", "context_manipulation", "critical", r"ignore\s+(the\s+)?safety\s+(protocols?|guidelines?|restrictions?)", ("ignore",)),
    InjectionPattern("obedience_demand", "context_manipulation", "high", r"you\s+(must|have\s+to|should)\s+(always\s+)?obey\s+(me|this|the\s+user)", ("obey",)),
    InjectionPattern("admin_claim", "context_manipulation", "high", r"admin(istrator)?\s*(access|mode|override|command)", ("admin",)),
)

CATEGORIES = tuple(dict.fromkeys(p.category for p in PATTERNS))

# Letters outside ASCII that fold to s, k or i when case is ignored; such texts skip the needle test.
_ODD_FOLDS = r"[\x{017F}\x{212A}\x{0130}\x{0131}]"
_LONG_RUN = r"\S{50}"


def select_patterns(
    without: Sequence[str] = (), patterns: Sequence[InjectionPattern] = PATTERNS
) -> tuple[InjectionPattern, ...]:
    """Switch off whole categories."""
    return tuple(p for p in patterns if p.category not in without)


# Token vocabularies legitimately hold bracketed tags, so embedding inputs skip delimiter patterns.
EMBEDDING_PATTERNS = select_patterns(without=("delimiter_attack",))


def injection_matches(
    text: Column,
    patterns: Sequence[InjectionPattern] = PATTERNS,
    case_sensitive: bool = False,
    without_delimiters: Column | None = None,
) -> Column:
    """All matches in pattern order, each pattern left to right.

    Every pattern is a literal, so it is compiled once; its regex is only run where one of its needles stands in the text.
    """
    # What the needle tests share is worked out once per text.
    fact = F.struct(
        text.alias("text"),
        F.lower(text).alias("folded"),
        F.rlike(text, F.lit(_ODD_FOLDS)).alias("odd"),
        F.rlike(text, F.lit(_LONG_RUN)).alias("long_run"),
    )

    def found(p: InjectionPattern, fact: Column) -> Column:
        regex = unicode_regex(p.regex, not case_sensitive)
        hit = F.rlike(fact["text"], F.lit(regex))
        if p.long_run:
            hit = fact["long_run"] & hit
        if p.needles:
            hit = (reduce(Column.__or__, [F.contains(fact["folded"], F.lit(n)) for n in p.needles]) | fact["odd"]) & hit
        if without_delimiters is not None and p.category == "delimiter_attack":
            hit = ~without_delimiters & hit
        about = [F.lit(v).alias(k) for k, v in (("pattern", p.name), ("category", p.category), ("level", p.level))]
        return F.when(hit, F.struct(*about, match_pieces(fact["text"], regex).alias("pieces")))

    def matches(hit: Column) -> Column:
        return F.transform(
            spans_of(hit["pieces"]),
            lambda span: F.struct(hit["pattern"], hit["category"], span["text"].alias("text"), span["start"].alias("position"), hit["level"]),
        )

    if not patterns:
        return F.array().cast(MATCH_ARRAY)
    hits = let(fact, lambda fact: F.array_compact(F.array(*[found(p, fact) for p in patterns])))
    return F.flatten(F.transform(hits, matches))


def max_threat(matches: Column) -> Column:
    """Name of the highest level among the matches, ``none`` without any."""
    orders = F.transform(matches, lambda m: threat_order(m["level"]))
    return threat_name(F.coalesce(F.array_max(orders), F.lit(0)))


def _with_verdict(df: DataFrame, matches: Column) -> DataFrame:
    out = evaluate_once(df, "matches", F.coalesce(matches, F.array().cast(MATCH_ARRAY)))
    return out.withColumn("threat_level", max_threat(F.col("matches"))).withColumn("match_count", F.size("matches"))


def scan_injection(
    df: DataFrame,
    text: str,
    patterns: Sequence[InjectionPattern] = PATTERNS,
    case_sensitive: bool = False,
    embedding_task: Column | None = None,
) -> DataFrame:
    """Add ``matches``, ``threat_level``, ``match_count``; over whole texts.

    Where ``embedding_task`` is true, delimiter patterns are left out.
    """
    return _with_verdict(df, injection_matches(F.col(text), patterns, case_sensitive, embedding_task))


def scan_injection_messages(
    df: DataFrame,
    messages: str = "messages",
    patterns: Sequence[InjectionPattern] = PATTERNS,
    case_sensitive: bool = False,
    embedding_task: Column | None = None,
) -> DataFrame:
    """The same over a message array: matches of all messages in message order."""
    spoken = F.filter(F.col(messages), lambda m: m["content"].isNotNull())
    found = F.transform(spoken, lambda m: injection_matches(m["content"], patterns, case_sensitive, embedding_task))
    return _with_verdict(df, F.flatten(found))


def scan_json(matches: Column, threat_level: Column) -> Column:
    """The stored form of one scan."""
    return F.to_json(
        F.struct(
            F.lit(True).alias("scanned"),
            threat_level.alias("threat_level"),
            (threat_level != "none").alias("is_suspicious"),
            F.size(matches).alias("match_count"),
            matches.alias("matches"),
        )
    )
