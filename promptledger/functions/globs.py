"""Shell-style globs (``*``, ``?``, ``[seq]``, ``[!seq]``) as regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One bracket expression, or any single character.
_TOKEN = r"(?s)\[!?\]?[^\]]*\]|."


def _token_regex(token: Column) -> Column:
    negated = token.startswith("[!")
    inner = F.when(negated, F.expr("1")).otherwise(F.lit(0))
    body = F.substring(token, F.lit(2) + inner, F.length(token) - 2 - inner)
    safe_body = F.regexp_replace(body, r"([\\\[\]^&])", r"\\$1")
    bracket = F.concat(F.when(negated, F.lit("[^")).otherwise(F.lit("[")), safe_body, F.lit("]"))
    return (
        F.when(token == "*", F.lit(".*"))
        .when(token == "?", F.lit("."))
        .when((F.length(token) > 2) & token.startswith("["), bracket)
        .otherwise(F.regexp_replace(token, r"([^\p{L}\p{N}\s])", r"\\$1"))
    )


def glob_to_regex(pattern: Column) -> Column:
    """Anchored Java regex of a glob; folds to a constant when the glob is a literal."""
    tokens = F.regexp_extract_all(pattern, F.lit(_TOKEN), F.lit(0))
    return F.concat(F.lit(r"(?s)\A"), F.array_join(F.transform(tokens, _token_regex), ""), F.lit(r"\z"))


def glob_match(value: Column, pattern: Column, fold_case: bool = False) -> Column:
    """True when ``value`` matches ``pattern``; case is folded on both sides on request."""
    if fold_case:
        value, pattern = F.lower(value), F.lower(pattern)
    return F.rlike(value, glob_to_regex(pattern))


def matches_any(value: Column, patterns: Column, fold_case: bool = False) -> Column:
    """True when ``value`` matches at least one glob of an array column."""
    return F.exists(patterns, lambda p: glob_match(value, p, fold_case))
