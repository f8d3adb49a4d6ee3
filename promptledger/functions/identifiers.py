"""Keys, identifiers and labels made safe for logs and metrics; quality checks; timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptledger.functions.spans import unicode_regex

# What counts as safe.
SAFE_KEY = r"\A[a-zA-Z0-9][a-zA-Z0-9_-]{0,127}\n?\z"
SAFE_ID = r"\A[a-zA-Z0-9][a-zA-Z0-9_.-]{0,127}\n?\z"
SAFE_LOG_VALUE = r"\A[a-zA-Z0-9][a-zA-Z0-9_\-.:]{0,127}\n?\z"
SAFE_IDENTIFIER = r"\A[a-zA-Z][a-zA-Z0-9_-]{0,63}\n?\z"
SAFE_API_KEY = r"\A[a-zA-Z0-9_-]{16,128}\n?\z"

_STRIP = unicode_regex(r"\A\s+|\s+\z")


def _filled(value: Column) -> Column:
    return F.when(value != "", value)


def limiter_key(explicit: Column, client_id: Column, user_id: Column) -> Column:
    """Explicit key, else client, else user, else ``anonymous``; empty counts as missing."""
    return F.coalesce(_filled(explicit), _filled(client_id), _filled(user_id), F.lit("anonymous"))


def clean_limiter_key(key: Column) -> Column:
    """Safe keys stay; others become their whole digest, so that no two keys share a limit."""
    return F.when(F.rlike(key, F.lit(SAFE_KEY)), key).otherwise(F.concat(F.lit("hashed_"), F.sha2(key, 256)))


def clean_log_value(value: Column) -> Column:
    replaced = F.regexp_replace(value, F.lit(r"[^\p{L}\p{N}\-_.:@]"), F.lit("_"))
    return F.when(F.rlike(value, F.lit(SAFE_LOG_VALUE)), value).otherwise(replaced)


def clean_metric_label(value: Column) -> Column:
    replaced = F.regexp_replace(value, F.lit(r"[^\p{L}\p{N}\-_.]"), F.lit("_"))
    return F.coalesce(_filled(replaced), F.lit("unknown"))


def clean_id(value: Column) -> Column:
    """Missing becomes ``anonymous``; unsafe characters become underscores, a bad first one gets a prefix."""
    cut = F.regexp_replace(value, F.lit(_STRIP), F.lit(""))
    replaced = F.regexp_replace(cut, F.lit(r"[^a-zA-Z0-9_.\-]"), F.lit("_"))
    fixed = F.when(F.rlike(replaced, F.lit(r"\A[a-zA-Z0-9]")), replaced).otherwise(F.concat(F.lit("user_"), replaced))
    safe = F.when(F.rlike(cut, F.lit(SAFE_ID)), cut).otherwise(fixed)
    return F.when(_filled(value).isNull(), F.lit("anonymous")).otherwise(safe)


def key_hash(key: Column) -> Column:
    return F.sha2(key, 256)


def key_prefix(key: Column) -> Column:
    return F.substring(key, 1, 12)


def identifier_problem(value: Column) -> Column:
    """Null when fine, else the reason."""
    clean = F.regexp_replace(value, F.lit(_STRIP), F.lit(""))
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit("identifier_empty")).when(
        ~F.rlike(clean, F.lit(SAFE_IDENTIFIER)), F.lit("identifier_invalid")
    )


def url_problem(value: Column) -> Column:
    clean = F.rtrim(F.regexp_replace(value, F.lit(_STRIP), F.lit("")), F.lit("/"))
    scheme = F.lower(F.substring_index(clean, "://", 1))
    rest = F.substring(clean, F.instr(clean, "://") + 3, F.length(clean))
    return (
        F.when(F.coalesce(clean, F.lit("")) == "", F.lit("url_empty"))
        .when(~F.contains(clean, F.lit("://")), F.lit("url_without_scheme"))
        .when(~scheme.isin("http", "https"), F.lit("url_scheme"))
        .when((rest == "") | rest.startswith("/"), F.lit("url_without_host"))
    )


def api_key_problem(value: Column) -> Column:
    bad = value.isNull() | ~F.rlike(value, F.lit(SAFE_API_KEY))
    return F.when(bad, F.lit("api_key_format"))


def problems(*checks: Column) -> Column:
    """All reasons of a row as an array; empty when the row is fine."""
    return F.array_compact(F.array(*checks))


def lenient_utc(value: Column) -> Column:
    """Timestamp of a text; without a zone it is UTC."""
    zoned = value.endswith("Z") | F.rlike(value, F.lit(r"[+-]\d{2}:\d{2}\z"))
    return F.try_to_timestamp(F.when(zoned, value).otherwise(F.concat(value, F.lit("Z"))))
