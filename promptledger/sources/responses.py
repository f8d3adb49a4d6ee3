"""Wire responses of two API dialects, normalized to one schema (request_id, model, body)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptledger.functions.requests import finish_from_wire

_CALLS = "array<struct<id:string,function:struct<name:string,arguments:variant>>>"


def _get(body: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(body, path, kind)


def _tool_calls(calls: Column) -> Column:
    """Id, name and arguments as JSON text; argument text that is no JSON is kept under ``raw``."""
    def arguments(value: Column) -> Column:
        text = F.coalesce(_get(value, "$", "string"), F.lit("{}"))
        parsed = F.to_json(F.try_parse_json(text))
        return F.coalesce(parsed, F.to_json(F.struct(text.alias("raw"))))

    return F.transform(
        calls,
        lambda c: F.struct(
            c["id"].alias("id"),
            F.coalesce(c["function"]["name"], F.lit("")).alias("name"),
            arguments(c["function"]["arguments"]).alias("arguments"),
        ),
    )


def _count(body: Column, path: str) -> Column:
    return F.coalesce(_get(body, path, "int"), F.lit(0))


def chat_responses(raw: DataFrame) -> DataFrame:
    """First choice, usage and tool calls; ``empty_response`` without a choice."""
    b = F.col("_b")
    rows = raw.withColumn("_b", F.try_parse_json("body"))
    some = F.coalesce(F.size(_get(b, "$.choices", "array<variant>")) > 0, F.lit(False))
    calls = _get(b, "$.choices[0].message.tool_calls", _CALLS)
    text = F.coalesce(_get(b, "$.choices[0].message.content", "string"), _get(b, "$.choices[0].text", "string"))

    def when_some(value: Column) -> Column:
        return F.when(some, value)

    return rows.select(
        "request_id",
        F.coalesce(when_some(_get(b, "$.model", "string")), F.col("model"), F.lit("unknown")).alias("model"),
        when_some(F.coalesce(text, F.lit(""))).alias("content"),
        F.when(some, finish_from_wire(_get(b, "$.choices[0].finish_reason", "string"))).otherwise(F.lit("error")).alias("finish_reason"),
        F.when(some, _count(b, "$.usage.prompt_tokens")).otherwise(0).alias("prompt_tokens"),
        F.when(some, _count(b, "$.usage.completion_tokens")).otherwise(0).alias("completion_tokens"),
        F.when(some, _count(b, "$.usage.total_tokens")).otherwise(0).alias("total_tokens"),
        F.when(some & (F.size(calls) > 0), _tool_calls(calls)).alias("tool_calls"),
        F.when(~some, F.lit("empty_response")).alias("error_code"),
    )


def options_responses(raw: DataFrame) -> DataFrame:
    """Second dialect: evaluation counts become usage, ``done`` the finish reason."""
    b = F.col("_b")
    rows = raw.withColumn("_b", F.try_parse_json("body"))
    calls = _get(b, "$.message.tool_calls", _CALLS)
    has_calls = F.coalesce(F.size(calls) > 0, F.lit(False))
    done = F.coalesce(_get(b, "$.done", "boolean"), F.lit(False))
    prompt, completion = _count(b, "$.prompt_eval_count"), _count(b, "$.eval_count")
    text = F.coalesce(_get(b, "$.message.content", "string"), _get(b, "$.response", "string"), F.lit(""))
    return rows.select(
        "request_id",
        F.coalesce(_get(b, "$.model", "string"), F.col("model"), F.lit("unknown")).alias("model"),
        text.alias("content"),
        F.when(has_calls, "tool_calls").when(done, "stop").otherwise("length").alias("finish_reason"),
        prompt.alias("prompt_tokens"),
        completion.alias("completion_tokens"),
        (prompt + completion).alias("total_tokens"),
        F.when(has_calls, _tool_calls(calls)).alias("tool_calls"),
    )
