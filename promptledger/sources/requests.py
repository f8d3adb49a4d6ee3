"""Wire requests of two API dialects, normalized to one schema.

Input rows: request_id, client_id, body (JSON text). The union-typed parts stay variants until
their shape is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Defaults of the canonical request.
DEFAULT_MAX_TOKENS = 1024
DEFAULT_TEMPERATURE = 0.7
DEFAULT_TOP_P = 1.0
ANONYMOUS = "anonymous"


def _get(body: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(body, path, kind)


def string_or_list(value: Column, path: str = "$") -> Column:
    """A string or a list of strings as a list; the list is tried first, since a list also casts to text."""
    as_list = _get(value, path, "array<string>")
    single = _get(value, path, "string")
    return F.coalesce(as_list, F.when(single.isNotNull(), F.array(single)))


def content_text(content: Column) -> Column:
    """Message content: text as is, or the text parts of an array joined by newlines; null is empty."""
    parts = _get(content, "$", "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit("")))
    return F.coalesce(F.array_join(texts, "\n"), _get(content, "$", "string"), F.lit(""))


_MESSAGES = "array<struct<role:string,content:variant,name:string>>"


def _messages(body: Column) -> Column:
    raw = _get(body, "$.messages", _MESSAGES)
    return F.transform(
        raw,
        lambda m: F.struct(
            m["role"].alias("role"),
            F.when(content_text(m["content"]) != "", content_text(m["content"])).alias("content"),
            m["name"].alias("name"),
        ),
    )


def _parsed(df: DataFrame) -> DataFrame:
    return df.withColumn("_b", F.try_parse_json("body"))


def _max_tokens(value: Column) -> Column:
    return F.coalesce(F.when(value != 0, value), F.lit(DEFAULT_MAX_TOKENS))


def _common(body: Column) -> list[Column]:
    return [
        F.coalesce(F.when(_get(body, "$.user", "string") != "", _get(body, "$.user", "string")), F.lit(ANONYMOUS)).alias("user_id"),
        _get(body, "$.model", "string").alias("model"),
    ]


def _sampling(body: Column, where: str = "$") -> list[Column]:
    return [
        F.coalesce(_get(body, f"{where}.temperature", "double"), F.lit(DEFAULT_TEMPERATURE)).alias("temperature"),
        F.coalesce(_get(body, f"{where}.top_p", "double"), F.lit(DEFAULT_TOP_P)).alias("top_p"),
    ]


def _stop(body: Column) -> Column:
    stops = string_or_list(body, "$.stop")
    return F.when((F.size(stops) > 0) & (F.array_join(stops, "") != ""), stops).alias("stop")


def chat_requests(raw: DataFrame) -> DataFrame:
    """Chat dialect."""
    b = F.col("_b")
    return _parsed(raw).select(
        "request_id", "client_id", F.lit("chat").alias("task"), *_common(b),
        _messages(b).alias("messages"),
        _max_tokens(_get(b, "$.max_tokens", "int")).alias("max_tokens"),
        *_sampling(b), _stop(b),
        F.coalesce(_get(b, "$.stream", "boolean"), F.lit(False)).alias("stream"),
        F.size(F.coalesce(_get(b, "$.tools", "array<variant>"), F.array().cast("array<variant>"))).alias("tool_count"),
    )


_FULL_MESSAGES = "array<struct<role:string,content:variant,name:string,tool_call_id:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>>>"


def chat_details(raw: DataFrame) -> DataFrame:
    """What ``chat_requests`` leaves out: content parts and tool calls of the messages, tools, tool choice, response format.

    Free-form values are JSON text. ``parse_error`` names a body that is no JSON object; its other columns are null.
    """
    b = F.col("_b")

    def message(m: Column) -> Column:
        calls = F.transform(
            m["tool_calls"], lambda c: F.struct(c["id"].alias("id"), c["type"].alias("type"), c["function"]["name"].alias("name"), c["function"]["arguments"].alias("arguments")))
        parts = _get(m["content"], "$", "array<variant>")
        return F.struct(
            m["role"].alias("role"), F.transform(parts, lambda p: F.to_json(p)).alias("parts"), m["tool_call_id"].alias("tool_call_id"), calls.alias("tool_calls"))

    tools = _get(b, "$.tools", "array<variant>")
    return _parsed(raw).select(
        "request_id",
        F.when(F.col("body").isNull(), F.lit("empty")).when(b.isNull(), F.lit("not_json")).when(~F.rlike("body", F.lit(r"\A\s*\{")), F.lit("not_an_object")).alias("parse_error"),
        F.transform(_get(b, "$.messages", _FULL_MESSAGES), message).alias("messages"),
        F.transform(tools, lambda t: F.to_json(t)).alias("tools"),
        F.to_json(_get(b, "$.tool_choice", "variant")).alias("tool_choice"),
        F.to_json(_get(b, "$.response_format", "variant")).alias("response_format"),
    )


def completion_requests(raw: DataFrame) -> DataFrame:
    """Completion dialect; of a prompt list the first element counts."""
    b = F.col("_b")
    return _parsed(raw).select(
        "request_id", "client_id", F.lit("completion").alias("task"), *_common(b),
        F.get(string_or_list(b, "$.prompt"), F.lit(0)).alias("prompt"),
        _max_tokens(_get(b, "$.max_tokens", "int")).alias("max_tokens"),
        *_sampling(b), _stop(b),
        F.coalesce(_get(b, "$.stream", "boolean"), F.lit(False)).alias("stream"),
    )


def embedding_requests(raw: DataFrame) -> DataFrame:
    """Embedding dialect: always a list of inputs, no token limit."""
    b = F.col("_b")
    return _parsed(raw).select(
        "request_id", "client_id", F.lit("embeddings").alias("task"), *_common(b),
        string_or_list(b, "$.input").alias("input_data"),
        F.lit(0).alias("max_tokens"),
        F.lit(DEFAULT_TEMPERATURE).alias("temperature"),
        F.lit(DEFAULT_TOP_P).alias("top_p"),
        F.lit(False).alias("stream"),
    )


def options_requests(raw: DataFrame) -> DataFrame:
    """Second dialect: sampling under ``options``, streaming on unless switched off.

    A body with ``messages`` is a chat; otherwise system and prompt become messages of a generate task.
    """
    b = F.col("_b")
    chat = _messages(b)
    system, prompt = _get(b, "$.system", "string"), _get(b, "$.prompt", "string")

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"), F.lit(None).cast("string").alias("name"))

    generated = F.array_compact(F.array(F.when(system != "", message("system", system)), message("user", prompt)))
    is_chat = chat.isNotNull()
    return _parsed(raw).select(
        "request_id", "client_id",
        F.when(is_chat, F.lit("chat")).otherwise(F.lit("generate")).alias("task"),
        F.lit(ANONYMOUS).alias("user_id"),
        _get(b, "$.model", "string").alias("model"),
        F.when(is_chat, chat).otherwise(generated).alias("messages"),
        F.when(~is_chat, prompt).alias("prompt"),
        F.coalesce(_get(b, "$.options.num_predict", "int"), F.lit(DEFAULT_MAX_TOKENS)).alias("max_tokens"),
        *_sampling(b, "$.options"),
        F.coalesce(_get(b, "$.stream", "boolean"), F.lit(True)).alias("stream"),
    )


def all_requests(*normalized: DataFrame) -> DataFrame:
    """One schema for every dialect and task; what a dialect lacks is null."""
    out = normalized[0]
    for df in normalized[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
