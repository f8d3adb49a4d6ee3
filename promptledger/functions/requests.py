"""Small expressions over requests and responses: texts, timing, finish reasons, limits, model traits."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Finish reasons of the wire format and of the canonical schema.
FINISH_FROM_WIRE = {
    "stop": "stop",
    "length": "length",
    "content_filter": "content_filter",
    "tool_calls": "tool_calls",
    "function_call": "tool_calls",
}
FINISH_TO_WIRE = {
    "stop": "stop",
    "length": "length",
    "content_filter": "content_filter",
    "tool_calls": "tool_calls",
    "error": "stop",
}
# Task to the capability it needs.
TASK_CAPABILITY = {
    "chat": "chat",
    "completion": "completion",
    "generate": "completion",
    "embeddings": "embeddings",
    "summarize": "chat",
    "extract": "chat",
    "classify": "chat",
}
# Context length by model name part, first hit wins.
CONTEXT_LENGTHS = (
    (("gpt-4-turbo",), 128000),
    (("gpt-4o",), 128000),
    (("gpt-4-32k",), 32768),
    (("gpt-4",), 8192),
    (("gpt-3.5-turbo-16k",), 16384),
    (("gpt-3.5",), 4096),
    (("claude-3",), 200000),
    (("claude-2",), 100000),
    (("llama-3", "70b"), 8192),
    (("mixtral",), 32768),
)
DEFAULT_CONTEXT_LENGTH = 4096


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*values.items())])


def filled(value: Column) -> Column:
    return F.when(value != "", value)


def finish_from_wire(reason: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(FINISH_FROM_WIRE), F.lower(reason)), F.lit("stop"))


def finish_to_wire(reason: Column) -> Column:
    known = F.coalesce(F.element_at(literal_map(FINISH_TO_WIRE), reason), F.lit("stop"))
    return F.when(reason.isNotNull(), known)


def input_text(prompt: Column, input_text: Column, messages: Column, input_data: Column) -> Column:
    """Primary text: prompt, else input text, else joined messages, else joined data."""
    joined = F.array_join(
        F.transform(F.filter(messages, lambda m: m["content"].isNotNull()), lambda m: m["content"]), "\n"
    )
    return (
        F.when(filled(prompt).isNotNull(), prompt)
        .when(filled(input_text).isNotNull(), input_text)
        .when(F.size(messages) > 0, joined)
        .when(F.size(input_data) > 0, F.array_join(input_data, "\n"))
        .otherwise(F.lit(""))
    )


def last_of_role(messages: Column, role: str) -> Column:
    of_role = F.filter(messages, lambda m: m["role"] == role)
    return F.try_element_at(of_role, F.lit(-1))["content"]


def last_user_message(messages: Column, prompt: Column, input_text: Column) -> Column:
    has_messages = F.coalesce(F.size(messages) > 0, F.lit(False))
    return F.when(has_messages, last_of_role(messages, "user")).otherwise(F.coalesce(filled(prompt), input_text))


def output_text(content: Column, messages: Column) -> Column:
    return F.coalesce(filled(content), last_of_role(messages, "assistant"), F.lit(""))


def millis_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1000.0)


def tokens_per_second(completion_tokens: Column, latency_ms: Column) -> Column:
    return F.when((completion_tokens > 0) & (latency_ms > 0), completion_tokens / (latency_ms / F.lit(1000.0)))


def total_tokens(prompt: Column, completion: Column) -> Column:
    return F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0))


def or_default(value: Column, default: Column | int) -> Column:
    """A value of 0 counts as not set."""
    return F.coalesce(F.when(value != 0, value), default if isinstance(default, Column) else F.lit(default))


def token_limit_check(
    requested: Column,
    context_tokens: Column,
    max_tokens_per_request: int = 32768,
    max_context_tokens: int = 32000,
    default_max_tokens: int = 1024,
) -> Column:
    """Struct of the limit decision: strict verdict with code, and the lenient capped values."""
    too_many = F.coalesce(requested > max_tokens_per_request, F.lit(False))
    too_long = F.coalesce(context_tokens > max_context_tokens, F.lit(False))
    validated = F.when(requested.isNull() | (requested < 1), F.lit(default_max_tokens)).when(~too_many, requested)
    effective = or_default(requested, default_max_tokens)
    capped = effective > max_tokens_per_request
    code = F.when(too_many, F.lit("max_tokens_per_request")).when(too_long, F.lit("max_context_tokens"))
    return F.struct(
        (~too_many).alias("max_tokens_ok"),
        (~too_long).alias("context_ok"),
        validated.alias("validated_max_tokens"),
        code.alias("limit_type"),
        (~too_long & (~capped | requested.isNull())).alias("allowed"),
        F.when(capped, F.lit(max_tokens_per_request)).otherwise(effective).alias("max_tokens"),
        F.when(capped, F.lit(max_tokens_per_request)).alias("adjusted_max_tokens"),
    )


def local_capabilities(model: Column) -> Column:
    """Capabilities of a self-hosted model, from its name."""
    name = F.lower(model)
    embedding = name.contains("embed") | name.contains("nomic")
    vision = name.contains("vision") | name.contains("llava")
    base = F.when(embedding, F.array(F.lit("embeddings"))).otherwise(
        F.array(F.lit("chat"), F.lit("completion"), F.lit("streaming"))
    )
    return F.when(vision, F.array_append(base, "vision")).otherwise(base)


def hosted_capabilities(model: Column) -> Column:
    """Capabilities of a hosted model, from its name."""
    name = F.lower(model)

    def has(*parts: str) -> Column:
        test = name.contains(parts[0])
        for part in parts[1:]:
            test = test | name.contains(part)
        return test

    extras = F.array_compact(
        F.array(
            F.lit("chat"),
            F.lit("streaming"),
            F.when(has("instruct", "davinci"), F.lit("completion")),
            F.when(has("vision", "gpt-4o", "gpt-4-turbo"), F.lit("vision")),
            F.when(has("gpt-4", "gpt-3.5-turbo"), F.lit("function_calling")),
            F.when(has("gpt-4", "gpt-3.5-turbo"), F.lit("json_mode")),
        )
    )
    return F.when(has("embed", "ada-002"), F.array(F.lit("embeddings"))).otherwise(extras)


def hosted_context_length(model: Column) -> Column:
    name = F.lower(model)
    out = None
    for parts, length in CONTEXT_LENGTHS:
        test = name.contains(parts[0])
        for part in parts[1:]:
            test = test & name.contains(part)
        out = F.when(test, length) if out is None else out.when(test, length)
    return out.otherwise(DEFAULT_CONTEXT_LENGTH)


def supports_task(capabilities: Column, task: Column) -> Column:
    needed = F.element_at(literal_map(TASK_CAPABILITY), task)
    return F.coalesce(F.array_contains(capabilities, needed), F.lit(False))


def preview(messages: Column) -> Column:
    """One line per scan for listings: user messages, else all messages with their role."""
    users = F.filter(messages, lambda m: m["role"] == "user")
    own = F.array_join(F.transform(users, lambda m: m["content"]), " | ")
    rest = F.array_join(
        F.transform(messages, lambda m: F.concat(F.lit("["), m["role"], F.lit("] "), m["content"])), " | "
    )
    return F.when(F.size(users) > 0, own).otherwise(rest)
