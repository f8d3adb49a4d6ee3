"""Explicit schemas of the canonical tables and of the wire formats."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])

REGEX_MATCH = T.StructType([
    T.StructField("pattern", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("level", T.StringType()),
])

AUDIT_LOG = T.StructType([
    T.StructField("request_id", T.StringType(), False),
    T.StructField("event_ts", T.TimestampType(), False),
    T.StructField("client_id", T.StringType(), False),
    T.StructField("user_id", T.StringType()),
    T.StructField("environment", T.StringType()),
    T.StructField("task", T.StringType(), False),
    T.StructField("model", T.StringType(), False),
    T.StructField("endpoint", T.StringType(), False),
    T.StructField("provider_type", T.StringType()),
    T.StructField("stream", T.BooleanType()),
    T.StructField("max_tokens", T.IntegerType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("status", T.StringType(), False),
    T.StructField("error_code", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("time_to_first_token_ms", T.DoubleType()),
    T.StructField("tokens_per_second", T.DoubleType()),
    T.StructField("prompt_tokens", T.IntegerType()),
    T.StructField("completion_tokens", T.IntegerType()),
    T.StructField("total_tokens", T.IntegerType()),
    T.StructField("estimated_cost_usd", T.DoubleType()),
    T.StructField("request_body", T.VariantType()),
    T.StructField("response_body", T.VariantType()),
    T.StructField("event_date", T.DateType()),
])

USAGE_DAILY = T.StructType([
    T.StructField("usage_date", T.DateType(), False),
    T.StructField("client_id", T.StringType(), False),
    T.StructField("user_id", T.StringType()),
    T.StructField("environment", T.StringType()),
    T.StructField("endpoint", T.StringType(), False),
    T.StructField("model", T.StringType(), False),
    T.StructField("request_count", T.LongType()),
    T.StructField("success_count", T.LongType()),
    T.StructField("error_count", T.LongType()),
    T.StructField("stream_count", T.LongType()),
    T.StructField("total_prompt_tokens", T.LongType()),
    T.StructField("total_completion_tokens", T.LongType()),
    T.StructField("total_tokens", T.LongType()),
    T.StructField("total_cost_usd", T.DoubleType()),
    T.StructField("avg_latency_ms", T.DoubleType()),
    T.StructField("min_latency_ms", T.DoubleType()),
    T.StructField("max_latency_ms", T.DoubleType()),
    T.StructField("p50_latency_ms", T.DoubleType()),
    T.StructField("p95_latency_ms", T.DoubleType()),
    T.StructField("p99_latency_ms", T.DoubleType()),
    T.StructField("avg_ttft_ms", T.DoubleType()),
    T.StructField("avg_tokens_per_second", T.DoubleType()),
])

API_KEYS = T.StructType([
    T.StructField("key_id", T.LongType(), False),
    T.StructField("key_hash", T.StringType(), False),
    T.StructField("key_prefix", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("client_id", T.StringType(), False),
    T.StructField("environment", T.StringType()),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("expires_at", T.TimestampType()),
    T.StructField("last_used_at", T.TimestampType()),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("rate_limit_rpm", T.IntegerType()),
    T.StructField("allowed_models", T.ArrayType(T.StringType())),
    T.StructField("allowed_endpoints", T.ArrayType(T.StringType())),
    T.StructField("description", T.StringType()),
    T.StructField("created_by", T.StringType()),
])

SECURITY_SCANS = T.StructType([
    T.StructField("request_id", T.StringType(), False),
    T.StructField("event_ts", T.TimestampType(), False),
    T.StructField("client_id", T.StringType(), False),
    T.StructField("model", T.StringType()),
    T.StructField("task", T.StringType()),
    T.StructField("messages", T.ArrayType(MESSAGE), False),
    T.StructField("regex_threat_level", T.StringType(), False),
    T.StructField("regex_match_count", T.IntegerType()),
    T.StructField("regex_matches", T.ArrayType(REGEX_MATCH)),
    T.StructField("guard_safe", T.BooleanType()),
    T.StructField("guard_skipped", T.BooleanType()),
    T.StructField("guard_category_code", T.StringType()),
    T.StructField("guard_category_name", T.StringType()),
    T.StructField("guard_confidence", T.StringType()),
    T.StructField("guard_inference_ms", T.DoubleType()),
    T.StructField("guard_raw_response", T.StringType()),
    T.StructField("guard_error", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("label_category", T.StringType()),
    T.StructField("labeled_by", T.StringType()),
    T.StructField("labeled_at", T.TimestampType()),
    T.StructField("label_notes", T.StringType()),
    T.StructField("is_disagreement", T.BooleanType()),
])

PII_EVENTS = T.StructType([
    T.StructField("request_id", T.StringType(), False),
    T.StructField("event_ts", T.TimestampType(), False),
    T.StructField("client_id", T.StringType(), False),
    T.StructField("model", T.StringType()),
    T.StructField("task", T.StringType()),
    T.StructField("pii_type", T.StringType(), False),
    T.StructField("message_index", T.IntegerType()),
    T.StructField("message_role", T.StringType()),
    T.StructField("position_start", T.IntegerType()),
    T.StructField("position_end", T.IntegerType()),
    T.StructField("value_hash", T.StringType(), False),
    T.StructField("was_scrubbed", T.BooleanType()),
])

LOG_LINE = T.StructType([
    T.StructField("level", T.StringType()),
    T.StructField("logger", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("client_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("task", T.StringType()),
    T.StructField("exception", T.StringType()),
])
