"""The policy chain over request logs: the first violated rule of each request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptledger.functions.errors import violation_code
from promptledger.functions.requests import token_limit_check
from promptledger.operators.budget import DEFAULT_DAILY_LIMIT, replay_admissions
from promptledger.operators.keys import endpoint_allowed, model_allowed
from promptledger.operators.ratelimit import RateLimits, replay_limits


def provider_violation(provider: Column, allowed: Column, denied: Column) -> Column:
    """Deny list first, then allow list; empty lists do not restrict."""
    is_denied = (F.size(denied) > 0) & F.array_contains(denied, provider)
    not_listed = (F.size(allowed) > 0) & ~F.array_contains(allowed, provider)
    return F.when(provider.isNull(), F.lit(None).cast("string")).when(
        F.coalesce(is_denied, F.lit(False)), F.lit("provider_denied_for_task")
    ).when(F.coalesce(not_listed, F.lit(False)), F.lit("provider_not_allowed_for_task"))


def check_providers(requests: DataFrame, policies: DataFrame, provider: str = "endpoint") -> DataFrame:
    """Add ``provider_violation`` from per-task policies (task, allowed_providers, denied_providers)."""
    rules = policies.select("task", "allowed_providers", "denied_providers")
    out = requests.join(rules, "task", "left")
    return out.withColumn(
        "provider_violation",
        provider_violation(F.col(provider), F.col("allowed_providers"), F.col("denied_providers")),
    ).drop("allowed_providers", "denied_providers")


def enforce(
    requests: DataFrame,
    policies: DataFrame,
    limits: RateLimits = RateLimits(),
    daily_limit: int = DEFAULT_DAILY_LIMIT,
    max_tokens_per_request: int = 32768,
    budget_enabled: bool = True,
) -> DataFrame:
    """First violation per request, in order: rate, token limit, model, endpoint, budget, provider.

    Input: request_id, key, start_ts, end_ts, task, model, endpoint, max_tokens, tokens, tier,
    tier_daily_limit, cost_multiplier, allowed_models, allowed_endpoints, optional rpm_override.
    The rate slot is taken before the later checks and is not given back when they deny.
    """
    columns = ["request_id", "key", "start_ts"] + (["rpm_override"] if "rpm_override" in requests.columns else [])
    rate = replay_limits(requests.select(*columns), limits).select(
        "request_id", F.col("allowed").alias("_rate_ok"), "retry_after"
    )
    tokens = token_limit_check(F.col("max_tokens"), F.lit(None).cast("int"), max_tokens_per_request)
    early = (
        F.when(~F.col("_rate_ok"), "rate_limit")
        .when(~tokens["max_tokens_ok"], "token_limit")
        .when(~model_allowed(F.col("model"), F.col("allowed_models")), "model_not_allowed")
        .when(~endpoint_allowed(F.col("endpoint"), F.col("allowed_endpoints")), "endpoint_not_allowed")
    )
    rows = check_providers(requests, policies).join(rate, "request_id", "left").withColumn("_early", early)
    kind = F.col("_early")
    if budget_enabled:
        # Requests stopped earlier never reach the budget; those stopped later are checked but not charged.
        reach = rows.filter(F.col("_early").isNull()).select(
            "request_id", "key", "tier", "tier_daily_limit", "cost_multiplier", "start_ts", "end_ts",
            F.when(F.col("provider_violation").isNull(), F.col("tokens")).otherwise(F.lit(0)).alias("tokens"),
            F.col("max_tokens").alias("estimated_tokens"),
        )
        budget = replay_admissions(reach, daily_limit).select("request_id", F.col("admitted").alias("_in_budget"))
        rows = rows.join(budget, "request_id", "left")
        kind = F.coalesce(kind, F.when(~F.col("_in_budget"), F.lit("token_budget_exceeded")))
    kind = F.coalesce(kind, F.when(F.col("provider_violation").isNotNull(), F.lit("provider_task")))
    out = rows.withColumn("violation", kind)
    detail = F.when(F.col("violation") == "provider_task", F.col("provider_violation")).otherwise(
        violation_code(F.col("violation"))
    )
    return out.select(
        "request_id", "key", "start_ts",
        F.col("violation").isNull().alias("allowed"),
        "violation",
        detail.alias("violation_code"),
        F.when(F.col("violation") == "rate_limit", F.col("retry_after")).alias("retry_after"),
    )
