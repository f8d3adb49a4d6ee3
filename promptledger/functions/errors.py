"""Error codes, their categories and report classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptledger.functions.requests import literal_map

# Code to category.
CODE_CATEGORY = {
    "authentication_required": "authentication",
    "invalid_api_key": "authentication",
    "invalid_api_key_format": "authentication",
    "rate_limit_exceeded": "rate_limit",
    "burst_limit_exceeded": "rate_limit",
    "token_limit_exceeded": "policy",
    "context_length_exceeded": "policy",
    "policy_violation": "policy",
    "provider_not_allowed": "policy",
    "model_not_allowed": "policy",
    "endpoint_not_allowed": "policy",
    "token_budget_exceeded": "policy",
    "no_provider": "dispatch",
    "provider_not_found": "dispatch",
    "provider_unavailable": "dispatch",
    "all_providers_unavailable": "dispatch",
    "dispatch_error": "dispatch",
    "ambiguous_model": "dispatch",
    "model_not_found": "dispatch",
    "endpoint_not_found": "dispatch",
    "validation_error": "validation",
    "invalid_request": "validation",
    "provider_error": "provider",
    "provider_timeout": "provider",
    "internal_error": "internal",
    "stream_error": "internal",
    "configuration_error": "internal",
    "not_found": "validation",
}
# Category to status class, and the codes that differ from their category.
CATEGORY_STATUS = {
    "authentication": "401",
    "rate_limit": "429",
    "policy": "403",
    "dispatch": "503",
    "validation": "422",
    "provider": "502",
    "internal": "500",
}
CODE_STATUS = {
    "no_provider": "400",
    "provider_not_found": "404",
    "not_found": "404",
    "invalid_request": "400",
}
# Kind of policy violation to the error code it is reported under.
VIOLATION_CODE = {
    "rate_limit": "rate_limit_exceeded",
    "token_limit": "token_limit_exceeded",
    "provider_task": "provider_not_allowed",
    "model_not_allowed": "model_not_allowed",
    "endpoint_not_allowed": "endpoint_not_allowed",
    "token_budget_exceeded": "token_budget_exceeded",
}


def error_category(code: Column) -> Column:
    return F.when(
        code.isNotNull(), F.coalesce(F.element_at(literal_map(CODE_CATEGORY), code), F.lit("internal"))
    )


def error_status(code: Column) -> Column:
    status = F.coalesce(
        F.element_at(literal_map(CODE_STATUS), code),
        F.element_at(literal_map(CATEGORY_STATUS), error_category(code)),
    )
    return status.cast("int")


def violation_code(kind: Column) -> Column:
    known = F.coalesce(F.element_at(literal_map(VIOLATION_CODE), kind), F.lit("policy_violation"))
    return F.when(kind.isNotNull(), known)
