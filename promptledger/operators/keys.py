"""API keys: authentication of request logs, inventory, maintenance, allowlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptledger.functions.globs import matches_any
from promptledger.functions.identifiers import api_key_problem, key_hash
from promptledger.operators.ordered import _join_on


def authenticate(requests: DataFrame, stored: DataFrame, configured: DataFrame) -> DataFrame:
    """Add client, environment, permissions and ``auth_status`` to requests that carry ``api_key``.

    Configured keys (api_key, client_id, environment, target_endpoint) win over stored ones; stored
    keys must be active and not expired at ``request_ts``. No key means client ``default``.
    Both key tables have one row per key; Spark broadcasts them when they are small enough.
    """
    no_key = F.coalesce(F.col("api_key"), F.lit("")) == ""
    # Requests without a key, perhaps most of all, match nothing; their own hashes spread them over the join's tasks.
    spread = F.concat(F.lit("none:"), F.xxhash64("request_ts"))
    rows = requests.withColumn("_hash", F.when(no_key, spread).otherwise(key_hash(F.col("api_key"))))
    own = configured.select(
        key_hash(F.col("api_key")).alias("_hash"),
        F.col("client_id").alias("_c_client"),
        F.col("environment").alias("_c_env"),
        "target_endpoint",
    )
    kept = stored.filter("is_active").select(
        F.col("key_hash").alias("_hash"),
        F.col("client_id").alias("_s_client"),
        F.col("environment").alias("_s_env"),
        F.col("expires_at").alias("_s_expires"),
        "allowed_models", "allowed_endpoints", "rate_limit_rpm",
    )
    alive = F.col("_s_client").isNotNull() & (
        F.col("_s_expires").isNull() | (F.col("_s_expires") > F.col("request_ts"))
    )
    bad_format = api_key_problem(F.col("api_key")).isNotNull()
    status = (
        F.when(no_key, F.lit("anonymous"))
        .when(bad_format, F.lit("invalid_api_key_format"))
        .when(F.col("_c_client").isNotNull(), F.lit("configured"))
        .when(alive, F.lit("stored"))
        .otherwise(F.lit("invalid_api_key"))
    )
    out = rows.join(own, "_hash", "left").join(kept, "_hash", "left").withColumn("auth_status", status)
    out = out.withColumn("key_hash", key_hash(F.col("api_key")))
    is_stored = F.col("auth_status") == "stored"
    is_configured = F.col("auth_status") == "configured"
    out = out.withColumn(
        "client_id",
        F.when(no_key, F.lit("default")).when(is_configured, F.col("_c_client")).when(is_stored, F.col("_s_client")),
    ).withColumn("environment", F.when(is_configured, F.col("_c_env")).when(is_stored, F.col("_s_env")))
    for name in ("allowed_models", "allowed_endpoints", "rate_limit_rpm"):
        out = out.withColumn(name, F.when(is_stored, F.col(name)))
    out = out.withColumn("target_endpoint", F.when(is_configured, F.col("target_endpoint")))
    return out.drop("_hash", "_c_client", "_c_env", "_s_client", "_s_env", "_s_expires", "api_key")


def rejected(authenticated: DataFrame) -> DataFrame:
    return authenticated.filter(F.col("auth_status").startswith("invalid"))


def inventory(stored: DataFrame) -> DataFrame:
    """Key listing without hashes, newest first."""
    return stored.select(
        "key_id", "key_prefix", "name", "client_id", "environment", "created_at", "last_used_at", "is_active",
        "allowed_endpoints", "allowed_models", "rate_limit_rpm", "description",
    ).orderBy(F.desc("created_at"), "key_id")


def touch_last_used(stored: DataFrame, uses: DataFrame) -> DataFrame:
    """New key table whose ``last_used_at`` covers the given uses (key_hash, request_ts)."""
    latest = uses.groupBy("key_hash").agg(F.max("request_ts").alias("_used"))
    out = stored.join(latest, "key_hash", "left")
    return out.withColumn("last_used_at", F.greatest("last_used_at", "_used")).drop("_used")


def revoke(stored: DataFrame, revocations: DataFrame) -> DataFrame:
    """New key table with the listed ``key_id`` switched off; ``revoked`` tells which rows changed."""
    marks = revocations.select("key_id").distinct().withColumn("_hit", F.lit(True))
    out = stored.join(marks, "key_id", "left").withColumn("revoked", F.col("_hit").isNotNull())
    return out.withColumn("is_active", F.col("is_active") & ~F.col("revoked")).drop("_hit")


def model_allowed(model: Column, allowed_models: Column) -> Column:
    """Missing or empty list, or no model, means allowed."""
    open_list = allowed_models.isNull() | (F.size(allowed_models) == 0)
    return open_list | (F.coalesce(model, F.lit("")) == "") | F.coalesce(matches_any(model, allowed_models), F.lit(False))


def endpoint_allowed(endpoint: Column, allowed_endpoints: Column) -> Column:
    open_list = allowed_endpoints.isNull() | (F.size(allowed_endpoints) == 0)
    return open_list | (F.coalesce(endpoint, F.lit("")) == "") | F.coalesce(
        F.array_contains(allowed_endpoints, endpoint), F.lit(False)
    )


def check_allowlists(requests: DataFrame) -> DataFrame:
    """Add ``model_allowed`` / ``endpoint_allowed`` from the permissions of the key.

    Globs are tried once per distinct pair of model and allow list, not per request.
    """
    pairs = requests.select("model", "allowed_models").distinct().withColumn("model_allowed", model_allowed(F.col("model"), F.col("allowed_models")))
    return _join_on(requests, pairs, ["model", "allowed_models"], "left").withColumn(
        "endpoint_allowed", endpoint_allowed(F.col("endpoint"), F.col("allowed_endpoints"))
    )
