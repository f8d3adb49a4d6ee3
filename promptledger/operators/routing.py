"""Routing decisions as tables: prefixes, environments, endpoint resolution, fallback order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptledger.functions.globs import glob_match
from promptledger.functions.identifiers import SAFE_IDENTIFIER

# Fixed value.
PREFIXED_MODEL = r"\A([a-zA-Z][a-zA-Z0-9_-]*)/(.+)\n?\z"



def split_prefix(model: Column) -> tuple[Column, Column]:
    """(endpoint hint, model name) of ``endpoint/model``; an unsafe hint leaves the name whole."""
    hint = F.regexp_extract(model, PREFIXED_MODEL, 1)
    prefixed = (hint != "") & F.rlike(hint, F.lit(SAFE_IDENTIFIER))
    filled = F.when(model != "", model)
    return F.when(prefixed, hint), F.when(prefixed, F.regexp_extract(model, PREFIXED_MODEL, 2)).otherwise(filled)


def resolve_provider(requests: DataFrame, default_provider: Column) -> DataFrame:
    """Prefix, else the preferred provider, else the default; ``no_provider`` when none."""
    hint, name = split_prefix(F.col("requested_model"))
    preferred = F.when(F.col("preferred_provider") != "", F.col("preferred_provider"))
    out = requests.withColumn("provider", F.coalesce(hint, preferred, default_provider))
    return out.withColumn(
        "model_name", F.when(hint.isNotNull(), name).otherwise(F.col("requested_model"))
    ).withColumn("error_code", F.when(F.col("provider").isNull(), F.lit("no_provider")))


def default_provider(providers: DataFrame, configured: str | None = None) -> Column:
    """The configured default, else the first enabled provider."""
    if configured:
        return F.lit(configured)
    return providers.filter("enabled").agg(F.min_by("name", "ord")).scalar()


def default_environment(environments: DataFrame) -> Column:
    """``dev`` when declared, else the first."""
    return environments.agg(F.min_by("name", F.struct(F.col("name") != "dev", F.col("ord")))).scalar()


def resolve_environment(requests: DataFrame, environments: DataFrame) -> DataFrame:
    """Header, else key environment, else default. An unknown explicit name resolves to null."""
    def filled(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name))

    wanted = F.coalesce(filled("header_environment"), filled("key_environment"), F.lit(None).cast("string"))
    known = environments.select(F.col("name").alias("resolved_environment")).withColumn("_wanted", F.col("resolved_environment"))
    out = requests.withColumn("_wanted", F.coalesce(wanted, default_environment(environments)))
    return out.join(known, "_wanted", "left").drop("_wanted")


def _config_array(df: DataFrame, *columns: Column | str) -> Column:
    """A bounded configuration table as one array in declared order."""
    return df.agg(F.array_sort(F.collect_list(F.struct("ord", *columns)))).scalar()


def resolve_endpoints(
    requests: DataFrame,
    catalog: DataFrame,
    endpoints: DataFrame,
    environments: DataFrame,
    model_defaults: DataFrame,
    priorities: DataFrame,
    ambiguous: str = "error",
) -> DataFrame:
    """Endpoint of every distinct (requested_model, environment): five steps with error codes.

    Explicit prefix; environment filter; default of the model (exact or glob, declared order);
    priority list; otherwise ambiguous. Candidates are the endpoints that have the model, or all
    registered ones when none has. Configuration travels as arrays; only distinct pairs are resolved.
    """
    pairs = requests.select("requested_model", "environment").distinct()
    hint, name = split_prefix(F.col("requested_model"))
    pairs = pairs.withColumn("hint", hint).withColumn("model_name", F.coalesce(name, F.lit("")))
    registered = endpoints.filter("enabled")
    order = registered.select(F.col("name").alias("endpoint"), "ord")
    having = (
        catalog.select(F.col("name").alias("model_name"), "endpoint")
        .distinct()
        .join(order, "endpoint")
        .groupBy("model_name")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "endpoint"))).alias("_having"))
    )
    env = environments.select(F.col("name").alias("environment"), "allowed_endpoints", "endpoint_filter")
    rows = (
        pairs.join(having, "model_name", "left")
        .join(env, "environment", "left")
        .withColumn("_all", _config_array(registered, F.col("name").alias("endpoint"), F.map_entries("labels").alias("labels")))
        .withColumn("_defaults", _config_array(model_defaults, "model", "endpoint"))
        .withColumn("_priorities", _config_array(priorities, "endpoint"))
    )
    wanted = F.map_entries(F.coalesce("endpoint_filter", F.create_map().cast("map<string,string>")))
    available = F.when(
        F.size("_having") > 0,
        F.filter("_all", lambda e: F.array_contains(F.transform("_having", lambda h: h["endpoint"]), e["endpoint"])),
    ).otherwise(F.col("_all"))

    def in_environment(e: Column) -> Column:
        listed = (F.coalesce(F.size("allowed_endpoints"), F.lit(0)) <= 0) | F.array_contains(
            "allowed_endpoints", e["endpoint"]
        )
        labelled = F.forall(
            wanted, lambda w: F.exists(e["labels"], lambda own: (own["key"] == w["key"]) & (own["value"] == w["value"]))
        )
        return F.coalesce(listed, F.lit(True)) & labelled

    rows = rows.withColumn("_candidates", F.transform(F.filter(available, in_environment), lambda e: e["endpoint"]))
    fitting = F.filter(
        "_defaults",
        lambda d: (d["model"] == F.col("model_name")) | glob_match(F.col("model_name"), d["model"]),
    )
    by_default = F.get(fitting, F.lit(0))["endpoint"]
    by_default = F.when(F.array_contains("_candidates", by_default), by_default)
    by_priority = F.get(
        F.filter("_priorities", lambda p: F.array_contains("_candidates", p["endpoint"])), F.lit(0)
    )["endpoint"]
    count = F.size("_candidates")
    known_hint = F.array_contains(F.transform("_all", lambda e: e["endpoint"]), F.col("hint"))
    rows = rows.withColumn("_default", by_default).withColumn("_priority", by_priority)
    step = (
        F.when(F.col("hint").isNotNull(), F.when(known_hint, "explicit").otherwise("error"))
        .when(count == 0, "error")
        .when(count == 1, "single")
        .when(F.col("_default").isNotNull(), "model_default")
        .when(F.col("_priority").isNotNull(), "priority")
        .otherwise(F.lit("first" if ambiguous == "first_priority" else "error"))
    )
    rows = rows.withColumn("step", step)
    endpoint = (
        F.when(F.col("step") == "explicit", F.col("hint"))
        .when(F.col("step").isin("single", "first"), F.get("_candidates", F.lit(0)))
        .when(F.col("step") == "model_default", F.col("_default"))
        .when(F.col("step") == "priority", F.col("_priority"))
    )
    error = F.when(
        F.col("step") == "error",
        F.when(F.col("hint").isNotNull(), "endpoint_not_found").when(count == 0, "no_provider").otherwise("ambiguous_model"),
    )
    return rows.select(
        "requested_model", "environment", "model_name", "step",
        endpoint.alias("resolved_endpoint"), error.alias("resolution_error"), count.alias("candidate_count"),
    )


def with_resolution(requests: DataFrame, resolved: DataFrame) -> DataFrame:
    """Requests with the resolution of their (requested_model, environment)."""
    right = resolved.withColumnsRenamed({"requested_model": "_rm", "environment": "_env"})
    on = requests["requested_model"].eqNullSafe(right["_rm"]) & requests["environment"].eqNullSafe(right["_env"])
    return requests.join(right, on, "left").drop("_rm", "_env")


def fallback_order(
    requests: DataFrame, catalog: DataFrame, health: DataFrame, providers: DataFrame, max_attempts: int | None = None
) -> DataFrame:
    """All attempts per distinct (provider, model_name, fallback_allowed), or the first ``max_attempts``.

    Healthy endpoints that have the model, other endpoints that have it, the provider itself,
    then the remaining enabled providers in declared order.
    """
    distinct = requests.select("provider", "model_name", "fallback_allowed").distinct()
    order = providers.select(F.col("name").alias("endpoint"), "ord")
    state = health.select(F.col("provider").alias("endpoint"), F.col("healthy").alias("_healthy"))
    having = (
        catalog.select(F.col("name").alias("model_name"), "endpoint")
        .distinct()
        .join(order, "endpoint", "left")
        .join(state, "endpoint", "left")
        .groupBy("model_name")
        .agg(
            F.array_sort(
                F.collect_list(F.struct((~F.coalesce("_healthy", F.lit(False))).alias("sick"), "ord", "endpoint"))
            ).alias("_having")
        )
    )
    chain = _config_array(providers.filter("enabled"), F.col("name").alias("endpoint"))
    rows = distinct.join(having, "model_name", "left").withColumn("_chain", chain)
    first = F.coalesce(F.transform("_having", lambda h: h["endpoint"]), F.array().cast("array<string>"))
    rest = F.when(F.col("fallback_allowed"), F.transform("_chain", lambda c: c["endpoint"])).otherwise(
        F.array().cast("array<string>")
    )
    attempts = F.array_distinct(F.concat(first, F.array("provider"), rest))
    if max_attempts is not None:
        attempts = F.slice(attempts, 1, max_attempts)
    return rows.select("provider", "model_name", "fallback_allowed", attempts.alias("attempts"))


def route_report(resolved: DataFrame, health: DataFrame, providers: DataFrame) -> DataFrame:
    """What would happen to each resolved request: healthy, fallback, reason."""
    state = health.select("provider", "healthy")
    chain = _config_array(providers.filter("enabled"), F.col("name").alias("endpoint"))
    rows = resolved.join(F.broadcast(state), "provider", "left").withColumn("_chain", chain)
    healthy = F.coalesce("healthy", F.lit(False))
    others = F.filter("_chain", lambda c: c["endpoint"] != F.col("provider"))
    would = ~healthy & F.col("fallback_allowed") & (F.size(others) > 0)
    tail = F.when(would, F.lit("' unhealthy, would fallback")).otherwise(F.lit("' unhealthy, no fallback available"))
    return (
        rows.withColumn("would_fallback", would)
        .withColumn("reason", F.when(~healthy, F.concat(F.lit("Primary provider '"), F.col("provider"), tail)))
        .withColumn("provider_healthy", healthy)
        .drop("_chain", "healthy")
    )


def config_violations(
    endpoints: DataFrame,
    model_defaults: DataFrame,
    priorities: DataFrame,
    environments: DataFrame,
    routing_rules: DataFrame | None = None,
) -> DataFrame:
    """References to endpoints that are not declared: (relation, owner, endpoint)."""
    relations = [
        model_defaults.select(F.lit("model_default").alias("relation"), F.col("model").alias("owner"), "endpoint"),
        priorities.select(F.lit("priority").alias("relation"), F.col("ord").cast("string").alias("owner"), "endpoint"),
        environments.select(
            F.lit("environment").alias("relation"), F.col("name").alias("owner"),
            F.explode("allowed_endpoints").alias("endpoint"),
        ),
    ]
    if routing_rules is not None:
        relations += [
            routing_rules.select(F.lit("rule").alias("relation"), F.col("task").alias("owner"), F.col("provider").alias("endpoint")),
            routing_rules.select(
                F.lit("rule_fallback").alias("relation"), F.col("task").alias("owner"),
                F.explode("fallback_providers").alias("endpoint"),
            ),
        ]
    known = endpoints.select(F.col("name").alias("endpoint"))
    return reduce(DataFrame.unionByName, relations).join(known, "endpoint", "left_anti")
