"""The model catalog: which model is on which endpoint, and who may use it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptledger.functions.globs import glob_match, matches_any


def find_model(catalog: DataFrame, pattern: str) -> DataFrame:
    return catalog.filter(glob_match(F.col("name"), F.lit(pattern)))


def enabled(config: DataFrame) -> DataFrame:
    """Enabled endpoints or providers in declared order."""
    return config.filter("enabled").orderBy("ord")


def labels_match(labels: Column, wanted: Column) -> Column:
    """Every wanted label is present with its value."""
    return F.forall(F.map_entries(wanted), lambda e: F.coalesce(F.try_element_at(labels, e["key"]) == e["value"], F.lit(False)))


def endpoints_for_model(catalog: DataFrame, model: str, endpoints: DataFrame | None = None, labels: dict[str, str] | None = None) -> DataFrame:
    """Endpoints that have a model, optionally only those with given labels."""
    names = catalog.filter(F.col("name") == model).select("endpoint").distinct()
    if labels and endpoints is not None:
        wanted = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
        fit = endpoints.filter(labels_match(F.col("labels"), wanted)).select(F.col("name").alias("endpoint"))
        names = names.join(fit, "endpoint", "left_semi")
    return names


def models_for_endpoint(catalog: DataFrame, endpoint: str) -> DataFrame:
    return catalog.filter(F.col("endpoint") == endpoint).select("name")


def distinct_models(catalog: DataFrame) -> DataFrame:
    return catalog.select("name").distinct()


def distinct_endpoints(catalog: DataFrame) -> DataFrame:
    return catalog.select("endpoint").distinct()


def with_existence(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add ``model_known`` and ``model_on_endpoint`` to requests (model, endpoint)."""
    names = catalog.select(F.col("name").alias("model")).distinct().withColumn("_m", F.lit(True))
    pairs = catalog.select(F.col("name").alias("model"), "endpoint").distinct().withColumn("_p", F.lit(True))
    out = requests.join(names, "model", "left").join(pairs, ["model", "endpoint"], "left")
    return (
        out.withColumn("model_known", F.col("_m").isNotNull())
        .withColumn("model_on_endpoint", F.col("_p").isNotNull())
        .drop("_m", "_p")
    )


def effective_models(catalog: DataFrame, endpoints: DataFrame, environments: DataFrame) -> DataFrame:
    """Catalog rows usable in each environment: allowed endpoints, endpoint labels, approved names.

    Environments are configuration (at most 20) and travel as one array; no join by condition.
    """
    envs = environments.agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "ord", "name", "allowed_endpoints", "approved_models", "allow_all_discovered",
                    F.map_entries("endpoint_filter").alias("wanted"),
                )
            )
        )
    ).scalar()
    labels = endpoints.select(F.col("name").alias("endpoint"), "labels")
    rows = catalog.join(labels, "endpoint", "left").withColumn("_envs", envs)

    def usable(env: Column) -> Column:
        listed = (F.size(env["allowed_endpoints"]) == 0) | F.array_contains(env["allowed_endpoints"], F.col("endpoint"))
        labelled = F.forall(
            env["wanted"],
            lambda e: F.coalesce(F.try_element_at(F.col("labels"), e["key"]) == e["value"], F.lit(False)),
        )
        approved = (
            env["allow_all_discovered"]
            | (F.size(env["approved_models"]) == 0)
            | matches_any(F.col("name"), env["approved_models"])
        )
        return listed & labelled & approved

    return rows.select("name", "endpoint", F.explode(F.filter("_envs", usable)).alias("_env")).select(
        F.col("_env.name").alias("environment"), "name", "endpoint"
    )


def refresh(snapshots: DataFrame) -> DataFrame:
    """Current catalog from snapshot rows (endpoint, snapshot_ts, ord, name, ...).

    The latest snapshot of an endpoint replaces its older ones; inside it the last row of a name wins.
    """
    newest = snapshots.groupBy("endpoint").agg(F.max("snapshot_ts").alias("snapshot_ts"))
    current = snapshots.join(newest, ["endpoint", "snapshot_ts"], "left_semi")
    everything = F.struct(*[F.col(c) for c in snapshots.columns])
    last = current.groupBy("name", "endpoint").agg(F.max_by(everything, F.col("ord")).alias("_row"))
    return last.select("_row.*")


def summary(endpoints: DataFrame, catalog: DataFrame, health: DataFrame) -> DataFrame:
    """Enabled endpoints with health, model list and count, and the totals of the catalog."""
    models = catalog.groupBy("endpoint").agg(
        F.array_sort(F.collect_set("name")).alias("models"), F.count(F.lit(1)).alias("model_count")
    )
    state = health.select(F.col("provider").alias("endpoint"), "healthy")
    rows = endpoints.filter("enabled").select(F.col("name").alias("endpoint"), "type", "url", "labels", "ord")
    out = rows.join(models, "endpoint", "left").join(state, "endpoint", "left")
    return out.select(
        "endpoint", "type", "url", "labels", "ord",
        F.coalesce("healthy", F.lit(False)).alias("healthy"),
        F.coalesce("models", F.array().cast("array<string>")).alias("models"),
        F.coalesce("model_count", F.lit(0)).alias("model_count"),
        catalog.agg(F.count(F.lit(1))).scalar().alias("total_models"),
        endpoints.filter("enabled").agg(F.count(F.lit(1))).scalar().alias("total_endpoints"),
    ).orderBy("ord")


def fleet_health(providers: DataFrame, health: DataFrame) -> DataFrame:
    state = health.select(F.col("provider").alias("name"), "healthy")
    rows = providers.select("name").join(state, "name", "left")
    good = F.count_if(F.coalesce("healthy", F.lit(False)))
    return rows.agg(
        F.count(F.lit(1)).alias("providers_configured"),
        good.alias("providers_healthy"),
        F.when((good > 0) | (F.count(F.lit(1)) == 0), "healthy").otherwise("degraded").alias("status"),
    )


def capability_union(models: DataFrame) -> DataFrame:
    """All capabilities of a provider (endpoint, capabilities array)."""
    each = models.select("endpoint", F.explode("capabilities").alias("capability")).distinct()
    return each.groupBy("endpoint").agg(F.array_sort(F.collect_set("capability")).alias("capabilities"))


def available_models(catalog: DataFrame, health: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Models of healthy providers under their public id."""
    good = health.filter("healthy").select(F.col("provider").alias("endpoint"))
    rows = catalog.join(good, "endpoint", "left_semi").join(capabilities, "endpoint", "left")
    return rows.select(
        F.concat_ws("/", "endpoint", "name").alias("id"), F.col("endpoint").alias("owned_by"), "capabilities"
    )


def tag_listing(catalog: DataFrame) -> DataFrame:
    """The listing of the second dialect, with its defaults."""
    return catalog.select(
        "name",
        F.col("name").alias("model"),
        F.coalesce("size_bytes", F.lit(0)).cast("bigint").alias("size"),
        F.lit("").alias("digest"),
        F.coalesce("family", F.lit("")).alias("family"),
        F.coalesce("parameter_size", F.lit("")).alias("parameter_size"),
        F.coalesce("quantization", F.lit("")).alias("quantization_level"),
    )


def provider_status(providers: DataFrame, health: DataFrame, catalog: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Every configured provider with status, models and capabilities; unknown without a check."""
    models = catalog.groupBy("endpoint").agg(F.array_sort(F.collect_set("name")).alias("models"))
    state = health.select(F.col("provider").alias("name"), "healthy", "status")
    caps = capabilities.select(F.col("endpoint").alias("name"), "capabilities")
    out = (
        providers.select("name", "type", "url", "enabled", "ord")
        .join(state, "name", "left")
        .join(models.withColumnRenamed("endpoint", "name"), "name", "left")
        .join(caps, "name", "left")
    )
    empty = F.array().cast("array<string>")
    return (
        out.withColumn("healthy", F.coalesce("healthy", F.lit(False)))
        .withColumn("status", F.coalesce("status", F.lit("unknown")))
        .withColumn("models", F.coalesce("models", empty))
        .withColumn("capabilities", F.coalesce("capabilities", empty))
        .orderBy("ord")
    )
