"""Catalog snapshots as endpoints list them (endpoint, snapshot_ts, body), one row per model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptledger.functions.identifiers import lenient_utc

_TAGS = (
    "models array<struct<name:string,modified_at:string,size:bigint,digest:string,"
    "details:struct<family:string,parameter_size:string,quantization_level:string>>>"
)
_IDS = "data array<struct<id:string>>"
_STATES = "models array<struct<name:string,state:string>>"


def _rows(raw: DataFrame, schema: str, items: str) -> DataFrame:
    parsed = raw.withColumn("_b", F.from_json("body", schema))
    return parsed.select("endpoint", "snapshot_ts", F.posexplode(f"_b.{items}").alias("ord", "_m"))


def tags_listing(raw: DataFrame) -> DataFrame:
    rows = _rows(raw, _TAGS, "models").filter(F.coalesce("_m.name", F.lit("")) != "")
    return rows.select(
        "endpoint", "snapshot_ts", "ord",
        F.col("_m.name").alias("name"),
        F.col("_m.size").alias("size_bytes"),
        F.col("_m.digest").alias("digest"),
        F.col("_m.details.family").alias("family"),
        F.col("_m.details.parameter_size").alias("parameter_size"),
        F.col("_m.details.quantization_level").alias("quantization"),
        lenient_utc(F.col("_m.modified_at")).alias("modified_at"),
    )


def ids_listing(raw: DataFrame) -> DataFrame:
    rows = _rows(raw, _IDS, "data").filter(F.coalesce("_m.id", F.lit("")) != "")
    return rows.select("endpoint", "snapshot_ts", "ord", F.col("_m.id").alias("name"))


def server_listing(raw: DataFrame) -> DataFrame:
    """Only models in state READY."""
    rows = _rows(raw, _STATES, "models").filter((F.coalesce("_m.name", F.lit("")) != "") & (F.col("_m.state") == "READY"))
    return rows.select("endpoint", "snapshot_ts", "ord", F.col("_m.name").alias("name"))
