"""Structured log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptledger.functions.identifiers import lenient_utc
from promptledger.schemas import LOG_LINE


def _is_object(column: str) -> Column:
    return F.coalesce(F.try_parse_json(column).isNotNull() & F.rlike(F.col(column), F.lit(r"\A\s*\{")), F.lit(False))


def rejected_log_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Lines that ``parse_log_lines`` leaves out, with the ``reason``: ``empty``, ``not_json`` or ``not_an_object``."""
    reason = (
        F.when(F.coalesce(F.trim(column), F.lit("")) == "", F.lit("empty"))
        .when(F.try_parse_json(column).isNull(), F.lit("not_json")).otherwise(F.lit("not_an_object"))
    )
    return lines.filter(~_is_object(column)).withColumn("reason", reason)


def parse_log_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Known fields as columns, the rest as a map of text in ``extra``; for broken lines see ``rejected_log_lines``."""
    known = [f.name for f in LOG_LINE.fields]
    rows = lines.filter(_is_object(column))
    fields = F.from_json(F.col(column), LOG_LINE)
    everything = F.from_json(F.col(column), "map<string,string>")
    extra = F.map_filter(everything, lambda k, v: ~k.isin(*known))
    out = rows.select(*[c for c in lines.columns if c != column], fields.alias("_f"), extra.alias("extra"))
    keep = [c for c in lines.columns if c != column]
    return out.select(
        *keep,
        *[F.col(f"_f.{n}").alias(n) for n in known if n != "timestamp"],
        lenient_utc(F.col("_f.timestamp")).alias("log_ts"),
        "extra",
    )


def read_log_files(spark: SparkSession, path: str) -> DataFrame:
    return parse_log_lines(spark.read.text(path), "value")
