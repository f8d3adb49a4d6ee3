"""Stream lines of two dialects as chunks, and chunks assembled to responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptledger.functions.requests import finish_from_wire
from promptledger.operators.ordered import running

_PIECE = 1024


def _get(body: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(body, path, kind)


def _numbered(chunks: DataFrame) -> DataFrame:
    """Add ``idx``: position among the kept chunks of a request."""
    out = running(
        chunks, ["request_id"], [F.col("line_no")], F.floor(F.col("line_no") / F.lit(65536)), sums={"_n": F.lit(1)}
    )
    return out.withColumn("idx", (F.col("_n") - 1).cast("int")).drop("_n")


def data_lines(lines: DataFrame) -> DataFrame:
    """``data: {json}`` lines (request_id, line_no, line, chunk_ts) up to ``[DONE]``.

    Lines without the prefix, broken JSON and chunks without a choice are skipped.
    """
    data = lines.filter(F.col("line").startswith("data: ")).withColumn("_data", F.substring("line", 7, 2147483647))
    end = data.filter(F.col("_data") == "[DONE]").groupBy("request_id").agg(F.min("line_no").alias("_end"))
    b = F.col("_b")
    open_lines = data.join(end, "request_id", "left").filter(F.col("_end").isNull() | (F.col("line_no") < F.col("_end")))
    parsed = open_lines.withColumn("_b", F.try_parse_json("_data")).filter(
        F.size(_get(b, "$.choices", "array<variant>")) > 0
    )
    reason = _get(b, "$.choices[0].finish_reason", "string")
    last = reason.isNotNull() & (reason != "") & _get(b, "$.usage", "variant").isNotNull()

    def usage(name: str) -> Column:
        return F.when(last, F.coalesce(_get(b, f"$.usage.{name}", "int"), F.lit(0))).alias(name)

    chunks = parsed.select(
        "request_id", "line_no", "chunk_ts",
        F.coalesce(_get(b, "$.choices[0].delta.content", "string"), F.lit("")).alias("delta"),
        F.when(reason.isNotNull() & (reason != ""), finish_from_wire(reason)).alias("finish_reason"),
        usage("prompt_tokens"), usage("completion_tokens"), usage("total_tokens"),
    )
    return _numbered(chunks)


def json_lines(lines: DataFrame) -> DataFrame:
    """One JSON object per line; ``done`` closes the stream and carries the counts."""
    b = F.col("_b")
    parsed = lines.filter(F.col("line") != "").withColumn("_b", F.try_parse_json("line")).filter(b.isNotNull())
    done = F.coalesce(_get(b, "$.done", "boolean"), F.lit(False))
    prompt = F.coalesce(_get(b, "$.prompt_eval_count", "int"), F.lit(0))
    completion = F.coalesce(_get(b, "$.eval_count", "int"), F.lit(0))
    thinking = _get(b, "$.message.thinking", "string")
    chunks = parsed.select(
        "request_id", "line_no", "chunk_ts",
        F.coalesce(_get(b, "$.message.content", "string"), F.lit("")).alias("delta"),
        F.when(thinking != "", thinking).alias("thinking"),
        F.when(done, F.lit("stop")).alias("finish_reason"),
        F.when(done, prompt).alias("prompt_tokens"),
        F.when(done, completion).alias("completion_tokens"),
        F.when(done, prompt + completion).alias("total_tokens"),
    )
    return _numbered(chunks)


def _joined(pieces: str, order: str, text: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    return F.array_join(F.transform(ordered, lambda p: p[text]), "").alias(pieces)


def assemble(chunks: DataFrame) -> DataFrame:
    """One row per request: text in order, first-token time, last usage, finish reason.

    Deltas are joined in pieces of 1,024 chunks first, so a very long stream is not ordered in one go.
    """
    usage = F.struct("prompt_tokens", "completion_tokens", "total_tokens")
    pieces = chunks.groupBy("request_id", F.floor(F.col("idx") / F.lit(_PIECE)).alias("_piece")).agg(
        _joined("_text", "idx", "delta"),
        F.min(F.when(F.col("delta") != "", F.col("chunk_ts"))).alias("first_token_ts"),
        F.max("chunk_ts").alias("last_chunk_ts"),
        F.count(F.lit(1)).alias("chunk_count"),
        F.max(F.when(F.col("total_tokens").isNotNull(), F.struct("idx", usage.alias("u")))).alias("_usage"),
        F.max(F.when(F.col("finish_reason").isNotNull(), F.struct("idx", "finish_reason"))).alias("_finish"),
    )
    out = pieces.groupBy("request_id").agg(
        _joined("content", "_piece", "_text"),
        F.min("first_token_ts").alias("first_token_ts"),
        F.max("last_chunk_ts").alias("last_chunk_ts"),
        F.sum("chunk_count").alias("chunk_count"),
        F.max("_usage").alias("_usage"),
        F.max("_finish").alias("_finish"),
    )
    return out.select(
        "request_id", "content", "first_token_ts", "last_chunk_ts", "chunk_count",
        F.col("_finish.finish_reason").alias("finish_reason"),
        F.col("_usage.u.prompt_tokens").alias("prompt_tokens"),
        F.col("_usage.u.completion_tokens").alias("completion_tokens"),
        F.col("_usage.u.total_tokens").alias("total_tokens"),
    )
