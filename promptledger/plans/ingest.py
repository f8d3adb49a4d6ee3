"""A3-A17 and H1: wire formats built from the given tables, normalized; guard scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptledger.functions.guard import combine_risk_verdicts, parse_hazard_verdict
from promptledger.operators import scans
from promptledger.operators.scoring import score, score_categories
from promptledger.plans import fixtures as X
from promptledger.plans.registry import query
from promptledger.plans.scan_tables import SCANS_SQL, labelled_scans
from promptledger.session import scratch_path
from promptledger.sources import chunks as C
from promptledger.sources import logs
from promptledger.sources import requests as R
from promptledger.sources import responses as P
from promptledger.sources import snapshots as N

_ID = "concat('conv-', cast(conv_id as string), '-', cast(turn as string)) as request_id"


def _turns(spark, sf):
    return X._table(spark, sf, "conversations").selectExpr(_ID, "concat('client-', cast(conv_id % 10 as string)) as client_id", "*")


def _halves():
    half = F.expr("floor(length(text) / 2)")
    return F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))


def _content():
    """Message content as the wire has it: text, or text parts around an image."""
    first, second = _halves()
    parts = F.array(
        F.struct(F.lit("text").alias("type"), first.alias("text"), F.lit(None).cast("string").alias("url")),
        F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("http://x/y").alias("url")),
        F.struct(F.lit("text").alias("type"), second.alias("text"), F.lit(None).cast("string").alias("url")),
    )
    return F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("text").alias("v")))).otherwise(F.to_json(F.struct(parts.alias("v"))))


_FLAT = "case when turn % 2 = 0 then text else concat(substr(text, 1, length(text) // 2), chr(10), substr(text, length(text) // 2 + 1)) end"


@query("a3_content_text", f"select concat('conv-', conv_id, '-', turn) as request_id, sha256({_FLAT}) as content_hash from conversations")
def a3(spark, sf):
    rows = _turns(spark, sf).withColumn("v", F.variant_get(F.parse_json(_content()), "$.v", "variant"))
    return rows.select("request_id", F.sha2(R.content_text(F.col("v")), 256).alias("content_hash"))


def _body(*fields):
    """JSON text of an object from its fields."""
    separated = [x for i, f in enumerate(fields) for x in ([F.lit(",")] if i else []) + [f]]
    return F.concat(F.lit("{"), *separated, F.lit("}"))


def _field(name, value):
    return F.concat(F.lit(f'"{name}":'), value)


def _value():
    """The value inside the JSON text {"v": value} of column ``_c``."""
    return F.expr("substring(_c, 6, length(_c) - 6)")


def chat_bodies(spark, sf):
    rows = _turns(spark, sf).withColumn("_c", _content())
    message = F.concat(F.lit('[{"role":"'), F.col("role"), F.lit('","content":'), _value(), F.lit("}]"))
    limit = F.expr("case turn % 3 when 0 then '0' when 1 then 'null' else '77' end")
    stop = F.expr("""case turn % 3 when 0 then '"END"' when 1 then '["a","b"]' else 'null' end""")
    return rows.select(
        "request_id", "client_id",
        _body(
            _field("model", F.lit('"gpt-4o"')), _field("messages", message), _field("max_tokens", limit),
            _field("temperature", F.expr("case when turn % 2 = 0 then '0' else 'null' end")), _field("stop", stop),
            _field("stream", F.expr("case when turn % 2 = 0 then 'true' else 'false' end")),
            _field("user", F.expr("""case when turn % 2 = 0 then '""' else '"u-1"' end""")),
        ).alias("body"),
    )


_CHAT_SQL = f"""select concat('conv-', conv_id, '-', turn) as request_id, concat('client-', conv_id % 10) as client_id, 'chat' as task,
  case when turn % 2 = 0 then 'anonymous' else 'u-1' end as user_id, 'gpt-4o' as model, role, sha256({_FLAT}) as content_hash,
  case when turn % 3 = 2 then 77 else 1024 end::bigint as max_tokens, case when turn % 2 = 0 then 0.0::double else 0.7::double end as temperature, 1.0::double as top_p,
  case turn % 3 when 0 then 'END' when 1 then 'a|b' end as stop, turn % 2 = 0 as stream from conversations"""


@query("a4_chat_requests", _CHAT_SQL)
def a4(spark, sf):
    first = F.get("messages", F.lit(0))
    return R.chat_requests(chat_bodies(spark, sf)).select(
        "request_id", "client_id", "task", "user_id", "model", first["role"].alias("role"),
        F.sha2(first["content"], 256).alias("content_hash"), "max_tokens", "temperature", "top_p",
        F.array_join("stop", "|").alias("stop"), "stream",
    )


def completion_bodies(spark, sf):
    text = F.to_json(F.struct(F.col("text").alias("v")))
    rows = _turns(spark, sf).withColumn("_c", text)
    prompt = F.when(F.col("turn") % 2 == 0, _value()).otherwise(F.concat(F.lit("["), _value(), F.lit(',"second"]')))
    return rows.select("request_id", "client_id", _body(_field("model", F.lit('"davinci"')), _field("prompt", prompt), _field("top_p", F.lit("0.5"))).alias("body"))


@query("a5_completion_requests", "select concat('conv-', conv_id, '-', turn) as request_id, 'completion' as task, 'davinci' as model, sha256(text) as prompt_hash, 1024::bigint as max_tokens, 0.5::double as top_p, false as stream from conversations")
def a5(spark, sf):
    return R.completion_requests(completion_bodies(spark, sf)).select(
        "request_id", "task", "model", F.sha2("prompt", 256).alias("prompt_hash"), "max_tokens", "top_p", "stream"
    )


def embedding_bodies(spark, sf):
    rows = _turns(spark, sf).withColumn("_c", F.to_json(F.struct(F.col("text").alias("v"))))
    given = F.when(F.col("turn") % 2 == 0, _value()).otherwise(F.concat(F.lit("["), _value(), F.lit(',"more"]')))
    return rows.select("request_id", "client_id", _body(_field("model", F.lit('"nomic-embed-text"')), _field("input", given)).alias("body"))


@query("a6_embedding_requests", "select concat('conv-', conv_id, '-', turn) as request_id, 'embeddings' as task, (turn % 2 + 1)::bigint as inputs, sha256(case when turn % 2 = 0 then text else concat(text, '|more') end) as input_hash, 0::bigint as max_tokens from conversations")
def a6(spark, sf):
    return R.embedding_requests(embedding_bodies(spark, sf)).select(
        "request_id", "task", F.size("input_data").alias("inputs"), F.sha2(F.array_join("input_data", "|"), 256).alias("input_hash"), "max_tokens"
    )


def options_bodies(spark, sf):
    rows = _turns(spark, sf).withColumn("_c", F.to_json(F.struct(F.col("text").alias("v"))))
    chat = F.concat(F.lit('[{"role":"'), F.col("role"), F.lit('","content":'), _value(), F.lit("}]"))
    asked = F.when(
        F.col("turn") % 2 == 0, _field("messages", chat)
    ).otherwise(F.concat(_field("prompt", _value()), F.expr("""case when turn % 3 = 0 then ',"system":"be brief"' else '' end""")))
    options = F.expr("""case when turn % 2 = 0 then '{"num_predict":5,"temperature":0.1}' else '{}' end""")
    stream = F.expr("""case when turn % 3 = 0 then ',"stream":false' else '' end""")
    return rows.select("request_id", "client_id", F.concat(F.lit('{"model":"phi4:14b",'), asked, F.lit(',"options":'), options, stream, F.lit("}")).alias("body"))


@query("a7_options_requests", """
select concat('conv-', conv_id, '-', turn) as request_id, case when turn % 2 = 0 then 'chat' else 'generate' end as task,
  sha256(case when turn % 2 = 0 then concat(role, ':', text) when turn % 3 = 0 then concat('system:be brief', chr(10), 'user:', text) else concat('user:', text) end) as messages_hash,
  case when turn % 2 = 1 then sha256(text) end as prompt_hash, case when turn % 2 = 0 then 5 else 1024 end::bigint as max_tokens,
  case when turn % 2 = 0 then 0.1::double else 0.7::double end as temperature, turn % 3 <> 0 as stream from conversations""")
def a7(spark, sf):
    joined = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return R.options_requests(options_bodies(spark, sf)).select(
        "request_id", "task", F.sha2(joined, 256).alias("messages_hash"), F.sha2("prompt", 256).alias("prompt_hash"), "max_tokens", "temperature", "stream"
    )


@query("a8_all_requests", """
select task, count(*) as request_count, sum(max_tokens)::bigint as max_tokens, count(*) filter (where streams) as stream_count from (
  select 'chat' as task, case when turn % 3 = 2 then 77 else 1024 end as max_tokens, turn % 2 = 0 as streams from conversations
  union all select 'completion', 1024, false from conversations
  union all select 'embeddings', 0, false from conversations
  union all select case when turn % 2 = 0 then 'chat' else 'generate' end, case when turn % 2 = 0 then 5 else 1024 end, turn % 3 <> 0 from conversations) x group by task""")
def a8(spark, sf):
    rows = R.all_requests(
        R.chat_requests(chat_bodies(spark, sf)), R.completion_requests(completion_bodies(spark, sf)),
        R.embedding_requests(embedding_bodies(spark, sf)), R.options_requests(options_bodies(spark, sf)),
    )
    return rows.groupBy("task").agg(
        F.count("*").alias("request_count"), F.sum("max_tokens").alias("max_tokens"), F.count_if("stream").alias("stream_count")
    )


def response_bodies(spark, sf):
    rows = _turns(spark, sf).withColumn("_c", F.to_json(F.struct(F.col("text").alias("v"))))
    calls = F.expr(r"""case turn % 4 when 1 then ',"tool_calls":[{"id":"c1","function":{"name":"find","arguments":"{\\"q\\": 1}"}}]'
      when 2 then ',"tool_calls":[{"id":"c2","function":{"name":"find","arguments":"not json"}}]' else '' end""")
    choice = F.concat(F.lit('[{"message":{"role":"assistant","content":'), _value(), calls, F.lit('},"finish_reason":"length"}]'))
    choices = F.when(F.col("turn") == 3, F.lit("[]")).otherwise(choice)
    usage = F.concat(F.lit(',"usage":{"prompt_tokens":'), F.col("turn"), F.lit(',"completion_tokens":9,"total_tokens":'), F.col("turn") + 9, F.lit("}}"))
    return rows.select("request_id", F.lit("asked-model").alias("model"), F.concat(F.lit('{"model":"gpt-4o-mini","choices":'), choices, usage).alias("body"))


@query("a9_chat_responses", """
select concat('conv-', conv_id, '-', turn) as request_id, case when turn = 3 then 'asked-model' else 'gpt-4o-mini' end as model,
  case when turn <> 3 then sha256(text) end as content_hash, case when turn = 3 then 'error' else 'length' end as finish_reason,
  case when turn = 3 then 0 else turn end as prompt_tokens, case when turn = 3 then 0 else turn + 9 end as total_tokens,
  case when turn = 3 then null when turn % 4 = 1 then 'c1/find/{"q":1}' when turn % 4 = 2 then 'c2/find/{"raw":"not json"}' end as tool_calls,
  case when turn = 3 then 'empty_response' end as error_code from conversations""")
def a9(spark, sf):
    out = P.chat_responses(response_bodies(spark, sf))
    calls = F.array_join(F.transform("tool_calls", lambda c: F.concat_ws("/", c["id"], c["name"], c["arguments"])), ",")
    return out.select(
        "request_id", "model", F.sha2("content", 256).alias("content_hash"), "finish_reason", "prompt_tokens", "total_tokens",
        calls.alias("tool_calls"), "error_code",
    )


def options_response_bodies(spark, sf):
    rows = _turns(spark, sf).withColumn("_c", F.to_json(F.struct(F.col("text").alias("v"))))
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('"message":{"content":'), _value(), F.lit("}"))).otherwise(_field("response", _value()))
    return rows.select(
        "request_id", F.lit("phi4:14b").alias("model"),
        F.concat(F.lit("{"), text, F.expr("case when turn % 3 = 0 then ',\"done\":true' else '' end"), F.lit(',"prompt_eval_count":'), F.col("turn"), F.lit(',"eval_count":4}')).alias("body"),
    )


@query("a10_options_responses", """
select concat('conv-', conv_id, '-', turn) as request_id, 'phi4:14b' as model, sha256(text) as content_hash,
  case when turn % 3 = 0 then 'stop' else 'length' end as finish_reason, turn as prompt_tokens, 4::bigint as completion_tokens, turn + 4 as total_tokens from conversations""")
def a10(spark, sf):
    return P.options_responses(options_response_bodies(spark, sf)).select(
        "request_id", "model", F.sha2("content", 256).alias("content_hash"), "finish_reason", "prompt_tokens", "completion_tokens", "total_tokens"
    )


# --- streams of chunks: each turn is cut into three pieces ---------------------------------------


def _pieces(spark, sf):
    third = F.expr("floor(length(text) / 3)")
    pieces = F.array(
        F.substring("text", F.lit(1), third), F.substring("text", third + 1, third), F.substring("text", third * 2 + 1, F.length("text"))
    )
    return _turns(spark, sf).select("request_id", "conv_id", "turn", F.posexplode(pieces).alias("n", "piece"))


def data_line_rows(spark, sf):
    """Three chunk lines per turn between noise, then [DONE] and a line that must be ignored."""
    p = _pieces(spark, sf).withColumn("_c", F.to_json(F.struct(F.col("piece").alias("v"))))
    end = F.when(
        F.col("n") == 2, F.concat(F.lit(',"finish_reason":"stop"}],"usage":{"prompt_tokens":3,"completion_tokens":'), F.col("turn"), F.lit(',"total_tokens":'), F.col("turn") + 3, F.lit("}}"))
    ).otherwise(F.lit("}]}"))
    line = F.concat(F.lit('data: {"choices":[{"delta":{"content":'), _value(), F.lit("}"), end)
    at = F.timestamp_micros(F.lit(1704067200000000) + F.col("conv_id") * 60000000 + F.col("turn") * 1000000)
    chunk = p.select("request_id", (F.col("n") * 10).alias("line_no"), line.alias("line"), (at + F.make_interval(secs=F.col("n"))).alias("chunk_ts"))
    noise = F.array(
        F.struct(F.lit(5).alias("line_no"), F.lit("data: {broken").alias("line")),
        F.struct(F.lit(6).alias("line_no"), F.lit(": comment").alias("line")),
        F.struct(F.lit(15).alias("line_no"), F.lit('data: {"choices":[]}').alias("line")),
        F.struct(F.lit(30).alias("line_no"), F.lit("data: [DONE]").alias("line")),
        F.struct(F.lit(40).alias("line_no"), F.lit('data: {"choices":[{"delta":{"content":"late"}}]}').alias("line")),
    )
    extra = _turns(spark, sf).withColumn("_t", at).select("request_id", F.inline(noise), F.col("_t").alias("chunk_ts")).select("request_id", "line_no", "line", "chunk_ts")
    return chunk.unionByName(extra)


_PIECES_SQL = """pieces as (
  select concat('conv-', conv_id, '-', turn) as request_id, conv_id, turn, n, case n when 0 then substr(text, 1, length(text) // 3)
    when 1 then substr(text, length(text) // 3 + 1, length(text) // 3) else substr(text, length(text) // 3 * 2 + 1) end as piece
  from conversations, (values (0), (1), (2)) t(n))"""


@query("a11_data_lines", X.with_sql("""
select request_id, n::bigint as idx, sha256(piece) as delta_hash, case when n = 2 then 'stop' end as finish_reason,
  case when n = 2 then turn end as completion_tokens, case when n = 2 then turn + 3 end as total_tokens from pieces""", _PIECES_SQL))
def a11(spark, sf):
    return C.data_lines(data_line_rows(spark, sf)).select(
        "request_id", "idx", F.sha2("delta", 256).alias("delta_hash"), "finish_reason", "completion_tokens", "total_tokens"
    )


@query("a11_json_lines", X.with_sql("""
select request_id, n::bigint as idx, sha256(piece) as delta_hash, case when n = 0 then 'hm' end as thinking, case when n = 2 then 'stop' end as finish_reason,
  case when n = 2 then turn + 7 end as total_tokens from pieces""", _PIECES_SQL))
def a11_json(spark, sf):
    p = _pieces(spark, sf).withColumn("_c", F.to_json(F.struct(F.col("piece").alias("v"))))
    thinking = F.expr("""case when n = 0 then ',"thinking":"hm"' else '' end""")
    end = F.when(F.col("n") == 2, F.concat(F.lit(',"done":true,"prompt_eval_count":7,"eval_count":'), F.col("turn"))).otherwise(F.lit(""))
    line = F.concat(F.lit('{"message":{"content":'), _value(), thinking, F.lit("}"), end, F.lit("}"))
    rows = p.select("request_id", F.col("n").alias("line_no"), line.alias("line"), F.lit(None).cast("timestamp").alias("chunk_ts"))
    return C.json_lines(rows).select("request_id", "idx", F.sha2("delta", 256).alias("delta_hash"), "thinking", "finish_reason", "total_tokens")


_ASSEMBLED_SQL = """
select concat('conv-', conv_id, '-', turn) as request_id, sha256(text) as content_hash,
  1704067200000000 + conv_id * 60000000 + turn * 1000000 + case when length(text) // 3 > 0 then 0 else 2000000 end as first_token_ts,
  3::bigint as chunk_count, 'stop' as finish_reason, 3::bigint as prompt_tokens, turn as completion_tokens, turn + 3 as total_tokens from conversations"""


@query("a12_assembled_streams", _ASSEMBLED_SQL)
def a12(spark, sf):
    return C.assemble(C.data_lines(data_line_rows(spark, sf))).select(
        "request_id", F.sha2("content", 256).alias("content_hash"), "first_token_ts", "chunk_count", "finish_reason", "prompt_tokens", "completion_tokens", "total_tokens"
    )


# --- catalog snapshots, one per endpoint and day -------------------------------------------------


def _snapshots(spark, sf, key, item):
    """One listing per endpoint and day with every model seen; ``item`` builds a listing entry."""
    seen = X.audit(spark, sf).select("endpoint", "event_date", "model").distinct()
    listed = seen.groupBy("endpoint", "event_date").agg(F.array_sort(F.collect_set("model")).alias("_models"))
    body = F.to_json(F.struct(F.transform("_models", item).alias(key)))
    return listed.select("endpoint", F.col("event_date").cast("timestamp").alias("snapshot_ts"), body.alias("body"))


_SEEN_SQL = f"""{X.AUDIT_SQL},
seen as (select *, row_number() over (partition by endpoint, event_date order by model) - 1 as ord from (select distinct endpoint, event_date, model from audit) x)"""


@query("a13_tags_listing", X.with_sql("""
select endpoint, epoch_us(cast(event_date as timestamp)) as snapshot_ts, ord, model as name, (length(model) * 1000)::bigint as size_bytes,
  concat('sha256:', model) as digest, 'fam' as family, case when contains(model, '70b') then null else '7B' end as parameter_size, 'Q4_0' as quantization,
  epoch_us(timestamp '2024-05-01 10:00:00') as modified_at from seen""", _SEEN_SQL))
def a13(spark, sf):
    def item(m):
        details = F.struct(
            F.lit("fam").alias("family"), F.when(~F.contains(m, F.lit("70b")), "7B").alias("parameter_size"), F.lit("Q4_0").alias("quantization_level")
        )
        return F.struct(
            m.alias("name"), F.lit("2024-05-01T10:00:00Z").alias("modified_at"), (F.length(m) * 1000).alias("size"),
            F.concat(F.lit("sha256:"), m).alias("digest"), details.alias("details"),
        )

    return N.tags_listing(_snapshots(spark, sf, "models", item))


@query("a14_ids_listing", X.with_sql("select endpoint, epoch_us(cast(event_date as timestamp)) as snapshot_ts, ord, model as name from seen", _SEEN_SQL))
def a14(spark, sf):
    return N.ids_listing(_snapshots(spark, sf, "data", lambda m: F.struct(m.alias("id"), F.lit("model").alias("object"))))


@query("a15_server_listing", X.with_sql("select endpoint, epoch_us(cast(event_date as timestamp)) as snapshot_ts, ord, model as name from seen where contains(model, ':')", _SEEN_SQL))
def a15(spark, sf):
    def item(m):
        return F.struct(m.alias("name"), F.lit("1").alias("version"), F.when(F.contains(m, F.lit(":")), "READY").otherwise("LOADING").alias("state"))

    return N.server_listing(_snapshots(spark, sf, "models", item))


# --- logs, export ------------------------------------------------------------------------------


@query("a16_log_lines", X.with_sql("""
select case status when 'error' then 'ERROR' else 'INFO' end as level, 'audit' as logger, concat('served ', model) as message, request_id, client_id, model,
  epoch_us(date_trunc('second', event_ts)) as log_ts, cast(latency_ms as varchar) is not null as has_latency from audit""", X.AUDIT_SQL))
def a16(spark, sf):
    rows = X.audit(spark, sf).select(
        F.to_json(
            F.struct(
                F.expr("case status when 'error' then 'ERROR' else 'INFO' end").alias("level"), F.lit("audit").alias("logger"),
                F.concat(F.lit("served "), F.col("model")).alias("message"),
                F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "request_id", "client_id", "model", "latency_ms",
            )
        ).alias("line")
    )
    broken = X.audit(spark, sf).select(F.concat(F.lit("not a json line of "), "endpoint").alias("line"))
    noisy = rows.unionByName(broken)
    return logs.parse_log_lines(noisy).select(
        "level", "logger", "message", "request_id", "client_id", "model", "log_ts", F.try_element_at("extra", F.lit("latency_ms")).isNotNull().alias("has_latency")
    )


@query("a16_rejects", X.with_sql("""
select line, reason from (
  select concat('not a json line of ', endpoint) as line, 'not_json' as reason from audit
  union all select concat('["', endpoint, '"]'), 'not_an_object' from audit where event_id % 2 = 0
  union all select '  ', 'empty' from audit where event_id % 5 = 0) x""", X.AUDIT_SQL))
def a16_rejects(spark, sf):
    """Broken lines of three kinds among good ones."""
    rows = X.audit(spark, sf)
    good = rows.select(F.to_json(F.struct("request_id", "model")).alias("line"))
    broken = rows.select(F.concat(F.lit("not a json line of "), "endpoint").alias("line"))
    lists = rows.filter("event_id % 2 = 0").select(F.concat(F.lit('["'), "endpoint", F.lit('"]')).alias("line"))
    blank = rows.filter("event_id % 5 = 0").select(F.lit("  ").alias("line"))
    return logs.rejected_log_lines(good.unionByName(broken).unionByName(lists).unionByName(blank))


@query("a4_tool_messages", """
select request_id, case kind when 3 then 'not_json' end as parse_error, case kind when 3 then null else role end as role,
  case kind when 0 then 'call-7' end as call_id, case kind when 0 then 'look_up' end as call_name, case kind when 0 then '{"id":1}' end as call_arguments,
  case kind when 1 then 'call-7' end as tool_call_id, case kind when 2 then 2 end as part_count, case kind when 3 then null else 1 end as tool_count,
  case kind when 0 then '"auto"' end as tool_choice, case kind when 1 then '{"type":"json_object"}' end as response_format
from (select concat('conv-', conv_id, '-', turn) as request_id, role, (conv_id + turn) % 4 as kind from conversations) x""")
def a4_tools(spark, sf):
    """Bodies with tool calls, tool answers, content parts, and broken ones, one for each turn."""
    rows = X._table(spark, sf, "conversations").selectExpr("concat('conv-', conv_id, '-', turn) as request_id", "role", "cast((conv_id + turn) % 4 as int) as kind")
    role = F.to_json(F.struct("role"))
    head = F.substring(role, F.lit(1), F.length(role) - 1)
    tools = F.lit(', "tools": [{"type": "function", "function": {"name": "look_up"}}]')
    body = (
        F.when(F.col("kind") == 0, F.concat(F.lit('{"messages": ['), head, F.lit(', "tool_calls": [{"id": "call-7", "type": "function", "function": {"name": "look_up", "arguments": "{\\"id\\":1}"}}]}]'), tools, F.lit(', "tool_choice": "auto"}')))
        .when(F.col("kind") == 1, F.concat(F.lit('{"messages": ['), head, F.lit(', "content": "x", "tool_call_id": "call-7"}]'), tools, F.lit(', "response_format": {"type": "json_object"}}')))
        .when(F.col("kind") == 2, F.concat(F.lit('{"messages": ['), head, F.lit(', "content": [{"type": "text", "text": "a"}, {"type": "image_url", "image_url": {"url": "u"}}]}]'), tools, F.lit("}")))
        .otherwise(F.lit('{"messages": ['))
    )
    out = R.chat_details(rows.select("request_id", body.alias("body")))
    m = F.get("messages", F.lit(0))
    call = F.get(m["tool_calls"], F.lit(0))
    return out.select(
        "request_id", "parse_error", m["role"].alias("role"), call["id"].alias("call_id"), call["name"].alias("call_name"), call["arguments"].alias("call_arguments"),
        m["tool_call_id"].alias("tool_call_id"), F.size(m["parts"]).alias("part_count"), F.size("tools").alias("tool_count"), "tool_choice", "response_format")


@query("a17_training_export", X.with_sql("""
select request_id, case when label = 'unsafe' and label_category is not null then concat('unsafe', chr(10), label_category) when label = 'unsafe' then 'unsafe' else 'safe' end as target
from scans where label is not null""", SCANS_SQL))
def a17(spark, sf):
    """Write the export and read it back."""
    path = scratch_path(spark, "training-export")
    scans.export_training(scans.finetune_rows(labelled_scans(spark, sf)), path)
    rows = spark.read.schema("target string, metadata struct<request_id:string>").json(path)
    return rows.select("metadata.request_id", "target")


# --- guard scoring -----------------------------------------------------------------------------


def keyword_scorer(conversations):
    """Stand-in for a guard model: flags card numbers, fails on tags."""
    texts = [" ".join(m["content"] for m in messages) for messages in conversations]
    if any("[SYSTEM]" in text for text in texts):
        raise RuntimeError("guard model timeout")
    return ["unsafe\nS7" if "Card " in text else "safe" for text in texts]


def category_scorer(category, conversations):
    """Stand-in for a model that is asked about one risk at a time."""
    word = {"violence": "Card ", "jailbreak": "the"}.get(category)
    return ["Yes" if word and any(word in m["content"] for m in messages) else "No" for messages in conversations]


@query("h1_category_scoring", X.with_sql("""
select request_id, case when contains(combined, 'Card ') then 'violence' when contains(combined, 'the') then 'jailbreak' end as category_code,
  case when contains(combined, 'Card ') then 2 else 3 end as asked, not (contains(combined, 'Card ') or contains(combined, 'the')) as safe from requests""", X.REQUESTS_SQL))
def h1_categories(spark, sf):
    """Three categories in order; the first flagged one ends the questions."""
    scored = score_categories(X.requests(spark, sf), category_scorer, ("harm", "violence", "jailbreak"), lambda raw: raw == "Yes")
    return scored.withColumn("v", combine_risk_verdicts(F.col("answers"))).select("request_id", "v.category_code", F.size("answers").alias("asked"), "v.safe")


@query("h1_guard_scoring", X.with_sql("""
select request_id, case when contains(combined, '[SYSTEM]') then true else not contains(combined, 'Card ') end as safe,
  contains(combined, '[SYSTEM]') as skipped,
  case when contains(combined, '[SYSTEM]') then 'guard model timeout' end as error,
  case when not contains(combined, '[SYSTEM]') and contains(combined, 'Card ') then 'Privacy' end as category_name from requests""", X.REQUESTS_SQL))
def h1(spark, sf):
    scored = score(X.requests(spark, sf), keyword_scorer)
    return scored.withColumn("v", parse_hazard_verdict(F.col("guard_raw_response"))).select(
        "request_id", "v.safe", "v.skipped", F.coalesce("guard_error", "v.error").alias("error"), "v.category_name"
    )
