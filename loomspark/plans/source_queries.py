"""Queries that write the event table out in the session formats, as lines, and read it back through their adapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.plans.evidence_queries import _ONCE, _events
from loomspark.sources import adapters

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def _lines(events: DataFrame, record: Column, adapter: str) -> tuple[DataFrame, DataFrame]:
    """One line per event in a file per session, at made-up offsets in the order of event ids; and the files."""
    at = F.row_number().over(Window.partitionBy("session_id").orderBy("event_id")) * 1000
    lines = events.select(F.concat("session_id", F.lit(".jsonl")).alias("path"), at.cast("bigint").alias("byte_offset"), F.to_json(record).alias("line"), F.lit(True).alias("terminated"))
    return lines, lines.select("path").distinct().withColumn("adapter", F.lit(adapter))


def _parsed(events: DataFrame, record: Column, adapter: str) -> DataFrame:
    rows = adapters.parse_lines(*_lines(events, record, adapter)).filter("kind = 'event'")
    return rows.select("session_id", F.col("sequence").cast("bigint").alias("sequence"), "record_locator", "role", "event_type", "content", F.coalesce("call_id", F.lit("")).alias("call_id"), F.coalesce("tool_name", F.lit("")).alias("tool_name"), F.coalesce("actor_hint", F.lit("")).alias("actor_hint"))


_KINDS = "event_type IN ('message', 'tool_call', 'tool_result') AND content <> ''"
_ROWS = f"""WITH {_ONCE}, k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS nth, CASE WHEN event_type = 'message' THEN CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' ELSE 'assistant' END
    WHEN event_type = 'tool_call' THEN 'assistant' ELSE 'tool' END AS who FROM e WHERE {_KINDS})"""
_OUT = "event_type, content, CASE WHEN event_type = 'message' THEN '' ELSE coalesce(call_id, '') END AS call_id"


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.lower(F.trim("role")).isin("user", "human"), "user").otherwise("assistant")
    return _events(spark, sf_dir).filter(_KINDS).withColumn("who", said)


@query(
    f"""{_ROWS} SELECT lower(session_id) AS session_id, nth AS sequence, 'byte:' || nth * 1000 AS record_locator, who AS role, {_OUT}, CASE WHEN event_type = 'tool_call' THEN coalesce(tool_name, 'function_call') ELSE '' END AS tool_name,
    CASE WHEN event_type = 'message' AND who = 'user' THEN 'native_user' ELSE '' END AS actor_hint FROM k WHERE NOT (event_type = 'tool_call' AND coalesce(tool_name, '') = 'apply_patch')"""
)
def r_a01_codex(spark, sf_dir):
    """Messages, calls and results through the first line format."""
    kind = F.col("event_type")
    payload = (
        F.when(kind == "message", F.struct(F.when(F.col("who") == "user", "user_message").otherwise("agent_message").alias("type"), F.col("content").alias("message"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), F.lit(None).cast("string").alias("output"), F.lit(None).cast("string").alias("call_id")))
        .when(kind == "tool_call", F.struct(F.lit("function_call").alias("type"), F.lit(None).cast("string").alias("message"), F.col("tool_name").alias("name"), F.col("content").alias("arguments"), F.lit(None).cast("string").alias("output"), F.col("call_id").alias("call_id")))
        .otherwise(F.struct(F.lit("function_call_output").alias("type"), F.lit(None).cast("string").alias("message"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), F.col("content").alias("output"), F.col("call_id").alias("call_id")))
    )
    record = F.struct(F.when(kind == "message", "event_msg").otherwise("response_item").alias("type"), F.col("timestamp").alias("timestamp"), payload.alias("payload"))
    rows = _parsed(_source(spark, sf_dir), record, "codex-jsonl")
    return rows.filter("event_type <> 'patch'")


@query(
    f"""{_ROWS} SELECT lower(session_id) AS session_id, nth AS sequence, 'byte:' || nth * 1000 || '.content[0]' AS record_locator, who AS role, {_OUT}, CASE WHEN event_type = 'tool_call' THEN coalesce(tool_name, 'tool') ELSE '' END AS tool_name,
    CASE WHEN event_type = 'message' AND who = 'user' THEN 'native_user' ELSE '' END AS actor_hint FROM k WHERE NOT (event_type = 'tool_call' AND coalesce(tool_name, '') = 'apply_patch')"""
)
def r_a04_blocks(spark, sf_dir):
    """The same through the format of content blocks."""
    kind, none = F.col("event_type"), F.lit(None).cast("string")
    block = F.struct(
        F.when(kind == "message", "text").when(kind == "tool_call", "tool_use").otherwise("tool_result").alias("type"), F.when(kind == "message", F.col("content")).alias("text"), F.when(kind == "tool_call", F.col("content")).alias("input"), F.when(kind == "tool_call", F.col("tool_name")).alias("name"),
        F.when(kind == "tool_call", F.col("call_id")).otherwise(none).alias("id"), F.when(kind == "tool_result", F.col("content")).alias("content"), F.when(kind == "tool_result", F.col("call_id")).alias("tool_use_id"),
    )
    record = F.struct(F.when(kind == "message", F.col("who")).when(kind == "tool_call", "assistant").otherwise("user").alias("type"), F.col("session_id").alias("sessionId"), F.struct(F.when(kind == "message", F.col("who")).when(kind == "tool_call", "assistant").otherwise("user").alias("role"), F.array(block).alias("content")).alias("message"))
    rows = _parsed(_source(spark, sf_dir), record, "claude-code-jsonl")
    return rows.filter("event_type <> 'patch'")


@query(
    f"""{_ROWS} SELECT lower(session_id) AS session_id, nth AS sequence, 'byte:' || nth * 1000 AS record_locator, who AS role, {_OUT}, CASE WHEN event_type = 'tool_call' THEN coalesce(tool_name, 'tool') ELSE '' END AS tool_name,
    CASE WHEN event_type = 'message' AND who = 'user' THEN 'native_user' ELSE '' END AS actor_hint FROM k WHERE NOT (event_type = 'tool_call' AND coalesce(tool_name, '') = 'apply_patch')"""
)
def r_a05_flat(spark, sf_dir):
    """The same through the flat format."""
    kind = F.col("event_type")
    record = F.struct(
        F.when(kind == "message", "message").when(kind == "tool_call", "function_call").otherwise("function_call_result").alias("type"), F.col("session_id").alias("sessionId"), F.when(kind == "message", F.col("who")).alias("role"), F.when(kind == "message", F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text")))).alias("content"),
        F.when(kind == "tool_call", F.col("tool_name")).alias("name"), F.when(kind == "tool_call", F.col("content")).alias("arguments"), F.when(kind == "tool_result", F.col("content")).alias("output"), F.when(kind != "message", F.col("call_id")).alias("callId"),
    )
    rows = _parsed(_source(spark, sf_dir), record, "workbuddy-jsonl")
    return rows.filter("event_type <> 'patch'")
