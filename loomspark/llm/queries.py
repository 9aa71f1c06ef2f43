"""Queries of the language-model operators and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import conversations, leakage, pii, splitting, tokenizer
from loomspark.session import Scratch, table

#: The secret of the surrogates; a deployment passes its own.
SURROGATE_KEY = b"loomspark-demonstration-key"


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(
        {
            "unified_events": (table(spark, sf_dir, "unified_events"), "event_id", "content", False),
            "raw_events": (table(spark, sf_dir, "raw_events"), "raw_event_id", "working_dir", True),
        }
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of personal data that every record has replaced by surrogates."""
    spans = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value")))
    detected = Scratch(spark, "detected").keep(_detected(spark, sf_dir).select("record_table", "record_id", spans.alias("spans")), "detected")  # read twice
    return pii.replaced(detected, pii.surrogate_table(detected, SURROGATE_KEY))


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that holds personal data, with typed placeholders instead."""
    return pii.redact(_detected(spark, sf_dir))


def p2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that holds personal data, with keyed type-consistent surrogates instead."""
    detected = Scratch(spark, "detected").keep(_detected(spark, sf_dir), "detected")  # it is read twice
    return pii.redact(detected, pii.surrogate_table(detected, SURROGATE_KEY))


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.run_stream(spark, f"{sf_dir}/unified_events.parquet", Scratch(spark, "conversations"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations that are left out, with the reason."""
    return conversations.verdicts(_summaries(spark, sf_dir)).filter("reason IS NOT NULL").select("logical_session_id", "reason")


def p3_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of all valid conversations, in order."""
    return conversations.conversations(table(spark, sf_dir, "unified_events"), _summaries(spark, sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return tokenizer.encode(table(spark, sf_dir, "documents"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text, encoded and decoded again."""
    return tokenizer.decode(tokenizer.encode(table(spark, sf_dir, "documents")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold twelve consecutive words of an evaluation item, with the items."""
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with passages much like an evaluation item's, word order kept, with the items."""
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), exact=False)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that have to be cut."""
    split = splitting.split_oversized(table(spark, sf_dir, "documents"), with_text=False)
    return split.filter(F.size("pieces") > 1).select("doc_id")


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document that has to be cut."""
    return splitting.pieces(splitting.split_oversized(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (p2_found, p2_redacted, p2_surrogates, p3_found, p3_conversations, p7_ids, p7_decoded, p8_found, p8_paraphrases, p9_found, p9_pieces)}

_SPEAKING = r"""
once AS (
  SELECT logical_session_id, event_id, min(sequence) AS sequence, min(role) AS role, min(event_type) AS event_type, min(coalesce(content, '')) AS content
  FROM unified_events WHERE logical_session_id IS NOT NULL GROUP BY logical_session_id, event_id),
spoken AS (
  SELECT *, CASE WHEN event_type = 'message' AND regexp_matches(regexp_replace(content, '[​﻿]', '', 'g'), '[^\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{001C}-\x{001F}]')
    THEN CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 1 WHEN lower(trim(role)) IN ('assistant', 'ai', 'model') THEN 2 ELSE 0 END ELSE 0 END AS who
  FROM once),
turns AS (
  SELECT *, lead(who) OVER (PARTITION BY logical_session_id ORDER BY sequence, who) AS next_who, row_number() OVER (PARTITION BY logical_session_id ORDER BY sequence, who) AS nth
  FROM (SELECT DISTINCT logical_session_id, sequence, who, content FROM spoken WHERE who > 0)),
spoke AS (
  SELECT logical_session_id, bool_or(who = 1 AND coalesce(next_who, 1) = 1) AS missing, bool_or(nth = 1 AND who = 2) AS answer_first FROM turns GROUP BY 1),
numbered AS (
  SELECT logical_session_id, count(DISTINCT sequence) AS n, min(sequence) AS low, max(sequence) AS high, count(DISTINCT (sequence, content)) AS kinds FROM spoken GROUP BY 1),
judged AS (
  SELECT n.logical_session_id, CASE WHEN s.logical_session_id IS NULL THEN 'empty' WHEN n.low <> 1 OR n.high <> n.n OR n.kinds <> n.n OR s.answer_first THEN 'broken' WHEN s.missing THEN 'missing_reply' END AS reason
  FROM numbered n LEFT JOIN spoke s USING (logical_session_id))
"""

ORACLES: dict[str, str] = {
    "p3_found": f"WITH {_SPEAKING} SELECT logical_session_id, reason FROM judged WHERE reason IS NOT NULL",
    "p3_conversations": f"""WITH {_SPEAKING} SELECT t.logical_session_id, t.nth AS turn, CASE WHEN t.who = 1 THEN 'user' ELSE 'assistant' END AS speaker, t.content AS text
        FROM turns t JOIN judged j USING (logical_session_id) WHERE j.reason IS NULL""",
    "p7_decoded": "SELECT doc_id, coalesce(min(text), '') AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id",
    "p8_found": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
        e AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
        dg AS (SELECT DISTINCT doc_id, w[i:i+11] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
        eg AS (SELECT DISTINCT item_id, w[i:i+11] AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e WHERE len(w) >= 12))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)""",
}
