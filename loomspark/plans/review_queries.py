"""Queries of review, distillation and release operators over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as fx
from loomspark.functions.tokens import folded
from loomspark.operators import evidence as ev
from loomspark.operators import release, retrieval, review, snapshots
from loomspark.plans.evidence_queries import _FILES_ONCE, _ONCE, _events
from loomspark.session import table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(f"WITH {_ONCE}, x AS (SELECT event_id, 'no-durable-knowledge' AS disposition FROM e WHERE event_type = 'status') SELECT event_id, coalesce(x.disposition, CASE WHEN e.project_key IS NULL THEN 'session-only' ELSE 'reviewed' END) AS disposition FROM e LEFT JOIN x USING (event_id)")
def r_x01_dispositions(spark, sf_dir):
    """One disposition per event: its exception, else its project's default."""
    events = _events(spark, sf_dir)
    exceptions = events.filter("event_type = 'status'").select("event_id", F.lit("no-durable-knowledge").alias("disposition"))
    default = F.when(F.col("project_key").isNull(), "session-only").otherwise("reviewed")
    return events.select("event_id", default.alias("usual")).join(exceptions, "event_id", "left").select("event_id", F.coalesce("disposition", "usual").alias("disposition"))


# Java's word boundary knows all letters, RE2's only ASCII: so none is used
_BUCKETS = {"request": r"(?i)could you|please|por favor|merci de|bitte", "finding": r"(?i)still fails|error|locktimeout", "plan": r"(?i)next step|keep the", "question": r"\?"}


@query(
    f"WITH {_ONCE}, b AS (SELECT event_id, unnest([" + ", ".join(f"CASE WHEN regexp_matches(content, '{p}') THEN '{b}' END" for b, p in _BUCKETS.items()) + "]) AS bucket FROM e WHERE event_type = 'message') SELECT event_id, bucket FROM b WHERE bucket IS NOT NULL"
)
def r_x07_buckets(spark, sf_dir):
    """Messages by what they do; one may be in several buckets."""
    tests = F.array_compact(F.array(*[F.when(F.col("content").rlike(p), F.lit(b)) for b, p in _BUCKETS.items()]))
    return _events(spark, sf_dir).filter("event_type = 'message'").select("event_id", F.explode(tests).alias("bucket"))


@query(f"WITH {_ONCE} SELECT project_key, arg_min(project_label, (coalesce(timestamp, ''), logical_session_id, sequence, event_id)) AS label FROM e WHERE project_key IS NOT NULL AND project_label IS NOT NULL GROUP BY 1")
def r_w09_first_labels(spark, sf_dir):
    """The label each project had first."""
    rows = _events(spark, sf_dir).filter("project_key IS NOT NULL AND project_label IS NOT NULL")
    return rows.groupBy("project_key").agg(F.min_by("project_label", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(ev.total_order())])).alias("label"))


@query(f"WITH {_ONCE}, {_FILES_ONCE} SELECT coalesce(f.agent_name, 'unknown') AS agent, e.source_agent = f.agent_name AS agrees, count(*) AS n FROM e LEFT JOIN f USING (source_file_id) GROUP BY 1, 2")
def r_j01_source_join(spark, sf_dir):
    """Events against the agent their file names."""
    files = table(spark, sf_dir, "source_files").groupBy("source_file_id").agg(F.min("agent_name").alias("agent_name"))
    joined = _events(spark, sf_dir).join(files, "source_file_id", "left")
    return joined.groupBy(F.coalesce("agent_name", F.lit("unknown")).alias("agent"), (F.col("source_agent") == F.col("agent_name")).alias("agrees")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_ONCE}, c AS (SELECT source_file_id, call_id, min(event_id) AS call FROM e WHERE event_type IN ('tool_call', 'patch') AND call_id IS NOT NULL GROUP BY 1, 2) SELECT call, r.event_id AS result FROM c LEFT JOIN (SELECT * FROM e WHERE event_type IN ('tool_result', 'error')) r USING (source_file_id, call_id)")
def r_j05_calls_with_results(spark, sf_dir):
    """Every call with each result that answers it, once with none where it has no result."""
    events = _events(spark, sf_dir).filter("call_id IS NOT NULL")
    calls = events.filter("event_type IN ('tool_call', 'patch')").groupBy("source_file_id", "call_id").agg(F.min("event_id").alias("call"))
    results = events.filter("event_type IN ('tool_result', 'error')").select("source_file_id", "call_id", F.col("event_id").alias("result"))
    return calls.join(results, ["source_file_id", "call_id"], "left").select("call", "result")


@query(
    r"WITH l AS (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS lines FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)), x AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS line, unnest(lines) AS content FROM l), y AS (SELECT doc_id, line, unnest(["
    "CASE WHEN contains(lower(content), 'tombstone') THEN 'DENIED_1' END, CASE WHEN contains(lower(content), 'the ledger') THEN 'DENIED_2' END]) AS rule FROM x) SELECT doc_id, line, rule FROM y WHERE rule IS NOT NULL"
)
def r_y01_denied_terms(spark, sf_dir):
    """Lines of documents that hold a denied term, which is named by its place only."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").distinct()
    return release.scan(docs, "doc_id", F.col("text"), [], ["tombstone", "The Ledger"])


@query()
def r_y01_release_scan(spark, sf_dir):
    """Lines of documents and event contents that show what must not be released, by the whole set of rules."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("at"), "text").distinct()
    events = _events(spark, sf_dir).select(F.concat(F.lit("event:"), "event_id").alias("at"), F.col("content").alias("text"))
    return release.scan(docs.unionByName(events), "at", F.col("text"))


@query("WITH s AS (SELECT source_file_id AS path, count(*) AS n FROM source_files GROUP BY 1), e AS (SELECT DISTINCT source_file_id AS path FROM unified_events) SELECT path, 'repeated' AS message FROM s WHERE n > 1 UNION ALL SELECT path, 'unexpected' FROM s WHERE path NOT IN (SELECT path FROM e) UNION ALL SELECT path, 'missing' FROM e WHERE path NOT IN (SELECT path FROM s)")
def r_s09_snapshot_errors(spark, sf_dir):
    """What is wrong with the file table as a snapshot of the files the events come from."""
    files = table(spark, sf_dir, "source_files").select(F.col("source_file_id").alias("path"), F.coalesce("frozen_size", F.lit(0)).alias("size"), F.sha2("path", 256).alias("sha256"))
    expected = table(spark, sf_dir, "unified_events").select(F.col("source_file_id").alias("path")).distinct()
    return snapshots.snapshot_errors(files, expected)


@query(f"WITH {_ONCE} SELECT DISTINCT event_type, role, evidence_grade FROM e")
def r_u01_distinct_kinds(spark, sf_dir):
    """The kinds of events there are."""
    return _events(spark, sf_dir).select("event_type", "role", "evidence_grade").distinct()


@query("SELECT DISTINCT session_id FROM unified_events WHERE session_id NOT IN (SELECT session_id FROM raw_events WHERE session_id IS NOT NULL)")
def r_u03_sessions_without_raw(spark, sf_dir):
    """Sessions of the event table that the raw events don't have."""
    return table(spark, sf_dir, "unified_events").select("session_id").distinct().exceptAll(table(spark, sf_dir, "raw_events").select("session_id").filter("session_id IS NOT NULL").distinct())


@query(f"WITH {_ONCE}, a AS (SELECT project_key, min(event_id) AS event_id FROM e WHERE role = 'user' AND project_key IS NOT NULL GROUP BY 1) SELECT e.event_id, CASE WHEN a.event_id IS NOT NULL THEN 'primary_user' WHEN e.actor_kind IN ('native_user', 'unknown_user') AND e.project_key LIKE 'prj-%' THEN 'member' ELSE e.actor_kind END AS actor FROM e LEFT JOIN a ON a.event_id = e.event_id")
def r_v20_effective_actors(spark, sf_dir):
    """Actors after attributing each project's first user event, and its undetermined users."""
    events = _events(spark, sf_dir)
    first = events.filter("role = 'user' AND project_key IS NOT NULL").groupBy("project_key").agg(F.min("event_id").alias("event_id")).select("event_id", F.lit("primary_user").alias("actor"))
    lanes = events.filter("project_key LIKE 'prj-%'").select("project_key", F.lit("member").alias("actor")).distinct()
    return review.effective_actor(events, first, lanes)


@query(
    f"""WITH {_ONCE}, x AS (SELECT sha256(content) AS k, project_key FROM e WHERE event_type = 'tool_call'), g AS (SELECT k, count(DISTINCT project_key) AS n FROM x GROUP BY 1)
    SELECT 'scope' AS rule, k AS location, 'fewer than 3 projects' AS message FROM g WHERE n = 2"""
)
def r_v27_global_scope(spark, sf_dir):
    """Calls made in more than one project, and so called global, that touch fewer than three."""
    events = _events(spark, sf_dir)
    calls = events.filter("event_type = 'tool_call'").select(F.sha2("content", 256).alias("k"), "event_id", "project_key")
    several = calls.groupBy("k").agg(F.countDistinct("project_key").alias("n")).filter("n > 1").select("k", F.lit("global").alias("scope"))
    return review.too_few_projects(calls.select("k", "event_id").join(several, "k"), "k", events, 3, "scope")


@query(
    r"""WITH d AS (SELECT DISTINCT doc_id, title, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:48] AS stem FROM documents WHERE title IS NOT NULL AND title = regexp_replace(title, '[^\x00-\x7F]', '', 'g'))
    SELECT doc_id, CASE WHEN stem = '' THEN 'project' ELSE stem END || '-' || sha256(title)[1:10] || '.md' AS slug FROM d"""
)
def r_p13_slugs(spark, sf_dir):
    """The file name of every title in ASCII; others are tested on fixtures."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "title").filter(r"title IS NOT NULL AND NOT title RLIKE '[^\\x00-\\x7F]'").distinct()
    return docs.select("doc_id", fx.slug(folded("title"), F.col("title")).alias("slug"))


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").groupBy("path").agg(F.min("project_key").alias("project_key"), F.min("doc_id").alias("doc_id"))
    after = docs.select("project_key", F.col("path").alias("target_path"), (F.col("doc_id") - 1).alias("doc_id"))
    edges = docs.join(after, ["project_key", "doc_id"]).select(F.col("doc_id").alias("position"), F.col("path").alias("source_path"), "target_path", F.lit("follows").alias("relation"), F.lit("directed").alias("direction"), F.lit("confirmed").alias("status"))
    return docs, edges


@query(
    """WITH d AS (SELECT path, min(project_key) AS project_key, min(doc_id) AS doc_id FROM documents GROUP BY 1), e AS (SELECT a.doc_id AS position, a.path AS s, b.path AS t FROM d a JOIN d b ON a.project_key = b.project_key AND b.doc_id = a.doc_id + 1),
    sel AS (SELECT path AS task_id, path FROM d), f AS (SELECT task_id, t AS path, position, 'follows' AS relation, 'forward' AS traversal FROM sel JOIN e ON s = path UNION ALL SELECT task_id, s, position, 'reverse of follows', 'reverse' FROM sel JOIN e ON t = path),
    r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY position, path) AS n FROM f WHERE path <> task_id) SELECT task_id, path, relation, traversal FROM r WHERE n <= 2"""
)
def r_h04_one_hop(spark, sf_dir):
    """The neighbours of every document, at most two each."""
    docs, edges = _links(spark, sf_dir)
    return retrieval.one_hop(docs.select(F.col("path").alias("task_id"), "path"), edges, 2).select("task_id", "path", "relation", "traversal")
