"""Queries of the snapshot, publication, membership, ingest and lifecycle operators over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as fx
from loomspark.operators import evidence as ev
from loomspark.operators import lifecycle, publication, ranges, retrieval, review, snapshots
from loomspark.plans.evidence_queries import _ONCE, _SEMANTIC, _events
from loomspark.session import table
from loomspark.sources import adapters
from loomspark.streaming import ingest

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_SKIP = "'.git', 'node_modules', 'plugins', 'skills', 'cache', 'caches', 'file-history', 'binaries', 'connectors', 'connectors-marketplace', 'downloads', 'assets', 'docs', 'documentation'"


@query(
    rf"""WITH p AS (SELECT DISTINCT path, string_split(path, '/') AS parts FROM source_files), q AS (SELECT path, parts, parts[-1] AS name, lower(regexp_extract(parts[-1], '\.([A-Za-z0-9]+)$', 1)) AS suffix FROM p)
    SELECT path, ((suffix IN ('jsonl', 'ndjson', 'json', 'md', 'db', 'sqlite', 'sqlite3') AND (suffix <> 'md' OR regexp_matches(name, '(?i)session|conversation|history|chat|transcript|rollout|project|composer') OR regexp_matches(name, '(?i)-chunk-\d+\.md$')))
      OR (suffix = '' AND regexp_matches(name, '(?i)session|conversation|history|chat|transcript|rollout|project|composer')))
      AND NOT list_has_any(list_transform(parts[1:-2], lambda x: lower(x)), [{_SKIP}]) AND len(parts) <= 12 AS candidate FROM q"""
)
def r_s02_candidates(spark, sf_dir):
    """Which paths may hold sessions."""
    return table(spark, sf_dir, "source_files").select("path").distinct().select("path", snapshots.is_candidate(F.col("path")).alias("candidate"))


@query("SELECT root, count(DISTINCT path) AS candidates, count(DISTINCT path) FILTER (WHERE mtime_ns IS NOT NULL) AS accepted, CASE WHEN count(DISTINCT path) > 500 THEN 'truncated_by_max_files' END AS gap FROM source_files GROUP BY 1")
def r_s07_coverage(spark, sf_dir):
    """Files found and taken of each root."""
    files = table(spark, sf_dir, "source_files")
    return snapshots.coverage(files, files.filter("mtime_ns IS NOT NULL"), 500)


@query(
    """WITH f AS (SELECT source_file_id AS path, min(frozen_size) AS size, coalesce(min(inode)::VARCHAR, '') AS body FROM source_files GROUP BY 1), b AS (SELECT path, size, md5(body) AS sha256 FROM f WHERE path < 'e'),
    a AS (SELECT path, size + CASE WHEN path < '6' THEN 10 ELSE 0 END AS size, md5(CASE WHEN path < '8' THEN 'x' ELSE '' END || body) AS sha256, md5(CASE WHEN path BETWEEN '3' AND '5' THEN 'y' ELSE '' END || body) AS prefix FROM f WHERE path > '1')
    SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.sha256 IS NULL THEN 'added' WHEN a.sha256 IS NULL THEN 'missing' WHEN a.sha256 = b.sha256 THEN 'same' WHEN a.size > b.size AND a.prefix = b.sha256 THEN 'appended' ELSE 'rewritten' END AS change
    FROM b FULL OUTER JOIN a USING (path)"""
)
def r_i01_source_changes(spark, sf_dir):
    """Sources added, missing, same, appended or rewritten (also such as grew) between two snapshots made of the file table."""
    files = table(spark, sf_dir, "source_files").groupBy(F.col("source_file_id").alias("path")).agg(F.min("frozen_size").alias("size"), F.coalesce(F.min("inode").cast("string"), F.lit("")).alias("body"))
    before = files.filter("path < 'e'").select("path", "size", F.md5("body").alias("sha256"))
    now = F.md5(F.concat(F.when(F.col("path") < "8", "x").otherwise(""), F.col("body")))
    prefix = F.md5(F.concat(F.when(F.col("path").between("3", "5"), "y").otherwise(""), F.col("body")))
    after = files.filter("path > '1'").select("path", (F.col("size") + F.when(F.col("path") < "6", 10).otherwise(0)).alias("size"), now.alias("sha256"), prefix.alias("prefix_sha256"))
    return snapshots.source_changes(before, after)


@query(
    """WITH s AS (SELECT DISTINCT path, lower(replace(trim(adapter), '_', '-')) AS adapter, CASE WHEN regexp_matches(path, '[0-4][^/]*$') THEN 2 ELSE 1 END AS score FROM source_files),
    t AS (SELECT path, count(*) AS n, min(adapter) AS adapter FROM (SELECT *, rank() OVER (PARTITION BY path ORDER BY score DESC) AS place FROM s) WHERE place = 1 GROUP BY 1)
    SELECT path, CASE WHEN n = 1 THEN adapter END AS adapter, CASE WHEN n > 1 THEN 'tie' END AS reason FROM t"""
)
def r_s04_identified(spark, sf_dir):
    """The adapter of each path of the file table; paths that several claim alike have none."""
    files = table(spark, sf_dir, "source_files")
    scores = files.select("path", F.lower(F.replace(F.trim("adapter"), F.lit("_"), F.lit("-"))).alias("adapter"), F.when(F.col("path").rlike(r"[0-4][^/]*$"), 2).otherwise(1).alias("score")).distinct()
    return snapshots.identified(files, scores)


@query(
    """WITH f AS (SELECT path, min(lower(replace(trim(adapter), '_', '-'))) AS adapter, max(frozen_size) AS size FROM source_files GROUP BY 1), k AS (SELECT unnest(['codex-jsonl', 'clacky-json', 'clacky-chunk', 'claude-code-jsonl', 'workbuddy-jsonl', 'neo-claude-jsonl', 'cursor-agent-jsonl', 'opened-later']) AS adapter),
    g AS (SELECT adapter, count(*) AS files, sum(size) AS bytes FROM f GROUP BY 1) SELECT adapter, coalesce(files, 0) AS files, coalesce(bytes, 0) AS bytes, CASE WHEN files IS NULL THEN 'no_current_sample' ELSE 'found' END AS status FROM k FULL JOIN g USING (adapter)"""
)
def r_s13_inventory(spark, sf_dir):
    """Files and bytes of every adapter known, and of those only the files name."""
    files = table(spark, sf_dir, "source_files").groupBy("path").agg(F.min(F.lower(F.replace(F.trim("adapter"), F.lit("_"), F.lit("-")))).alias("adapter"), F.max("frozen_size").alias("size"))
    return snapshots.inventory(files, [*adapters.ADAPTERS, "opened-later"])


@query(
    """WITH k AS (SELECT lower(replace(trim(adapter), '-', '_')) AS adapter, record, unnest(json_keys(record::JSON)) AS field FROM adapter_records), t AS (SELECT adapter, field, json_type(record::JSON, '$."' || field || '"') AS kind FROM k)
    SELECT adapter, list_sort(list(DISTINCT field || ':' || CASE kind WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'UBIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'decimal' WHEN 'NULL' THEN 'void' ELSE lower(kind) END)) AS fields FROM t GROUP BY 1"""
)
def r_s14_fingerprints(spark, sf_dir):
    """Field names and types seen for each adapter, without values."""
    rows = table(spark, sf_dir, "adapter_records").select(F.lower(F.replace(F.trim("adapter"), F.lit("-"), F.lit("_"))).alias("adapter"), "record")
    out = snapshots.fingerprints(rows, ["adapter"])
    return out.select("adapter", F.array_sort(F.array_distinct(F.transform("fields", lambda f: F.regexp_replace(f, ":double$", ":decimal")))).alias("fields"))


@query(f"WITH {_ONCE} SELECT project_key, count(*) AS n FROM (SELECT coalesce(CASE WHEN event_type = 'error' THEN 'prj-errors' END, project_key) AS project_key FROM e) WHERE project_key IS NOT NULL GROUP BY 1")
def r_b01_membership(spark, sf_dir):
    """Events of each project after sending all errors to a project of their own."""
    events = _events(spark, sf_dir)
    moved = events.filter("event_type = 'error'").select("event_id", F.lit("prj-errors").alias("target"))
    return review.membership(events, moved).filter("target IS NOT NULL").groupBy(F.col("target").alias("project_key")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_ONCE}, a AS (SELECT DISTINCT project_key AS source, session_title AS target FROM e WHERE project_key IS NOT NULL AND session_title IS NOT NULL)
    SELECT 'merge' AS operation, target AS project_key FROM a GROUP BY target HAVING count(DISTINCT source) >= 2 UNION ALL SELECT 'split', source FROM a GROUP BY source HAVING count(DISTINCT target) >= 2"""
)
def r_g14_merges_and_splits(spark, sf_dir):
    """Titles that several projects share, and projects with several titles."""
    rows = _events(spark, sf_dir).filter("project_key IS NOT NULL AND session_title IS NOT NULL").select(F.col("project_key").alias("source"), F.col("session_title").alias("target"))
    return review.derived_membership(rows)


def _knowledge(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents, claims (contents of deliveries), feedback (user messages) and rules (repeated statements) as the data has them."""
    docs = table(spark, sf_dir, "documents").groupBy("path").agg(F.min("title").alias("title"), F.min("project_key").alias("project_key"))
    body = F.sha2(fx.collapsed(F.col("content")), 256)
    events = _events(spark, sf_dir).filter("project_key IS NOT NULL")
    none = F.array().cast("array<string>")
    said = events.filter("event_type IN ('delivery', 'error')").groupBy("project_key", F.concat_ws("/", "project_key", body).alias("claim_id")).agg(F.min("content").alias("statement")).select("*", none.alias("conflicts"), none.alias("supersedes"))
    asked = events.filter("event_type = 'message' AND role = 'user'").select("project_key", F.col("event_id").alias("feedback_id"), F.col("content").alias("statement"))
    named = asked.select(F.sha2(fx.collapsed(F.col("statement")), 256).alias("evolution_id"), "feedback_id", "statement")
    repeated = named.groupBy("evolution_id").agg(F.min("statement").alias("rule"), F.countDistinct("feedback_id").alias("n")).filter("n > 1").drop("n")
    rules = repeated.join(named.select("evolution_id", "feedback_id"), "evolution_id")  # a row per signal
    return docs, said, asked, rules.withColumn("promoted_claim_id", F.lit(None).cast("string"))


_KNOWLEDGE_SQL = f"""docs AS (SELECT path, min(project_key) AS project_key FROM documents GROUP BY 1), p AS (SELECT *, {_SEMANTIC} AS body FROM e WHERE project_key IS NOT NULL),
    claims AS (SELECT DISTINCT project_key, project_key || '/' || body AS claim_id FROM p WHERE event_type IN ('delivery', 'error')), asked AS (SELECT project_key, event_id, body FROM p WHERE event_type = 'message' AND role = 'user'),
    rules AS (SELECT body FROM asked GROUP BY 1 HAVING count(DISTINCT event_id) > 1),
    owner AS (SELECT project_key, min(path) AS path FROM docs WHERE project_key IS NOT NULL GROUP BY 1),
    edges AS (SELECT d.path AS source, c.claim_id AS target, 'contains-claim' AS relation FROM owner d JOIN claims c USING (project_key) UNION SELECT d.path, a.event_id, 'records-feedback' FROM owner d JOIN asked a USING (project_key)
      UNION SELECT a.event_id, r.body, 'supports-evolution' FROM asked a JOIN rules r USING (body))"""


@query(
    f"""WITH {_ONCE}, {_KNOWLEDGE_SQL}, every AS (SELECT * FROM edges UNION SELECT o.path, 'assert/' || p.event_id, 'contains-assertion' FROM p JOIN owner o USING (project_key) WHERE event_type = 'status'
      UNION SELECT o.path, claim_id, 'evidence-for-claim' FROM claims c JOIN owner o USING (project_key) UNION SELECT a.path, b.path, 'follows' FROM (SELECT path, min(project_key) AS k, min(doc_id) AS i FROM documents GROUP BY 1) a JOIN (SELECT path, min(project_key) AS k, min(doc_id) AS i FROM documents GROUP BY 1) b ON a.k = b.k AND b.i = a.i + 1)
    SELECT relation, count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets FROM every GROUP BY 1"""
)
def r_h02_graph(spark, sf_dir):
    """Edges of the knowledge graph by relation."""
    docs, claims, feedback, rules = _knowledge(spark, sf_dir)
    states = _events(spark, sf_dir).filter("event_type = 'status' AND project_key IS NOT NULL").select(F.concat(F.lit("assert/"), "event_id").alias("assertion_id"), "project_key")
    numbered = table(spark, sf_dir, "documents").groupBy("path").agg(F.min("project_key").alias("project_key"), F.min("doc_id").alias("doc_id"))
    after = numbered.select("project_key", F.col("path").alias("target_path"), (F.col("doc_id") - 1).alias("doc_id"))
    follows = numbered.join(after, ["project_key", "doc_id"]).select(F.col("path").alias("source_path"), "target_path", F.lit("follows").alias("relation"))
    made = publication.edges(docs, claims, feedback, rules, states, claims.select("claim_id", "project_key"), follows)
    return made.groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"), F.countDistinct("target").alias("targets"))


@query(f"WITH {_ONCE}, {_KNOWLEDGE_SQL} SELECT path, count(source) AS links FROM docs LEFT JOIN edges ON source = path GROUP BY 1")
def r_g13_link_audit(spark, sf_dir):
    """Links of every document."""
    docs, *rest = _knowledge(spark, sf_dir)
    return publication.link_audit(docs, publication.edges(docs, *rest))


@query(
    f"""WITH {_ONCE}, {_KNOWLEDGE_SQL}, kept AS (SELECT path FROM docs WHERE path NOT LIKE '%7.md'), idx AS (SELECT CASE WHEN path LIKE '%3.md' THEN '../' || path ELSE path END AS path FROM docs),
    bad AS (SELECT DISTINCT source, target, relation FROM edges WHERE source LIKE '%7.md') SELECT 'an end does not exist' AS message, count(*) AS n FROM bad UNION ALL SELECT 'document is not in the index', count(*) FROM kept WHERE path LIKE '%3.md' UNION ALL SELECT 'document is not in the graph', count(*) FROM idx WHERE path NOT IN (SELECT path FROM kept)
      UNION ALL SELECT 'unsafe path', count(*) FROM idx WHERE path LIKE '../%' UNION ALL SELECT 'node is not unique', count(*) FROM claims"""
)
def r_h05_graph_errors(spark, sf_dir):
    """What is wrong with the graph after some documents left it, others moved out of the folder in the index, and claims were written twice."""
    docs, claims, feedback, rules = _knowledge(spark, sf_dir)
    nodes = publication.nodes(docs.filter("path NOT LIKE '%7.md'"), claims.unionByName(claims), feedback, rules.dropDuplicates(["evolution_id"]))
    index = docs.withColumn("path", F.when(F.col("path").like("%3.md"), F.concat(F.lit("../"), "path")).otherwise(F.col("path")))
    return publication.graph_errors(nodes, publication.edges(docs, claims, feedback, rules), index).groupBy("message").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH d AS (SELECT path, min(project_key) AS project_key, min(doc_id) AS doc_id FROM documents GROUP BY 1), e AS (SELECT a.path AS source_path, b.path AS target_path, a.doc_id * 1000000 + b.doc_id AS edge_id FROM d a JOIN d b ON a.project_key = b.project_key AND b.doc_id = a.doc_id + 1)
    SELECT edge_id, source_path AS path, target_path AS other, 'follows' AS relation FROM e UNION ALL SELECT edge_id, target_path, source_path, 'reverse of follows' FROM e"""
)
def r_h03_reciprocal_links(spark, sf_dir):
    """Both directions of the links between neighbouring documents of a project."""
    docs = table(spark, sf_dir, "documents").groupBy("path").agg(F.min("project_key").alias("project_key"), F.min("doc_id").alias("doc_id"))
    after = docs.select("project_key", F.col("path").alias("target_path"), (F.col("doc_id") - 1).alias("doc_id"))
    links = docs.join(after, ["project_key", "doc_id"]).select((F.col("doc_id") * 1_000_000 + F.col("doc_id") + 1).alias("edge_id"), F.col("path").alias("source_path"), "target_path", F.lit("follows").alias("relation"), F.lit("directed").alias("direction"), F.lit("confirmed").alias("status"))
    return retrieval.reciprocal_links(links)


@query(
    f"""WITH {_ONCE}, o AS (SELECT event_id, source_file_id AS path, project_key, content FROM e WHERE event_type <> 'status'), n AS (SELECT event_id, source_file_id AS path, project_key, content FROM e WHERE event_type IN ('status', 'message')),
    kept AS (SELECT * FROM o WHERE path >= '4') SELECT path, count(*) AS n, sum(length(content)) AS chars FROM (SELECT * FROM kept UNION ALL SELECT * FROM n WHERE event_id NOT IN (SELECT event_id FROM kept)) GROUP BY 1"""
)
def r_i03_merge(spark, sf_dir):
    """The event table after a run that replaced some sources and extended the others."""
    events = _events(spark, sf_dir).select("event_id", F.col("source_file_id").alias("path"), "project_key", "content", "event_type")
    old, new = events.filter("event_type <> 'status'").drop("event_type"), events.filter("event_type IN ('status', 'message')").drop("event_type")
    actions = events.select("path", F.when(F.col("path") < "4", "parse").otherwise("tail").alias("action")).distinct()
    return ingest.merge(old, new, actions).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


@query(f"WITH {_ONCE} SELECT DISTINCT project_key FROM e WHERE event_type IN ('error', 'delivery') AND project_key IS NOT NULL")
def r_g09_affected_projects(spark, sf_dir):
    """Projects with an event that changed, came or went between two versions."""
    events = _events(spark, sf_dir)
    after = events.filter("event_type <> 'delivery'").withColumn("content", F.when(F.col("event_type") == "error", F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return ingest.affected_projects(events, after, ["content"])


@query(
    """SELECT doc_id, list_filter([CASE WHEN recheck_after <= '2025-09-01' THEN 'recheck_after' END, CASE WHEN retain_until <= '2025-09-01' THEN 'retain_until' END], lambda x: x IS NOT NULL) AS reasons
    FROM (SELECT DISTINCT doc_id, strftime(created_at + INTERVAL 90 DAY, '%Y-%m-%d') AS recheck_after, strftime(created_at + INTERVAL 365 DAY, '%Y-%m-%d') AS retain_until FROM documents) WHERE recheck_after <= '2025-09-01' OR retain_until <= '2025-09-01'"""
)
def r_l08_due(spark, sf_dir):
    """Documents due for another look, or at the end of their keeping time."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.date_format(F.col("created_at") + F.expr("INTERVAL 90 DAY"), "yyyy-MM-dd").alias("recheck_after"), F.date_format(F.col("created_at") + F.expr("INTERVAL 365 DAY"), "yyyy-MM-dd").alias("retain_until")).distinct()
    return lifecycle.due(docs, "2025-09-01").select("doc_id", "reasons")


_SPANS = """s AS (SELECT logical_session_id AS k, session_id, min(sequence) - 1 AS start, max(sequence) AS "end" FROM e GROUP BY ALL), l AS (SELECT *, max("end") OVER (PARTITION BY k) AS length FROM s),
    o AS (SELECT *, coalesce(max("end") OVER (PARTITION BY k ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM l)"""


def _spans(spark: SparkSession, sf_dir: str, longer: int = 0) -> DataFrame:
    from pyspark.sql import Window

    spans = _events(spark, sf_dir).groupBy(F.col("logical_session_id").alias("k"), "session_id").agg((F.min("sequence") - 1).alias("start"), (F.max("sequence") + longer).alias("end"))
    return spans.withColumn("length", F.max("end").over(Window.partitionBy("k")))


@query(f"""WITH {_ONCE}, {_SPANS} SELECT k, reach AS start, start AS "end" FROM o WHERE start > reach""")
def r_w06_uncovered(spark, sf_dir):
    """Stretches of conversations that none of their sessions covers."""
    return ranges.uncovered(_spans(spark, sf_dir), "k")


@query(f"""WITH {_ONCE}, {_SPANS.replace('max(sequence) AS "end"', 'max(sequence) + 2 AS "end"')} SELECT k, session_id, start, "end", length FROM o WHERE start < reach""")
def r_j07_overlaps(spark, sf_dir):
    """Sessions of a conversation that begin before an earlier one, taken to be two rows longer, ends."""
    return ranges.overlapping(_spans(spark, sf_dir, 2), "k")


@query(
    f"""WITH {_ONCE}, x AS (SELECT logical_session_id AS k, CASE WHEN event_type = 'delivery' THEN 'prj-other' ELSE project_key END AS project_key, CASE WHEN event_type = 'error' THEN event_id || 'x' ELSE event_id END AS event_id FROM e WHERE project_key IS NOT NULL),
    i AS (SELECT DISTINCT k, project_key FROM x) SELECT rule, location FROM (
      SELECT 'id' AS rule, k AS location FROM i GROUP BY k HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'project', x.k FROM x JOIN e USING (event_id) WHERE e.project_key <> x.project_key UNION ALL SELECT DISTINCT 'event', k FROM x WHERE event_id NOT IN (SELECT event_id FROM e))"""
)
def r_j04_evidence_checks(spark, sf_dir):
    """Violations among items made of conversations, some of them under another project or citing events that don't exist: ids that repeat, evidence that is missing or of another project."""
    events = _events(spark, sf_dir)
    project = F.when(F.col("event_type") == "delivery", "prj-other").otherwise(F.col("project_key"))
    event = F.when(F.col("event_type") == "error", F.concat("event_id", F.lit("x"))).otherwise(F.col("event_id"))
    cited = events.filter("project_key IS NOT NULL").select(F.col("logical_session_id").alias("k"), project.alias("project_key"), event.alias("event_id"))
    parts = [review.repeated(cited.select("k", "project_key").distinct(), "k", "id"), review.foreign_evidence(cited, "k", events, "project"), review.unknown_evidence(cited, "k", events, "event")]
    return review.union(parts).select("rule", "location")


@query(f"""WITH {_ONCE}, c AS (SELECT path, project_key FROM documents GROUP BY ALL) SELECT path FROM c WHERE project_key IS NOT NULL AND project_key NOT IN (SELECT project_key FROM e WHERE project_key IS NOT NULL)""")
def r_u04_stale_paths(spark, sf_dir):
    """Published paths of projects that have no events any more."""
    docs = table(spark, sf_dir, "documents").filter("project_key IS NOT NULL").select("path", "project_key").distinct()
    current = docs.join(_events(spark, sf_dir).select("project_key").distinct(), "project_key", "left_semi")
    return publication.stale_paths(docs, current)


@query()
def r_h01_components(spark, sf_dir):
    """Connected components of sessions that share a project, by large-star and small-star steps."""
    events = _events(spark, sf_dir).filter("project_key IS NOT NULL")
    return ev.connected_components(events.select(F.concat(F.lit("p:"), F.col("project_key")).alias("a"), F.concat(F.lit("s:"), F.col("session_id")).alias("b")).distinct())
