"""Queries of the pages, hashes and gates over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import canonical, gates, pages, search
from loomspark.operators import evidence as ev
from loomspark.plans.evidence_queries import _ONCE, _events, _set_hash
from loomspark.session import table
from loomspark.sources.adapters import ADAPTERS

QUERIES = {}
ORACLES: dict[str, str] = {}
_ORDER = "coalesce(timestamp, ''), logical_session_id, sequence, event_id"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(
    f"""WITH {_ONCE}, c AS (SELECT project_key, event_id, row_number() OVER (PARTITION BY project_key ORDER BY {_ORDER}) - 1 AS pos FROM e WHERE project_key IS NOT NULL),
    p AS (SELECT project_key, pos // 4096 AS part, count(*) AS n, sha256(string_agg(event_id, chr(10) ORDER BY pos)) AS h FROM c GROUP BY 1, 2), s AS (SELECT project_key, {_set_hash('event_id')} AS set_sha256 FROM c GROUP BY 1)
    SELECT project_key, sum(n)::BIGINT AS n, sha256(string_agg(h, chr(10) ORDER BY part)) AS ordered_sha256, any_value(set_sha256) AS set_sha256 FROM p JOIN s USING (project_key) GROUP BY 1"""
)
def r_p22_chain_hashes(spark, sf_dir):
    """Length, ordered hash and set hash of every project's chain of events."""
    return canonical.chain_hashes(_events(spark, sf_dir).filter("project_key IS NOT NULL"), ["project_key"], ev.total_order(), F.col("event_id"))


@query(
    f"""WITH {_ONCE}, c AS (SELECT project_key, event_id, row_number() OVER (PARTITION BY project_key ORDER BY {_ORDER}) - 1 AS pos FROM e WHERE project_key IS NOT NULL)
    SELECT project_key, pos // 50 AS slice, count(*) AS n, sha256(string_agg(event_id, chr(10) ORDER BY pos)) AS ordered_sha256 FROM c GROUP BY 1, 2"""
)
def r_w07_slices(spark, sf_dir):
    """The hash of every slice of 50 events of every project, as a receipt binds it."""
    return canonical.slice_hashes(_events(spark, sf_dir).filter("project_key IS NOT NULL"), "project_key", ev.total_order(), F.col("event_id"), 50)


@query(
    f"""WITH {_ONCE}, c AS (SELECT project_key, event_id, event_type, row_number() OVER (PARTITION BY project_key ORDER BY {_ORDER}) - 1 AS pos FROM e WHERE project_key IS NOT NULL),
    d AS (SELECT project_key, event_id, row_number() OVER (PARTITION BY project_key ORDER BY {_ORDER}) - 1 AS pos FROM e WHERE project_key IS NOT NULL AND event_type <> 'error'),
    old AS (SELECT project_key, pos // 50 AS slice, count(*) AS n, string_agg(event_id, ',' ORDER BY pos) AS h FROM c GROUP BY 1, 2), new AS (SELECT project_key, pos // 50 AS slice, count(*) AS n, string_agg(event_id, ',' ORDER BY pos) AS h FROM d GROUP BY 1, 2)
    SELECT message, count(*) AS n FROM (SELECT CASE WHEN new.h IS NULL THEN 'no such slice' WHEN old.h <> new.h THEN 'slice has changed' END AS message FROM old LEFT JOIN new USING (project_key, slice)) WHERE message IS NOT NULL GROUP BY 1"""
)
def r_v09_receipts(spark, sf_dir):
    """Receipts of slices that don't hold any more once the errors are gone."""
    chain = _events(spark, sf_dir).filter("project_key IS NOT NULL")
    old = canonical.slice_hashes(chain, "project_key", ev.total_order(), F.col("event_id"), 50)
    new = canonical.slice_hashes(chain.filter("event_type <> 'error'"), "project_key", ev.total_order(), F.col("event_id"), 50)
    return canonical.receipt_errors(old, new, "project_key").groupBy("message").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_ONCE}, p AS (SELECT DISTINCT concat_ws(chr(0), project_key, event_id) AS pair FROM e WHERE project_key IS NOT NULL) SELECT count(*) AS n, {_set_hash('pair')} AS sha256 FROM p")
def r_p24_partition(spark, sf_dir):
    """The hash of how events are parted among projects."""
    return canonical.partition_hash(_events(spark, sf_dir).filter("project_key IS NOT NULL"))


@query(
    f"""WITH {_ONCE} SELECT message, count(*) AS n FROM (SELECT CASE WHEN n.event_id IS NULL THEN 'event is gone' WHEN n.event_type = 'delivery' THEN 'evidence has changed' ELSE 'kept' END AS message FROM e LEFT JOIN (SELECT * FROM e WHERE event_type <> 'status') n USING (event_id)) GROUP BY 1"""
)
def r_b02_rebase(spark, sf_dir):
    """Assignments carried over to events of which the states are gone and the deliveries changed."""
    events = _events(spark, sf_dir).select("event_id", F.col("project_key").alias("target"), F.sha2("content", 256).alias("content_sha256"), "event_type")
    now = events.filter("event_type <> 'status'").withColumn("content_sha256", F.when(F.col("event_type") == "delivery", F.concat(F.lit("x"), "content_sha256")).otherwise(F.col("content_sha256")))
    kept, errors = canonical.rebase(events.drop("event_type"), now)
    return kept.select(F.lit("kept").alias("message")).unionByName(errors.select("message")).groupBy("message").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_ONCE} SELECT project_key, list_sort(list(DISTINCT source_agent)) AS agents, count(DISTINCT session_id) AS sessions, min(nullif(timestamp, '')) AS first_at, max(nullif(timestamp, '')) AS last_at, count(*) AS n, count_if(event_type = 'message' AND role = 'user') AS asked,
    count_if(event_type = 'message' AND role = 'assistant') AS answered, count_if(event_type IN ('tool_call', 'patch')) AS acted, count_if(event_type = 'delivery') AS delivered, count_if(event_type = 'error') AS failed FROM e WHERE project_key IS NOT NULL GROUP BY 1"""
)
def r_x08_dossier_figures(spark, sf_dir):
    """The figures at the head of every project's dossier."""
    return pages.dossier_figures(_events(spark, sf_dir))


@query()
def r_x08_dossiers(spark, sf_dir):
    """Every project's dossier as a page."""
    return pages.dossiers(_events(spark, sf_dir), ev.total_order())


@query(
    f"""WITH {_ONCE}, l AS (SELECT project_key, arg_min(project_label, ({_ORDER})) AS title FROM e WHERE project_key IS NOT NULL AND project_label IS NOT NULL GROUP BY 1), p AS (SELECT DISTINCT project_key FROM e WHERE project_key IS NOT NULL),
    t AS (SELECT project_key, coalesce(title, project_key) AS title FROM p LEFT JOIN l USING (project_key)), s AS (SELECT *, regexp_replace(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g')[1:48] AS stem FROM t)
    SELECT project_key, title, 'projects/' || CASE WHEN stem = '' THEN 'project' ELSE stem END || '-' || sha256(project_key)[1:10] || '.md' AS path FROM s"""
)
def r_x09_index(spark, sf_dir):
    """Title and path of every project's page in the draft index; its keywords are those of r_t02_project_keywords."""
    return pages.index_entries(_events(spark, sf_dir), ev.total_order()).select("project_key", "title", "path")


@query(
    f"""WITH {_ONCE}, f AS (SELECT DISTINCT source_file_id, lower(replace(trim(adapter), '_', '-')) AS adapter FROM source_files), c AS (SELECT adapter, count(*) AS sources FROM f GROUP BY 1), k AS (SELECT unnest([{', '.join(f"'{a}'" for a in ADAPTERS)}, 'opened-later']) AS adapter),
    n AS (SELECT f.adapter, count(*) AS events FROM e JOIN f USING (source_file_id) GROUP BY 1) SELECT adapter, coalesce(sources, 0)::BIGINT AS sources, coalesce(events, 0)::BIGINT AS events, CASE WHEN coalesce(events, 0) > 0 THEN 'verified' WHEN coalesce(sources, 0) > 0 THEN 'seen' ELSE 'not seen' END AS status
    FROM k LEFT JOIN c USING (adapter) LEFT JOIN n USING (adapter)"""
)
def r_x10_compatibility(spark, sf_dir):
    """What was seen, and came out, of every adapter."""
    files = table(spark, sf_dir, "source_files").select("source_file_id", F.lower(F.replace(F.trim("adapter"), F.lit("_"), F.lit("-"))).alias("adapter")).distinct()
    sources = files.groupBy("adapter").agg(F.count(F.lit(1)).alias("sources")).withColumn("events", F.lit(0).cast("bigint"))
    events = _events(spark, sf_dir).select("source_file_id").join(files, "source_file_id").groupBy("adapter").agg(F.count(F.lit(1)).alias("events")).withColumn("sources", F.lit(0).cast("bigint"))
    return pages.compatibility(sources.unionByName(events), [*ADAPTERS, "opened-later"])


@query(
    """WITH d AS (SELECT path, min(doc_id) AS id FROM documents GROUP BY 1), p AS (SELECT path, id FROM d WHERE id % 3 <> 0), c AS (SELECT CASE WHEN path LIKE '%9.md' THEN '../' || path ELSE path END AS path, CASE WHEN id % 5 = 0 THEN id + 1 ELSE id END AS id FROM d WHERE id % 4 <> 0)
    SELECT path, CASE WHEN path LIKE '../%' THEN 'refuse' WHEN c.id IS NULL THEN 'archive' WHEN c.id = p.id THEN 'keep' ELSE 'write' END AS action, CASE WHEN c.id IS NULL AND path NOT LIKE '../%' THEN 'archive/run/' || path END AS target FROM p FULL JOIN c USING (path)"""
)
def r_x05_page_moves(spark, sf_dir):
    """What happens to every page between two publications."""
    docs = table(spark, sf_dir, "documents").groupBy("path").agg(F.min("doc_id").alias("id"))
    before = docs.filter("id % 3 <> 0").select("path", F.col("id").cast("string").alias("sha256"))
    now = F.when(F.col("id") % 5 == 0, F.col("id") + 1).otherwise(F.col("id")).cast("string")
    after = docs.filter("id % 4 <> 0").select(F.when(F.col("path").like("%9.md"), F.concat(F.lit("../"), "path")).otherwise(F.col("path")).alias("path"), now.alias("sha256"))
    return pages.page_moves(before, after, spark.createDataFrame([], "path string"), "run")


@query(
    """WITH d AS (SELECT path, min(doc_id) AS id, min(n_chars) AS size FROM documents GROUP BY 1), p AS (SELECT path, size, id FROM d WHERE id % 3 <> 0), f AS (SELECT path, size + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS size, id FROM d WHERE id % 4 <> 0)
    SELECT path, message FROM (SELECT path, CASE WHEN f.id IS NULL THEN 'file is gone' WHEN p.id IS NULL THEN 'file was not published' WHEN p.size <> f.size THEN 'file has changed' END AS message FROM p FULL JOIN f USING (path)) WHERE message IS NOT NULL"""
)
def r_q07_manifest(spark, sf_dir):
    """Published pages that are gone, changed or unannounced."""
    docs = table(spark, sf_dir, "documents").groupBy("path").agg(F.min("doc_id").alias("id"), F.min("n_chars").alias("size"))
    row = lambda df, size: df.select("path", size.alias("size"), F.col("id").cast("string").alias("sha256"))
    return gates.manifest_errors(row(docs.filter("id % 3 <> 0"), F.col("size")), row(docs.filter("id % 4 <> 0"), F.col("size") + F.when(F.col("id") % 7 == 0, 1).otherwise(0)))


@query(r"SELECT DISTINCT doc_id, sha256(lower(trim(regexp_replace(title, '\s+', ' ', 'g')))) AS task_sha256 FROM documents WHERE title IS NOT NULL AND title = regexp_replace(title, '[^\x00-\x7F]', '', 'g')")
def r_p28_task_hashes(spark, sf_dir):
    """The hash of every title in ASCII as a task."""
    docs = table(spark, sf_dir, "documents").filter(r"title IS NOT NULL AND NOT title RLIKE '[^\\x00-\\x7F]'")
    return docs.select("doc_id", search.task_fingerprint(F.col("title")).alias("task_sha256")).distinct()
