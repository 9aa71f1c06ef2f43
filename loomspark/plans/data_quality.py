"""Queries of the general training-data operators (p1, p4, p5, p6) and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import bad_rows, hierarchy, schema_drift, timestamps
from loomspark.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and depth of every session."""
    found = hierarchy.resolve(hierarchy.session_links(table(spark, sf_dir, "unified_events")))
    return found.select(F.col("node").alias("session_id"), F.col("root").alias("root_session_id"), "depth")


def p1_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session with root, depth, full path from the root and the number of its descendants."""
    paths = hierarchy.resolve(hierarchy.session_links(table(spark, sf_dir, "unified_events")), with_paths=True)
    return paths.select(F.col("node").alias("session_id"), F.col("root").alias("root_session_id"), "depth", F.array_join("path", "/").alias("path"), "n_descendants")


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ancestor-descendant pair with its distance; -1 where the descendant is in or below a cycle."""
    return hierarchy.descendants(hierarchy.resolve(hierarchy.session_links(table(spark, sf_dir, "unified_events")), with_paths=True))


def _drift(spark: SparkSession, sf_dir: str) -> schema_drift.Drift:
    return schema_drift.Drift(table(spark, sf_dir, "adapter_records"), table(spark, sf_dir, "field_contract"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of every file against the contract."""
    return _drift(spark, sf_dir).changes()


def p4_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records in one table with the fields of the contract."""
    fields = [r.field for r in table(spark, sf_dir, "field_contract").select("field").distinct().orderBy("field").collect()]
    return _drift(spark, sf_dir).unified(fields)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The UTC instant of every record that denotes one."""
    return timestamps.record_instants(spark, {"unified_events": (table(spark, sf_dir, "unified_events"), "event_id"), "raw_events": (table(spark, sf_dir, "raw_events"), "raw_event_id")})


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that can't be loaded, with its reason."""
    return bad_rows.bad_lines(bad_rows.parse_lines(table(spark, sf_dir, "raw_lines")))


def p6_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid lines as rows."""
    return bad_rows.good_rows(bad_rows.parse_lines(table(spark, sf_dir, "raw_lines")))


def p6_parse_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bad lines as ParseResult.errors and ParseResult.excluded of their files."""
    lines = table(spark, sf_dir, "raw_lines")
    return bad_rows.parse_results(lines, bad_rows.parse_lines(lines))


QUERIES = {f.__name__: f for f in (p1_found, p1_hierarchy, p1_descendants, p4_found, p4_unified, p5_found, p6_found, p6_loaded, p6_parse_results)}

_LINKS = r"""
cleaned AS (
  SELECT lower(regexp_replace(session_id, '^\s+|\s+$', '', 'g')) AS node,
         nullif(nullif(nullif(lower(regexp_replace(parent_session_id, '^\s+|\s+$', '', 'g')), ''), 'none'), 'null') AS parent
  FROM unified_events),
links AS (
  SELECT node, min(parent) AS parent
  FROM (SELECT node, parent FROM cleaned UNION ALL SELECT parent, NULL FROM cleaned WHERE parent IS NOT NULL)
  WHERE node IS NOT NULL GROUP BY node),
up AS (
  SELECT node, node AS ancestor, parent AS next FROM links
  UNION
  SELECT up.node, links.node, links.parent FROM up JOIN links ON links.node = up.next),
above AS (SELECT DISTINCT node, next AS ancestor FROM up WHERE next IS NOT NULL),
cyclic AS (SELECT node FROM above WHERE node = ancestor),
rooted AS (SELECT node, max(ancestor) FILTER (WHERE next IS NULL) AS root FROM up GROUP BY node),
resolved AS (
  SELECT r.node, coalesce(r.root, (SELECT min(u.ancestor) FROM up u WHERE u.node = r.node AND u.ancestor IN (SELECT node FROM cyclic))) AS root,
         CASE WHEN r.root IS NULL THEN -1 ELSE (SELECT count(*) FROM above a WHERE a.node = r.node) END AS depth
  FROM rooted r)
"""

ORACLES = {
    "p1_found": f"WITH RECURSIVE {_LINKS} SELECT node AS session_id, root AS root_session_id, depth FROM resolved",
    "p1_descendants": f"""WITH RECURSIVE {_LINKS},
        deep AS (SELECT node, count(*) AS d FROM above GROUP BY node)
        SELECT a.ancestor, a.node AS descendant, CASE WHEN r.depth < 0 THEN -1 ELSE r.depth - coalesce(d.d, 0) END AS distance
        FROM above a JOIN resolved r ON r.node = a.node LEFT JOIN deep d ON d.node = a.ancestor WHERE a.node <> a.ancestor""",
    "p1_hierarchy": f"""WITH RECURSIVE {_LINKS},
        plain AS (SELECT node, ancestor FROM above WHERE ancestor NOT IN (SELECT node FROM cyclic) AND node <> ancestor),
        nth AS (SELECT l.node, count(p.ancestor) AS n FROM links l LEFT JOIN plain p USING (node) GROUP BY 1),
        steps AS (SELECT p.node, p.ancestor AS step, n.n FROM plain p JOIN nth n ON n.node = p.ancestor UNION ALL SELECT node, node, n FROM nth),
        ways AS (SELECT node, string_agg(step, '/' ORDER BY n) AS way, arg_min(step, n) AS top FROM steps GROUP BY 1),
        below AS (SELECT ancestor AS node, count(*) AS n FROM above WHERE node <> ancestor GROUP BY 1)
        SELECT r.node AS session_id, r.root AS root_session_id, r.depth, CASE WHEN r.depth < 0 AND r.node NOT IN (SELECT node FROM cyclic) THEN l.parent || '/' || w.way ELSE w.way END AS path, coalesce(b.n, 0) AS n_descendants
        FROM resolved r JOIN ways w USING (node) JOIN links l ON l.node = w.top LEFT JOIN below b ON b.node = r.node""",
}
