"""Incremental ingest: which sources to parse again, and how new rows replace, extend or keep the old ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspark.sources.lines import register


def plan(changes: DataFrame, append_only: DataFrame, policy_changed: bool = False) -> DataFrame:
    """path, action (skip, tail, parse, keep): what to do with each source after ``snapshots.source_changes``.

    A changed policy parses everything anew; a source that is missing, or changed while it was read, keeps its rows.
    """
    known = changes.join(append_only, "path", "left").withColumn("tail_ok", F.coalesce("append_only", F.lit(False)))
    action = F.when(F.col("change").isin("missing", "unstable"), "keep").when(F.lit(policy_changed), "parse").when(F.col("change") == "same", "skip").when((F.col("change") == "appended") & F.col("tail_ok"), "tail").otherwise("parse")
    return known.select("path", "change", action.alias("action"))


def merge(old: DataFrame, new: DataFrame, actions: DataFrame) -> DataFrame:
    """The table after a run: rows of parsed sources are replaced, those of tails extended (an id counts once), all others kept."""
    parsed = actions.filter("action = 'parse'").select("path")
    kept = old.join(parsed, "path", "left_anti")
    fresh = new.join(kept.select("event_id"), "event_id", "left_anti").dropDuplicates(["event_id"])
    return kept.unionByName(fresh.select(kept.columns))


def affected_projects(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """project_key of every project one of whose events was added, removed, modified or moved."""
    mark = lambda df, n: df.select("event_id", F.col("project_key").alias(f"p{n}"), F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256).alias(f"h{n}"))
    both = mark(old, 0).join(mark(new, 1), "event_id", "full_outer").filter("NOT (h0 <=> h1) OR NOT (p0 <=> p1)")
    return both.select(F.explode(F.array("p0", "p1")).alias("project_key")).filter("project_key IS NOT NULL").distinct()


def tail_lines(spark: SparkSession, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append the complete new lines of all session files under ``root`` to the table ``out``; run again to go on where it stopped."""
    register(spark)
    lines = spark.readStream.format("session_lines").load(root)
    return lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
