"""Canonical hashes: the same content hashes alike whatever the order of its rows, fields or keys.

A row's hash is over its chosen fields as JSON with sorted names and nulls kept.  A chain's hash is over its rows' hashes in order, made in parts of
fixed length whose hashes are hashed in turn, so that no chain is gathered; a set's hash is a mergeable sum (``functions.text.set_hash``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import set_hash
from loomspark.operators.ranges import numbered

#: Rows of a chain hashed as one part.
PART_ROWS = 4096
# The fields that make up the meaning of a note, of a project's synthesis and of the state across projects.
NOTE_FIELDS = ("section", "text", "status", "evidence_event_ids", "before", "after", "applies_to")
SYNTHESIS_FIELDS = ("project_key", "title", "semantic_status", "default_disposition", "rationale")
STATE_FIELDS = ("base_claims", "feedback_signals", "rule_evolutions", "relationships")


def canonical_json(fields: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]), {"ignoreNullFields": "false"})


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of the columns of a row, whatever order they are named in; a null differs from an empty text."""
    return F.sha2(canonical_json({c: F.col(c) for c in columns}), 256)


def semantic_hash(rows: DataFrame, fields: tuple[str, ...]) -> Column:
    """The hash of those of ``fields`` that ``rows`` has."""
    return row_hash([c for c in fields if c in rows.columns])


def chain_hashes(rows: DataFrame, keys: list[str], order: list[Column], member: Column) -> DataFrame:
    """keys, n, ordered_sha256, set_sha256 of each key's chain of ``member`` texts in ``order`` (total).

    Rows are numbered over range partitions; parts of ``PART_ROWS`` rows are hashed, then the list of part hashes: 1 / 4,096 of a key's rows.
    """
    picked = rows.select(*keys, member.alias("_member"), *[c.alias(f"_c{i}") for i, c in enumerate(order)])
    at = numbered(picked, keys, [F.col(f"_c{i}") for i in range(len(order))], "_at")
    joined = lambda pairs, text: F.sha2(F.array_join(F.transform(F.array_sort(pairs), lambda s: s[text]), "\n"), 256)
    parts = at.groupBy(*keys, F.floor((F.col("_at") - 1) / PART_ROWS).alias("_part")).agg(F.count(F.lit(1)).alias("n"), joined(F.collect_list(F.struct("_at", "_member")), "_member").alias("_hash"))
    ordered = parts.groupBy(*keys).agg(F.sum("n").alias("n"), joined(F.collect_list(F.struct("_part", "_hash")), "_hash").alias("ordered_sha256"))
    sets = picked.groupBy(*keys).agg(set_hash(F.col("_member")).alias("set_sha256"))
    return ordered.join(sets, keys)


def partition_hash(assignments: DataFrame) -> DataFrame:
    """One row, n, sha256: the partition of events among projects (project_key, event_id), by the set of its pairs."""
    pair = F.concat_ws("\u0000", "project_key", "event_id")
    return assignments.select("project_key", "event_id").distinct().agg(F.count(F.lit(1)).alias("n"), set_hash(pair).alias("sha256"))


def slice_hashes(chain: DataFrame, key: str, order: list[Column], member: Column, size: int) -> DataFrame:
    """key, slice, n, ordered_sha256: the hash of every slice of ``size`` rows of a chain, as a receipt binds it."""
    picked = chain.select(key, member.alias("_member"), *[c.alias(f"_c{i}") for i, c in enumerate(order)])
    at = numbered(picked, [key], [F.col(f"_c{i}") for i in range(len(order))], "_at")
    slices = at.groupBy(key, F.floor((F.col("_at") - 1) / size).cast("bigint").alias("slice"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_member"))), lambda s: s["_member"]), "\n")
    return slices.agg(F.count(F.lit(1)).alias("n"), F.sha2(text, 256).alias("ordered_sha256"))


def receipt_errors(receipts: DataFrame, slices: DataFrame, key: str) -> DataFrame:
    """key, slice, message: receipts (key, slice, n, ordered_sha256) of slices that don't exist or read otherwise now, and slices without a receipt."""
    now = slices.select(key, "slice", F.col("n").alias("_n"), F.col("ordered_sha256").alias("_sha"))
    both = receipts.join(now, [key, "slice"], "full_outer")
    message = F.when(F.col("_sha").isNull(), "no such slice").when(F.col("ordered_sha256").isNull(), "slice has no receipt").when((F.col("_sha") != F.col("ordered_sha256")) | (F.col("_n") != F.col("n")), "slice has changed")
    return both.select(key, "slice", message.alias("message")).filter("message IS NOT NULL")


def rebase(prior: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Earlier assignments (event_id, target, content_sha256) carried over to a new set of events (event_id, content_sha256): kept, and errors.

    An event that is gone, or whose content changed, can't keep its assignment.
    """
    now = events.select("event_id", F.col("content_sha256").alias("_now")).dropDuplicates(["event_id"])
    joined = prior.join(now, "event_id", "left")
    kept = joined.filter("_now = content_sha256").select(*prior.columns)
    message = F.when(F.col("_now").isNull(), "event is gone").otherwise("evidence has changed")
    return kept, joined.filter("_now IS NULL OR NOT (_now <=> content_sha256)").select("event_id", message.alias("message"))
