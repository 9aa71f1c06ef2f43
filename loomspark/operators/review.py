"""Review checks: every rule is a query that yields violation rows (rule, location, message); none means publishable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import normalised, set_hash

# The vocabularies of a review.
HISTORY_STATUSES = ("observed", "inferred", "disputed", "superseded", "stale", "retracted", "candidate")
CLAIM_STATUSES = ("candidate", "confirmed", "stale", "retracted")
RELATION_STATUSES = ("candidate", "confirmed", "rejected")


def violations(rule: str, location: Column, message: str, rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), location.cast("string").alias("location"), F.lit(message).alias("message"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def repeated(rows: DataFrame, key: str, rule: str) -> DataFrame:
    return violations(rule, F.col(key), f"{key} is not unique", rows.groupBy(key).count().filter("count > 1"))


def outside(rows: DataFrame, key: str, field: str, allowed: tuple[str, ...], rule: str) -> DataFrame:
    return violations(rule, F.col(key), f"{field} is not allowed", rows.filter(F.col(field).isNull() | ~F.col(field).isin(*allowed)))


def evidence_rows(items: DataFrame, key: str, project: str | None = None) -> DataFrame:
    """key, (project,) event_id: the cited events of items, exploded; items may come as one row per cited event (event_id) in the first place."""
    event = "event_id" if "event_id" in items.columns else F.explode("evidence_event_ids").alias("event_id")
    return items.select(key, *([project] if project else []), event)


def unknown_evidence(items: DataFrame, key: str, events: DataFrame, rule: str) -> DataFrame:
    """Items that cite an event that does not exist."""
    return violations(rule, F.col(key), "cited event does not exist", evidence_rows(items, key).join(events.select("event_id"), "event_id", "left_anti").select(key).distinct())


def foreign_evidence(items: DataFrame, key: str, events: DataFrame, rule: str) -> DataFrame:
    """Items that cite an event of another project."""
    cited = evidence_rows(items, key, "project_key").join(events.select("event_id", F.col("project_key").alias("own")), "event_id")
    return violations(rule, F.col(key), "cited event belongs to another project", cited.filter(~F.col("own").eqNullSafe(F.col("project_key"))).select(key).distinct())


def weak_observed(items: DataFrame, key: str, events: DataFrame, rule: str) -> DataFrame:
    """Items called observed on grade C or D evidence alone."""
    cited = evidence_rows(items.filter("status = 'observed'"), key).join(events.select("event_id", "evidence_grade"), "event_id")
    weak = cited.groupBy(key).agg(F.bool_and(F.col("evidence_grade").isin("C", "D")).alias("weak")).filter("weak")
    return violations(rule, F.col(key), "observed rests on statements only", weak)


def dangling(items: DataFrame, key: str, field: str, rule: str) -> DataFrame:
    """Items whose references (an array of keys) name themselves or nothing."""
    refs = items.select(key, F.explode(field).alias("ref"))
    known = items.select(F.col(key).alias("ref")).distinct().withColumn("known", F.lit(True))
    return violations(rule, F.col(key), f"{field} names an unknown or the same item", refs.join(known, "ref", "left").filter(F.col("known").isNull() | (F.col("ref") == F.col(key))).select(key).distinct())


def too_few_projects(items: DataFrame, key: str, events: DataFrame, least: int, rule: str) -> DataFrame:
    """Items of global scope whose evidence lies in fewer than ``least`` projects."""
    cited = evidence_rows(items.filter("scope = 'global'"), key).join(events.select("event_id", "project_key"), "event_id", "left")
    few = cited.groupBy(key).agg(F.countDistinct("project_key").alias("n")).filter(F.col("n") < least)
    return violations(rule, F.col(key), f"fewer than {least} projects", few)


def out_of_order(evolutions: DataFrame, events: DataFrame, rule: str) -> DataFrame:
    """Evolutions whose baseline evidence is not all before their validation evidence (order known by reliable times).

    Every baseline before every validation is the same as the last baseline before the first validation.
    """
    at = events.select("event_id", "utc_us")
    side = lambda field, agg: evolutions.select("evolution_id", F.explode(field).alias("event_id")).join(at, "event_id", "left").groupBy("evolution_id").agg(agg.alias(field), F.bool_or(F.col("utc_us").isNull()).alias(f"{field}_unknown"))
    both = side("baseline_event_ids", F.max("utc_us")).join(side("validation_event_ids", F.min("utc_us")), "evolution_id")
    bad = both.filter("baseline_event_ids_unknown OR validation_event_ids_unknown OR baseline_event_ids >= validation_event_ids")
    return violations(rule, F.col("evolution_id"), "baseline is not proved to precede validation", bad)


def effective_actor(events: DataFrame, by_event: DataFrame, by_lane: DataFrame) -> DataFrame:
    """event_id, actor: the attribution of the event, else of its lane (undetermined users only), else its own actor."""
    lane = by_lane.select("project_key", F.col("actor").alias("lane_actor"))
    joined = events.join(by_event.select("event_id", F.col("actor").alias("event_actor")), "event_id", "left").join(lane, "project_key", "left")
    by = F.when(F.col("actor_kind").isin("native_user", "unknown_user"), F.col("lane_actor"))
    return joined.select("event_id", F.coalesce("event_actor", by, "actor_kind").alias("actor"))


_CLUSTER = ("scope", "object", "applies_to", "statement")


def clustered(feedback: DataFrame) -> DataFrame:
    """feedback_id, project_key and the cluster of every signal: scope, object, and what it applies to and states, normalised."""
    applies = normalised(F.coalesce("applies_to", F.lit(""))) if "applies_to" in feedback.columns else F.lit("")
    return feedback.select("feedback_id", "project_key", "scope", "object", applies.alias("applies_to"), normalised(F.col("statement")).alias("statement"))


def feedback_clusters(feedback: DataFrame) -> DataFrame:
    """Clusters of signals that say the same: their number, first id, hash of the set of ids, number of projects, and whether two or more agree.

    ``clustered`` lists the members; they are never gathered.
    """
    distinct = clustered(feedback).distinct()
    return distinct.groupBy(*_CLUSTER).agg(F.countDistinct("feedback_id").alias("signals"), F.min("feedback_id").alias("first_id"), set_hash(F.col("feedback_id")).alias("members_sha256"), F.countDistinct("project_key").alias("projects"), (F.countDistinct("project_key") >= 2).alias("promotable"))


def derived_membership(assignments: DataFrame) -> DataFrame:
    """operation, project_key: merges (a target with two or more sources) and splits (a source with two or more targets)."""
    merged = assignments.groupBy(F.col("target").alias("project_key")).agg(F.countDistinct("source").alias("n")).filter("n >= 2").select(F.lit("merge").alias("operation"), "project_key")
    parted = assignments.groupBy(F.col("source").alias("project_key")).agg(F.countDistinct("target").alias("n")).filter("n >= 2").select(F.lit("split").alias("operation"), "project_key")
    return merged.unionByName(parted)


def reassigned(assignments: DataFrame) -> DataFrame:
    """source, target: the distinct moves between projects."""
    return assignments.filter("source <> target").select("source", "target").distinct()


def membership(events: DataFrame, overrides: DataFrame) -> DataFrame:
    """event_id, proposed, target: the project each event goes to, overridden per event; unnamed events keep their proposal."""
    over = overrides.groupBy("event_id").agg(F.min("target").alias("override"))
    joined = events.select("event_id", F.col("project_key").alias("proposed")).join(over, "event_id", "left")
    return joined.select("event_id", "proposed", F.coalesce("override", "proposed").alias("target"))


def membership_errors(events: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides of unknown events, and events sent to two projects."""
    unknown = overrides.join(events.select("event_id"), "event_id", "left_anti").select("event_id").distinct()
    twice = overrides.groupBy("event_id").agg(F.countDistinct("target").alias("n")).filter("n > 1")
    return violations("membership", F.col("event_id"), "event does not exist", unknown).unionByName(violations("membership", F.col("event_id"), "event goes to two projects", twice))
