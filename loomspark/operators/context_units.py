"""Reviewed statements of a document as units that can be handed out one by one: relevance, current view, whole units under a budget, checks.

units: doc_key, position, unit_id, section, text, status, evidence_event_ids, conflicts, supersedes; states: doc_key, field, unit_id (what a
reviewer named as the current state, never inferred from order).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import collapsed
from loomspark.functions.tokens import folded, tokens
from loomspark.session import Scratch

# Fields of a current state, states of a unit, views, and the bounds of what may be asked for.
STATE_FIELDS = ("accepted_baseline", "constraints", "delivery", "goal", "latest_correction", "next_step")
UNIT_STATUSES = ("confirmed", "observed", "agent-reported", "inferred", "disputed", "stale", "retracted", "unverified")
INACTIVE = ("stale", "retracted")
VIEWS, BASE_CONTEXTS = ("documents", "facts", "current"), ("auto", "none", "identity", "collaboration", "both")
FACT_BOUNDS, CHAR_BOUNDS = (1, 50), (256, 50_000)
DEFAULTS = {"base_context": "auto", "view": "documents", "max_facts": 6, "max_chars": 6000}


def selection_options(**asked) -> dict:
    """The options of a selection with their defaults; an unknown name, or a value out of its bounds (booleans are no numbers), is an error."""
    if unknown := sorted(set(asked) - set(DEFAULTS)):
        raise ValueError(f"no such options: {unknown}")
    options = DEFAULTS | asked
    for name, allowed in (("view", VIEWS), ("base_context", BASE_CONTEXTS)):
        if options[name] not in allowed:
            raise ValueError(f"{name} must be one of {allowed}")
    for name, (low, high) in (("max_facts", FACT_BOUNDS), ("max_chars", CHAR_BOUNDS)):
        if isinstance(options[name], bool) or not isinstance(options[name], int) or not low <= options[name] <= high:
            raise ValueError(f"{name} must be an integer from {low} to {high}")
    return options


def history_units(items: DataFrame) -> DataFrame:
    """Units of the history sections of a document: doc_key, section, item_index, text, status, evidence_event_ids to units named ``history:section:index``."""
    none = F.array().cast("array<string>")
    unit = F.concat_ws(":", F.lit("history"), "section", F.col("item_index").cast("string"))
    return items.select("doc_key", F.struct("section", "item_index").alias("position"), unit.alias("unit_id"), "section", "text", "status", "evidence_event_ids", none.alias("conflicts"), none.alias("supersedes"))


def fill(candidates: DataFrame, keys: list[str], order: str, max_facts: int, max_chars: int) -> DataFrame:
    """keys, ids, used: of each group's candidates (keys, ``order``, unit_id, size) in order those that fit, whole, skipping (not stopping at) what doesn't.

    Each step takes, by a mergeable aggregate, the next candidate behind the last one taken that fits the rest of the budget; what was skipped never
    fits later, as the rest only shrinks.  So a group of any size takes ``max_facts`` steps and is never gathered.  ``order`` must be unique in a group.
    """
    scratch = Scratch(candidates.sparkSession, "fill")
    candidates = scratch.keep(candidates.select(*keys, order, "unit_id", F.col("size").cast("bigint").alias("size")), "candidates")
    step = F.min(F.struct(F.col(order).alias("at"), "unit_id", "size"))
    first = candidates.filter(F.col("size") <= max_chars).groupBy(*keys).agg(step.alias("next"))
    taken = first.select(*keys, F.array("next.unit_id").alias("ids"), F.col("next.size").alias("used"), F.col("next.at").alias("last"))
    for n in range(max_facts - 1):
        taken = scratch.keep(taken, f"taken{n}")  # else the plan would hold all steps' sorts at once
        fits = candidates.join(taken.select(*keys, "used", "last"), keys).filter((F.col(order) > F.col("last")) & (F.col("used") + F.col("size") <= max_chars))
        more = fits.groupBy(*keys).agg(step.alias("next"))
        joined = taken.join(more, keys, "left")
        taken = joined.select(*keys, F.when(F.col("next").isNull(), F.col("ids")).otherwise(F.concat("ids", F.array("next.unit_id"))).alias("ids"), (F.col("used") + F.coalesce("next.size", F.lit(0))).cast("bigint").alias("used"), F.coalesce("next.at", "last").alias("last"))
    return taken.drop("last")


def relevance(terms: Column, text: Column) -> Column:
    """How many terms stand in a (folded) text."""
    return F.size(F.filter(terms, lambda t: text.contains(t)))


def unit_size(unit: Column) -> Column:
    """What a unit costs: the characters of its JSON."""
    return F.length(F.to_json(unit, {"ignoreNullFields": "false"}))


def unit_views(chosen: DataFrame, documents: DataFrame, units: DataFrame, states: DataFrame, options: dict) -> DataFrame:
    """What each chosen document hands out: task_id, doc_key, context_status, unit_ids, returned_chars, omitted_count, unexpanded_ids, missing_state_fields, selection_sha256.

    chosen: task_id, doc_key, terms (of the task, those that say something); documents: doc_key, title, aliases.  Facts go by how many of the task's
    terms, those of title and aliases left out, they hold, then by position; the current view goes by the named state fields only.  A document
    without units, or without a reviewed state in the current view, is ``unavailable``.  Claims that conflict with, or are superseded by, what was
    handed out but didn't fit are named, not hidden.
    """
    keys = ["task_id", "doc_key"]
    anchors = documents.select("doc_key", tokens(F.concat_ws(" ", "title", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "))).alias("anchors"))
    asked = chosen.join(anchors, "doc_key", "left").select(*keys, F.array_except("terms", F.coalesce("anchors", F.array().cast("array<string>"))).alias("terms"))
    fields = [c for c in units.columns if c not in ("doc_key", "position")]
    sized = units.withColumn("size", unit_size(F.struct(*fields))).withColumn("low", F.coalesce(folded("text"), F.lit("")))
    if options["view"] == "current":
        named = states.filter(F.col("field").isin(*STATE_FIELDS)).join(sized, ["doc_key", "unit_id"])
        candidates = asked.join(named, "doc_key").withColumn("at", F.struct(F.lit(0).alias("r"), F.col("field").cast("string").alias("f"), "unit_id"))
    else:
        rows = asked.join(sized, "doc_key")
        candidates = rows.withColumn("at", F.struct((-relevance(F.col("terms"), F.col("low"))).alias("r"), F.col("position").alias("f"), "unit_id"))
    candidates = candidates.select(*keys, "at", "unit_id", "size", "conflicts", "supersedes")
    picked = fill(candidates, keys, "at", options["max_facts"], options["max_chars"])
    counts = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    linked = picked.select(*keys, F.explode("ids").alias("unit_id")).join(candidates.select(*keys, "unit_id", F.concat(F.coalesce("conflicts", F.array().cast("array<string>")), F.coalesce("supersedes", F.array().cast("array<string>"))).alias("l")), [*keys, "unit_id"])
    linked = linked.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("l")))).alias("linked"))  # of at most max_facts units
    missing = asked.select(*keys).crossJoin(F.broadcast(states.sparkSession.createDataFrame([(f,) for f in STATE_FIELDS], "field string"))).join(states.select("doc_key", "field").distinct(), ["doc_key", "field"], "left_anti")
    missing = missing.groupBy(*keys).agg(F.array_sort(F.collect_set("field")).alias("missing"))
    empty = F.array().cast("array<string>")
    out = asked.select(*keys).distinct().join(counts, keys, "left").join(picked, keys, "left").join(linked, keys, "left").join(missing, keys, "left")
    ids = F.coalesce("ids", empty)
    status = F.when(F.col("n").isNull(), "unavailable").when(F.size(ids) > 0, "available").otherwise("empty_or_budget_limited")
    return out.select(
        *keys, status.alias("context_status"), ids.alias("unit_ids"), F.coalesce("used", F.lit(0)).alias("returned_chars"), (F.coalesce("n", F.lit(0)) - F.size(ids)).alias("omitted_count"), F.array_except(F.coalesce("linked", empty), ids).alias("unexpanded_ids"),
        (F.coalesce("missing", empty) if options["view"] == "current" else empty).alias("missing_state_fields"), F.sha2(F.array_join(ids, "\n"), 256).alias("selection_sha256"),
    )


def unit_errors(units: DataFrame, states: DataFrame) -> DataFrame:
    """doc_key, unit_id, message: units without id, text, evidence or a known status, repeated ids, blank references, and states that name no active unit."""
    bad = lambda df, message: df.select("doc_key", F.col("unit_id").cast("string").alias("unit_id"), F.lit(message).alias("message"))
    blank = lambda c: F.coalesce(collapsed(F.col(c)), F.lit("")) == ""
    refs = lambda c: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda r: r.isNull() | (r == ""))
    known = units.select("doc_key", "unit_id", "status").dropDuplicates(["doc_key", "unit_id"])
    named = states.join(known, ["doc_key", "unit_id"], "left")
    return reduce(
        lambda a, b: a.unionByName(b),
        [
            bad(units.filter(blank("unit_id")), "unit has no id"), bad(units.filter(blank("text")), "unit has no text"), bad(units.filter(F.col("status").isNull() | ~F.col("status").isin(*UNIT_STATUSES)), "status is not allowed"),
            bad(units.filter(F.coalesce(F.size("evidence_event_ids"), F.lit(0)) < 1), "unit has no evidence"), bad(units.filter(refs("evidence_event_ids") | refs("conflicts") | refs("supersedes")), "a reference is blank"),
            bad(units.groupBy("doc_key", "unit_id").count().filter("count > 1"), "unit id is not unique"), bad(states.filter(~F.col("field").isin(*STATE_FIELDS)), "no such state field"),
            bad(named.filter(F.col("status").isNull()), "state names no unit"), bad(named.filter(F.col("status").isin(*INACTIVE)), "state names an inactive unit"),
        ],
    )
