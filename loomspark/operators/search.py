"""A search as users run it: base documents, ranked projects, one hop over confirmed links, evidence rules first, units, receipts; and suites of cases over it.

documents: doc_key, position, path, type (project, identity, collaboration, evidence, ...), project_key, title, aliases, keywords.
edges: position, source_path, target_path, relation, direction, status.  tasks: task_id, task.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from loomspark.functions.text import collapsed
from loomspark.operators import context_units as cu
from loomspark.operators import retrieval
from loomspark.operators.sanitize import sanitize_text
from loomspark.session import Scratch

# The profile of a search, its bounds, kinds of cases, and how many of each a suite needs.
PROFILE = {"min_score": 4, "max_projects": 3, "max_related": 2}
PROFILE_BOUNDS = {"min_score": (0, 10_000), "max_projects": (1, 20), "max_related": (0, 20)}
BASE_TYPES, EVIDENCE = ("collaboration", "identity"), "evidence"
CASE_KINDS, LEAST_RELATED, LEAST_NEGATIVE = ("related", "hard_negative"), 2, 2
EDGES = "position bigint, source_path string, target_path string, relation string, direction string, status string"
FOUND = "task_id string, place int, path string, type string, project_key string, score int, relation string, traversal string"


def profile(**asked: int) -> dict[str, int]:
    """A search profile with its defaults; unknown names and values out of bounds are errors."""
    if unknown := sorted(set(asked) - set(PROFILE)):
        raise ValueError(f"no such profile fields: {unknown}")
    for name, value in asked.items():
        low, high = PROFILE_BOUNDS[name]
        if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
            raise ValueError(f"{name} must be an integer from {low} to {high}")
    return PROFILE | asked


def skipped(spark: SparkSession) -> DataFrame:
    """The answer where the context at hand suffices: nothing, and nothing is read."""
    return spark.createDataFrame([], FOUND)


def search(tasks: DataFrame, documents: DataFrame, edges: DataFrame, base_context: str = "auto", **asked: int) -> DataFrame:
    """task_id, place, path, type, project_key, score, relation, traversal: the documents of each task in order.  Tasks that match nothing have no rows.

    First the evidence rules, if anything was found at all; then the base documents the task asks for, the best projects by score, and their
    neighbours over confirmed links, in the order of the links.  A base document comes in as a neighbour only if it was asked for.
    """
    p = profile(**asked)
    scratch = Scratch(tasks.sparkSession, "search")  # each is read several times
    documents = scratch.keep(documents.select("doc_key", "position", "path", "type", "project_key", "title", "aliases", "keywords"), "documents")
    edges = scratch.keep(edges.filter("status = 'confirmed'"), "edges") if p["max_related"] else edges
    docs = documents.select("path", "type", "project_key", "position").dropDuplicates(["path"])
    asked_base = tasks.select("task_id", F.explode(retrieval.base_context(F.col("task"), base_context)).alias("type"))
    firsts = docs.filter(F.col("type").isin(*BASE_TYPES, EVIDENCE)).groupBy("type").agg(F.min_by(F.struct("path", "project_key"), F.struct("position", "path")).alias("d"))
    base = asked_base.join(firsts.filter(F.col("type") != EVIDENCE), "type").select("task_id", "type", "d.path", "d.project_key")
    best = retrieval.best(tasks, documents.filter("type = 'project'").select("doc_key", "path", "title", "aliases", "keywords"), p["min_score"], p["max_projects"])
    none = F.lit(None)
    text = lambda c: none.cast("string").alias(c)
    best = scratch.keep(best, "best")
    rows = [base.select("task_id", F.lit(1).alias("part"), (F.col("type") == "collaboration").cast("int").alias("nth"), "path", none.cast("int").alias("score"), text("relation"), text("traversal"))]
    rows.append(best.select("task_id", F.lit(2).alias("part"), F.col("rank").alias("nth"), "path", "score", text("relation"), text("traversal")))
    selected = rows[0].unionByName(rows[1])
    if p["max_related"]:
        allowed = asked_base.select("task_id", F.col("type").alias("base_type"))
        unwanted = docs.filter(F.col("type").isin(*BASE_TYPES)).select("path", F.col("type").alias("base_type"))
        kept = retrieval.neighbours(selected.select("task_id", "path"), edges).join(unwanted, "path", "left").join(allowed.withColumn("ok", F.lit(True)), ["task_id", "base_type"], "left").filter("base_type IS NULL OR ok")
        rows.append(retrieval.first_neighbours(kept, p["max_related"]).select("task_id", F.lit(3).alias("part"), "nth", "path", none.cast("int").alias("score"), "relation", "traversal"))
    every = reduce(lambda a, b: a.unionByName(b), rows)
    rules = firsts.filter(F.col("type") == EVIDENCE).select("d.path")
    head = every.select("task_id").distinct().crossJoin(F.broadcast(rules)).select("task_id", F.lit(0).alias("part"), F.lit(0).alias("nth"), "path", none.cast("int").alias("score"), text("relation"), text("traversal"))
    already = head.select("task_id", "path").withColumn("is_head", F.lit(True))
    every = every.join(already, ["task_id", "path"], "left").filter("is_head IS NULL").drop("is_head").unionByName(head)
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("part", "nth", "path"))  # a bounded answer
    return every.join(docs.drop("position"), "path", "left").select("task_id", place.alias("place"), "path", "type", "project_key", "score", "relation", "traversal")


def search_units(found: DataFrame, tasks: DataFrame, documents: DataFrame, units: DataFrame, states: DataFrame, options: dict) -> DataFrame:
    """``cu.unit_views`` of every document found but the evidence rules."""
    terms = retrieval.task_tokens(tasks).select("task_id", "terms")
    keyed = documents.select("path", "doc_key").dropDuplicates(["path"])
    chosen = found.filter(F.col("type") != EVIDENCE).select("task_id", "path").join(keyed, "path").join(terms, "task_id").select("task_id", "doc_key", "terms")
    return cu.unit_views(chosen, documents, units, states, options)


def task_fingerprint(task: Column) -> Column:
    """The hash of a task, spelling of blanks and case aside; its text is kept nowhere."""
    return F.sha2(F.lower(collapsed(task)), 256)


def receipts(found: DataFrame, tasks: DataFrame, run_id: str, verified: dict[str, int], **asked: int) -> DataFrame:
    """run_id, task_sha256, match_status, selected (paths in order), project_matches, related, verified_profile_used: one row per task."""
    p = profile(**asked)
    grouped = found.groupBy("task_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda s: s["path"]).alias("selected"), F.count_if(F.col("score").isNotNull()).alias("project_matches"), F.count_if(F.col("relation").isNotNull()).alias("related")
    )
    joined = tasks.join(grouped, "task_id", "left")
    return joined.select(
        "task_id", F.lit(run_id).alias("run_id"), task_fingerprint(F.col("task")).alias("task_sha256"), F.when(F.col("selected").isNull(), "no_match").otherwise("matched").alias("match_status"), F.coalesce("selected", F.array().cast("array<string>")).alias("selected"),
        F.coalesce("project_matches", F.lit(0)).alias("project_matches"), F.coalesce("related", F.lit(0)).alias("related"), F.lit(p == PROFILE | verified).alias("verified_profile_used"),
    )


@pandas_udf(StringType())
def _safe_task(task: pd.Series) -> pd.Series:
    return task.map(lambda t: " ".join(sanitize_text(t).split()) if t else "")


def suite_cases(cases: DataFrame) -> DataFrame:
    """Cases ready to run: kind unified, task without private data and its hash, expectations trimmed, distinct and sorted, bounds defaulted.

    cases: case_id, kind, task, expected_project_keys, expected_document_types, min_project_matches, min_context_units.
    """
    tidy = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")))
    kind = F.replace(F.lower(F.trim("kind")), F.lit("-"), F.lit("_"))
    rows = cases.select("case_id", kind.alias("kind"), _safe_task("task").alias("task"), tidy("expected_project_keys").alias("projects"), tidy("expected_document_types").alias("types"), "min_project_matches", "min_context_units")
    usual = F.when((F.col("kind") == "related") & ~((F.size("types") > 0) & (F.size("projects") == 0)), 1).otherwise(0)
    return rows.withColumns({"min_project_matches": F.coalesce("min_project_matches", usual), "min_context_units": F.coalesce("min_context_units", F.lit(0)), "task_sha256": task_fingerprint(F.col("task"))})


def suite_errors(ready: DataFrame) -> DataFrame:
    """case_id, message: unknown kinds, tasks that are empty or repeat, negatives that expect something, bounds out of range."""
    bad = lambda df, message: df.select(F.col("case_id").cast("string").alias("case_id"), F.lit(message).alias("message"))
    twice = ready.groupBy("task_sha256").agg(F.count(F.lit(1)).alias("n"), F.max("case_id").alias("case_id")).filter("n > 1")
    return reduce(
        lambda a, b: a.unionByName(b),
        [
            bad(ready.filter(F.col("kind").isNull() | ~F.col("kind").isin(*CASE_KINDS)), "unknown kind"), bad(ready.filter(F.coalesce("task", F.lit("")) == ""), "empty task"), bad(twice, "task is not distinct"),
            bad(ready.filter("kind = 'hard_negative' AND (size(projects) > 0 OR size(types) > 0)"), "a negative expects something"), bad(ready.filter("NOT min_project_matches BETWEEN 0 AND 20 OR NOT min_context_units BETWEEN 0 AND 1000"), "bound out of range"),
        ],
    )


def suite_verdicts(ready: DataFrame, found: DataFrame, views: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """case_id, kind, passed, project_matches, selected (number of documents): a related case needs its expectations, a negative one nothing at all.

    found: the search with case ids as task ids; ``views`` (with ``documents``): the units handed out, of which each expected target must supply
    ``min_context_units`` itself (without expectations: the documents found directly).
    """
    counted = found.withColumn("n_units", F.lit(0))
    if views is not None:
        sizes = views.join(documents.select("doc_key", "path").dropDuplicates(["path"]), "doc_key").select("task_id", "path", F.size("unit_ids").alias("n_units"))
        counted = found.join(sizes, ["task_id", "path"], "left").withColumn("n_units", F.coalesce("n_units", F.lit(0)))
    got = counted.groupBy(F.col("task_id").alias("case_id")).agg(
        F.collect_list(F.struct("project_key", "type", "n_units", F.col("relation").isNull().alias("direct"))).alias("docs"), F.count_if(F.col("score").isNotNull()).alias("project_matches")  # one bounded answer
    )
    rows = ready.join(got, "case_id", "left").withColumn("docs", F.coalesce("docs", F.array().cast(got.schema["docs"].dataType)))
    total = lambda test: F.aggregate(F.filter("docs", test), F.lit(0), lambda a, d: a + d["n_units"])
    least = F.col("min_context_units")
    enough = F.forall("projects", lambda k: total(lambda d: d["project_key"] == k) >= least) & F.forall("types", lambda t: total(lambda d: d["type"] == t) >= least)
    direct = (F.size("projects") + F.size("types") > 0) | (total(lambda d: d["direct"] & (d["type"] != EVIDENCE)) >= least)
    has = lambda want, field: F.size(F.array_except(want, F.transform("docs", lambda d: d[field]))) == 0
    matches = F.coalesce("project_matches", F.lit(0))
    related = (F.size("docs") > 0) & (matches >= F.col("min_project_matches")) & has("projects", "project_key") & has("types", "type") & enough & direct
    return rows.select("case_id", "kind", F.when(F.col("kind") == "related", related).otherwise(F.size("docs") == 0).alias("passed"), matches.alias("project_matches"), F.size("docs").alias("selected"))


def suite_report(verdicts: DataFrame, unsupported_clear: bool = True) -> DataFrame:
    """One row: cases and passes by kind, both gates and the final status; too few cases of a kind leave it incomplete."""
    count = lambda kind, ok: F.count_if((F.col("kind") == kind) & (F.col("passed") | F.lit(not ok)))
    sums = verdicts.agg(*[count(k, ok).alias(f"{k}_{'passed' if ok else 'cases'}") for k in CASE_KINDS for ok in (False, True)])
    gates = sums.withColumn("related_gate", (F.col("related_cases") >= LEAST_RELATED) & (F.col("related_passed") == F.col("related_cases"))).withColumn("negative_gate", (F.col("hard_negative_cases") >= LEAST_NEGATIVE) & (F.col("hard_negative_passed") == F.col("hard_negative_cases")))
    done = "complete" if unsupported_clear else "complete_with_unsupported_formats"
    return gates.withColumn("status", F.when(F.col("related_gate") & F.col("negative_gate"), done).otherwise("needs_retrieval_verification"))
