"""Retract, forget and schedule: what a request touches, in one pass, and its effect on the tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.session import Scratch

# What may be selected, what may be done, kinds a tombstone keeps.
SELECTORS, ACTIONS = ("source_file_ids", "event_ids", "claim_ids", "project_keys"), ("retract", "forget", "schedule")
TOMBSTONES = {"event": "events", "project": "projects", "source": "sources", "event_locator": "event_locators"}


@dataclass
class Tables:
    """What a request is followed through.  Claims, feedback and rules may have an array of cited events, or a row per cited event.

    events: event_id, source_file_id, project_key, logical_session_id; claims: claim_id; feedback: feedback_id, project_key; rules: evolution_id,
    feedback_ids or feedback_id, promoted_claim_id; documents: path, project_key; nodes: id, path, project_key; edges: edge_id, source, target.
    """

    events: DataFrame
    claims: DataFrame
    feedback: DataFrame
    rules: DataFrame
    documents: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)


def selectors(**asked) -> dict[str, list[str]]:
    """The four lists of a request, trimmed, distinct and sorted; unknown names, and a request that selects nothing, are errors."""
    if unknown := sorted(set(asked) - set(SELECTORS)):
        raise ValueError(f"no such selectors: {unknown}")
    values = {name: asked.get(name) or [] for name in SELECTORS}
    tidy = {name: sorted({str(v).strip() for v in ([vs] if isinstance(vs, str) else vs)} - {""}) for name, vs in values.items()}
    if not any(tidy.values()):
        raise ValueError(f"select something by one of {SELECTORS}")
    return tidy


def own_project(events: DataFrame) -> Column:
    """An event's project, or its session's stand-in."""
    session = F.when(F.col("logical_session_id").isNotNull(), F.concat(F.lit("session:"), "logical_session_id")) if "logical_session_id" in events.columns else F.lit(None)
    return F.coalesce("project_key", session)


def cited(items: DataFrame, key: str) -> DataFrame:
    """id, event_id of all events a table's items cite: the column event_id, and every array whose name ends in event_ids."""
    parts = [items.select(F.col(key).alias("id"), F.explode(c).alias("event_id")) for c in items.columns if c.endswith("event_ids")]
    if "event_id" in items.columns:
        parts.append(items.select(F.col(key).alias("id"), "event_id"))
    return reduce(lambda a, b: a.unionByName(b), parts).filter("event_id IS NOT NULL") if parts else items.select(F.col(key).alias("id"), F.lit(None).cast("string").alias("event_id")).limit(0)


def select_events(events: DataFrame, asked: dict[str, list[str]]) -> DataFrame:
    """The events a request names by source, by id or by project.  Names are few: what one request says."""
    test = F.col("source_file_id").isin(asked["source_file_ids"]) | F.col("event_id").isin(asked["event_ids"]) | own_project(events).isin(asked["project_keys"])
    return events.filter(F.coalesce(test, F.lit(False)))


def impact(tables: Tables, selected: DataFrame, action: str = "retract", claim_ids: DataFrame | None = None, project_keys: DataFrame | None = None) -> DataFrame:
    """kind, id of everything a selection touches, in one pass in this order, never again from the start.

    Events selected; their projects; claims that cite them, or are named (``claim_ids``: claim_id), and the projects of what those cite; for ``forget``
    the events those claims cite too; feedback that cites a touched event or belongs to a touched project; rules on touched feedback, events or claims;
    documents of touched projects; nodes and edges on any of these.  Null ids touch nothing; tables left out are not followed.
    """
    if action not in ACTIONS:
        raise ValueError(f"no such action: {action}")
    scratch = Scratch(tables.events.sparkSession, "impact")  # sets of ids are read again and again
    ids = lambda df, column: df.select(F.col(column).cast("string").alias("id")).filter("id IS NOT NULL").distinct()
    union = lambda *parts: reduce(lambda a, b: a.unionByName(b), [p for p in parts if p is not None]).distinct()
    events = scratch.keep(tables.events.select("event_id", own_project(tables.events).alias("own")).dropDuplicates(["event_id"]), "events")
    on = lambda df, among, column="event_id": df.join(among.select(F.col("id").alias(column)), column, "left_semi")
    hit = scratch.keep(ids(selected, "event_id"), "selected")
    direct = union(ids(on(events, hit), "own"), ids(project_keys, "project_key") if project_keys is not None else None)
    claim_cites = scratch.keep(cited(tables.claims, "claim_id"), "cites")
    claims = union(ids(on(claim_cites, hit), "id"), ids(tables.claims.join(claim_ids.select("claim_id"), "claim_id", "left_semi"), "claim_id") if claim_ids is not None else None)
    claims = scratch.keep(claims, "claims")
    of_claims = ids(claim_cites.join(claims, "id", "left_semi"), "event_id")
    projects = scratch.keep(union(direct, ids(on(events, of_claims), "own")), "projects")
    if action == "forget":
        hit = scratch.keep(union(hit, ids(on(events, of_claims), "event_id")), "hit")
        direct = projects
    feedback = union(ids(on(cited(tables.feedback, "feedback_id"), hit), "id"), ids(on(tables.feedback, direct, "project_key"), "feedback_id") if "project_key" in tables.feedback.columns else None)
    feedback = scratch.keep(feedback, "feedback")
    signals = tables.rules.select(F.col("evolution_id").alias("id"), (F.col("feedback_id") if "feedback_id" in tables.rules.columns else F.explode("feedback_ids")).alias("feedback_id"))
    promoted = ids(on(tables.rules, claims, "promoted_claim_id"), "evolution_id") if "promoted_claim_id" in tables.rules.columns else None
    rules = union(ids(on(signals, feedback, "feedback_id"), "id"), ids(on(cited(tables.rules, "evolution_id"), hit), "id"), promoted)
    found = {"event": hit, "project": projects, "claim": claims, "feedback": feedback, "rule": rules}
    if tables.documents is not None:
        found["document"] = ids(on(tables.documents, direct, "project_key"), "path")
    if tables.nodes is not None:
        known = union(claims, feedback, rules, found.get("document"))
        by_project = ids(on(tables.nodes, direct, "project_key"), "id") if "project_key" in tables.nodes.columns else None
        found["node"] = union(ids(tables.nodes.join(known, "id", "left_semi"), "id"), by_project)
        if tables.edges is not None:
            ends = tables.edges.select("edge_id", F.explode(F.array("source", "target")).alias("id"))
            found["edge"] = ids(ends.join(found["node"], "id", "left_semi"), "edge_id")
    return reduce(lambda a, b: a.unionByName(b), [rows.select(F.lit(kind).alias("kind"), "id") for kind, rows in found.items()])


def plan(tables: Tables, asked: dict[str, list[str]], action: str) -> tuple[DataFrame, DataFrame]:
    """A dry run: the impact of a request, and its selectors that match nothing (selector, value)."""
    spark = tables.events.sparkSession
    frame = lambda name, column: spark.createDataFrame([(v,) for v in asked[name]], f"{column} string")
    touched = impact(tables, select_events(tables.events, asked), action, frame("claim_ids", "claim_id"), frame("project_keys", "project_key"))
    owners = tables.events.select(own_project(tables.events).alias("v")) if tables.documents is None else tables.events.select(own_project(tables.events).alias("v")).unionByName(tables.documents.select(F.col("project_key").alias("v")))
    there = {"source_file_ids": tables.events.select(F.col("source_file_id").alias("v")), "event_ids": tables.events.select(F.col("event_id").alias("v")), "claim_ids": tables.claims.select(F.col("claim_id").alias("v")), "project_keys": owners}
    missing = [frame(name, "v").join(known.distinct(), "v", "left_anti").select(F.lit(name).alias("selector"), F.col("v").alias("value")) for name, known in there.items()]
    return touched, reduce(lambda a, b: a.unionByName(b), missing)


def retract(claims: DataFrame, touched: DataFrame) -> DataFrame:
    """Claims with the touched ones (kind claim) marked retracted."""
    ids = touched.filter("kind = 'claim'").select(F.col("id").alias("claim_id"), F.lit(True).alias("_hit"))
    return claims.join(ids, "claim_id", "left").withColumn("status", F.when(F.col("_hit"), "retracted").otherwise(F.col("status"))).drop("_hit")


def without(rows: DataFrame, touched: DataFrame, kind: str, key: str) -> DataFrame:
    """``rows`` without those of a kind that were touched."""
    return rows.join(touched.filter(F.col("kind") == kind).select(F.col("id").alias(key)), key, "left_anti")


def scrub(rows: DataFrame, column: str, literals: list[str], by: str = "[FORGOTTEN]") -> DataFrame:
    """``rows`` with every literal of a request replaced in a text column, the longest first; blank ones are ignored."""
    text = F.col(column)
    for literal in sorted({x for x in literals if x.strip()}, key=lambda x: (-len(x), x)):
        text = F.replace(text, F.lit(literal), F.lit(by))
    return rows.withColumn(column, text)


def tombstones(touched: DataFrame, events: DataFrame | None = None, asked_projects: list[str] | None = None) -> DataFrame:
    """kind, sha256: what a forget leaves behind; ids are never stored in the clear.

    With ``events`` the locators of touched events are kept too, with ``asked_projects`` only projects named by the request.
    """
    plural = F.create_map(*[F.lit(x) for pair in TOMBSTONES.items() for x in pair])
    rows = touched.filter(F.col("kind").isin("event", "project", "source"))
    if asked_projects is not None:
        rows = rows.filter((F.col("kind") != "project") | F.col("id").isin(asked_projects))
    out = rows.select(plural[F.col("kind")].alias("kind"), F.sha2("id", 256).alias("sha256"))
    if events is not None:
        gone = events.join(touched.filter("kind = 'event'").select(F.col("id").alias("event_id")), "event_id", "left_semi")
        locator = F.concat("source_file_id", F.char(F.lit(0)), F.col("record_locator"))
        out = out.unionByName(gone.select(F.lit("event_locators").alias("kind"), F.sha2(locator, 256).alias("sha256")))
    return out.distinct()


def schedule(policies: DataFrame, new: DataFrame) -> DataFrame:
    """Policies (selector_sha256, recheck_after, retain_until) with the new ones in place of those of the same selector; the last of repeated new ones by date."""
    latest = new.groupBy("selector_sha256").agg(F.max(F.struct("recheck_after", "retain_until")).alias("p")).select("selector_sha256", "p.*")
    return policies.join(latest.select("selector_sha256"), "selector_sha256", "left_anti").select(*latest.columns).unionByName(latest)


def due(policies: DataFrame, as_of: str) -> DataFrame:
    """Policies and dated claims (id, recheck_after, retain_until) that are due by ``as_of``, with the reasons."""
    reason = F.array_compact(F.array(F.when(F.col("recheck_after") <= as_of, "recheck_after"), F.when(F.col("retain_until") <= as_of, "retain_until")))
    return policies.withColumn("reasons", reason).filter("size(reasons) > 0")
