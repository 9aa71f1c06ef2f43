"""A knowledge base from end to end: rebuild evidence from session files, publish reviewed knowledge, verify the search, query, retract and forget.

Each layer is a versioned folder of tables (``publication.VersionedFolder``): a run writes a new version and makes it current at once, so a reader
sees one whole state, and a run that fails leaves the old one.  Folders of one knowledge base: evidence, knowledge, audit.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as fx
from loomspark.operators import canonical, context_units, gates, lifecycle, pages, publication, review, sanitize, search, snapshots
from loomspark.operators import evidence as ev
from loomspark.session import Scratch
from loomspark.sources import adapters
from loomspark.sources.lines import register
from loomspark.streaming import ingest

# The agents behind the formats, the version of events and of the redaction rules, what an event holds.
AGENTS = {"codex-jsonl": "Codex", "clacky-json": "Clacky", "clacky-chunk": "Clacky", "claude-code-jsonl": "Claude Code", "workbuddy-jsonl": "WorkBuddy", "neo-claude-jsonl": "Neo", "cursor-agent-jsonl": "Cursor"}
SCHEMA_VERSION, POLICY = "1.3", "7"
EVENT_FIELDS = (
    "event_id source_agent adapter source_file_id source_relpath session_id logical_session_id record_locator sequence role actor_kind event_type evidence_grade content content_sha256 timestamp parent_session_id flags call_id tool_name "
    "project_key project_label session_title working_dir metadata schema_version"
).split()
_PLAIN = r"^file:/*"


def parse_sources(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Tagged rows (kind event, excluded, error) of all session files under ``root``, of lines and of whole documents; and path, adapter of the files."""
    register(spark)
    tagged = adapters.read_sessions(spark, root)
    docs = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    whole = lambda glob: docs.option("pathGlobFilter", glob).load(root).select(F.regexp_replace("_metadata.file_path", _PLAIN, "/").alias("path"), "value")
    candidate = lambda df: df.filter(snapshots.is_candidate(F.regexp_replace("path", "^" + root.rstrip("/") + "/", "")))
    parts = [("clacky-json", adapters.parse_clacky_json(candidate(whole("*.json")))), ("clacky-chunk", adapters.parse_clacky_chunk(candidate(whole("*-chunk-*.md"))))]
    for name, rows in parts:
        lane = F.create_map(F.lit("transport_lane"), F.lit(name))
        tagged = tagged.unionByName(rows.withColumns({"kind": F.lit("event"), "adapter": F.lit(name), "metadata": lane}), allowMissingColumns=True)
    return tagged, tagged.select("path", "adapter").distinct()


def unify(tagged: DataFrame, root: str, homes: tuple[str, ...] = ()) -> DataFrame:
    """Raw events as unified ones: redacted, classified, with content hash, grade and a proposed project; ids follow once sessions are stitched."""
    agents = F.create_map(*[F.lit(x) for pair in AGENTS.items() for x in pair])
    rows = tagged.filter("kind = 'event'").withColumns({"source_file_id": fx.stable_hash("path"), "source_agent": F.coalesce(F.try_element_at(agents, F.col("adapter")), "adapter"), "source_relpath": F.regexp_replace("path", "^" + root.rstrip("/") + "/", "")})
    rows = sanitize.sanitize(rows.withColumn("content", F.coalesce("content", F.lit(""))), "content", "_clean", homes).withColumn("content", F.col("_clean")).drop("_clean")
    rows = rows.withColumn("flags", ev.classify_flags(F.col("content"), F.col("flags")))
    rows = rows.withColumn("actor_kind", ev.actor_kind(F.col("role"), F.col("flags"), F.col("actor_hint")))
    identity = fx.project_identity(F.lit(None).cast("string"), F.col("working_dir"), F.col("source_agent"), F.col("session_id"))
    rows = rows.withColumns({"evidence_grade": ev.evidence_grade(F.col("role"), F.col("event_type"), F.col("actor_kind")), "content_sha256": F.sha2("content", 256), "_i": identity, "schema_version": F.lit(SCHEMA_VERSION)})
    rows = rows.withColumns({"project_key": F.nullif("_i.key", F.lit("")), "project_label": F.col("_i.label"), "working_dir": sanitize.display_path(F.col("working_dir"), homes)})
    return rows.drop("_i", "kind", "reason", "actor_hint")


@dataclass
class Run:
    """What a rebuild made: tables by name, and the report of the run."""

    tables: dict[str, DataFrame]
    report: dict


class KnowledgeBase:
    """A knowledge base at ``root`` (which may also be given as its knowledge folder)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = os.path.dirname(root.rstrip("/")) if os.path.basename(root.rstrip("/")) == "knowledge" else root.rstrip("/")
        self.evidence, self.knowledge, self.audit = (publication.VersionedFolder(spark, os.path.join(self.root, name)) for name in ("evidence", "knowledge", "audit"))

    # ---- evidence ----------------------------------------------------------------------------------------------------

    def rebuild(self, sources: str, homes: tuple[str, ...] = (), policy: str = POLICY, dry_run: bool = False) -> Run:
        """Evidence from the session files under ``sources``: parsed, redacted, quarantined, stitched, freed of mirrors and of what was forgotten.

        Sources that did not change keep their rows; rewritten ones are replaced; appended ones are parsed anew from the start, as context is carried
        from there, and keep the events known; unstable and missing ones keep what they had.  Another policy parses everything anew.  A dry run writes nothing.
        """
        with gates.writer_lock(self.root):
            spark, scratch = self.spark, Scratch(self.spark, "rebuild")
            before = self.evidence.current()
            old = {name: self.evidence.read(name) for name in ("events", "snapshot", "state")} if before else {}
            snapshot = scratch.keep(snapshots.freeze(spark, sources, old.get("snapshot")), "snapshot")
            tagged, files = parse_sources(spark, sources)
            tagged = scratch.keep(tagged, "tagged")
            policy_changed = bool(old) and old["state"].filter(F.col("policy") != policy).limit(1).count() > 0
            plain = lambda df: df.withColumn("path", F.regexp_replace("path", _PLAIN, "/"))
            if old:
                changes = plain(snapshots.source_changes(old["snapshot"], snapshot))
                actions = scratch.keep(ingest.plan(changes, files.select("path", F.col("adapter").endswith("-jsonl").alias("append_only")), policy_changed), "actions")
                tagged = tagged.join(actions.filter("action IN ('parse', 'tail')").select("path"), "path", "left_semi")
            else:
                actions = plain(snapshot).select("path", F.lit("added").alias("change"), F.lit("parse").alias("action"))
            rows = scratch.keep(unify(tagged, sources, homes), "unified")
            own = (os.path.basename(self.root) + "/",)
            reason = ev.quarantine_reason(F.col("flags"))
            kept = rows.filter(reason.isNull())
            memory = ev.memory_rows(kept, F.array_contains("flags", "old_memory_reference") & (F.col("event_type") == "tool_call"))
            spot = ["source_file_id", "record_locator"]
            excluded = [rows.filter(reason.isNotNull()).select(*spot, reason.alias("reason")), memory.select(*spot, F.lit("old_memory_reference").alias("reason")), tagged.filter("kind = 'excluded'").select(fx.stable_hash("path").alias("source_file_id"), "record_locator", "reason")]
            kept = kept.join(memory.select(*spot).distinct(), spot, "left_anti")
            outside = ev.without_self_reconstruction(kept, own)
            excluded.append(kept.join(outside.select(*spot).distinct(), spot, "left_anti").select(*spot, F.lit("self_reconstruction").alias("reason")))
            events = self._identified(outside, old.get("events"), actions, scratch)
            mirrors = scratch.keep(ev.mirrored(events), "mirrors")
            events = events.join(mirrors.filter("kept").select("event_id"), "event_id", "left_semi")
            if self._has(self.audit, "tombstones"):
                events = ev.without_forgotten(events, self.audit.read("tombstones"))
            events = scratch.keep(events.select(*EVENT_FIELDS), "events")
            errors = tagged.filter("kind = 'error'").select(fx.stable_hash("path").alias("source_file_id"), "record_locator", F.col("reason").alias("error"))
            seen = tagged.groupBy(fx.stable_hash("path").alias("source_file_id")).agg(F.countDistinct(fx.canonical_locator(F.col("record_locator"))).alias("records_seen"))
            outcomes = reduce(lambda a, b: a.unionByName(b), [rows.select(*spot), *[x.select(*spot) for x in excluded], errors.select(*spot)]).distinct()
            accounting = ev.transport_accounting(outcomes, seen)
            changed = ev.changes(old["events"], events, ["content", "project_key"]) if old else events.select("event_id", F.lit("added").alias("change"))
            unaccounted = accounting.filter("unaccounted > 0").limit(1).count()
            tables = {
                "events": events, "dispositions": mirrors.select("event_id", F.when(F.col("kept"), "kept").otherwise("mirror").alias("disposition"), "target"), "excluded": reduce(lambda a, b: a.unionByName(b), excluded).distinct(), "errors": errors.distinct(), "accounting": accounting, "snapshot": snapshot,
                "actions": actions, "impact": changed, "state": spark.createDataFrame([(policy, SCHEMA_VERSION)], "policy string, schema_version string"), "manifest": ev.project_manifest(events),
            }
            counts = {f"{name}": df.count() for name, df in tables.items() if name in ("events", "excluded", "errors", "impact")}
            report = {"counters": counts, "gates": {"accounting_complete": not unaccounted}, "preserves_publication": bool(old) and not policy_changed and counts["impact"] == 0}
            if not dry_run:
                self.evidence.publish(tables, replaces=before)
            return Run(tables, report)

    def _identified(self, rows: DataFrame, old: DataFrame | None, actions: DataFrame, scratch: Scratch) -> DataFrame:
        """Rows with sticky projects, stitched sessions and event ids, merged with the rows kept from before."""
        first = ev.first_identity(rows.withColumn("event_id", F.col("record_locator")))
        rows = rows.drop("project_key", "project_label").join(first, ["source_file_id", "session_id"], "left")
        columns = [c for c in EVENT_FIELDS if c not in ("event_id", "logical_session_id")]
        rows = rows.select(*columns)
        if old is not None:
            again = actions.filter("action IN ('parse', 'tail')").select(fx.stable_hash("path").alias("source_file_id"))
            rows = rows.unionByName(old.join(again, "source_file_id", "left_anti").select(*columns))
        rows = scratch.keep(rows, "rows")
        logical = ev.logical_sessions(rows)
        rows = rows.join(logical, ["source_agent", "session_id"])
        session = F.concat(F.lit("session:"), "logical_session_id")
        proposed = F.col("project_key").isNull() | F.col("project_key").startswith("session:")
        rows = rows.withColumns({"project_label": F.when(proposed, F.coalesce("session_title", F.concat(F.lit("Session chain "), F.substring("logical_session_id", -12, 12)))).otherwise(F.col("project_label")), "project_key": F.when(proposed, session).otherwise(F.col("project_key"))})
        ids = fx.event_id(*[F.col(c) for c in ("source_file_id", "record_locator", "role", "event_type", "content_sha256", "call_id")])
        return scratch.keep(ev.without_replays(rows.withColumn("event_id", ids), [F.col("sequence")]).select(*EVENT_FIELDS), "identified")

    @staticmethod
    def _has(folder: publication.VersionedFolder, name: str) -> bool:
        return folder.current() is not None and os.path.isdir(os.path.join(folder.root, folder.current(), name))

    # ---- knowledge ----------------------------------------------------------------------------------------------------

    def review_errors(self, tables: dict[str, DataFrame]) -> DataFrame:
        """rule, location, message of reviewed tables (claims, feedback, rules, and units and states if given) against the evidence."""
        events = self.evidence.read("events")
        claims, feedback = tables["claims"], tables["feedback"]
        parts = [
            review.repeated(claims, "claim_id", "claim-id"), review.outside(claims, "claim_id", "status", review.CLAIM_STATUSES, "claim-status"), review.unknown_evidence(claims, "claim_id", events, "claim-evidence"), review.dangling(claims, "claim_id", "conflicts", "claim-conflicts"),
            review.dangling(claims, "claim_id", "supersedes", "claim-supersedes"), review.repeated(feedback, "feedback_id", "feedback-id"), review.unknown_evidence(feedback, "feedback_id", events, "feedback-evidence"), review.repeated(tables["rules"], "evolution_id", "rule-id"),
        ]
        if "units" in tables:
            units = context_units.unit_errors(tables["units"], tables["states"])
            parts.append(units.select(F.lit("unit").alias("rule"), F.concat_ws("/", "doc_key", "unit_id").alias("location"), "message"))
        return review.union(parts)

    def distill(self, tables: dict[str, DataFrame], run_id: str) -> dict:
        """Publish reviewed tables as documents, graph and index; refused if the review or the graph has an error.

        tables: claims, feedback, rules, base_documents (doc_key, position, path, type, project_key, title, aliases, keywords), and units and states if any.
        """
        with gates.writer_lock(self.root):
            if first := self.review_errors(tables).limit(20).collect():
                raise ValueError(f"the review has errors: {[tuple(r) for r in first]}")
            spark, before = self.spark, self.knowledge.current()
            events = self.evidence.read("events")
            index = pages.index_entries(events, ev.total_order())
            projects = index.select(F.col("project_key").alias("doc_key"), F.lit(1_000_000).alias("position"), "path", "type", "project_key", "title", "aliases", "keywords")
            documents = Scratch(spark, "distill").keep(tables["base_documents"].select(*projects.columns).unionByName(projects), "documents")
            edges = publication.edges(documents, tables["claims"], tables["feedback"], tables["rules"])
            nodes = publication.nodes(documents, tables["claims"], tables["feedback"], tables["rules"])
            if first := publication.graph_errors(nodes, edges, documents).limit(20).collect():
                raise ValueError(f"the graph has errors: {[tuple(r) for r in first]}")
            links = tables.get("links", spark.createDataFrame([], search.EDGES))
            empty = spark.createDataFrame([], "doc_key string, position struct<n: int>, unit_id string, section string, text string, status string, evidence_event_ids array<string>, conflicts array<string>, supersedes array<string>")
            written = {
                "documents": documents, "nodes": nodes, "edges": edges, "links": links, "units": tables.get("units", empty), "states": tables.get("states", spark.createDataFrame([], "doc_key string, field string, unit_id string")), "link_audit": publication.link_audit(documents, edges),
                "dossiers": pages.dossiers(events, ev.total_order()), "moves": pages.page_moves(self._page_hashes(before), documents.select("path", canonical.row_hash(["path", "title"]).alias("sha256")), spark.createDataFrame([], "path string"), run_id),
                "run": spark.createDataFrame([(run_id, "published")], "run_id string, semantic_status string"),
            }
            version = self.knowledge.publish(written, replaces=before)
            self._complete(run_id, "needs_retrieval_verification", {g: g not in ("related_retrieval", "negative_retrieval") for g in gates.GATES})
            return {"version": version, "documents": documents.count()}

    def _page_hashes(self, version: str | None) -> DataFrame:
        if version is None:
            return self.spark.createDataFrame([], "path string, sha256 string")
        return self.knowledge.read("documents").select("path", canonical.row_hash(["path", "title"]).alias("sha256"))

    def _complete(self, run_id: str, status: str, passed: dict[str, bool], **more: DataFrame) -> None:
        """The audit tables: reports first, the completion with its gates last, all in one version, so that a crash leaves the old one."""
        kept = {"tombstones": self.audit.read("tombstones")} if self._has(self.audit, "tombstones") else {}
        tables = {**kept, **more, "gates": self.spark.createDataFrame(sorted(passed.items()), "gate string, passed boolean"), "completion": self.spark.createDataFrame([(run_id, status, self.knowledge.current() or "")], "run_id string, status string, knowledge_version string")}
        self.audit.publish(tables, replaces=self.audit.current())

    def verify(self, cases: DataFrame, **asked: int) -> dict:
        """Run a suite of cases over the published search and open or close the retrieval gates."""
        ready = search.suite_cases(cases)
        if first := search.suite_errors(ready).limit(20).collect():
            raise ValueError(f"the suite has errors: {[tuple(r) for r in first]}")
        found = search.search(ready.select(F.col("case_id").alias("task_id"), "task"), self.knowledge.read("documents"), self.knowledge.read("links"), **asked)
        verdicts = Scratch(self.spark, "suite").keep(search.suite_verdicts(ready, found), "verdicts")
        report = search.suite_report(verdicts).first()
        passed = {r.gate: r.passed for r in self.audit.read("gates").collect()} | {"related_retrieval": report.related_gate, "negative_retrieval": report.negative_gate}
        profile = self.spark.createDataFrame(sorted(search.profile(**asked).items()), "field string, value int")
        self._complete(self.audit.read("completion").first().run_id, report.status, passed, verdicts=verdicts, profile=profile)
        return report.asDict()

    def query(self, tasks: DataFrame, allow_unverified: bool = False, context_sufficient: bool = False, view: dict | None = None, **asked: int) -> dict[str, DataFrame]:
        """documents, receipts and, with ``view`` (options of a selection), units of every task; nothing is read where the context at hand suffices.

        The publication is checked first (gates, run ids, status, content) and must still be the same version afterwards.
        """
        if context_sufficient:
            return {"documents": search.skipped(self.spark)}
        version, completion = self.knowledge.current(), self.audit.read("completion").first()
        errors = gates.publication_errors({"run_id": completion.run_id, "status": completion.status}, self.knowledge.read("run").first().asDict(), self.audit.read("gates"), *[self.spark.createDataFrame([], "path string, size int, sha256 string")] * 2)
        if completion.knowledge_version != version:
            errors.append("the completion belongs to another version")
        if errors and not allow_unverified:
            raise ValueError(f"not to be read: {errors}")
        documents = self.knowledge.read("documents", verify=True)
        scratch = Scratch(self.spark, "query")
        found = scratch.keep(search.search(tasks, documents, self.knowledge.read("links"), **asked), "found")
        verified = {r.field: r.value for r in self.audit.read("profile").collect()} if self._has(self.audit, "profile") else {}
        out = {"documents": found, "receipts": scratch.keep(search.receipts(found, tasks, completion.run_id, verified, **asked), "receipts")}
        if view is not None:
            out["units"] = scratch.keep(search.search_units(found, tasks, documents, self.knowledge.read("units"), self.knowledge.read("states"), context_units.selection_options(**view)), "units")
        if self.knowledge.current() != version:
            raise RuntimeError("the publication changed while it was read")
        return out

    # ---- lifecycle ----------------------------------------------------------------------------------------------------

    def execute(self, action: str, asked: dict[str, list[str]], reviewed: dict[str, DataFrame], literals: tuple[str, ...] = (), apply: bool = False) -> dict[str, DataFrame]:
        """Retract or forget what a request selects; a dry run unless ``apply``.  Returns touched, unmatched and the reviewed tables after it.

        Forgetting removes events, and what rests on them, replaces ``literals`` in all remaining contents, and leaves hashed tombstones, which are written
        before the evidence changes; either action closes the gates until the knowledge is distilled and verified again.
        """
        with gates.writer_lock(self.root):
            scratch = Scratch(self.spark, "lifecycle")
            events = self.evidence.read("events")
            tables = lifecycle.Tables(events, reviewed["claims"], reviewed["feedback"], reviewed["rules"], self.knowledge.read("documents") if self.knowledge.current() else None)
            touched, unmatched = lifecycle.plan(tables, asked, action)
            touched = scratch.keep(touched, "touched")
            if action == "forget":
                after = {"claims": lifecycle.without(reviewed["claims"], touched, "claim", "claim_id"), "feedback": lifecycle.without(reviewed["feedback"], touched, "feedback", "feedback_id"), "rules": lifecycle.without(reviewed["rules"], touched, "rule", "evolution_id")}
            else:
                after = dict(reviewed) | {"claims": lifecycle.retract(reviewed["claims"], touched)}
            result = {"touched": touched, "unmatched": unmatched, **after}
            if not apply:
                return result
            run_id = self.audit.read("completion").first().run_id if self._has(self.audit, "completion") else ""
            closed = dict.fromkeys(gates.GATES, False)
            if action == "forget":
                dead = lifecycle.tombstones(touched, events, asked["project_keys"])
                earlier = self.audit.read("tombstones") if self._has(self.audit, "tombstones") else dead.limit(0)
                self._complete(run_id, "forgetting", closed, tombstones=scratch.keep(dead.unionByName(earlier).distinct(), "tombstones"))
                left = lifecycle.scrub(lifecycle.without(events, touched, "event", "event_id"), "content", list(literals))
                self.evidence.publish({name: (left if name == "events" else self.evidence.read(name)) for name in self._names(self.evidence)}, replaces=self.evidence.current())
            self._complete(run_id, "needs_distillation", closed)
            return result

    @staticmethod
    def _names(folder: publication.VersionedFolder) -> list[str]:
        return sorted(n for n in os.listdir(os.path.join(folder.root, folder.current())) if not n.startswith((".", "_")))


def golden(spark: SparkSession, root: str, cases: DataFrame) -> DataFrame:
    """case_id, check, ok of parsed samples: each case's folder under ``root`` gives its adapter, enough events, the wanted types, no forbidden text, unique locators, and no errors.

    cases: case_id, adapter, minimum_events, required_event_types, forbidden_text.
    """
    tagged, _ = parse_sources(spark, root)
    rows = tagged.withColumn("case_id", F.split(F.regexp_replace("path", "^" + root.rstrip("/") + "/", ""), "/")[0])
    per = rows.groupBy("case_id").agg(
        F.count_if(F.col("kind") == "event").alias("n"), F.count_if(F.col("kind") == "error").alias("errors"), F.array_sort(F.collect_set("adapter")).alias("adapters"), F.collect_set("event_type").alias("types"),
        F.countDistinct(F.when(F.col("kind") == "event", F.struct("path", "record_locator"))).alias("locators"), F.array_join(F.collect_list(F.coalesce("content", F.lit(""))), "\n").alias("text"),  # samples are small
    )
    empty = F.array().cast("array<string>")
    both = cases.join(per, "case_id", "left")
    checks = {
        "has adapter": F.array_contains("adapters", F.col("adapter")), "enough events": F.col("n") >= F.col("minimum_events"), "event types": F.size(F.array_except(F.coalesce("required_event_types", empty), "types")) == 0,
        "forbidden text": ~F.exists(F.coalesce("forbidden_text", empty), lambda t: F.col("text").contains(t)), "locators are unique": F.col("n") == F.col("locators"), "no errors": F.col("errors") == 0,
    }
    flat = F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.coalesce(test, F.lit(False)).alias("ok")) for name, test in checks.items()]))
    return both.select("case_id", flat.alias("c")).select("case_id", "c.*")
