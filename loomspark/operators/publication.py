"""Publishing reviewed knowledge: documents, graph and index as tables, integrity checks, and versioned writes."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import stable_hash


def nodes(documents: DataFrame, claims: DataFrame, feedback: DataFrame, rules: DataFrame, assertions: DataFrame | None = None) -> DataFrame:
    """id, kind, title of the graph: documents, what projects assert, claims, feedback signals and rules."""
    pick = lambda df, key, kind, title: df.select(F.col(key).cast("string").alias("id"), F.lit(kind).alias("kind"), F.col(title).cast("string").alias("title"))
    parts = [pick(documents, "path", "document", "title"), pick(claims, "claim_id", "claim", "statement"), pick(feedback, "feedback_id", "feedback_signal", "statement"), pick(rules, "evolution_id", "rule_evolution", "rule")]
    if assertions is not None:
        parts.append(pick(assertions, "assertion_id", "project_assertion", "text"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def edges(documents: DataFrame, claims: DataFrame, feedback: DataFrame, rules: DataFrame, assertions: DataFrame | None = None, evidence: DataFrame | None = None, relationships: DataFrame | None = None) -> DataFrame:
    """edge_id, source, target, relation: what contains, supports, contradicts, replaces or activates what.

    A project's records belong to its one document, the first by path should there be more.  assertions: assertion_id, project_key; evidence: claim_id,
    project_key of the events a claim cites; relationships: source_path, target_path, relation of documents.
    """
    of_project = documents.filter("project_key IS NOT NULL").groupBy("project_key").agg(F.min("path").alias("source"))
    within = lambda df, key, relation: df.join(of_project, "project_key").select("source", F.col(key).alias("target"), F.lit(relation).alias("relation"))
    links = lambda df, key, field, relation: df.select(F.col(key).alias("source"), F.explode(field).alias("target"), F.lit(relation).alias("relation"))
    cited = F.col("feedback_id") if "feedback_id" in rules.columns else F.explode("feedback_ids")  # rules may come as one row per signal
    supports = rules.select(cited.alias("source"), F.col("evolution_id").alias("target"), F.lit("supports-evolution").alias("relation"))
    activates = rules.filter("promoted_claim_id IS NOT NULL").select(F.col("evolution_id").alias("source"), F.col("promoted_claim_id").alias("target"), F.lit("activates-claim").alias("relation"))
    parts = [within(claims, "claim_id", "contains-claim"), within(feedback, "feedback_id", "records-feedback"), links(claims, "claim_id", "conflicts", "conflicts"), links(claims, "claim_id", "supersedes", "supersedes"), supports, activates]
    if assertions is not None:
        parts.append(within(assertions, "assertion_id", "contains-assertion"))
    if evidence is not None:
        parts.append(within(evidence, "claim_id", "evidence-for-claim"))
    if relationships is not None:
        parts.append(relationships.select(F.col("source_path").alias("source"), F.col("target_path").alias("target"), "relation"))
    every = reduce(lambda a, b: a.unionByName(b), parts).distinct()
    return every.select(F.concat(F.lit("edge-"), stable_hash("source", "target", "relation", length=24)).alias("edge_id"), "source", "target", "relation")


def graph_errors(node_rows: DataFrame, edge_rows: DataFrame, index: DataFrame) -> DataFrame:
    """location, message: repeated nodes, endpoints that don't exist, documents on one side only, unsafe paths."""
    rows = lambda df, key, message: df.select(F.col(key).cast("string").alias("location"), F.lit(message).alias("message"))
    ids = node_rows.select(F.col("id").alias("end")).distinct()
    ends = edge_rows.select("edge_id", F.explode(F.array("source", "target")).alias("end")).join(ids, "end", "left_anti").select("edge_id").distinct()
    docs = node_rows.filter("kind = 'document'").select(F.col("id").alias("path")).distinct()
    unsafe = index.filter(F.col("path").rlike(r"(^|/)\.\.(/|$)|^/|^[A-Za-z]:|\\|(^|/)archive(/|$)"))
    return reduce(
        lambda a, b: a.unionByName(b),
        [
            rows(node_rows.groupBy("id").count().filter("count > 1"), "id", "node is not unique"), rows(ends, "edge_id", "an end does not exist"), rows(docs.join(index, "path", "left_anti"), "path", "document is not in the index"),
            rows(index.select("path").distinct().join(docs, "path", "left_anti"), "path", "document is not in the graph"), rows(unsafe, "path", "unsafe path"),
        ],
    )


def link_audit(documents: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """path, links: how many edges touch each document."""
    ends = edge_rows.select(F.explode(F.array("source", "target")).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("links"))
    return documents.select("path").join(ends, "path", "left").select("path", F.coalesce("links", F.lit(0)).alias("links"))


def cards(entries: DataFrame, key: str, order: list) -> DataFrame:
    """key, markdown: the entries of a page in order, one line each with its status and evidence.

    entries: key, position, text, status, evidence_event_ids.  A page is what one reader reads; its entries are joined in one task.
    """
    line = F.concat(F.lit("- "), F.regexp_replace("text", r"\s+", " "), F.lit(" ("), F.col("status"), F.lit("; "), F.array_join("evidence_event_ids", ", "), F.lit(")"))
    return entries.withColumn("line", line).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda s: s["line"]), "\n").alias("markdown"))


def stale_paths(previous: DataFrame, current: DataFrame) -> DataFrame:
    return previous.select("path").exceptAll(current.select("path"))


def manifest(tables: dict[str, DataFrame]) -> dict[str, dict]:
    """Rows and an order-free content hash of each table, in one aggregation per table."""
    out = {}
    for name, df in tables.items():
        row = F.xxhash64(F.to_json(F.struct(*[df[c] for c in sorted(df.columns)]), {"ignoreNullFields": "false"}))
        n, low, high = df.agg(F.count(F.lit(1)), F.sum(F.pmod(row, F.lit(1 << 31))), F.bit_xor(row)).first()
        out[name] = {"rows": n, "hash": f"{low or 0}:{high or 0}"}
    return out


class VersionedFolder:
    """Tables published together: written to a new version, then made current by replacing one pointer file.

    A reader always sees one whole version; a crash leaves the old one current.  ``publish`` refuses to replace a version other than the
    one it was told it replaces.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        os.makedirs(root, exist_ok=True)

    def current(self) -> str | None:
        try:
            with open(os.path.join(self.root, "CURRENT")) as file:
                return json.load(file)["version"]
        except FileNotFoundError:
            return None

    def publish(self, tables: dict[str, DataFrame], replaces: str | None = None) -> str:
        if self.current() != replaces:
            raise ValueError(f"the current version is {self.current()}, not {replaces}")
        version = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(os.path.join(self.root, version, name))
        content = manifest({n: self.spark.read.parquet(os.path.join(self.root, version, n)) for n in tables})
        fd, temporary = tempfile.mkstemp(dir=self.root)
        with os.fdopen(fd, "w") as file:
            json.dump({"version": version, "tables": content}, file)
            file.flush()
            os.fsync(file.fileno())
        os.replace(temporary, os.path.join(self.root, "CURRENT"))
        return version

    def read(self, name: str, verify: bool = False) -> DataFrame:
        with open(os.path.join(self.root, "CURRENT")) as file:
            pointer = json.load(file)
        df = self.spark.read.parquet(os.path.join(self.root, pointer["version"], name))
        if verify and manifest({name: df})[name] != pointer["tables"][name]:
            raise ValueError(f"{name} is not what was published")
        return df
