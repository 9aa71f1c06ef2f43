"""Pages made of reviewed rows: quote cards, project dossiers, the index, related links, the compatibility matrix, evidence rules, and their folder.

A page is what one reader reads: its parts are bounded lists (the feature), picked before any text is joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import collapsed, excerpt, slug
from loomspark.functions.tokens import corpus_keywords, folded

# How many entries a section of a page shows at most.
CANDIDATES, DELIVERIES, CARD_CHARS = 300, 40, 600


def quote_card(row: dict[str, str] | None = None, limit: int = CARD_CHARS) -> Column:
    """Markdown of one event: who, when and where, its text as a quotation, its id as evidence."""
    c = {"role": "role", "at": "timestamp", "id": "event_id", "text": "content"} | (row or {})
    quoted = F.concat(F.lit("> "), F.regexp_replace(excerpt(F.col(c["text"]), limit), r"\r\n|\r|\n", "\n> "))
    return F.concat(F.lit("- **"), F.coalesce(c["role"], F.lit("unknown")), F.lit("** "), F.coalesce(c["at"], F.lit("without a time")), F.lit("\n"), quoted, F.lit("\n  (`"), c["id"], F.lit("`)"))


def last_entries(events: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """The last ``limit`` rows of each key, numbered ``nth`` from the first shown: found by rank from the end, so the rest of a key is never sorted out."""
    from_end = F.row_number().over(Window.partitionBy(key).orderBy(*[c.desc() for c in order]))
    last = events.withColumn("_from_end", from_end).filter(F.col("_from_end") <= limit)
    return last.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_from_end")))).drop("_from_end")


def section(entries: DataFrame, key: str, title: str, line: Column) -> DataFrame:
    """key, title, markdown: a section of a page from its bounded entries (key, nth), an entry a paragraph."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))), lambda s: s["line"]), "\n\n")
    return entries.groupBy(key).agg(body.alias("body")).select(key, F.lit(title).alias("title"), F.concat(F.lit(f"## {title}\n\n"), "body").alias("markdown"))


def dossier_figures(events: DataFrame, key: str = "project_key") -> DataFrame:
    """key, agents, sessions, first_at, last_at, n and counts by kind: the head of a dossier.  Agents are as many as there are products."""
    at = F.nullif("timestamp", F.lit(""))
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    kind = F.col("event_type")
    return events.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.array_sort(F.collect_set("source_agent")).alias("agents"), F.countDistinct("session_id").alias("sessions"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count(F.lit(1)).alias("n"),
        count((kind == "message") & (F.col("role") == "user")).alias("asked"), count((kind == "message") & (F.col("role") == "assistant")).alias("answered"), count(kind.isin("tool_call", "patch")).alias("acted"),
        count(kind == "delivery").alias("delivered"), count(kind == "error").alias("failed"),
    )


def dossiers(events: DataFrame, order: list[Column], key: str = "project_key") -> DataFrame:
    """key, markdown: a project's dossier, its figures and its last deliveries as cards."""
    figures = dossier_figures(events, key)
    title = F.concat(F.lit("# "), key, F.lit("\n\n"), F.col("n"), F.lit(" events in "), F.col("sessions"), F.lit(" sessions, "), F.coalesce("first_at", F.lit("?")), F.lit(" to "), F.coalesce("last_at", F.lit("?")), F.lit("; "), F.array_join("agents", ", "))
    delivered = section(last_entries(events.filter((F.col("event_type") == "delivery") & F.col(key).isNotNull()), key, order, DELIVERIES), key, "Deliveries", quote_card())
    joined = figures.select(key, title.alias("head")).join(delivered.select(key, "markdown"), key, "left")
    return joined.select(key, F.concat_ws("\n\n", "head", F.coalesce("markdown", F.lit("No deliveries."))).alias("markdown"))


def related_sections(links: DataFrame) -> DataFrame:
    """path, markdown: the links of each page, each target and edge once, sorted.  links: path, other, title, relation, edge_id."""
    once = links.dropDuplicates(["path", "other", "edge_id"])
    nth = F.row_number().over(Window.partitionBy("path").orderBy("title", "other", "edge_id"))
    line = F.concat(F.lit("- ["), "title", F.lit("]("), "other", F.lit("): "), "relation")
    return section(once.withColumn("nth", nth), "path", "Related", line).select("path", "markdown")


def index_entries(events: DataFrame, order: list[Column], limit: int = 120) -> DataFrame:
    """path, type, project_key, title, aliases, keywords of the draft index: one page a project, named by its first label; keywords over whole contents."""
    rows = events.filter("project_key IS NOT NULL")
    first = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    labels = rows.filter("project_label IS NOT NULL").groupBy("project_key").agg(F.min_by("project_label", first).alias("title"))
    words = corpus_keywords(rows, "project_key", F.concat_ws(" ", "project_label", "content"), first, limit)
    named = rows.select("project_key").distinct().join(labels, "project_key", "left").withColumn("title", F.coalesce("title", "project_key"))
    path = F.concat(F.lit("projects/"), slug(folded("title"), F.col("project_key")))
    return named.join(words, "project_key", "left").select(path.alias("path"), F.lit("project").alias("type"), "project_key", "title", F.array().cast("array<string>").alias("aliases"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))


def compatibility(found: DataFrame, adapters: list[str]) -> DataFrame:
    """adapter, sources, events, status of every adapter known: verified where events came out, seen where only sources did, else not seen.  found: adapter, sources, events."""
    known = found.sparkSession.createDataFrame([(a,) for a in adapters], "adapter string")
    joined = known.join(found.groupBy("adapter").agg(F.sum("sources").alias("sources"), F.sum("events").alias("events")), "adapter", "left").na.fill(0, ["sources", "events"])
    return joined.withColumn("status", F.when(F.col("events") > 0, "verified").when(F.col("sources") > 0, "seen").otherwise("not seen"))


def evidence_rules(counters: dict[str, int]) -> str:
    """The page that says how far evidence carries, with a run's counters."""
    lines = ["# Evidence rules", "", "- A: the person's own words.", "- B: what tools, files and systems show.", "- C: what agents report.", "- D: everything else; never enough by itself.", ""]
    return "\n".join(lines + [f"- {name.replace('_', ' ')}: {value}" for name, value in sorted(counters.items())])


def rule_summary(rules: DataFrame) -> DataFrame:
    """One row: rules by status and what that adds up to (none, proposed, active, validated)."""
    n = lambda *statuses: F.count_if(F.col("status").isin(*statuses))
    sums = rules.agg(n("candidate").alias("candidate"), n("approved").alias("approved"), n("validated").alias("validated"), n("rejected").alias("rejected"))
    return sums.withColumn("summary", F.when(F.col("validated") > 0, "validated").when(F.col("approved") > 0, "active").when(F.col("candidate") > 0, "proposed").otherwise("none"))


def page_moves(previous: DataFrame, current: DataFrame, archive: DataFrame, run_id: str) -> DataFrame:
    """path, action, target of a new set of pages: write, keep (same hash), archive (no longer there; never over an archived page), or refuse.

    previous, current: path, sha256; archive: path.  Paths that leave the folder, or lie in the archive, are refused.
    """
    p, c = previous.select("path", F.col("sha256").alias("_old")), current.select("path", F.col("sha256").alias("_new"))
    both = p.join(c, "path", "full_outer")
    unsafe = F.col("path").rlike(r"(^|/)\.\.(/|$)|^/|^[A-Za-z]:|\\|^archive(/|$)")
    target = F.when(F.col("_new").isNull(), F.concat(F.lit(f"archive/{run_id}/"), "path"))
    moves = both.withColumn("target", target).join(archive.select(F.col("path").alias("target"), F.lit(True).alias("_taken")), "target", "left")
    action = F.when(unsafe, "refuse").when(F.col("_new").isNull(), F.when(F.col("_taken"), "refuse").otherwise("archive")).when(F.col("_new") == F.col("_old"), "keep").otherwise("write")
    return moves.select("path", action.alias("action"), F.when(action == "archive", F.col("target")).alias("target"))


def without_sections(text: Column, titles: list[str]) -> Column:
    """Markdown without the level-two sections of these titles, whatever stands below them up to the next heading of that level or above."""
    for title in titles:
        text = F.regexp_replace(text, rf"(?m)^## {title}[ \t]*(?:\r?\n|\z)(?:(?!^##? )[\s\S])*", "")
    return F.trim(text, F.lit(" \n"))


def page_text(parts: list[Column]) -> Column:
    """The parts of a page, blank ones left out, with a line feed at the end."""
    kept = F.filter(F.array(*parts), lambda p: F.coalesce(collapsed(p), F.lit("")) != "")
    return F.concat(F.array_join(kept, "\n\n"), F.lit("\n"))


def union_pages(pages: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), pages)
