"""Discovery reports and frozen snapshots of source files: hashes, denominators, comparison, structural fingerprints."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What may be a session file, and bytes hashed at either end.
CANDIDATE_SUFFIXES = ("jsonl", "ndjson", "json", "md", "db", "sqlite", "sqlite3")
SESSION_NAME = r"(?i)session|conversation|history|chat|transcript|rollout|project|composer"
SKIPPED = ".git node_modules plugins skills cache caches file-history binaries connectors connectors-marketplace downloads assets docs documentation".split()
BOUNDARY_BYTES, CHUNK_BYTES = 65536, 8 << 20
#: Folders a path may be deep, below a root known to hold sessions and below any other.
DEPTH, GENERIC_DEPTH = 12, 8


def is_candidate(path: Column, depth_limit: int | Column = DEPTH) -> Column:
    """Whether a path (relative to its root) may hold sessions; ``depth_limit`` is ``GENERIC_DEPTH`` below a root that belongs to no agent."""
    parts = F.split(path, "/")
    name, folders = F.element_at(parts, -1), F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), F.lower)
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    named = name.rlike(SESSION_NAME)
    kind = (suffix.isin(*CANDIDATE_SUFFIXES) & ((suffix != "md") | named | name.rlike(r"(?i)-chunk-\d+\.md$"))) | ((suffix == "") & named)
    return kind & ~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED))) & (F.size(parts) <= depth_limit)


_FROZEN = "path string, size bigint, modified timestamp, sha256 string, head_sha256 string, tail_sha256 string, prefix_sha256 string, stable boolean"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, length, modified, b_size of files to their hashes, read in chunks, so that no file must fit in memory."""
    from pyarrow import fs

    for batch in batches:
        rows = []
        for path, size, modified, b_size in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            local = re.match("file:/*", path)
            system, inner = (fs.LocalFileSystem(), "/" + path[local.end() :]) if local else fs.FileSystem.from_uri(quote(path, safe=":/@"))
            full, head, prefix, tail, at = hashlib.sha256(), hashlib.sha256(), hashlib.sha256(), b"", 0
            with system.open_input_stream(inner) as file:
                while at < size and (chunk := file.read(min(CHUNK_BYTES, size - at))):
                    full.update(chunk)
                    head.update(chunk[: max(0, BOUNDARY_BYTES - at)])
                    prefix.update(chunk[: max(0, (b_size or 0) - at)])
                    tail = (tail + chunk)[-BOUNDARY_BYTES:]
                    at += len(chunk)
            now = system.get_file_info(inner)
            stable = at == size == now.size and (now.mtime is None or abs(now.mtime.timestamp() - modified.timestamp()) < 1)
            rows.append((path, at, modified, full.hexdigest(), head.hexdigest(), hashlib.sha256(tail).hexdigest(), prefix.hexdigest() if b_size is not None and b_size <= at else None, stable))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        kinds = [pa.string(), pa.int64(), pa.timestamp("us", "UTC"), *[pa.string()] * 4, pa.bool_()]
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _FROZEN.split(", ")])


def freeze(spark: SparkSession, root: str, before: DataFrame | None = None) -> DataFrame:
    """path, size, modified, full, head and tail SHA-256 of every file up to the size it had when listed, hashed where it is read.

    With ``before``, an earlier snapshot, ``prefix_sha256`` is the hash of as many first bytes as the file had then (null for new files, and
    for those that shrank).  ``stable`` tells whether size and time were still the same after reading.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    sizes = before.select("path", F.col("size").alias("b_size")) if before is not None else None
    files = listed.join(sizes, "path", "left") if sizes is not None else listed.withColumn("b_size", F.lit(None).cast("bigint"))
    return files.select("path", "length", "modified", "b_size").mapInArrow(_hashed, _FROZEN)


def source_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change of two snapshots: added, missing, same, unstable, appended, or rewritten.

    A file that grew was appended to only if its first bytes, as many as it had before, still hash to what the whole file hashed to
    (``prefix_sha256`` of ``freeze(..., before)``).  One that changed while it was read is unstable: its old rows hold until the next run.
    """
    b = before.select("path", F.col("size").alias("b_size"), F.col("sha256").alias("b_sha"))
    grown = (F.col("size") > F.col("b_size")) & (F.col("prefix_sha256") == F.col("b_sha"))
    unstable = ~F.col("stable") if "stable" in after.columns else F.lit(False)
    change = (
        F.when(F.col("sha256").isNull(), "missing").when(unstable, "unstable").when(F.col("b_sha").isNull(), "added").when(F.col("sha256") == F.col("b_sha"), "same").when(grown, "appended").otherwise("rewritten")
    )
    return b.join(after, "path", "full_outer").select("path", change.alias("change"))


def snapshot_errors(snapshot: DataFrame, expected: DataFrame) -> DataFrame:
    """path, message: ids that repeat, that are expected and missing, or there and unexpected, and rows that are incomplete."""
    rows = lambda df, message: df.select("path", F.lit(message).alias("message"))
    return (
        rows(snapshot.groupBy("path").count().filter("count > 1"), "repeated")
        .unionByName(rows(expected.select("path").distinct().join(snapshot, "path", "left_anti"), "missing"))
        .unionByName(rows(snapshot.select("path").distinct().join(expected, "path", "left_anti"), "unexpected"))
        .unionByName(rows(snapshot.filter("size IS NULL OR sha256 IS NULL"), "incomplete"))
    )


def fingerprints(records: DataFrame, group: list[str], record: str = "record") -> DataFrame:
    """group columns, fields: names and JSON types of the fields of a group's records, sorted; never a value."""
    flat = records.select(*group, F.explode(F.from_json(record, "map<string,variant>")).alias("field", "v"))
    kind = F.regexp_replace(F.expr("schema_of_variant(v)"), r"[<(].*$", "")
    return flat.groupBy(*group).agg(F.array_sort(F.collect_set(F.concat_ws(":", "field", F.lower(kind)))).alias("fields"))


def identified(candidates: DataFrame, scores: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """path, adapter, reason of every candidate: the adapter that scores highest, or why there is none (``no_adapter``, ``tie``, ``forced_adapter_refused``).

    scores: path, adapter, score (0 and less mean no); ``forced``: path, adapter as asked for by name, which holds if that adapter scores at all.
    """
    good = scores.filter("score > 0")
    order = Window.partitionBy("path").orderBy(F.desc("score"))
    best = good.withColumn("place", F.rank().over(order)).filter("place = 1").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("adapter").alias("best"))
    rows = candidates.select("path").distinct().join(best, "path", "left")
    own = F.when(F.col("n") == 1, F.col("best"))
    reason = F.when(F.col("n").isNull(), "no_adapter").when(F.col("n") > 1, "tie")
    if forced is None:
        return rows.select("path", own.alias("adapter"), reason.alias("reason"))
    asked = forced.groupBy("path").agg(F.min("adapter").alias("asked")).join(good.select("path", F.col("adapter").alias("asked"), F.lit(True).alias("fits")), ["path", "asked"], "left")
    rows = rows.join(asked, "path", "left")
    adapter = F.when(F.col("asked").isNull(), own).when(F.col("fits"), F.col("asked"))
    return rows.select("path", adapter.alias("adapter"), F.when(F.col("asked").isNull(), reason).when(F.col("fits").isNull(), "forced_adapter_refused").alias("reason"))


def inventory(files: DataFrame, adapters: list[str]) -> DataFrame:
    """adapter, files, bytes, status: what there is of every adapter known; ``no_current_sample`` where there is nothing.  files: path, adapter, size."""
    known = files.sparkSession.createDataFrame([(a,) for a in adapters], "adapter string")
    found = files.filter("adapter IS NOT NULL").groupBy("adapter").agg(F.countDistinct("path").alias("files"), F.sum("size").alias("bytes"))
    joined = known.join(found, "adapter", "full_outer")
    return joined.select("adapter", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.when(F.col("files").isNull(), "no_current_sample").otherwise("found").alias("status"))


def coverage(candidates: DataFrame, accepted: DataFrame, limit: int) -> DataFrame:
    """root, candidates, accepted, gap: what of each root was not looked at because of a limit on files."""
    counts = candidates.groupBy("root").agg(F.countDistinct("path").alias("candidates"))
    taken = accepted.groupBy("root").agg(F.countDistinct("path").alias("accepted"))
    joined = counts.join(taken, "root", "left").withColumn("accepted", F.coalesce("accepted", F.lit(0)))
    return joined.withColumn("gap", F.when(F.col("candidates") > limit, "truncated_by_max_files"))
