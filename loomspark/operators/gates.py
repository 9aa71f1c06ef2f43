"""What must hold before something is published, kept or read: gates over small tables, and a lock for the one writer."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The gates of a publication.
GATES = ("accounting_complete", "evidence_valid", "membership_complete", "privacy_clear", "related_retrieval", "negative_retrieval", "review_valid")


def gate_errors(gates: DataFrame, required: tuple[str, ...] = GATES) -> DataFrame:
    """gate, message of every required gate that is missing, or not true.  gates: gate, passed (one row each, repeats must all pass)."""
    wanted = gates.sparkSession.createDataFrame([(g,) for g in required], "gate string")
    state = gates.groupBy("gate").agg(F.bool_and(F.coalesce("passed", F.lit(False))).alias("ok"))
    joined = wanted.join(state, "gate", "left").filter("NOT coalesce(ok, false)")
    return joined.select("gate", F.when(F.col("ok").isNull(), "gate is missing").otherwise("gate is closed").alias("message"))


def manifest_errors(published: DataFrame, found: DataFrame) -> DataFrame:
    """path, message: files that are gone, changed or unannounced.  Both sides: path, size, sha256."""
    p, f = published.select("path", F.col("size").alias("p_size"), F.col("sha256").alias("p_sha")), found.select("path", F.col("size").alias("f_size"), F.col("sha256").alias("f_sha"))
    message = F.when(F.col("f_sha").isNull(), "file is gone").when(F.col("p_sha").isNull(), "file was not published").when((F.col("p_sha") != F.col("f_sha")) | (F.col("p_size") != F.col("f_size")), "file has changed")
    return p.join(f, "path", "full_outer").select("path", message.alias("message")).filter("message IS NOT NULL")


def publication_errors(completion: dict, index: dict, gates: DataFrame, published: DataFrame, found: DataFrame, pending: bool = False) -> list[str]:
    """Everything that forbids reading a publication: an open transaction, run ids or states that differ, closed gates, files that are not as published.  The lists read are bounded by the gates and one line for the files."""
    errors = ["a transaction is pending"] if pending else []
    if not completion.get("run_id") or completion.get("run_id") != index.get("run_id"):
        errors.append("run ids differ")
    if index.get("semantic_status") != "published" or not str(completion.get("status", "")).startswith("complete"):
        errors.append("not published")
    errors += [f"{r.gate}: {r.message}" for r in gate_errors(gates).orderBy("gate").collect()]
    if n := manifest_errors(published, found).count():
        errors.append(f"{n} files differ from the manifest")
    return errors


def preserved(conditions: dict[str, DataFrame | bool]) -> tuple[bool, list[str]]:
    """Whether a publication may stay as it is: every condition holds (true, or a table without rows); and the names of those that don't."""
    broken = [name for name, c in conditions.items() if (not c if isinstance(c, bool) else bool(c.limit(1).count()))]
    return not broken, broken


def run_conditions(before: DataFrame, after: DataFrame, changes: DataFrame, policy_same: bool, keys: list[str]) -> dict[str, DataFrame | bool]:
    """The conditions under which a run changed nothing: no source moved, no row came, went or changed, and the policies are the same."""
    a, b = before.select(*keys), after.select(*keys)
    return {"policy": policy_same, "sources": changes.filter("change NOT IN ('same', 'missing')"), "rows gone": a.exceptAll(b), "rows new": b.exceptAll(a)}


def run_report(counters: list[tuple[str, int]], gates: DataFrame) -> dict:
    """Counters and gates of a run as one small document."""
    return {"counters": dict(sorted(counters)), "gates": {r.gate: bool(r.passed) for r in gates.groupBy("gate").agg(F.bool_and("passed").alias("passed")).collect()}}


@contextmanager
def writer_lock(root: str, wait: float = 0.0, stale_after: float | None = None) -> Iterator[str]:
    """Holds the one writer's lock of a folder: a file made exclusively.  Waits up to ``wait`` seconds; ``stale_after`` seconds old, it is taken over."""
    os.makedirs(root, exist_ok=True)
    path, until = os.path.join(root, ".writer.lock"), time.monotonic() + wait
    while True:
        try:
            fd = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            break
        except FileExistsError:
            if stale_after is not None and time.time() - os.stat(path).st_mtime > stale_after:
                os.replace(path, path + ".stale")
            elif time.monotonic() >= until:
                raise TimeoutError(f"{path} is held by another writer") from None
            else:
                time.sleep(0.05)
    try:
        with os.fdopen(fd, "w") as file:
            json.dump({"pid": os.getpid(), "at": time.time()}, file)
        yield path
    finally:
        os.unlink(path)


def all_errors(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
