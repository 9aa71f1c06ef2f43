"""Scalar functions on evidence rows, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Working directories that name no project.
NO_PROJECT_DIRS = ("~", "/", ".", "unknown")


def stable_hash(*parts: Column | str, length: int = 20) -> Column:
    """The first ``length`` hex digits of the SHA-256 of the NUL-terminated parts; a null part reads ``None``."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    terminated = [x for c in columns for x in (F.coalesce(c.cast("string"), F.lit("None")), F.char(F.lit(0)))]
    return F.substring(F.sha2(F.concat(*terminated), 256), 1, length)


def canonical_locator(locator: Column) -> Column:
    """The transport record a locator lies in: sub-locators of bytes and sections are cut off, of messages their list index kept."""
    message = F.regexp_extract(locator, r"^messages\[[0-9]+\]", 0)
    record = locator.startswith("byte:") | locator.startswith("section:")
    return F.when(record, F.substring_index(locator, ".", 1)).when(message != "", message).otherwise(locator)


def collapsed(text: Column) -> Column:
    """White space runs to single blanks, none outside."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalised(text: Column) -> Column:
    return F.lower(collapsed(text))


def semantic_key(logical_session: Column, role: Column, event_type: Column, tool_name: Column, call_id: Column, content: Column) -> Column:
    """What mirrored copies of one record have in common; calls link by id, messages and attachments by content alone."""
    linkage = F.when(event_type.isin("message", "attachment"), "").otherwise(F.coalesce(call_id, F.lit("")))
    return F.struct(
        logical_session.alias("logical_session_id"), role.alias("role"), event_type.alias("event_type"), F.coalesce(tool_name, F.lit("")).alias("tool_name"), linkage.alias("call_id"), F.sha2(collapsed(content), 256).alias("content")
    )


def event_id(source_file_id: Column, locator: Column, role: Column, event_type: Column, content_sha256: Column, call_id: Column) -> Column:
    return F.concat(F.lit("evt-"), stable_hash(source_file_id, locator, role, event_type, content_sha256, call_id, length=32))


def project_identity(project_id: Column, working_dir: Column, agent: Column, session_id: Column) -> Column:
    """struct<key, label>: by working directory (slashes unified, drive letter lowered), else by project id, else none."""
    slashed = F.regexp_replace(F.regexp_replace(F.trim(working_dir), r"[\\/]+", "/"), "/+$", "")
    canonical = F.when(slashed.rlike("^[A-Za-z]:/"), F.concat(F.lower(F.substring(slashed, 1, 1)), slashed.substr(F.lit(2), F.length(slashed)))).otherwise(slashed)
    by_dir = (F.coalesce(working_dir, F.lit("")) != "") & ~working_dir.isin(*NO_PROJECT_DIRS)
    by_id = F.coalesce(project_id, F.lit("")) != ""
    key = F.when(by_dir, F.concat(F.lit("cwd:"), stable_hash(canonical, length=24))).when(by_id, F.concat(F.lit("project:"), stable_hash(agent, project_id, length=24))).otherwise("")
    last = F.element_at(F.split(F.regexp_replace(working_dir, r"[\\/]+$", ""), r"[\\/]"), -1)
    label = F.when(by_dir, F.when(last != "", last).otherwise(working_dir)).when(by_id, project_id).otherwise(F.concat(F.lit("Session "), F.substring(session_id, 1, 12)))
    return F.struct(key.alias("key"), label.alias("label"))


def excerpt(text: Column, limit: int) -> Column:
    """The text, cut at ``limit`` characters with the hash of the whole."""
    cut = F.concat(F.substring(text, 1, limit), F.lit(" … [sha256="), F.sha2(text, 256), F.lit("]"))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def session_from_filename(path: Column) -> Column:
    """A UUID in the file's name, else the name without extension and chunk number."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", "")
    uuid = F.regexp_extract(name, "[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", 0)
    return F.when(uuid != "", uuid).otherwise(F.regexp_replace(name, r"-chunk-[0-9]+$", ""))


def normal_values(values: Column) -> Column:
    """Trimmed, non-empty, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")))


def ordered_hash(ids: Column) -> Column:
    """SHA-256 over the lines of an ordered array."""
    return F.sha2(F.array_join(ids, "\n"), 256)


def set_hash(member: Column) -> Column:
    """Aggregate: SHA-256 of a set of distinct texts, whatever their order.

    Made of their number and the sums of two 60-bit parts of their own hashes, so that partial results merge and no set, however
    large, is gathered.
    """
    digest = F.sha2(member, 256)
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return F.sha2(F.concat_ws(":", F.count(member).cast("string"), part(1), part(16)), 256)


def reliable_timestamp(text: Column) -> Column:
    """An ISO date-time with its offset, else null: a local time proves no order."""
    iso = F.regexp_extract(text, r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:?\d{2})$", 0)
    return F.when(iso != "", F.try_to_timestamp(F.regexp_replace(iso, r"([+-]\d{2})(\d{2})$", "$1:$2")))


def bounded_int(text: Column, low: int, high: int) -> Column:
    """The integer in range, else null; booleans and decimals are none."""
    number = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
    return F.when(number.between(low, high), number)


def slug(label: Column, key: Column) -> Column:
    """A file name of a label: letters and digits, hyphens between, at most 48 characters, and a hash of the key.

    ``label`` goes through ``functions.tokens.folded`` first (compatibility forms and case), which the JVM lacks.
    """
    stem = F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    stem = F.substring(stem, 1, 48)
    return F.concat(F.when(stem == "", "project").otherwise(stem), F.lit("-"), F.substring(F.sha2(key, 256), 1, 10), F.lit(".md"))


def any_contains(text: Column, markers: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(m) for m in markers])
