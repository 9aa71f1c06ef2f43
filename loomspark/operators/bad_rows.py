"""Rows that fail to parse: every line is loaded as nullable text, judged by rules, and kept with its reasons.

Delimited lines are judged by SQL array functions alone: splitting a line at its quotes leaves the parts outside
quotes at even places, and RFC 4180 says exactly what those may look like; no regular expression has to match a whole
line, so the length of a line is no danger.  JSON lines go through one Arrow-batched function that checks RFC
8259 and hands back the raw text of the fields of interest, JSON type included.  All rules are column
expressions collected into an error array; rows with an empty array are the valid ones.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from loomspark.session import fenced, salted_lookup

# Fixed values of the record contract.
FIELDS = ("session_id", "sequence", "role", "event_type", "timestamp", "duration_ms")
ROLES = ("user", "assistant", "tool", "system", "observer", "unknown")
EVENT_TYPES = ("message", "tool_call", "tool_result", "patch", "browser", "device", "attachment", "status", "delivery", "error")
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
ISO_INSTANT = (
    r"^(\d{4})-?(\d{2})-?(\d{2})T(\d{2})(?::?(\d{2}))?(?::?(\d{2}))?(?:[.,]\d+)?(?:Z|[+\-](\d{2})(?::?(\d{2}))?)\z"
)

_JSON = StructType([StructField("ok", BooleanType()), StructField("is_object", BooleanType()), *[StructField(f, StringType()) for f in FIELDS]])


def _refuse(token: str):
    raise ValueError(token)


class _Number(str):
    """The text of a JSON number."""


def _raw(value) -> str:
    return str(value) if isinstance(value, _Number) else json.dumps(value, ensure_ascii=False)


@pandas_udf(_JSON)
def json_fields(line: pd.Series) -> pd.DataFrame:
    """Strict JSON: no NaN or Infinity, no control characters in strings; numbers of any size; fields as raw JSON text."""
    decode = json.JSONDecoder(parse_constant=_refuse, parse_float=_Number, parse_int=_Number).decode
    rows = []
    for text in line:
        try:
            value = decode(text)
        except (ValueError, RecursionError, TypeError):
            rows.append((False, False, *[None] * len(FIELDS)))
            continue
        if not isinstance(value, dict):
            rows.append((True, False, *[None] * len(FIELDS)))
            continue
        rows.append((True, True, *[_raw(value[f]) if f in value and not isinstance(value[f], (dict, list)) else "[]" if f in value else None for f in FIELDS]))
    return pd.DataFrame(rows, columns=["ok", "is_object", *FIELDS])


#: Not deterministic for the optimizer only: else filters on its fields would be pushed down and parse every line again.
_json_once = json_fields.asNondeterministic()


def quote_parts_ok(parts: Column, delimiter: Column) -> Column:
    """Whether the quotes of a line, split at its double quotes into ``parts``, are as RFC 4180 requires.

    Parts at even places are outside quotes.  There must be an even number of quotes; an opening quote follows the
    start of the line or a delimiter; a closing one precedes a delimiter or the end; an empty part between two
    quotes is an escaped quote; line breaks occur inside quotes only.
    """
    last = F.size(parts) - 1

    def outside_ok(part: Column, i: Column) -> Column:
        opens = (i == last) | (part == "") | part.endswith(delimiter)
        closes = (i == 0) | (part == "") | part.startswith(delimiter)
        return (i % 2 == 1) | (opens & closes & ~part.contains("\n") & ~part.contains("\r"))

    return (last % 2 == 0) & F.forall(F.transform(parts, outside_ok), lambda ok: ok)


def delimited_fields(parts: Column, delimiter: Column) -> Column:
    """The unquoted fields of a line whose quotes are in order."""
    hidden = ""
    shielded = F.transform(parts, lambda part, i: F.when(i % 2 == 1, F.replace(part, delimiter, F.lit(hidden))).otherwise(part))
    split_at = F.concat(F.lit(r"\Q"), delimiter, F.lit(r"\E"))
    fields = F.split(F.array_join(shielded, '"'), split_at, -1)

    def unquote(field: Column) -> Column:
        inner = F.when(field.startswith('"'), F.replace(F.substring(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))).otherwise(field)
        return F.replace(inner, F.lit(hidden), delimiter)

    return F.transform(fields, unquote)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Every line with its fields as nullable text and ``errors``, an array of reasons in order of precedence.

    Needs source_file_id, line_no, line_format, line, terminated; other columns are not read.  Blank lines and the header
    of a delimited file are left out.  The header gives columns and delimiter; a delimited file without a line 1 has
    no columns, so that its lines fail with ``column_count``.  A null line counts as blank.  A format in other
    spelling compares without case and outer blanks; lines of an unknown format get ``unknown_format``.  Rows
    delivered again are judged alike; ``bad_lines`` and ``good_rows`` give each line once.
    """
    text = F.when(F.col("line").endswith("\r"), F.expr("left(line, length(line) - 1)")).otherwise(F.col("line"))
    rows = lines.select("source_file_id", "line_no", F.lower(F.trim("line_format")).alias("line_format"), text.alias("text"), "terminated").filter(r"NOT coalesce(text, '') RLIKE '(?U)^\\s*\\z'")

    heads = rows.filter("line_format = 'delimited' AND line_no = 1").groupBy("source_file_id").agg(F.regexp_replace(F.min("text"), "^﻿", "").alias("head"))
    delimiter = F.coalesce(F.nullif(F.regexp_extract("head", r"[,;\t|]", 0), F.lit("")), F.lit(","))
    heads = heads.select("source_file_id", delimiter.alias("delimiter"), F.transform(F.split("head", F.concat(F.lit(r"\Q"), delimiter, F.lit(r"\E")), -1), lambda c: F.trim(F.replace(c, F.lit('"'), F.lit("")))).alias("columns"))
    body = salted_lookup(rows.filter("line_format = 'delimited' AND line_no <> 1"), heads, "source_file_id", "line_no")
    body = body.withColumn("delimiter", F.coalesce("delimiter", F.lit(","))).withColumn("parts", F.split("text", '"', -1))
    body = body.withColumn("quotes_ok", quote_parts_ok(F.col("parts"), F.col("delimiter")))
    body = body.withColumn("fields", F.when(F.col("quotes_ok"), delimited_fields(F.col("parts"), F.col("delimiter"))))
    body = body.withColumn("count_ok", F.coalesce(F.size("fields") == F.size("columns"), F.lit(False)))
    value = lambda f: F.when(F.col("count_ok"), F.try_element_at("fields", F.nullif(F.array_position("columns", f), F.lit(0)).cast("int")))
    body = body.withColumns({f: value(f) for f in FIELDS})
    first = F.when(~F.col("quotes_ok"), F.lit("quoting")).when(~F.col("count_ok"), F.lit("column_count"))
    body = _judged(body, first, lambda f: F.col(f), lambda f: F.col(f).rlike(r"^[0-9]+\z"))

    docs = rows.filter("line_format = 'jsonl'").select("source_file_id", "line_no", "line_format", "text", "terminated")
    # the last line of a file: only its unterminated lines have to be looked up, and those are few
    ends = lines.groupBy("source_file_id").agg(F.max("line_no").alias("last_line"))
    whole = docs.filter("coalesce(terminated, true)").withColumn("last_line", F.lit(None).cast("bigint"))
    docs = whole.unionByName(docs.filter("NOT terminated").join(ends, "source_file_id", "left"))
    docs = docs.withColumn("j", _json_once("text")).select("source_file_id", "line_no", "line_format", "last_line", "j.*")
    first = F.when(~F.col("ok"), F.when(F.col("line_no") == F.col("last_line"), F.lit("incomplete_tail")).otherwise(F.lit("json"))).when(~F.col("is_object"), F.lit("not_object"))
    string = lambda f: F.when(F.col(f).startswith('"'), F.from_json(F.concat(F.lit("["), F.col(f), F.lit("]")), "array<string>")[0])
    docs = _judged(docs, first, string, lambda f: F.col(f).rlike(r"^-?[0-9]+\z"), json_null="null")

    other = rows.filter("line_format IS NULL OR line_format NOT IN ('jsonl', 'delimited')").withColumns({f: F.lit(None).cast("string") for f in FIELDS})
    other = other.withColumn("errors", F.array(F.lit("unknown_format")))
    keep = ["source_file_id", "line_no", "line_format", *FIELDS, "errors"]
    return body.select(keep).unionByName(docs.select(keep)).unionByName(other.select(keep))


def _judged(rows: DataFrame, first: Column, string, is_integer, json_null: str | None = None) -> DataFrame:
    """``rows`` with ``errors``.  string(f): the field's text, null where it isn't text; is_integer(f): whether it is written as one."""
    absent = lambda f: F.col(f).isNull() | F.coalesce(F.col(f) == F.lit(json_null), F.lit(False)) | F.coalesce(string(f) == "", F.lit(False))
    g = lambda n: F.regexp_extract("_t", ISO_INSTANT, n)
    rows = rows.withColumn("_t", string("timestamp"))
    rows = rows.withColumns({f"_t{n}": F.coalesce(F.nullif(g(n), F.lit("")), F.lit("0")).cast("int") for n in range(1, 9)})
    n = lambda k: F.col(f"_t{k}")
    leap = ((n(1) % 4 == 0) & (n(1) % 100 != 0)) | (n(1) % 400 == 0)
    days = F.when(n(2).isin(4, 6, 9, 11), 30).when(n(2) == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    exists = F.col("_t").rlike(ISO_INSTANT) & n(2).between(1, 12) & n(3).between(1, days) & (n(4) <= 23) & (n(5) <= 59) & (n(6) <= 59) & (n(7) <= 23) & (n(8) <= 59)
    above = lambda f, least: is_integer(f) & ~F.col(f).startswith("-") & (F.col(f).rlike("[1-9]") if least else F.lit(True))
    rules = [
        ("session_id", string("session_id").rlike(UUID)),
        ("sequence", above("sequence", 1)),
        ("role", string("role").isin(*ROLES)),
        ("event_type", string("event_type").isin(*EVENT_TYPES)),
        ("timestamp", absent("timestamp") | exists),
        ("duration_ms", absent("duration_ms") | above("duration_ms", 0) | F.coalesce(F.col("duration_ms") == F.lit("-0"), F.lit(False))),
    ]
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"invalid_value:{f}")) for f, ok in rules]))
    rows = rows.withColumn("_first", first)
    return fenced(rows.withColumn("errors", F.when(F.col("_first").isNotNull(), F.array("_first")).otherwise(broken)))


def bad_lines(parsed: DataFrame) -> DataFrame:
    """Lines that can't be loaded, each once: source_file_id, line_no, reason."""
    reason = F.split(F.col("errors")[0], ":")[0]
    return parsed.filter("size(errors) > 0").groupBy("source_file_id", "line_no").agg(F.min(reason).alias("reason"))


def good_rows(parsed: DataFrame) -> DataFrame:
    """Lines that load, each once, as text columns."""
    return parsed.filter("size(errors) = 0").drop("errors").dropDuplicates(["source_file_id", "line_no"])


def parse_results(lines: DataFrame, parsed: DataFrame, part_lines: int = 65_536) -> DataFrame:
    """The bad lines as ParseResult rows: errors and excluded per source file and part of ``part_lines`` lines, located by byte offset.

    A file of up to so many lines is one row (part 0); a longer one has a row for each part, so that no file, whatever its share of all lines,
    is gathered.  An unterminated last line is excluded, not an error: a later run may find it complete.
    """
    at = lines.groupBy("source_file_id", "line_no").agg(F.min("byte_offset").alias("byte_offset"))
    bad = bad_lines(parsed).join(at, ["source_file_id", "line_no"])
    locator = F.concat(F.lit("byte:"), F.col("byte_offset"))
    error = F.when(F.col("reason") != "incomplete_tail", F.struct(F.col("line_no").alias("n"), locator.alias("record_locator"), F.col("reason").alias("error"), F.concat(F.lit("line "), F.col("line_no")).alias("detail")))
    excluded = F.when(F.col("reason") == "incomplete_tail", F.struct(F.col("line_no").alias("n"), locator.alias("record_locator"), F.col("reason").alias("reason")))
    part = F.floor((F.col("line_no") - 1) / part_lines).cast("int").alias("part")
    per_file = bad.groupBy("source_file_id", part).agg(F.sort_array(F.collect_list(error)).alias("errors"), F.sort_array(F.collect_list(excluded)).alias("excluded"))
    seen = at.groupBy("source_file_id", part).agg(F.count(F.lit(1)).alias("records_seen"))
    strip = lambda a, *names: F.transform(a, lambda s: F.struct(*[s[x].alias(x) for x in names]))
    return seen.join(per_file, ["source_file_id", "part"], "left").select("source_file_id", "part", strip("errors", "record_locator", "error", "detail").alias("errors"), strip("excluded", "record_locator", "reason").alias("excluded"), "records_seen")
