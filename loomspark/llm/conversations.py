"""Rebuilding conversations from message rows with keyed streaming state.

Rows stream in, in any order, some late, some twice.  What is buffered is, per conversation and stretch of ``SEGMENT`` sequence numbers, the
packed (row id, sequence, speaker, content hash) of the rows seen, without their texts.  A stretch is bounded, so a conversation
that makes up a third of all rows is many small stretches, not one.  The state's key is a bucket of some stretches, as every key costs a call; the
number of buckets grows with the table.  The stream carries an event-time watermark; a stretch is buffered until the watermark has passed its
last row by ``idle``, then its bucket's timeout fires: it is given out, closed, and forgotten.

``lateness`` bounds how long after later events a row may still arrive; Spark drops what is later than that (and counts it).  A finished table
has no order of arrival, so ``run_stream`` takes all the time there is as the lateness: nothing is ever late, and everything is
buffered until a last, empty row with the time ``FOREVER`` moves the watermark past all others and closes what is open.  In an endless
stream a stretch that goes on after it was closed is given out again, as another part; parts are merged by row id.

Parts compose in order of their stretches (first and last speaker, unanswered turn inside, counts, bounds), so verdicts on whole conversations
need a handful of small rows each; the validated conversations are then read from the message table, each turn numbered by the turns of the
stretches before it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from loomspark.operators.timestamps import known_zones, with_utc_micros
from loomspark.session import Scratch

#: Sequence numbers per state; stretches (numbered below 0) that share the rows without a number.
SEGMENT, UNNUMBERED = 1024, 256
#: Event times (in milliseconds): from 2100 on a row counts as without a time; stretches without any close then; the row that ends a finished table
#: is of 2261 (pandas knows no later years), so that the watermark, behind it by ``ALL_TIME`` (1970 to 2100), is past everything.
LAST, FOREVER, ALL_TIME = 4_102_444_800_000, 9_183_110_400_000, "47482 days"
#: Rows of a finished table per bucket of stretches, on average; buckets of an endless stream.
BUCKET_ROWS, BUCKETS = 4096, 4096
#: Spellings of the two speakers.
SPEAKERS = {"user": 1, "human": 1, "assistant": 2, "ai": 2, "model": 2}

#: A row as the state keeps it, and as the JVM packs it: pandas would spend more on columns than the rules take.
_ROW = np.dtype([("id", ">i8"), ("seq", ">i8"), ("hash", ">i8"), ("ms", ">i8"), ("who", "i1")])
_SUMMARY = "n_numbers bigint, min_seq bigint, max_seq bigint, conflict boolean, n_turns bigint, first_who int, last_who int, unanswered boolean"
_TYPES = {"bigint": LongType(), "int": IntegerType(), "boolean": BooleanType()}
_BETWEEN = "\u001f"
#: Segments from here down hold rows without a number (numbers below 1 break a conversation too, but are numbers).
_UNNUMBERED_FROM = -(1 << 60)


def speaker(role: Column, event_type: Column, content: Column) -> Column:
    """1 for a user turn, 2 for an assistant turn, 0 for any other row."""
    codes = F.create_map(*[F.lit(x) for pair in SPEAKERS.items() for x in pair])
    visible = F.coalesce(content, F.lit("")).rlike("(?U)[^\\s\\u001c-\\u001f\\u200b\\ufeff]")
    code = F.try_element_at(codes, F.lower(F.regexp_replace(role, r"(?U)^\s+|\s+$", "")))
    return F.when((event_type == "message") & visible, F.coalesce(code, F.lit(0))).otherwise(0)


def message_rows(events: DataFrame, zones: list[str]) -> DataFrame:
    """The columns the state needs; works on streams and tables.  Rows without a conversation are left out.

    A row without event_id is a row of its own for each sequence and content.  Rows without a number only tell that there are such, and who
    spoke in them: they are spread over ``UNNUMBERED`` stretches by their id and kept once per speaker.
    """
    body = F.xxhash64(F.coalesce("content", F.lit("")))
    rows = events.filter("logical_session_id IS NOT NULL").select(
        "logical_session_id",
        F.floor(F.col("sequence") / SEGMENT).cast("bigint").alias("_numbered"),
        F.coalesce(F.xxhash64("event_id") if "event_id" in events.columns else F.lit(None), F.lit(0)).alias("_eid"),
        F.col("event_id").isNull().alias("_anonymous"),
        F.coalesce("sequence", F.lit(0)).cast("bigint").alias("seq"),
        body.alias("hash"),
        speaker(F.col("role"), F.col("event_type"), F.col("content")).cast("tinyint").alias("who"),
        F.col("timestamp").alias("_text"),
        F.col("metadata")["tz"].alias("_tz"),
    )
    rows = rows.withColumn("id", F.when(F.col("_anonymous"), F.xxhash64("logical_session_id", "seq", "hash")).otherwise(F.col("_eid")))
    lost = F.col("_numbered").isNull()
    rows = rows.withColumn("segment", F.coalesce("_numbered", _UNNUMBERED_FROM - F.pmod(F.col("id"), F.lit(UNNUMBERED))))
    rows = rows.withColumns({"id": F.when(lost, F.col("who").cast("bigint")).otherwise(F.col("id")), "hash": F.when(lost, F.lit(0)).otherwise(F.col("hash"))})
    rows = with_utc_micros(rows, F.col("_text"), F.col("_tz"), zones, "_us")
    rows = rows.withColumn("_us", F.when(F.col("_us").between(1, LAST * 1000 - 1), F.col("_us")))
    ms = F.coalesce(F.floor(F.col("_us") / 1000).cast("bigint"), F.lit(0))
    packed = F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in (F.col("id"), F.col("seq"), F.col("hash"), ms)], F.lpad(F.hex(F.col("who").cast("bigint")), 2, "0")))
    stretch = F.concat_ws(_BETWEEN, "logical_session_id", F.col("segment").cast("string"))
    return rows.select(stretch.alias("stretch"), packed.alias("packed"), F.timestamp_micros("_us").alias("event_time"))


def summarise(rows: np.ndarray) -> tuple:
    """The summary of a stretch's distinct rows: count and bounds of its numbers, conflict, turns, first and last speaker, unanswered.

    Under one number with one content user and assistant may both speak: two turns, the user's first.
    """
    order = np.lexsort((rows["who"], rows["hash"], rows["seq"]))
    seq, body, who = rows["seq"][order], rows["hash"][order], rows["who"][order]
    same = seq[1:] == seq[:-1]
    conflict = bool((same & (body[1:] != body[:-1])).any())
    who = who[np.concatenate([[True], ~same | (who[1:] != who[:-1])]) & (who > 0)]  # a speaker's copies of one number are one turn
    unanswered = bool(((who[1:] == 1) & (who[:-1] == 1)).any())
    ends = (int(who[0]), int(who[-1])) if len(who) else (0, 0)
    return len(seq) - int(same.sum()), int(seq[0]), int(seq[-1]), conflict, len(who), *ends, unanswered


def merge(rows: np.ndarray) -> np.ndarray:
    """One row per id (the smallest hash, should copies differ)."""
    rows = rows[np.lexsort((rows["hash"], rows["id"]))]
    return rows[np.concatenate([[True], rows["id"][1:] != rows["id"][:-1]])]


def _keeper(idle_ms: int):
    """The state function of a bucket: buffers what arrives by stretch; gives out and forgets the stretches whose last row the watermark has passed by ``idle_ms``."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] < 0:  # the end of a table
            return
        kept: dict[str, tuple[bytes, int]] = pickle.loads(bytes(state.get[0])) if state.exists else {}  # stretch to rows, time it closes
        arrived: dict[str, list[bytes]] = {}
        if not state.hasTimedOut:
            for frame in frames:
                for stretch, packed in zip(frame["stretch"].array, frame["packed"].array, strict=True):
                    arrived.setdefault(stretch, []).append(packed)
        for stretch, packed in arrived.items():
            rows = merge(np.frombuffer(kept.get(stretch, (b"",))[0] + b"".join(packed), dtype=_ROW))
            last = int(rows["ms"].max())
            # a stretch none of whose rows has a time stays open to the end
            kept[stretch] = rows.tobytes(), (last or LAST) + idle_ms
        watermark = state.getCurrentWatermarkMs()
        closed = [stretch for stretch, (_, at) in kept.items() if at <= watermark] if state.hasTimedOut else []
        if closed:
            yield pd.DataFrame({"stretch": closed, "rows": [kept.pop(stretch)[0] for stretch in closed]})
        if kept:
            state.update((pickle.dumps(kept, pickle.HIGHEST_PROTOCOL),))
            state.setTimeoutTimestamp(max(min(at for _, at in kept.values()), watermark + 1))
        else:
            state.remove()

    return run


def conversation_stream(rows: DataFrame, lateness: str = "1 day", idle_ms: int = 1_800_000, buckets: int = BUCKETS) -> DataFrame:
    """The stream of closed stretches (stretch, rows) of a stream of ``message_rows``; the row that ends a finished table names no stretch."""
    bucket = F.when(F.col("stretch") == "", -1).otherwise(F.pmod(F.xxhash64("stretch"), F.lit(buckets)))
    timed = rows.withColumn("bucket", bucket.cast("bigint")).withWatermark("event_time", lateness)
    return timed.groupBy("bucket").applyInPandasWithState(_keeper(idle_ms), "stretch string, rows binary", "buffer binary", "append", GroupStateTimeout.EventTimeTimeout)


@pandas_udf(StructType([StructField(name, _TYPES[kind]) for name, kind in map(str.split, _SUMMARY.split(", "))]))
def _summary(parts: pd.Series) -> pd.DataFrame:
    """The summary of each stretch from its parts (array of packed rows)."""
    rows = [summarise(merge(np.frombuffer(b"".join(p), dtype=_ROW))) for p in parts]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _SUMMARY.split(", ")])


def summaries(closed: DataFrame) -> DataFrame:
    """logical_session_id, segment and summary of every stretch, its parts merged."""
    whole = closed.groupBy("stretch").agg(F.collect_list("rows").alias("parts")).select("stretch", _summary("parts").alias("s"))
    key = F.split("stretch", _BETWEEN, -1)
    return whole.select(key[0].alias("logical_session_id"), key[1].cast("bigint").alias("segment"), "s.*")


def run_stream(spark: SparkSession, path: str, scratch: Scratch, max_bytes_per_trigger: int = 4_000_000_000, idle_ms: int = 1_800_000) -> DataFrame:
    """Stream the Parquet files at ``path`` to their end, close what is open, and return every stretch's summary.

    Source offsets, state and output are in the shared folder, so a lost executor or driver resumes from the last batch.
    """
    table = spark.read.parquet(path)
    zones = known_zones(spark)
    buckets = max(1, table.count() // BUCKET_ROWS)  # a count reads no column
    folder, _, name = path.rstrip("/").rpartition("/")
    # a pattern, because the streaming source takes a plain path for a folder and a table may be a single file
    source = spark.readStream.schema(table.schema).option("maxBytesPerTrigger", max_bytes_per_trigger).parquet(f"{folder}/{{{name}}}")
    end = spark.range(1).select(F.lit("").alias("stretch"), F.lit(None).cast("binary").alias("packed"), F.timestamp_millis(F.lit(FOREVER)).alias("event_time"))
    ends = scratch.path("end")
    end.limit(0).write.parquet(ends)
    every = message_rows(source, zones).unionByName(spark.readStream.schema(end.schema).parquet(ends))
    closed = conversation_stream(every, ALL_TIME, idle_ms, buckets)
    out = scratch.path("closed")
    for step in ("all rows", "the end"):
        if step == "the end":
            end.write.mode("append").parquet(ends)
        query = closed.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", scratch.path("stream")).trigger(availableNow=True).start()
        query.awaitTermination()
    return scratch.keep(summaries(spark.read.schema(closed.schema).parquet(out)), "summaries")


def verdicts(summaries: DataFrame) -> DataFrame:
    """logical_session_id, reason (null for a valid conversation), n_turns: the first reason that applies.

    ``empty``: no turn; ``broken``: the sequence numbers aren't 1 to n, one has two contents, or the assistant begins;
    ``missing_reply``: a user turn is followed by another, or by none.
    """
    spoken = summaries.filter("n_turns > 0")
    order = Window.partitionBy("logical_session_id").orderBy("segment")
    seams = spoken.withColumn("next_who", F.lead("first_who").over(order)).withColumn("at", F.row_number().over(order))
    turns = seams.groupBy("logical_session_id").agg(
        F.bool_or(F.col("unanswered") | ((F.col("last_who") == 1) & (F.coalesce("next_who", F.lit(1)) == 1))).alias("missing"),
        F.bool_or((F.col("at") == 1) & (F.col("first_who") == 2)).alias("assistant_first"),
    )
    numbers = summaries.groupBy("logical_session_id").agg(
        F.sum("n_turns").alias("n_turns"), F.sum("n_numbers").alias("n"), F.min("min_seq").alias("low"), F.max("max_seq").alias("high"), F.bool_or(F.col("conflict") | (F.col("segment") <= _UNNUMBERED_FROM)).alias("conflict")
    )
    both = numbers.join(turns, "logical_session_id", "left")
    broken = F.col("conflict") | (F.col("low") != 1) | (F.col("high") != F.col("n")) | F.coalesce("assistant_first", F.lit(False))
    reason = F.when(F.col("n_turns") == 0, "empty").when(broken, "broken").when(F.col("missing"), "missing_reply")
    return both.select("logical_session_id", reason.alias("reason"), "n_turns")


def conversations(events: DataFrame, summaries: DataFrame) -> DataFrame:
    """The turns of the valid conversations: logical_session_id, turn (1 to n), speaker, text.

    Turns are numbered per stretch and shifted by the turns of the stretches before, so no window spans a whole
    conversation.  Rows with one event_id, or one number and speaker, count once.
    """
    valid = verdicts(summaries).filter("reason IS NULL").select("logical_session_id")
    before = Window.partitionBy("logical_session_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = summaries.withColumn("shift", F.coalesce(F.sum("n_turns").over(before), F.lit(0))).join(valid, "logical_session_id").select("logical_session_id", "segment", "shift")
    rows = events.select("logical_session_id", F.floor(F.col("sequence") / SEGMENT).cast("bigint").alias("segment"), "sequence", speaker(F.col("role"), F.col("event_type"), F.col("content")).alias("who"), "content")
    rows = rows.filter("who > 0").join(starts, ["logical_session_id", "segment"]).dropDuplicates(["logical_session_id", "segment", "sequence", "who"])
    number = F.row_number().over(Window.partitionBy("logical_session_id", "segment").orderBy("sequence", "who")) + F.col("shift")
    return rows.select("logical_session_id", number.alias("turn"), F.when(F.col("who") == 1, "user").otherwise("assistant").alias("speaker"), F.col("content").alias("text"))
