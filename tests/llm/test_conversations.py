import random

import pytest

from loomspark.llm import conversations
from loomspark.llm.conversations import conversations as rebuild
from loomspark.llm.conversations import run_stream, verdicts
from loomspark.operators.timestamps import known_zones
from loomspark.session import Scratch

SCHEMA = "event_id string, logical_session_id string, sequence bigint, role string, event_type string, content string, timestamp string, metadata map<string,string>, segment string, who int"


def row(i, conv, seq, role, content="x", kind="message", at="1755845032"):
    return (None if i is None else f"{conv}-{i}", conv, seq, role, kind, content, at, None, "clash", 9)


CASES = {
    "good": ([row(1, "good", 1, "user"), row(2, "good", 2, " AI "), row(3, "good", 3, "tool", kind="tool_call"), row(4, "good", 4, "Human"), row(5, "good", 5, "model")], None),
    "twice": ([row(1, "twice", 1, "user"), row(1, "twice", 1, "user"), row(2, "twice", 2, "assistant")], None),
    "same": ([row(1, "same", 1, "user"), row(2, "same", 1, "user"), row(3, "same", 2, "assistant")], None),
    "empty": ([row(1, "empty", 1, "user", " \u200b\ufeff\n"), row(2, "empty", 5, "tool"), row(3, "empty", 3, "assistant", None)], "empty"),
    "gap": ([row(1, "gap", 1, "user"), row(2, "gap", 3, "assistant")], "broken"),
    "zero": ([row(1, "zero", 0, "user"), row(2, "zero", 1, "assistant")], "broken"),
    "null": ([row(1, "null", None, "user"), row(2, "null", 1, "user"), row(3, "null", 2, "assistant")], "broken"),
    "conflict": ([row(1, "conflict", 1, "user"), row(2, "conflict", 1, "user", "y"), row(3, "conflict", 2, "assistant")], "broken"),
    "answer": ([row(1, "answer", 1, "assistant"), row(2, "answer", 2, "user"), row(3, "answer", 3, "assistant")], "broken"),
    "open": ([row(1, "open", 1, "user"), row(2, "open", 2, "assistant"), row(3, "open", 3, "user")], "missing_reply"),
    "ask2": ([row(1, "ask2", 1, "user"), row(2, "ask2", 2, "user"), row(3, "ask2", 3, "assistant")], "missing_reply"),
    "late": ([row(2, "late", 2, "assistant", at="1755945032"), row(1, "late", 1, "user", at="1700000000")], None),
    "both": ([row(1, "both", 1, "user", "ok"), row(2, "both", 1, "assistant", "ok")], None),
    "lost": ([row(i, "lost", None, "user") for i in range(50)] + [row(99, "lost", 1, "user")], "broken"),
    "mute": ([row(i, "mute", None, "tool") for i in range(5)], "empty"),
    "times": ([row(1, "times", 1, "user", at=None), row(2, "times", 2, "assistant", at="no time")], None),
    "none": ([row(1, None, 1, "user")], None),
    "anon": ([row(None, "anon", 1, "user"), row(None, "anon", 1, "user"), row(None, "anon", 2, "assistant")], None),
}


@pytest.fixture
def stored(spark, tmp_path):
    def write(rows, files=1):
        path = str(tmp_path / f"t{random.random()}.parquet")
        for k in range(files):
            spark.createDataFrame(rows[k::files], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        return path

    return write


@pytest.mark.parametrize(("segment", "files", "size"), [(1024, 1, 4_000_000_000), (2, 3, 1)])
def test_verdicts(spark, stored, monkeypatch, segment, files, size):
    """Also with stretches of two numbers, and one batch per file, so that later batches reopen states."""
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    rows = [r for group, _ in CASES.values() for r in group]
    random.Random(1).shuffle(rows)
    path = stored(rows, files)
    summaries = run_stream(spark, path, Scratch(spark, "test"), size)
    got = {r.logical_session_id: r.reason for r in verdicts(summaries).collect()}
    assert got == {k: reason for k, (_, reason) in CASES.items() if k != "none"}
    turns = {}
    for r in rebuild(spark.read.parquet(path), summaries).collect():
        turns.setdefault(r.logical_session_id, []).append((r.turn, r.speaker))
    assert set(turns) == {k for k, (_, reason) in CASES.items() if reason is None and k != "none"}
    assert sorted(turns["good"]) == [(1, "user"), (2, "assistant"), (3, "user"), (4, "assistant")] and sorted(turns["twice"]) == sorted(turns["both"]) == [(1, "user"), (2, "assistant")]


def test_long_conversation_in_many_stretches(spark, stored):
    rows = [row(i, "long", i, "user" if i % 2 else "assistant", f"t{i}") for i in range(1, 3001)]
    summaries = run_stream(spark, stored(rows), Scratch(spark, "test"))
    assert summaries.count() == 3 and [(r.reason, r.n_turns) for r in verdicts(summaries).collect()] == [(None, 3000)]
    turns = rebuild(spark.createDataFrame(rows, SCHEMA), summaries).orderBy("turn").collect()
    assert [r.turn for r in turns] == list(range(1, 3001)) and turns[2047].text == "t2048"


def test_empty_table(spark, stored):
    summaries = run_stream(spark, stored([]), Scratch(spark, "test"))
    assert verdicts(summaries).count() == 0


def test_live_stream_closes_on_timeout_and_goes_on(spark, tmp_path):
    """A stretch is given out once the watermark has passed it, not before; where it goes on later, a second part follows and both are merged."""
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    spark.createDataFrame([], SCHEMA).write.parquet(source)

    def run(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        closed = conversations.conversation_stream(conversations.message_rows(stream, known_zones(spark)), "1 minute", idle_ms=1000)
        query = closed.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        parts = spark.read.schema(closed.schema).parquet(out)
        kept = query.lastProgress.stateOperators[0].numRowsTotal
        return parts.count(), kept, {r.logical_session_id: r.n_turns for r in conversations.summaries(parts).collect()}

    a = [row(1, "a", 1, "user", at="1755845032"), row(2, "a", 2, "assistant", at="1755845033")]
    assert run(*a) == (0, 1, {})
    assert run(row(1, "b", 1, "user", at="1755945032")) == (1, 1, {"a": 2})  # a is closed and forgotten
    assert run(row(3, "a", 3, "user", at="1755945100"), row(2, "a", 2, "assistant", at="1755945100")) == (2, 1, {"a": 2, "b": 1})  # b is closed, a open again
    assert run(row(1, "c", 1, "user", at="1756945100")) == (3, 1, {"a": 3, "b": 1})
