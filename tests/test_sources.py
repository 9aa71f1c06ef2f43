"""Session files of every format, written here, to raw events."""

import json

import pytest
from pyspark.sql import functions as F

from loomspark.sources import adapters, lines


def jsonl(*records, tail=""):
    return "".join(json.dumps(r) + "\n" for r in records) + tail


FILES = {
    "codex/rollout-1.jsonl": jsonl(
        {"type": "session_meta", "timestamp": "2025-01-01T00:00:00Z", "payload": {"id": "s-1", "cwd": "/srv/a", "title": "first"}},
        {"type": "event_msg", "timestamp": "2025-01-01T00:00:01Z", "payload": {"type": "user_message", "message": "hello"}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "hello"}, {"type": "input_image", "data": "x"}]}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "apply_patch", "arguments": {"b": 1, "a": 2}, "call_id": "c1"}},
        {"type": "response_item", "payload": {"type": "function_call_output", "output": "ok", "call_id": "c1"}},
        {"type": "response_item", "payload": {"type": "reasoning"}},
        {"type": "event_msg", "payload": {"type": "web_search_end", "query": "q"}},
        {"type": "event_msg", "payload": {"type": "task_complete", "last_agent_message": "done"}},
        {"type": "compacted"},
        tail='{"type": "event_m',
    ),
    "claude/0b0e8a52-1111-2222-3333-444455556666.jsonl": jsonl(
        {"type": "user", "sessionId": "s-2", "cwd": "/srv/b", "timestamp": "2025-01-02T00:00:00Z", "message": {"role": "user", "content": "plain"}},
        {"type": "ai-title", "title": "second"},
        {"type": "assistant", "isSidechain": True, "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "said"}, {"type": "tool_use", "name": "Edit", "id": "t1", "input": {"f": 1}}]}},
        {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": [{"type": "text", "text": "bad"}]}]}},
    )
    + "[1, 2]\n{broken\n",
    "buddy/w.jsonl": jsonl(
        {"type": "message", "sessionId": "s-3", "providerData": {}, "role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]},
        {"type": "function_call", "sessionId": "s-3", "name": "ls", "arguments": "{}", "callId": "k"},
        {"type": "reasoning", "sessionId": "s-3"},
    ),
    "agent-transcripts/cur.jsonl": jsonl({"role": "user", "message": {"content": [{"type": "text", "text": "hi"}]}}, {"role": "assistant", "message": {"content": [{"type": "tool_use", "name": "Write", "input": {}}]}}, {"type": "turn_ended", "status": "ok"}),
    ".neo/projects/n.jsonl": jsonl({"type": "queue-operation", "sessionId": "s-5", "operation": "enqueue"}, {"type": "user", "sessionId": "s-5", "message": {"role": "user", "content": "neo"}}),
    "node_modules/skip.jsonl": jsonl({"type": "session_meta", "payload": {}}),
}


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sessions")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root, adapters.read_sessions(spark, str(root)).collect()


def events(rows, adapter):
    return sorted((r for r in rows if r.adapter == adapter and r.kind == "event"), key=lambda r: r.sequence)


def test_codex(parsed):
    rows = events(parsed[1], "codex-jsonl")
    assert [(r.event_type, r.role) for r in rows] == [("message", "user"), ("message", "user"), ("attachment", "user"), ("patch", "assistant"), ("tool_result", "tool"), ("browser", "observer"), ("delivery", "observer")]
    assert [r.sequence for r in rows] == list(range(1, 8)) and {r.session_id for r in rows} == {"s-1"} and {r.working_dir for r in rows} == {"/srv/a"} and {r.session_title for r in rows} == {"first"}
    assert rows[3].content == '{"a":2,"b":1}' and rows[3].call_id == "c1" and rows[0].metadata == {"transport_lane": "codex-event-message"} and rows[6].content == "done"
    reasons = {r.reason for r in parsed[1] if r.adapter == "codex-jsonl" and r.kind == "excluded"}
    assert reasons == {"session_metadata", "hidden_reasoning_or_summary", "compacted_summary", "incomplete_jsonl_tail"}


def test_claude(parsed):
    rows = events(parsed[1], "claude-code-jsonl")
    assert [(r.event_type, r.role, r.content) for r in rows] == [("message", "user", "plain"), ("message", "assistant", "said"), ("patch", "assistant", '{"f":1}'), ("error", "tool", "bad")]
    assert rows[1].actor_hint == "subagent" and rows[1].flags == ["sidechain", "subagent"] and [r.session_title for r in rows] == [None, "second", "second", "second"]
    assert rows[1].record_locator.endswith(".content[1]")
    assert sorted(r.reason for r in parsed[1] if r.adapter == "claude-code-jsonl" and r.kind == "error") == ["json_decode_error", "jsonl_record_not_object"]


def test_others(parsed):
    assert [(r.event_type, r.content) for r in events(parsed[1], "workbuddy-jsonl")] == [("message", "a\nb"), ("tool_call", "{}")]
    assert [(r.event_type, r.session_id) for r in events(parsed[1], "cursor-agent-jsonl")] == [("message", "cur"), ("patch", "cur"), ("status", "cur")]
    neo = events(parsed[1], "neo-claude-jsonl")
    assert [(r.event_type, r.metadata["transport_lane"]) for r in neo] == [("status", "neo-claude-runtime"), ("message", "neo-claude-runtime")]
    assert not [r for r in parsed[1] if "node_modules" in r.path]


def test_blocks_carry_context(spark, parsed, monkeypatch):
    monkeypatch.setattr(adapters, "BLOCK_BYTES", 150)
    again = adapters.read_sessions(spark, str(parsed[0])).collect()
    key = lambda r: (r.path, r.record_locator, r.kind, r.sequence, r.session_id, r.session_title, r.content)
    assert sorted(map(repr, map(key, again))) == sorted(map(repr, map(key, parsed[1])))


def test_byte_ranges_own_their_lines(tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_bytes("".join(f"línea {i}\n" for i in range(50)).encode() + b"tail")
    whole = [r for b in lines.read_range(lines.ByteRange(str(path), 0, path.stat().st_size), True) for r in b.to_pylist()]
    for size in (1, 7, 64):
        parts = [r for p in lines.ranges(str(path), 0, path.stat().st_size, size) for b in lines.read_range(p, p.start == 0) for r in b.to_pylist()]
        assert parts == whole
    assert not whole[-1]["terminated"] and lines.complete_end(str(path)) == path.stat().st_size - 4


def test_stream_waits_for_complete_lines(spark, tmp_path):
    lines.register(spark)
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    (source / "a.jsonl").write_text('{"n": 1}\n{"n"')

    def run():
        stream = spark.readStream.format("session_lines").load(str(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.line for r in spark.read.parquet(out).collect())

    assert run() == ['{"n": 1}']
    with (source / "a.jsonl").open("a") as file:
        file.write(': 2}\n{"n": 3}\n')
    assert run() == ['{"n": 1}', '{"n": 2}', '{"n": 3}']


def test_clacky(spark):
    doc = {"session_id": "c-1", "working_dir": "/w", "messages": [{"role": "system", "content": "x"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": [{"type": "text", "text": "a"}], "tool_calls": [{"id": "t", "function": {"name": "ls", "arguments": "{}"}}]}, {"role": "tool", "content": "r", "tool_call_id": "t"}, {"role": "user", "content": "s", "compressed_summary": "y"}]}
    rows = adapters.parse_clacky_json(spark.createDataFrame([("p/c.json", json.dumps(doc)), ("p/d.json", "[]")], "path string, value string")).orderBy("sequence").collect()
    assert [(r.event_type, r.content, r.record_locator) for r in rows] == [("message", "q", "messages[1]"), ("message", "a", "messages[2]"), ("tool_call", "{}", "messages[2].tool_calls[0]"), ("tool_result", "r", "messages[3]")]
    chunk = "session_id: c-9\n\n## User\nplease\n\n## Assistant\nsure\n_Tool calls: ls, cat_\nthen\n### Tool Result: ls\nfile\nlist\n## User\nthanks\n"
    rows = adapters.parse_clacky_chunk(spark.createDataFrame([("x-chunk-1.md", chunk)], "path string, value string")).orderBy("sequence").collect()
    assert [(r.session_id, r.role, r.event_type, r.content) for r in rows] == [
        ("c-9", "user", "message", "please"), ("c-9", "assistant", "message", "sure"), ("c-9", "assistant", "tool_call", "ls, cat"), ("c-9", "assistant", "message", "then"), ("c-9", "tool", "tool_result", "file\nlist"), ("c-9", "user", "message", "thanks"),
    ]


def test_tie_identifies_nothing(spark):
    rows = spark.createDataFrame([("/x/.neo/projects/a.jsonl", '{"type": "session_meta", "payload": {}, "sessionId": "s", "message": {}}', '"type":"queue-operation"')], "path string, line string, head string")
    scored = adapters.probe_scores(rows.withColumn("v", F.expr("parse_json(line)")))
    assert scored.filter("score = 100").count() == 2 and adapters.identify(rows.withColumn("v", F.expr("parse_json(line)"))).count() == 0


def test_stream_reads_rewritten_files_anew(spark, tmp_path):
    lines.register(spark)
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()

    def run(**files):
        for name, text in files.items():
            (source / f"{name}.jsonl").write_text(text)
        stream = spark.readStream.format("session_lines").load(str(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(out).collect()
        return sorted((r.path[-7:-6], r.byte_offset, r.line, r.rewritten) for r in rows)

    first = run(a="1\n2\n", b="1\n2\n", c="1\n2\n")
    assert len(first) == 6 and not any(r[3] for r in first)
    again = run(a="1\n2\n3\n", b="9\n2\n3\n", c="1\n")
    assert sorted(set(again) - set(first)) == [("a", 4, "3", False), ("b", 0, "9", True), ("b", 2, "2", True), ("b", 4, "3", True), ("c", 0, "1", True)]
    assert run() == again


def test_chunk_without_headings(spark):
    rows = spark.createDataFrame([("x/t-chunk-1.md", "session_id: s1\n\njust text\nmore"), ("x/t-chunk-2.md", "before\n## User\nasked\n## Assistant\nsaid"), ("x/t-chunk-3.md", "")], "path string, value string")
    got = sorted((r.path[-4:-3], r.session_id, r.sequence, r.role, r.content) for r in adapters.parse_clacky_chunk(rows).collect())
    assert got == [("1", "s1", 1, "unknown", "just text\nmore"), ("2", "t", 1, "unknown", "before"), ("2", "t", 2, "user", "asked"), ("2", "t", 3, "assistant", "said")]
