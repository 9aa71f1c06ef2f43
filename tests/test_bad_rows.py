import csv
import io
import json

from loomspark.operators.bad_rows import bad_lines, good_rows, parse_lines, parse_results

UUID = "b60a0642-af0b-6e8c-856c-0c20f9de1817"
SCHEMA = "source_file_id string, line_no bigint, byte_offset bigint, line_format string, line string, terminated boolean, errors string"


def frame(spark, files):
    rows = []
    for name, (kind, lines) in files.items():
        for n, line in enumerate(lines, 1):
            rows.append((name, n, n * 100, kind, line, n < len(lines), "clash"))
    return spark.createDataFrame(rows, SCHEMA)


def reasons(spark, files):
    return {(r.source_file_id, r.line_no): r.reason for r in bad_lines(parse_lines(frame(spark, files))).collect()}


HEAD = "session_id,sequence,role,event_type,timestamp,duration_ms,content"


def row(**over):
    values = {"session_id": UUID, "sequence": "1", "role": "user", "event_type": "message", "timestamp": "2025-01-01T00:00:00Z", "duration_ms": "5", "content": "x"} | over
    return ",".join(values.values())


def test_delimited(spark):
    lines = {
        HEAD: None, row(): None, row(content='"a,b"'): None, row(content='"say ""x"", y"'): None, row(content='"a\nb"'): None, row(content='""'): None, row(content='""""""'): None, row(session_id=f'"{UUID}"'): None,
        row() + "\r": None, "": None, " \t": None, row(timestamp="", duration_ms=""): None, row(timestamp="20250101T000000Z"): None,
        row(content='"open'): "quoting", row(content='a"b'): "quoting", row(content='"a" b'): "quoting", row(content='"a "b" c"'): "quoting", row(content="a\nb"): "quoting",
        row() + ",": "column_count", row()[:-2]: "column_count", "just text": "column_count",
        row(sequence="0"): "invalid_value", row(sequence="-1"): "invalid_value", row(sequence="1.0"): "invalid_value", row(role="User"): "invalid_value", row(role=" user"): "invalid_value", row(event_type="x"): "invalid_value",
        row(session_id=UUID.upper()): "invalid_value", row(session_id=UUID + "\n0"): "quoting", row(timestamp="2025-02-30T00:00:00Z"): "invalid_value", row(timestamp="2025-01-01T00:00:00"): "invalid_value", row(timestamp="2025-01-01T24:00:00Z"): "invalid_value", row(duration_ms="-1"): "invalid_value", row(duration_ms="1.5"): "invalid_value",
    }
    got = reasons(spark, {"f": ("delimited", list(lines))})
    assert {n: got.get(("f", n)) for n in range(1, len(lines) + 1)} == dict(enumerate(lines.values(), 1))


def test_header_gives_columns_and_delimiter(spark):
    files = {
        "semi": (" Delimited", ["role;session_id;sequence;event_type\r", f"user;{UUID};1;message\r", f"user;{UUID};1;message;x", f'"us""er";{UUID};1;message']),
        "tab": ("delimited", ["﻿session_id\tsequence\trole\tevent_type", f"{UUID}\t3\ttool\terror", f"{UUID}\t3\ttool"]),
        "short": ("delimited", ["sequence,role", "1,user"]),
    }
    assert reasons(spark, files) == {("semi", 3): "column_count", ("semi", 4): "invalid_value", ("tab", 3): "column_count", ("short", 2): "invalid_value"}
    bare = frame(spark, {"bare": ("delimited", ["x", f"{UUID},1"])}).filter("line_no > 1")
    assert [r.reason for r in bad_lines(parse_lines(bare)).collect()] == ["column_count"]


def test_json(spark):
    good = {"session_id": UUID, "sequence": 1, "role": "user", "event_type": "message", "timestamp": None, "duration_ms": 0}
    lines = [
        (json.dumps(good), None), (json.dumps(good | {"extra": {"a": [1]}, "sequence": 10**40}), None), ("  " + json.dumps(good) + " \r", None), (json.dumps(good | {"timestamp": "", "duration_ms": ""}), None), ("", None),
        ("{", "json"), ("{'a': 1}", "json"), (json.dumps(good)[:-1] + ",}", "json"), ('{"a": NaN}', "json"), ('{"a": 01}', "json"), ('{"a": "\x01"}', "json"), ("{} {}", "json"), ("[" * 100_000, "json"),
        ("[]", "not_object"), ("null", "not_object"), ('"x"', "not_object"), ("12", "not_object"),
        (json.dumps(good | {"sequence": "1"}), "invalid_value"), (json.dumps(good | {"sequence": 1.0}), "invalid_value"), (json.dumps(good | {"sequence": True}), "invalid_value"), (json.dumps(good | {"sequence": 0}), "invalid_value"), (json.dumps(good | {"role": None}), "invalid_value"),
        (json.dumps(good | {"role": ["user"]}), "invalid_value"), (json.dumps(good | {"duration_ms": "5"}), "invalid_value"), (json.dumps(good | {"timestamp": 5}), "invalid_value"), ("{}", "invalid_value"), ('{"a', "incomplete_tail"),
    ]
    got = reasons(spark, {"j": ("jsonl", [x for x, _ in lines])})
    assert {n: got.get(("j", n)) for n in range(1, len(lines) + 1)} == {n: r for n, (_, r) in enumerate(lines, 1)}
    assert reasons(spark, {"k": ("jsonl", ["{", "{}", "[]"])}) == {("k", 1): "json", ("k", 2): "invalid_value", ("k", 3): "not_object"}


def test_quotes_agree_with_a_csv_reader(spark):
    import itertools

    texts = ["".join(p) for n in range(1, 7) for p in itertools.product('a",', repeat=n)]
    files = {"q": ("delimited", ["a,b", *texts])}
    parsed = {r.line_no: r for r in parse_lines(frame(spark, files)).collect()}
    for n, text in enumerate(texts, 2):
        try:
            fields = next(csv.reader(io.StringIO(text), strict=True))
            ok = ",".join('"' + f.replace('"', '""') + '"' if '"' in f or "," in f else f for f in fields) == text or _legal(text)
        except (csv.Error, StopIteration):
            fields, ok = [], False
        reason = parsed[n].errors[0]
        assert (reason == "quoting") == (not (ok and _legal(text))), text
        if ok and _legal(text):
            assert (reason == "column_count") == (len(fields) != 2), text


def _legal(text):
    """RFC 4180 by a small state machine."""
    state = "start"
    for ch in text:
        if state == "start":
            state = "quoted" if ch == '"' else "start" if ch == "," else "plain"
        elif state == "plain":
            if ch == '"':
                return False
            state = "start" if ch == "," else "plain"
        elif state == "quoted":
            state = "closed" if ch == '"' else "quoted"
        else:
            if ch not in '",':
                return False
            state = "quoted" if ch == '"' else "start"
    return state != "quoted"


def test_good_rows_results_and_empty_tables(spark):
    lines = frame(spark, {"f": ("delimited", [HEAD, row(), row(content='"x'), row()]), "j": ("jsonl", ['{"a'])})
    twice = lines.unionByName(lines)
    assert good_rows(parse_lines(twice)).count() == 2 and bad_lines(parse_lines(twice)).count() == 2
    results = {r.source_file_id: r for r in parse_results(twice, parse_lines(twice)).collect()}
    assert [e.record_locator for e in results["f"].errors] == ["byte:300"] and results["f"].records_seen == 4 and results["j"].excluded[0].reason == "incomplete_tail" and not results["j"].errors
    empty = lines.limit(0)
    assert bad_lines(parse_lines(empty)).count() == 0 and good_rows(parse_lines(empty)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None, None, None), ("a", 2, 0, "jsonl", None, None, None), ("a", 3, 0, "odd", "x", None, None)], SCHEMA)
    assert [(r.line_no, r.reason) for r in bad_lines(parse_lines(nulls)).collect()] == [(3, "unknown_format")]


def test_very_long_lines(spark):
    long = row(content='"' + 'a""' * 300_000 + '"')
    assert reasons(spark, {"f": ("delimited", [HEAD, long, long[:-1]])}) == {("f", 3): "quoting"}
