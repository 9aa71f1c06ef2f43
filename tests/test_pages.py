import pytest
from pyspark.sql import functions as F

from loomspark.operators import canonical, gates, pages
from loomspark.operators.evidence import total_order
from loomspark.sources import registry

EVENT = "event_id string, project_key string, project_label string, session_id string, logical_session_id string, source_agent string, sequence bigint, role string, event_type string, content string, timestamp string"


def rows(spark, n=120):
    kinds = ["message", "delivery", "error"]
    return spark.createDataFrame([(f"e{i:03}", "p" if i % 4 else None, "Pea" if i > 5 else None, f"s{i % 3}", "l", f"a{i % 2}", i, "user", kinds[i % 3], f"text {i}\nmore", f"{i:03}") for i in range(n)], EVENT)


def test_dossiers(spark):
    events = rows(spark)
    figures = pages.dossier_figures(events).collect()
    assert [(r.project_key, r.n, r.sessions, r.agents, r.first_at, r.asked + r.delivered + r.failed) for r in figures] == [("p", 90, 3, ["a0", "a1"], "001", 90)]
    text = pages.dossiers(events, total_order()).first().markdown
    shown = [line for line in text.splitlines() if line.startswith("> text ")]
    want = [f"> text {i}" for i in range(120) if i % 4 and i % 3 == 1]
    assert shown == want[-pages.DELIVERIES :] and text.startswith("# p\n") and "> more" in text
    assert pages.dossiers(events.limit(0), total_order()).count() == 0


def test_index_and_links(spark):
    entry = pages.index_entries(rows(spark), total_order()).collect()
    assert [(r.project_key, r.title) for r in entry] == [("p", "Pea")] and entry[0].path.startswith("projects/pea-") and entry[0].keywords[:3] == ["text", "more", "pea"]
    links = spark.createDataFrame([("a.md", "b.md", "B", "uses", "g1"), ("a.md", "b.md", "B", "uses", "g1"), ("a.md", "c.md", "A", "near", "g2")], "path string, other string, title string, relation string, edge_id string")
    assert [tuple(r) for r in pages.related_sections(links).collect()] == [("a.md", "## Related\n\n- [A](c.md): near\n\n- [B](b.md): uses")]
    matrix = pages.compatibility(spark.createDataFrame([("x", 2, 5), ("y", 1, 0)], "adapter string, sources int, events int"), ["x", "y", "z"])
    assert {r.adapter: r.status for r in matrix.collect()} == {"x": "verified", "y": "seen", "z": "not seen"}
    assert pages.evidence_rules({"kept_rows": 3}).endswith("- kept rows: 3")
    assert pages.rule_summary(spark.createDataFrame([("candidate",), ("approved",)], "status string")).first().summary == "active"


def test_moves_and_sections(spark):
    page = "path string, sha256 string"
    previous, current = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], page), spark.createDataFrame([("a", "1"), ("b", "2"), ("e", "1"), ("../x", "1")], page)
    archive = spark.createDataFrame([("archive/r/d",)], "path string")
    got = {r.path: (r.action, r.target) for r in pages.page_moves(previous, current, archive, "r").collect()}
    assert got == {"a": ("keep", None), "b": ("write", None), "c": ("archive", "archive/r/c"), "d": ("refuse", None), "e": ("write", None), "../x": ("refuse", None)}
    text = spark.createDataFrame([("# T\n\n## Old\nx\n### deeper\ny\n\n## Kept\nz",)], "t string")
    assert text.select(pages.without_sections(F.col("t"), ["Old"])).first()[0] == "# T\n\n## Kept\nz"
    assert text.select(pages.page_text([F.lit("a"), F.lit(" "), F.lit(None).cast("string"), F.lit("b")])).first()[0] == "a\n\nb\n"


def test_chain_hashes(spark, monkeypatch):
    monkeypatch.setattr(canonical, "PART_ROWS", 7)
    events = rows(spark)
    hashes = lambda df: {r.project_key: (r.n, r.ordered_sha256, r.set_sha256) for r in canonical.chain_hashes(df, ["project_key"], total_order(), F.col("event_id")).collect()}
    one = hashes(events.filter("project_key IS NOT NULL"))
    assert one == hashes(events.filter("project_key IS NOT NULL").repartition(5)) and one["p"][0] == 90
    swapped = events.filter("project_key IS NOT NULL").withColumn("timestamp", F.when(F.col("sequence") == 1, "999").otherwise(F.col("timestamp")))
    assert hashes(swapped)["p"][1] != one["p"][1] and hashes(swapped)["p"][2] == one["p"][2]
    slices = canonical.slice_hashes(events.filter("project_key = 'p'"), "project_key", total_order(), F.col("event_id"), 40)
    assert sorted(r.n for r in slices.collect()) == [10, 40, 40]
    other = canonical.slice_hashes(swapped, "project_key", total_order(), F.col("event_id"), 40)
    assert {r.message for r in canonical.receipt_errors(slices, other, "project_key").collect()} == {"slice has changed"} and canonical.receipt_errors(slices, slices, "project_key").count() == 0
    assert {r.message for r in canonical.receipt_errors(slices.filter("slice > 0"), slices, "project_key").collect()} == {"slice has no receipt"}
    a, b = spark.createDataFrame([(1, None)], "x int, y string"), spark.createDataFrame([(None, 1)], "y string, x int")
    assert a.select(canonical.row_hash(["x", "y"])).first() == b.select(canonical.row_hash(["y", "x"])).first() != a.select(canonical.row_hash(["x"])).first()
    pairs = spark.createDataFrame([("p", "1"), ("q", "2"), ("p", "1")], "project_key string, event_id string")
    assert canonical.partition_hash(pairs).first() == canonical.partition_hash(pairs.orderBy(F.desc("event_id")).distinct()).first()


def test_rebase(spark):
    prior = spark.createDataFrame([("1", "p", "x"), ("2", "p", "x"), ("3", "p", "x")], "event_id string, target string, content_sha256 string")
    now = spark.createDataFrame([("1", "x"), ("2", "y")], "event_id string, content_sha256 string")
    kept, errors = canonical.rebase(prior, now)
    assert [r.event_id for r in kept.collect()] == ["1"] and sorted(map(tuple, errors.collect())) == [("2", "evidence has changed"), ("3", "event is gone")]


def test_gates(spark, tmp_path):
    open_gates = spark.createDataFrame([(g, True) for g in gates.GATES], "gate string, passed boolean")
    files = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "path string, size int, sha256 string")
    done, index = {"run_id": "r", "status": "complete"}, {"run_id": "r", "semantic_status": "published"}
    assert gates.publication_errors(done, index, open_gates, files, files) == []
    bad = open_gates.filter("gate <> 'privacy_clear'").unionByName(spark.createDataFrame([("review_valid", None)], open_gates.schema))
    errors = gates.publication_errors({"run_id": "q", "status": "open"}, index, bad, files, files.filter("path = 'a'"), pending=True)
    assert errors == ["a transaction is pending", "run ids differ", "not published", "privacy_clear: gate is missing", "review_valid: gate is closed", "1 files differ from the manifest"]
    changes = spark.createDataFrame([("a", "same")], "path string, change string")
    assert gates.preserved(gates.run_conditions(files, files, changes, True, ["path", "sha256"])) == (True, [])
    assert gates.preserved(gates.run_conditions(files, files.limit(1), changes, False, ["path", "sha256"])) == (False, ["policy", "rows gone"])
    assert gates.run_report([("b", 2), ("a", 1)], open_gates.limit(1))["counters"] == {"a": 1, "b": 2}
    with gates.writer_lock(str(tmp_path)) as path:
        with pytest.raises(TimeoutError), gates.writer_lock(str(tmp_path)):
            pass
        with open(path) as file:
            assert "pid" in file.read()
    with gates.writer_lock(str(tmp_path)):
        pass


def test_registry(spark, tmp_path):
    (tmp_path / ".codex/sessions").mkdir(parents=True)
    (tmp_path / "c/projects").mkdir(parents=True)
    assert registry.root_hints({"CLAUDE_CONFIG_DIR": str(tmp_path / "c")}, str(tmp_path)) == [("claude-code-jsonl", str(tmp_path / "c/projects")), ("codex-jsonl", str(tmp_path / ".codex/sessions"))]
    formats = registry.Registry()
    mine = registry.Format("mine", lambda first: first.select("path", F.when(F.col("head").startswith("MINE"), 200).otherwise(0).alias("score")), lambda lines: lines.select(F.lit("event").alias("kind"), "path", "adapter", F.col("line").alias("content")))
    formats.register(mine)
    for name in ("mine", "codex-jsonl", "No Name"):
        with pytest.raises(ValueError):
            formats.register(registry.Format(name, mine.probe, mine.parse))
    assert formats.get("mine") is mine and formats.get("clacky-json") == "clacky-json" and "mine" in formats.names()
    with pytest.raises(KeyError):
        formats.get("other")
    first = spark.createDataFrame([("a.x", "MINE 1", "{}")], "path string, head string, line string").withColumn("v", F.expr("try_parse_json(line)"))
    assert [tuple(r) for r in formats.scores(first).collect()] == [("a.x", "mine", 200)]
    lines = spark.createDataFrame([("a.x", 0, "MINE 1", True)], "path string, byte_offset bigint, line string, terminated boolean")
    files = spark.createDataFrame([("a.x", "mine")], "path string, adapter string")
    assert [(r.kind, r.content) for r in formats.parse(lines, files).collect()] == [("event", "MINE 1")]
    assert [r.path for r in registry.outside(spark.createDataFrame([("/o/x",), ("/o2/x",), ("/o",)], "path string"), "/o/").collect()] == ["/o2/x"]
    (tmp_path / "t.jsonl").write_text('{"a": 1}\nnope\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        registry.read_events(spark, str(tmp_path / "t.jsonl"), "a int").collect()
