import pytest
from pyspark.sql import functions as F

from loomspark.operators import publication as pub
from loomspark.operators import review, snapshots
from loomspark.streaming import ingest


def test_candidates(spark):
    paths = {"a/x.jsonl": True, "a/notes.md": False, "a/session.md": True, "a/t-chunk-3.md": True, "node_modules/x.jsonl": False, "a/Cache/x.json": False, "a/history": True, "a/readme": False, "/".join("abcdefghijklmn") + "/x.json": False, "x.py": False}
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.ok for r in rows.select("path", snapshots.is_candidate(F.col("path")).alias("ok")).collect()} == paths


def test_snapshots_and_incremental_runs(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    for name, text in {"same": "1", "grown": "1\n", "changed": "abc", "gone": "x", "rewritten and grown": "short", "shrunk": "long text"}.items():
        (root / name).write_text(text)
    frozen = snapshots.freeze(spark, str(root))
    first = spark.createDataFrame(frozen.collect(), frozen.schema)
    (root / "grown").write_text("1\n2\n")
    (root / "changed").write_text("xyz")
    (root / "rewritten and grown").write_text("another text")
    (root / "shrunk").write_text("long")
    (root / "new").write_text("n")
    (root / "gone").unlink()
    second = snapshots.freeze(spark, str(root), first)
    changes = snapshots.source_changes(first, second)
    got = {r.path.rsplit("/", 1)[-1]: r.change for r in changes.collect()}
    assert got == {"same": "same", "grown": "appended", "changed": "rewritten", "new": "added", "gone": "missing", "rewritten and grown": "rewritten", "shrunk": "rewritten"}
    flags = second.select("path", F.col("path").endswith("grown").alias("append_only"))
    actions = {r.path.rsplit("/", 1)[-1]: r.action for r in ingest.plan(changes, flags).collect()}
    assert actions == {"same": "skip", "grown": "tail", "changed": "parse", "new": "parse", "gone": "keep", "rewritten and grown": "parse", "shrunk": "parse"}
    assert {r.action for r in ingest.plan(changes, flags, policy_changed=True).collect()} == {"parse", "keep"}
    errors = {(r.path.rsplit("/", 1)[-1], r.message) for r in snapshots.snapshot_errors(second, first).collect()}
    assert errors == {("gone", "missing"), ("new", "unexpected")}


def test_unstable_sources_keep_their_rows(spark):
    rows = "path string, size bigint, sha256 string, prefix_sha256 string, stable boolean"
    before, after = spark.createDataFrame([("a", 1, "x", None, True)], rows), spark.createDataFrame([("a", 2, "y", "x", False), ("b", 2, "y", None, False)], rows)
    changes = snapshots.source_changes(before, after)
    assert {r.path: r.change for r in changes.collect()} == {"a": "unstable", "b": "unstable"}
    assert {r.action for r in ingest.plan(changes, spark.createDataFrame([("a", True)], "path string, append_only boolean"), policy_changed=True).collect()} == {"keep"}


def test_forced_adapters(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("d",)], "path string")
    scores = spark.createDataFrame([("a", "x", 9), ("a", "y", 5), ("b", "x", 5), ("b", "y", 5), ("c", "x", 0), ("d", "x", 1)], "path string, adapter string, score int")
    forced = spark.createDataFrame([("a", "y"), ("d", "y")], "path string, adapter string")
    assert sorted(map(tuple, snapshots.identified(files, scores, forced).collect())) == [("a", "y", None), ("b", None, "tie"), ("c", None, "no_adapter"), ("d", None, "forced_adapter_refused")]


def test_merge(spark):
    schema = "path string, event_id string, project_key string, content string"
    old = spark.createDataFrame([("a", "1", "p", "x"), ("b", "2", "p", "x"), ("c", "3", "q", "x")], schema)
    new = spark.createDataFrame([("a", "9", "p", "y"), ("b", "2", "p", "x"), ("b", "4", "p", "z"), ("b", "4", "p", "z")], schema)
    actions = spark.createDataFrame([("a", "parse"), ("b", "tail")], "path string, action string")
    out = ingest.merge(old, new, actions)
    assert sorted(r.event_id for r in out.collect()) == ["2", "3", "4", "9"]
    assert [r.project_key for r in ingest.affected_projects(old, out, ["content"]).collect()] == ["p"]


def test_tail(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("{}\n{")
    for _ in range(2):
        ingest.tail_lines(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_graph(spark):
    docs = spark.createDataFrame([("a.md", "A", "p"), ("b.md", "B", None)], "path string, title string, project_key string")
    claims = spark.createDataFrame([("c1", "p", "s", ["c2"], []), ("c2", "q", "t", [], ["zz"])], "claim_id string, project_key string, statement string, conflicts array<string>, supersedes array<string>")
    feedback = spark.createDataFrame([("f1", "p", "u")], "feedback_id string, project_key string, statement string")
    rules = spark.createDataFrame([("r1", "rule", ["f1"], "c1")], "evolution_id string, rule string, feedback_ids array<string>, promoted_claim_id string")
    n, e = pub.nodes(docs, claims, feedback, rules), pub.edges(docs, claims, feedback, rules)
    assert n.count() == 6 and sorted((r.source, r.target, r.relation) for r in e.collect()) == [("a.md", "c1", "contains-claim"), ("a.md", "f1", "records-feedback"), ("c1", "c2", "conflicts"), ("c2", "zz", "supersedes"), ("f1", "r1", "supports-evolution"), ("r1", "c1", "activates-claim")]
    index = spark.createDataFrame([("a.md",), ("../x.md",)], "path string")
    assert sorted(r.message for r in pub.graph_errors(n, e, index).collect()) == ["an end does not exist", "document is not in the graph", "document is not in the index", "unsafe path"]
    assert {r.path: r.links for r in pub.link_audit(docs, e).collect()} == {"a.md": 2, "b.md": 0}
    assert pub.stale_paths(docs, docs.limit(1)).count() == 1


def test_cards(spark):
    rows = spark.createDataFrame([("p", 2, "b\nc", "stale", ["e2"]), ("p", 1, "a", "observed", ["e1", "e3"])], "k string, position int, text string, status string, evidence_event_ids array<string>")
    assert pub.cards(rows, "k", ["position"]).first().markdown == "- a (observed; e1, e3)\n- b c (stale; e2)"


def test_versions(spark, tmp_path):
    folder = pub.VersionedFolder(spark, str(tmp_path / "kb"))
    one = folder.publish({"t": spark.range(5)})
    assert folder.read("t", verify=True).count() == 5
    with pytest.raises(ValueError):
        folder.publish({"t": spark.range(6)})
    folder.publish({"t": spark.range(6)}, replaces=one)
    assert folder.read("t").count() == 6 and folder.current() != one
    spark.range(1).write.mode("append").parquet(str(tmp_path / "kb" / folder.current() / "t"))
    with pytest.raises(ValueError):
        folder.read("t", verify=True)


def test_membership(spark):
    events = spark.createDataFrame([("e1", "p"), ("e2", "p"), ("e3", "q")], "event_id string, project_key string")
    over = spark.createDataFrame([("e2", "r"), ("e9", "r"), ("e3", "a"), ("e3", "b")], "event_id string, target string")
    plan = review.membership(events, over)
    assert {r.event_id: r.target for r in plan.collect()} == {"e1": "p", "e2": "r", "e3": "a"}
    assert sorted(r.location for r in review.membership_errors(events, over).collect()) == ["e3", "e9"]
    moved = plan.select(F.col("proposed").alias("source"), "target")
    assert sorted(map(tuple, review.derived_membership(moved).collect())) == [("split", "p")]
