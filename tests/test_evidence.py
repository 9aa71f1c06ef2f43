import os
import random

import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as fx
from loomspark.functions import tokens as tk
from loomspark.operators import context_units as cu
from loomspark.operators import evidence, lifecycle, ranges, retrieval, review, search
from loomspark.plans import evidence_queries
from tests.oracle import SF


def test_tokens():
    assert tk.tokenize("The Quick_brown fox-2.0, a b!") == ["the", "quick_brown", "fox-2.0"]
    assert tk.tokenize("done. ＡＢＣ") == ["done.", "abc"]
    assert tk.tokenize("日本語テスト") == ["日本語テスト", "日本", "本語", "語テ", "テス", "スト"]
    assert tk.tokenize("ab中文cd") == ["ab", "中文", "cd"] and tk.tokenize("한국어 é́x") == ["한국어", "é́x"]
    assert tk.tokenize("") == tk.tokenize(None) == []


def test_keywords_break_ties_by_first_use(spark):
    rows = spark.createDataFrame([("p", 1, "beta alpha"), ("p", 2, "alpha gamma beta"), ("p", 3, None), ("q", 1, "")], "p string, n int, t string")
    assert [(r.p, r.keywords) for r in tk.corpus_keywords(rows, "p", F.col("t"), F.col("n"), 2).collect()] == [("p", ["beta", "alpha"])]


def test_hashes(spark):
    import hashlib

    row = spark.createDataFrame([("a", None)], "x string, y string").select(fx.stable_hash("x", "y", length=16).alias("h"), fx.slug(F.lit(" My Ünit / x "), F.lit("k")).alias("s")).first()
    assert row.h == hashlib.sha256(b"a\0None\0").hexdigest()[:16] and row.s == "my-ünit-x-" + hashlib.sha256(b"k").hexdigest()[:10] + ".md"


def test_components(spark):
    rng = random.Random(2)
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(200)] + [("z", "z")] + [(f"h{i}", "hub") for i in range(100)] + [(f"r{rng.randrange(60):02}", f"r{rng.randrange(60):02}") for _ in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    rows = evidence.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()
    assert {r.node: r.component for r in rows} == {n: find(n) for n in list(parent)} and len(rows) == len(parent)


EVENT = "event_id string, source_agent string, source_file_id string, session_id string, logical_session_id string, record_locator string, sequence bigint, role string, event_type string, content string, timestamp string, call_id string, tool_name string, project_key string, actor_kind string, metadata map<string,string>"


def event(i, **over):
    base = dict(event_id=f"e{i}", source_agent="A", source_file_id="f", session_id="s", logical_session_id="l", record_locator=f"byte:{i}", sequence=i, role="user", event_type="message", content="x", timestamp="1", call_id=None, tool_name=None, project_key="p", actor_kind="unknown_user", metadata={}) | over
    return tuple(base.values())


def test_mirrors(spark):
    lane = lambda n: {"transport_lane": n}
    rows = [event(1, metadata=lane("codex-event-message")), event(2, metadata=lane("codex-response-item"), content=" x "), event(3, metadata=lane("codex-response-item")), event(4, content="y"), event(5, content="y"), event(6, content="z", metadata=lane("codex-response-item")), event(7, content=None)]
    out = {r.event_id: (r.kept, r.target) for r in evidence.mirrored(spark.createDataFrame(rows, EVENT)).collect()}
    assert out["e2"] == (False, "e1") and all(out[f"e{i}"] == (True, None) for i in (1, 3, 4, 5, 6, 7))


def test_forget_and_impact(spark):
    events = spark.createDataFrame([event(1), event(2, project_key="q"), event(3, source_file_id="g")], EVENT)
    dead = spark.createDataFrame([("q",)], "id string").select(F.lit("projects").alias("kind"), F.sha2("id", 256).alias("sha256"))
    assert sorted(r.event_id for r in evidence.without_forgotten(events, dead).collect()) == ["e1", "e3"]
    claims = spark.createDataFrame([("c1", "confirmed", ["e1", "e2"]), ("c2", "confirmed", ["e3"])], "claim_id string, status string, evidence_event_ids array<string>")
    feedback = spark.createDataFrame([("f1", "z", ["e1"]), ("f2", "q", ["e9"])], "feedback_id string, project_key string, evidence_event_ids array<string>")
    rules = spark.createDataFrame([("r1", ["f1"], None, []), ("r2", ["f9"], "c1", []), ("r3", [], None, ["e2"])], "evolution_id string, feedback_ids array<string>, promoted_claim_id string, approval_event_ids array<string>")
    docs = spark.createDataFrame([("p.md", "p"), ("q.md", "q")], "path string, project_key string")
    nodes = spark.createDataFrame([("p.md", "p"), ("c1", None), ("x", "q"), ("y", None)], "id string, project_key string")
    edges = spark.createDataFrame([("g1", "c1", "y"), ("g2", "y", "y")], "edge_id string, source string, target string")
    tables = lifecycle.Tables(events, claims, feedback, rules, docs, nodes, edges)
    one = events.filter("event_id = 'e1'")
    got = lambda action: {(r.kind, r.id) for r in lifecycle.impact(tables, one, action).collect()}
    retract = {("event", "e1"), ("project", "p"), ("project", "q"), ("claim", "c1"), ("feedback", "f1"), ("rule", "r1"), ("rule", "r2"), ("document", "p.md"), ("node", "p.md"), ("node", "c1"), ("edge", "g1")}
    assert got("retract") == retract
    assert got("forget") == retract | {("event", "e2"), ("feedback", "f2"), ("rule", "r3"), ("document", "q.md"), ("node", "x")}
    touched = lifecycle.impact(tables, one)
    assert {r.claim_id: r.status for r in lifecycle.retract(claims, touched).collect()} == {"c1": "retracted", "c2": "confirmed"}
    assert lifecycle.tombstones(touched).count() == 3 and {r.kind for r in lifecycle.tombstones(touched, events, asked_projects=[]).collect()} == {"events", "event_locators"}
    assert [r.event_id for r in lifecycle.without(events, touched, "event", "event_id").orderBy("event_id").collect()] == ["e2", "e3"]


def test_requests(spark):
    events = spark.createDataFrame([event(1), event(2, project_key=None), event(3, source_file_id="g")], EVENT)
    claims = spark.createDataFrame([("c1", ["e3"])], "claim_id string, evidence_event_ids array<string>")
    none = spark.createDataFrame([], "feedback_id string, project_key string, evidence_event_ids array<string>"), spark.createDataFrame([], "evolution_id string, feedback_ids array<string>")
    tables = lifecycle.Tables(events, claims, *none)
    asked = lifecycle.selectors(project_keys=[" session:l ", "zz"], claim_ids="c1")
    touched, missing = lifecycle.plan(tables, asked, "forget")
    assert {(r.kind, r.id) for r in touched.collect()} == {("event", "e2"), ("event", "e3"), ("project", "session:l"), ("project", "p"), ("project", "zz"), ("claim", "c1")}
    assert [tuple(r) for r in missing.collect()] == [("project_keys", "zz")]
    for wrong in ({}, {"event_ids": [" "]}, {"names": ["x"]}):
        with pytest.raises(ValueError):
            lifecycle.selectors(**wrong)
    with pytest.raises(ValueError):
        lifecycle.impact(tables, events, "burn")
    rows = spark.createDataFrame([("ab abc x",), (None,)], "t string")
    assert [r.t for r in lifecycle.scrub(rows, "t", ["ab", "abc", " "]).collect()] == ["[FORGOTTEN] [FORGOTTEN] x", None]
    policies = spark.createDataFrame([("s1", "2025", "2026"), ("s2", "2025", None)], "selector_sha256 string, recheck_after string, retain_until string")
    new = spark.createDataFrame([("s1", "2027", None), ("s3", "2024", None)], policies.schema)
    assert sorted((r.selector_sha256, r.recheck_after) for r in lifecycle.schedule(policies, new).collect()) == [("s1", "2027"), ("s2", "2025"), ("s3", "2024")]


def test_numbers_within_hot_keys(spark):
    rows = spark.createDataFrame([("a" if i % 3 else None, i % 50, i) for i in range(3000)], "k string, x int, event_id int").repartition(7)
    got = {}
    for r in ranges.numbered(rows, ["k"], [F.col("x"), F.col("event_id")]).collect():
        got.setdefault(r.k, []).append((r.place, r.x, r.event_id))
    for key, places in got.items():
        want = sorted((i % 50, i) for i in range(3000) if ("a" if i % 3 else None) == key)
        assert [(x, i) for _, x, i in sorted(places)] == want and sorted(p for p, _, _ in places) == list(range(1, len(want) + 1))
    packs = sorted((r.packet, r.start, r.end, r.previous_id is None, r.next_id is None) for r in ranges.packets(rows.filter("k = 'a'"), "k", [F.col("x"), F.col("event_id")], 900).collect())
    assert packs == [(0, 0, 900, True, False), (1, 900, 1800, False, False), (2, 1800, 2000, False, True)]


def test_sessions_of_one_document_are_stitched(spark):
    schema = "source_agent string, session_id string, parent_session_id string, source_relpath string"
    rows = [("Clacky", "a", None, "x/t.json"), ("Clacky", "b", None, "x/t-chunk-2.md"), ("Clacky", "c", None, "y/t.md"), ("Codex", "a", None, "x/t.json"), ("Codex", "d", "a", None)]
    got = {(r.source_agent, r.session_id): r.logical_session_id for r in evidence.logical_sessions(spark.createDataFrame(rows, schema)).collect()}
    assert got[("Clacky", "a")] == got[("Clacky", "b")] != got[("Clacky", "c")] and got[("Codex", "a")] == got[("Codex", "d")] != got[("Clacky", "a")] and len(got) == 5


def test_manifest_does_not_depend_on_order(spark):
    rows = [event(i, event_id=f"x{i}") for i in range(400)]
    a, b = (evidence.project_manifest(spark.createDataFrame(r, EVENT).repartition(n)).collect() for r, n in ((rows, 1), (rows[::-1] + rows[:3], 3)))
    assert a == b and a[0].event_count == 400


def test_ranges(spark):
    rows = spark.createDataFrame([("a", 0, 3, 10), ("a", 3, 10, 10), ("b", 0, 4, 10), ("b", 3, 6, 10), ("b", 8, 9, 10)], 'k string, start int, `end` int, length int')
    assert {r.k: r.tiled for r in ranges.tiles(rows, "k").collect()} == {"a": True, "b": False}
    assert sorted(map(tuple, ranges.uncovered(rows, "k").collect())) == [("b", 6, 8), ("b", 9, 10)]
    assert [(r.k, r.start) for r in ranges.overlapping(rows, "k").collect()] == [("b", 3)]


def test_review_rules(spark):
    events = spark.createDataFrame([("e1", "p", "B", 10), ("e2", "p", "C", 20), ("e3", "q", "C", None)], "event_id string, project_key string, evidence_grade string, utc_us bigint")
    items = spark.createDataFrame([("i1", "p", "observed", "global", ["e2"], ["i2"]), ("i2", "p", "observed", "global", ["e1", "e3"], ["i2"]), ("i3", "q", "odd", "project", ["nope"], ["zz"])], "id string, project_key string, status string, scope string, evidence_event_ids array<string>, refs array<string>")
    at = lambda df: sorted(r.location for r in df.collect())
    assert at(review.unknown_evidence(items, "id", events, "r")) == ["i3"] and at(review.foreign_evidence(items, "id", events, "r")) == ["i2"]
    assert at(review.weak_observed(items, "id", events, "r")) == ["i1"] and at(review.dangling(items, "id", "refs", "r")) == ["i2", "i3"]
    assert at(review.outside(items, "id", "status", review.HISTORY_STATUSES, "r")) == ["i3"] and at(review.too_few_projects(items, "id", events, 2, "r")) == ["i1"]
    assert at(review.repeated(items.unionByName(items.limit(1)), "id", "r")) == ["i1"]
    ev = spark.createDataFrame([("v1", ["e1"], ["e2"]), ("v2", ["e2"], ["e1"]), ("v3", ["e1"], ["e3"])], "evolution_id string, baseline_event_ids array<string>, validation_event_ids array<string>")
    assert at(review.out_of_order(ev, events, "r")) == ["v2", "v3"]


def test_retrieval(spark):
    docs = spark.createDataFrame([("d1", "a.md", "Ledger merge plan", ["big ledger"], ["ledger", "merge"]), ("d2", "b.md", "Other", None, ["ledger"]), ("d3", "c.md", None, None, None)], "doc_key string, path string, title string, aliases array<string>, keywords array<string>")
    tasks = spark.createDataFrame([("t1", "Ledger"), ("t2", "please fix the code"), ("t3", "zebra")], "task_id string, task string")
    scored = {(r.task_id, r.doc_key): r.score for r in retrieval.scores(tasks, docs).collect()}
    assert scored == {("t1", "d1"): 4 + 3 + 4 + 20 + 24, ("t1", "d2"): 4}
    assert retrieval.scores(tasks.limit(0), docs).count() == 0
    assert [(r.doc_key, r.rank) for r in retrieval.ranked(retrieval.scores(tasks, docs), limit=1).collect()] == [("d1", 1)]
    edges = spark.createDataFrame([(1, "e1", "a.md", "b.md", "uses", "directed", "confirmed"), (2, "e2", "c.md", "a.md", "near", "symmetric", "confirmed"), (3, "e3", "c.md", "a.md", "x", "directed", "candidate")], "position int, edge_id string, source_path string, target_path string, relation string, direction string, status string")
    hop = retrieval.one_hop(spark.createDataFrame([("t1", "a.md")], "task_id string, path string"), edges)
    assert sorted((r.path, r.relation, r.traversal) for r in hop.collect()) == [("b.md", "uses", "forward"), ("c.md", "near", "reverse")]
    assert retrieval.reciprocal_links(edges).count() == 4
    rows = spark.createDataFrame([("k", 1, "u1", 50), ("k", 2, "u2", 100), ("k", 3, "u3", 40), ("k", 4, "u4", 5), ("l", 1, "u5", 999)], "k string, n int, unit_id string, size int")
    assert [(r.k, r.ids, r.used) for r in cu.fill(rows, ["k"], "n", 3, 95).collect()] == [("k", ["u1", "u3", "u4"], 95)]
    assert [r.ids for r in cu.fill(rows, ["k"], "n", 1, 95).collect()] == [["u1"]] and cu.fill(rows.limit(0), ["k"], "n", 3, 95).count() == 0


def test_scores_without_pairs_shuffled(spark, monkeypatch):
    from loomspark.operators import postings

    rng = random.Random(7)
    words = ["ledger", "merge", "led", "plan", "ger merge", "zebra", "note"]
    docs = [(f"d{i}", f"{i % 5}.md", rng.choice([None, "", " ".join(rng.choices(words, k=2))]), rng.choice([None, ["note"], ["big ledger", "note", "Ledger"]]), rng.choice([None, rng.choices(words, k=4)])) for i in range(60)]
    tasks = [(f"t{i}", rng.choice([None, "please", "Ledger", " ".join(rng.choices(words, k=2))])) for i in range(30)]
    want = {}
    for t, task in tasks:
        terms = [w for w in dict.fromkeys(tk.tokenize(task)) if w not in tk.GENERIC_TOKENS]
        for d, _, title, aliases, known in docs if terms else ():
            low, others = (title or "").lower(), [a.lower() for a in aliases or []]
            inside = lambda x, low=low, others=others: (x in low, any(x in a for a in others))
            score = sum(4 * (x in (known or [])) + 3 * inside(x)[0] + 4 * inside(x)[1] for x in terms) + 20 * inside(task.lower())[0] + 24 * inside(task.lower())[1]
            if score:
                want[t, d] = score
    tables = spark.createDataFrame(tasks, "task_id string, task string"), spark.createDataFrame(docs, "doc_key string, path string, title string, aliases array<string>, keywords array<string>")
    pairs = retrieval.scores(*tables)
    assert "keys=[task_id" not in pairs._jdf.queryExecution().executedPlan().toString()  # pairs are not shuffled to be added up
    assert {(r.task_id, r.doc_key): r.score for r in pairs.collect()} == want and pairs.count() == len(want)
    monkeypatch.setattr(retrieval, "TASKS_AT_ONCE", 9)  # several blocks
    monkeypatch.setattr(postings, "AT_ONCE", 50)
    assert {(r.task_id, r.doc_key): r.score for r in retrieval.scores(*tables).collect()} == want
    kept = {d: (title or "", path, d) for d, path, title, _, _ in docs}
    first = {(t, d) for t, _ in tasks for d in sorted((d for x, d in want if x == t and want[t, d] >= 7), key=lambda d: (-want[t, d], kept[d]))[:3]}
    assert {(r.task_id, r.doc_key): r.score for r in retrieval.best(*tables, 7, 3).collect()} == {k: want[k] for k in first}


DOCS = "doc_key string, position int, path string, type string, project_key string, title string, aliases array<string>, keywords array<string>"


def knowledge(spark):
    docs = spark.createDataFrame([("e", 1, "00.md", "evidence", None, "Rules", None, None), ("i", 2, "01.md", "identity", None, "Me", None, None), ("c", 3, "02.md", "collaboration", None, "Us", None, None), ("d1", 4, "a.md", "project", "p", "Ledger merge", ["big ledger"], ["ledger", "merge"]), ("d2", 5, "b.md", "project", "q", "Other", None, ["ledger"]), ("d3", 6, "c.md", "project", "r", "Far", None, None)], DOCS)
    edges = spark.createDataFrame([(1, "a.md", "01.md", "of", "directed", "confirmed"), (2, "c.md", "a.md", "uses", "directed", "confirmed"), (3, "a.md", "b.md", "near", "symmetric", "candidate")], search.EDGES)
    return docs, edges


def test_search(spark):
    docs, edges = knowledge(spark)
    tasks = spark.createDataFrame([("t1", "ledger"), ("t2", "who am i"), ("t3", "zebra"), ("t4", "please fix the code")], "task_id string, task string")
    found = search.search(tasks, docs, edges)
    got = {}
    for r in found.orderBy("task_id", "place").collect():
        got.setdefault(r.task_id, []).append((r.path, r.score, r.relation, r.traversal))
    assert got == {"t1": [("00.md", None, None, None), ("a.md", 55, None, None), ("b.md", 4, None, None), ("c.md", None, "reverse of uses", "reverse")], "t2": [("00.md", None, None, None), ("01.md", None, None, None), ("a.md", None, "reverse of of", "reverse")]}
    assert [r.path for r in search.search(tasks, docs, edges, "none", max_related=0, max_projects=1).orderBy("place").collect()] == ["00.md", "a.md"] and search.skipped(spark).columns == found.columns
    receipts = {r.task_id: r for r in search.receipts(found, tasks, "run", {"min_score": 4}).collect()}
    assert receipts["t1"].selected == ["00.md", "a.md", "b.md", "c.md"] and (receipts["t1"].project_matches, receipts["t1"].related, receipts["t3"].match_status, receipts["t1"].verified_profile_used) == (2, 1, "no_match", True)
    assert not search.receipts(found, tasks, "run", {"min_score": 5}).first().verified_profile_used
    for wrong in ({"min_score": -1}, {"max_projects": 0}, {"max_related": True}, {"other": 1}):
        with pytest.raises(ValueError):
            search.profile(**wrong)


def test_search_lists_no_pairs(spark, monkeypatch):
    docs, edges = knowledge(spark)
    monkeypatch.setattr(retrieval, "scores", None)  # a search ranks without it
    found = search.search(spark.createDataFrame([("t1", "ledger"), ("t2", "Ledger"), ("t3", "zebra")], "task_id string, task string"), docs, edges, max_projects=1, max_related=0)
    assert sorted((r.task_id, r.place, r.path, r.score) for r in found.collect()) == [(t, n, p, s) for t in ("t1", "t2") for n, p, s in ((1, "00.md", None), (2, "a.md", 55))]


def test_units(spark):
    docs, _ = knowledge(spark)
    rows = [("d1", 1, "u1", "s", "the ledger grows", "observed", ["e1"], [], []), ("d1", 2, "u2", "s", "a zebra and another zebra", "confirmed", ["e1"], ["u9"], ["u1"]), ("d1", 3, "u3", "s", "z" * 400, "observed", ["e2"], [], []), ("d2", 1, "u4", "s", " ", "odd", [], [""], None), ("d2", 2, "u4", "s", "x", "stale", ["e"], None, None)]
    units = spark.createDataFrame(rows, "doc_key string, position int, unit_id string, section string, text string, status string, evidence_event_ids array<string>, conflicts array<string>, supersedes array<string>")
    states = spark.createDataFrame([("d1", "goal", "u1"), ("d2", "goal", "u4"), ("d2", "mood", "u7")], "doc_key string, field string, unit_id string")
    chosen = spark.createDataFrame([("t", "d1", ["zebra", "ledger"]), ("t", "d3", ["zebra"])], "task_id string, doc_key string, terms array<string>")
    view = lambda **o: {r.doc_key: r for r in cu.unit_views(chosen, docs, units, states, cu.selection_options(**o)).collect()}
    facts = view(view="facts", max_chars=420)
    assert facts["d1"].unit_ids == ["u2", "u1"] and facts["d1"].omitted_count == 1 and facts["d1"].unexpanded_ids == ["u9"] and facts["d3"].context_status == "unavailable"  # ledger is an anchor, zebra isn't
    current = view(view="current")
    assert current["d1"].unit_ids == ["u1"] and "goal" not in current["d1"].missing_state_fields and len(current["d3"].missing_state_fields) == 6
    assert view(view="facts", max_chars=256, max_facts=1)["d1"].unit_ids == ["u2"]
    errors = sorted((r.unit_id, r.message) for r in cu.unit_errors(units, states).collect())
    assert errors == sorted([("u4", "unit has no text"), ("u4", "status is not allowed"), ("u4", "unit has no evidence"), ("u4", "a reference is blank"), ("u4", "unit id is not unique"), ("u7", "no such state field"), ("u7", "state names no unit")] + [("u4", "state names an inactive unit")] * sum(r.message == "state names an inactive unit" for r in cu.unit_errors(units, states).collect()))
    for wrong in ({"max_facts": 0}, {"max_chars": 255}, {"max_facts": True}, {"view": "x"}, {"size": 1}):
        with pytest.raises(ValueError):
            cu.selection_options(**wrong)


def test_suite(spark):
    docs, edges = knowledge(spark)
    schema = "case_id string, kind string, task string, expected_project_keys array<string>, expected_document_types array<string>, min_project_matches int, min_context_units int"
    rows = [("1", "Related", "ledger", [" p ", "p"], None, None, None), ("2", "related", "ledger now", ["r"], [], 1, None), ("3", "related", "ledger merge", ["zz"], [], None, None), ("4", "hard-negative", "zebra", [], [], None, None), ("5", "hard_negative", "big ledger", [], [], None, None), ("6", "related", "who am i", [], ["identity"], None, None)]
    ready = search.suite_cases(spark.createDataFrame(rows, schema))
    found = search.search(ready.select(F.col("case_id").alias("task_id"), "task"), docs, edges)
    verdicts = search.suite_verdicts(ready, found)
    assert {r.case_id: r.passed for r in verdicts.collect()} == {"1": True, "2": True, "3": False, "4": True, "5": False, "6": True}
    assert search.suite_errors(ready).count() == 0 and search.suite_report(verdicts).first().status == "needs_retrieval_verification"
    assert search.suite_report(verdicts.filter("passed").unionByName(verdicts.filter("case_id = '4'"))).first().status == "complete"
    bad = search.suite_cases(spark.createDataFrame([("1", "other", "x y", [], [], None, None), ("2", "related", " X  y", [], [], 21, None), ("3", "hard_negative", "", ["p"], [], None, None)], schema))
    assert sorted(r.message for r in search.suite_errors(bad).collect()) == ["a negative expects something", "bound out of range", "empty task", "task is not distinct", "unknown kind"]
    views = spark.createDataFrame([("1", "d1", ["u1"])], "task_id string, doc_key string, unit_ids array<string>")
    strict = ready.withColumn("min_context_units", F.lit(1))
    assert {r.case_id: r.passed for r in search.suite_verdicts(strict, found, views, docs).collect() if r.case_id in "12"} == {"1": True, "2": False}


def test_release_scan(spark):
    from loomspark.operators import release

    rows = spark.createDataFrame([(1, "fine\r\npassword = hunter22\nx Secret Project y\n-----BEGIN RSA PRIVATE KEY-----"), (2, None), (3, "")], "i int, t string")
    out = sorted(map(tuple, release.scan(rows, "i", F.col("t"), denied=["secret project"]).collect()))
    assert (1, 3, "DENIED_1") in out and (1, 4, "PRIVATE_KEY") in out and {(i, n) for i, n, _ in out} == {(1, 2), (1, 3), (1, 4)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_suite_cleans_tasks_once(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "scores", None)  # and lists no pairs
    plan = evidence_queries.QUERIES["r_z02_suite"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ArrowEvalPython" not in plan
