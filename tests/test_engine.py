import json

import pytest

from loomspark import engine
from loomspark.operators import lifecycle


def jsonl(*records):
    return "".join(json.dumps(r) + "\n" for r in records)


def said(kind, text):
    return {"type": "event_msg", "timestamp": "2025-01-01T00:00:01Z", "payload": {"type": kind, "message": text}}


@pytest.fixture
def sources(tmp_path):
    root = tmp_path / "src"
    (root / "a").mkdir(parents=True)
    meta = {"type": "session_meta", "payload": {"id": "s1", "cwd": "/srv/ledger"}}
    (root / "a" / "rollout-1.jsonl").write_text(jsonl(meta, said("user_message", "mail ana@site.example about the ledger"), said("agent_message", "done with the ledger"), said("user_message", "<environment_context> x"), {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "mail ana@site.example about the ledger"}]}}))
    (root / "a" / "session.json").write_text(json.dumps({"session_id": "c1", "working_dir": "/srv/zebra", "messages": [{"role": "user", "content": "feed the zebra"}, {"role": "assistant", "content": "fed"}]}))
    return root


BASE = "doc_key string, position int, path string, type string, project_key string, title string, aliases array<string>, keywords array<string>"


def reviewed(spark, event_id):
    none = "array<string>"
    return {
        "claims": spark.createDataFrame([("c1", None, "the ledger is done", "confirmed", [event_id], [], [])], f"claim_id string, project_key string, statement string, status string, evidence_event_ids {none}, conflicts {none}, supersedes {none}"),
        "feedback": spark.createDataFrame([], f"feedback_id string, project_key string, statement string, evidence_event_ids {none}"),
        "rules": spark.createDataFrame([], f"evolution_id string, rule string, feedback_ids {none}, promoted_claim_id string"),
        "base_documents": spark.createDataFrame([("rules", 1, "00.md", "evidence", None, "Rules", None, None)], BASE),
    }


def test_from_files_to_answers(spark, sources, tmp_path):
    kb = engine.KnowledgeBase(spark, str(tmp_path / "kb"))
    dry = kb.rebuild(str(sources), dry_run=True)
    assert kb.evidence.current() is None and dry.report["counters"]["events"] == 4
    run = kb.rebuild(str(sources))
    events = kb.evidence.read("events").collect()
    texts = sorted(e.content for e in events)
    assert texts == ["done with the ledger", "fed", "feed the zebra", "mail [REDACTED:EMAIL] about the ledger"]
    assert run.report["gates"]["accounting_complete"] and {r.reason for r in kb.evidence.read("excluded").collect()} == {"runtime_injection", "session_metadata"}
    assert [r.disposition for r in kb.evidence.read("dispositions").collect()].count("mirror") == 1
    assert all(e.event_id.startswith("evt-") and e.logical_session_id.startswith("session-") and e.project_key for e in events) and {e.project_label for e in events} == {"ledger", "zebra"}
    # nothing changed: everything is kept
    again = kb.rebuild(str(sources))
    assert again.report["preserves_publication"] and {e.event_id for e in kb.evidence.read("events").collect()} == {e.event_id for e in events}
    with open(sources / "a" / "rollout-1.jsonl", "a") as file:
        file.write(jsonl(said("agent_message", "and one more")))
    grown = kb.rebuild(str(sources))
    assert {r.action for r in kb.evidence.read("actions").collect()} == {"tail", "skip"} and [r.change for r in grown.tables["impact"].collect()] == ["added"]

    tables = reviewed(spark, events[0].event_id)
    with pytest.raises(ValueError, match="review"):
        kb.distill(reviewed(spark, "nope"), "run-1")
    kb.distill(tables, "run-1")
    tasks = spark.createDataFrame([("t1", "ledger"), ("t2", "quartz")], "task_id string, task string")
    with pytest.raises(ValueError, match="related_retrieval"):
        kb.query(tasks)
    project = {e.project_label: e.project_key for e in events}
    case = "case_id string, kind string, task string, expected_project_keys array<string>, expected_document_types array<string>, min_project_matches int, min_context_units int"
    cases = [("1", "related", "ledger", [project["ledger"]], [], None, None), ("2", "related", "zebra", [project["zebra"]], [], None, None), ("3", "hard_negative", "quartz", [], [], None, None), ("4", "hard_negative", "basalt", [], [], None, None)]
    assert kb.verify(spark.createDataFrame(cases, case))["status"] == "complete"
    answer = kb.query(tasks, view={"view": "facts"})
    assert [(r.task_id, r.type) for r in answer["documents"].orderBy("place").collect()] == [("t1", "evidence"), ("t1", "project")] and {r.match_status for r in answer["receipts"].collect()} == {"matched", "no_match"}
    assert {r.context_status for r in answer["units"].collect()} == {"unavailable"} and all(r.verified_profile_used for r in answer["receipts"].collect())
    assert kb.query(tasks, context_sufficient=True)["documents"].count() == 0

    gone = next(e for e in events if e.content == "fed")
    asked = lifecycle.selectors(event_ids=[gone.event_id])
    assert kb.execute("forget", asked, tables)["touched"].count() > 0 and kb.evidence.read("events").count() == 5
    kb.execute("forget", asked, tables, literals=("zebra",), apply=True)
    left = {e.content for e in kb.evidence.read("events").collect()}
    assert "fed" not in left and "feed the [FORGOTTEN]" in left
    with pytest.raises(ValueError, match="gate is closed"):
        kb.query(tasks)
    kb.rebuild(str(sources), policy="8")  # parsed anew, and still forgotten
    assert "fed" not in {e.content for e in kb.evidence.read("events").collect()} and engine.KnowledgeBase(spark, str(tmp_path / "kb" / "knowledge")).root == kb.root


def test_golden_samples(spark, sources):
    cases = spark.createDataFrame([("a", "codex-jsonl", 4, ["message"], ["never"]), ("a2", "codex-jsonl", 1, [], [])], "case_id string, adapter string, minimum_events int, required_event_types array<string>, forbidden_text array<string>")
    got = {(r.case_id, r.check): r.ok for r in engine.golden(spark, str(sources), cases).collect()}
    assert all(ok for (case, _), ok in got.items() if case == "a") and not got[("a2", "enough events")] and len(got) == 12
