import itertools
import json
import random
import uuid

from loomspark.operators.schema_drift import Drift, best_matching, few_values, name_similarity, pair_score, sketch_similarity

CONTRACT = [("A-x", "msg", f, t) for f, t in (("session_id", "string"), ("timestamp", "string"), ("role", "string"), ("title", "string"), ("tokens", "integer"), ("cost", "number"), ("args", "object"), ("flag", "boolean"))]
RECORDS = "source_file_id string, line_no bigint, adapter string, event_type string, record string, types string"


def record(rng, **rename):
    base = {
        "session_id": str(uuid.UUID(int=rng.getrandbits(128))), "timestamp": f"2025-{rng.randrange(1, 13):02}-11T10:00:00Z", "role": rng.choice(["user", "assistant"]), "title": rng.choice(["the old ledger", "a broken link", "the last page"]),
        "tokens": rng.randrange(50, 4000), "cost": rng.random() * 50, "args": {"path": "x", "limit": 3}, "flag": rng.random() < 0.5,
    }
    out = {}
    for k, v in base.items():
        new = rename.get(k, k)
        if callable(new):
            out[k] = new(v)
        elif new:
            out[new] = v
    return out | {k: v for k, v in rename.items() if k.startswith("new_")}


def changes(spark, files, contract=CONTRACT):
    rows = [(f, n, a, e, r if isinstance(r, str) or r is None else json.dumps(r), "clash") for f, (a, e, records) in files.items() for n, r in enumerate(records)]
    drift = Drift(spark.createDataFrame(rows, RECORDS), spark.createDataFrame(contract, "adapter string, event_type string, field string, json_type string"))
    return drift, sorted(tuple(r) for r in drift.changes().collect())


def test_changes(spark):
    rng = random.Random(3)
    many = lambda n, **kw: [record(rng, **kw) for _ in range(n)]
    files = {
        "same": ("A-x", "msg", many(40)),
        "spelt": (" a_X", "MSG ", many(5)),
        "renamed": ("A-x", "msg", many(2, session_id="sid", timestamp="created", title="heading", args="arguments")),
        "numbers": ("A-x", "msg", many(4, tokens="prompt_tokens", flag="is_flag")),
        "added": ("A-x", "msg", many(3, new_span={"start": 1}, new_retries=2)),
        "removed": ("A-x", "msg", many(3, role=None, cost=None)),
        "retyped": ("A-x", "msg", many(3, tokens=str, title=lambda v: [v])),
        "nulls": ("A-x", "msg", many(3, title=lambda v: None) + ["no json", None, "[]"]),
        "decoy": ("A-x", "msg", many(6, title=None, new_locale="de-DE")),
    }
    drift, got = changes(spark, files)
    assert got == sorted(
        [("renamed", "msg", "renamed", a, b) for a, b in (("session_id", "sid"), ("timestamp", "created"), ("title", "heading"), ("args", "arguments"))]
        + [("numbers", "msg", "renamed", "tokens", "prompt_tokens"), ("numbers", "msg", "renamed", "flag", "is_flag")]
        + [("added", "msg", "added", "", "new_span"), ("added", "msg", "added", "", "new_retries")]
        + [("removed", "msg", "removed", "role", ""), ("removed", "msg", "removed", "cost", "")]
        + [("retyped", "msg", "retyped", f, f) for f in ("tokens", "title")]
        + [("decoy", "msg", "removed", "title", ""), ("decoy", "msg", "added", "", "new_locale")]
    )
    rows = drift.unified(["session_id", "title"]).filter("source_file_id = 'renamed'").collect()
    assert len(rows) == 2 and all(r.f_session_id and r.f_title for r in rows)
    typed = drift.unified(["tokens", "cost", "flag", "it's `odd`"])
    assert [t for _, t in typed.dtypes[4:]] == ["bigint", "double", "boolean", "string", "map<string,string>"]
    retyped = typed.filter("source_file_id = 'retyped'").collect()
    assert all(isinstance(r.f_tokens, int) and r.recast == {} for r in retyped)
    _, got = changes(spark, {"f": ("A-x", "msg", [{"tokens": "twelve", "cost": "1.5"}])})
    drift, _ = changes(spark, {"f": ("A-x", "msg", [{"tokens": "twelve", "cost": "1.5"}])})
    row = drift.unified(["tokens", "cost"]).first()
    assert (row.f_tokens, row.f_cost, row.recast) == (None, 1.5, {"tokens": "twelve"})


def test_odd_tables(spark):
    _, got = changes(spark, {"f": ("other", "msg", [{"a": 1}]), "g": (None, None, [{"b": None}])})
    assert got == [("f", "msg", "added", "", "a"), ("g", "", "added", "", "b")]
    drift, got = changes(spark, {})
    assert got == [] and drift.unified(["title"]).count() == 0
    _, got = changes(spark, {"f": ("A-x", "msg", ["{}"])})
    assert {c for _, _, c, _, _ in got} == {"removed"} and len(got) == len(CONTRACT)


def test_matching_is_optimal():
    rng = random.Random(1)
    for rows, cols in ((1, 1), (2, 4), (4, 2), (4, 4), (5, 3)):
        for _ in range(20):
            score = [[rng.random() for _ in range(cols)] for _ in range(rows)]
            pairs = best_matching(score)
            assert len(pairs) == min(rows, cols) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
            small, large = (rows, cols) if rows <= cols else (cols, rows)
            best = max(sum(score[i][j] if rows <= cols else score[j][i] for i, j in enumerate(p)) for p in itertools.permutations(range(large), small))
            assert abs(sum(score[i][j] for i, j in pairs) - best) < 1e-9
    assert best_matching([]) == []


def test_similarities():
    assert name_similarity("session_id", "sessionId") == 1.0 and name_similarity("title", "session_title") == 0.9 and name_similarity("role", "cwd") == 0
    ref = {k: dict(zip(("class", "mass", "top", "concentration", "values"), (k, *v), strict=True)) for k, v in {"type": (1, 1, 1, 1), "shape": (1, 1, 1, 1), "value": (1, 0.5, 0.5, 2)}.items()}
    own = lambda known: {k: {"class": k, "mass": 1.0, "known": known, "shared": known} for k in ref}
    assert sketch_similarity(ref, own(1.0), 100) == 1.0 > sketch_similarity(ref, own(0.5), 100) > sketch_similarity(ref, own(0.0), 100) == 0.0
    assert few_values(ref, 100) == 1.0 and few_values(ref, 2) == 0.0 and few_values({}, 5) == 0.0


def test_weights_fade():
    """No jump where a field gets one value, or a file one record, more."""
    value = lambda n: {"value": {"class": "value", "mass": 1.0, "top": 1 / n, "concentration": 1 / n, "values": n}}
    steps = [few_values(value(n), 1000) for n in range(1, 60)]
    assert max(a - b for a, b in zip(steps, steps[1:], strict=False)) < 0.08 and steps[0] == 1.0 and steps[-1] < 0.4
    own = {"value": {"class": "value", "mass": 1.0, "known": 0.5, "shared": 0.5}}
    scores = [pair_score("abc", "xyz", "integer", value(3), own, 1000, n) for n in range(1, 30)]
    assert max(abs(a - b) for a, b in zip(scores, scores[1:], strict=False)) < 0.05
