import random

from loomspark.operators.hierarchy import descendants, resolve, session_links


def brute(parent):
    out = {}
    for node in parent:
        path, seen = [node], {node}
        while parent.get(path[-1]):
            above = parent[path[-1]]
            if above in seen:
                out[node] = (min(path[path.index(above) :]), -1, None)
                break
            seen.add(above)
            path.append(above)
        else:
            out[node] = (path[-1], len(path) - 1, path[::-1])
    return out


def check(spark, parent):
    links = spark.createDataFrame(list(parent.items()), "node string, parent string")
    rows = resolve(links, with_paths=True).collect()
    expected = brute(parent)
    assert len(rows) == len(expected)
    for r in rows:
        root, depth, path = expected[r.node]
        assert (r.root, r.depth) == (root, depth)
        assert depth < 0 or r.path == path
    below = {}
    for node in parent:
        above, seen = parent[node], {node}
        while above and above not in seen:
            seen.add(above)
            below[above] = below.get(above, 0) + 1
            above = parent.get(above)
    assert {r.node: r.n_descendants for r in rows} == {n: below.get(n, 0) for n in parent}
    return rows


def test_random_forests_with_cycles(spark):
    rng = random.Random(5)
    parent = {}
    for i in range(300):
        parent[f"n{i:03}"] = f"n{rng.randrange(i):03}" if i and rng.random() < 0.9 else None
    for i in range(1, 60):  # a chain
        parent[f"c{i:03}"] = f"c{i - 1:03}"
    parent["c000"] = None
    for size, tag in ((1, "x"), (2, "y"), (7, "z")):  # cycles with trees below
        for i in range(size):
            parent[f"{tag}{i}"] = f"{tag}{(i + 1) % size}"
        parent[f"{tag}-t"] = f"{tag}0"
        parent[f"{tag}-u"] = f"{tag}-t"
    check(spark, parent)


def test_star_holds_a_hot_parent(spark):
    check(spark, {"hub": None, **{f"k{i}": "hub" for i in range(500)}, **{f"m{i}": f"k{i}" for i in range(100)}})


def test_long_chain(spark):
    links = spark.range(3000).selectExpr("format_string('c%05d', id) AS node", "CASE WHEN id > 0 THEN format_string('c%05d', id - 1) END AS parent")
    rows = resolve(links, with_paths=True).select("depth", "n_descendants", "root").collect()
    assert sorted(r.depth for r in rows) == list(range(3000)) and all(r.n_descendants == 2999 - r.depth and r.root == "c00000" for r in rows)


def test_descendants(spark):
    rows = resolve(spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "d"), ("x", "y"), ("y", "z"), ("z", "x"), ("t", "y"), ("u", "t")], "node string, parent string"), with_paths=True)
    cyclic = [(a, b, -1) for a in "xyz" for b in "xyztu" if a != b] + [("t", "u", -1)]
    assert sorted(map(tuple, descendants(rows).collect())) == sorted([("a", "b", 1), ("a", "c", 2), ("b", "c", 1), *cyclic])
    assert {r.node: "/".join(r.path) for r in rows.collect()} == {"a": "a", "b": "a/b", "c": "a/b/c", "d": "d", "x": "x", "y": "y", "z": "z", "t": "y/t", "u": "y/t/u"}


def test_descendants_in_and_below_cycles_are_counted(spark):
    rng = random.Random(6)
    parent = {"a": None, "b": "a", "c": "b", "d": "a"}
    for size, tag in ((1, "w"), (2, "x"), (3, "y"), (8, "z")):
        parent |= {f"{tag}{i}": f"{tag}{(i + 1) % size}" for i in range(size)}
        for i in range(40):  # trees and chains below it
            parent[f"{tag}-t{i}"] = f"{tag}-t{rng.randrange(i)}" if i > 4 else f"{tag}{rng.randrange(size)}"
    expected = dict.fromkeys(parent, 0)
    for node in parent:
        above, seen = parent[node], {node}
        while above and above not in seen:
            seen.add(above)
            expected[above] += 1
            above = parent[above]
    rows = resolve(spark.createDataFrame(list(parent.items()), "node string, parent string"), with_paths=True).collect()
    assert {r.node: r.n_descendants for r in rows} == expected and len(rows) == len(expected)
    assert {r.node for r in rows if r.in_cycle} == {f"{tag}{i}" for size, tag in ((1, "w"), (2, "x"), (3, "y"), (8, "z")) for i in range(size)}


def test_unlisted_parents_end_the_way(spark):
    rows = resolve(spark.createDataFrame([("a", "gone"), ("b", "a")], "node string, parent string")).collect()
    assert sorted((r.node, r.root, r.depth) for r in rows) == [("a", "gone", 1), ("b", "gone", 2)]


def test_session_links(spark):
    schema = "session_id string, parent_session_id string, node string, parent int"
    rows = [("A", " none", "clash", 1), ("a ", "P\n", "clash", 2), ("a", None, "clash", 3), ("b", "a", None, 4), ("c", "", None, 5), ("d", "NULL", None, 6), (None, "q", None, 7), ("a", "p", None, 8), ("b", "Z", None, 9)]
    out = sorted(map(tuple, session_links(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert out == [("a", "p"), ("b", "a"), ("c", None), ("d", None), ("p", None), ("q", None), ("z", None)]
    assert resolve(session_links(spark.createDataFrame([], schema))).count() == 0
