import random

import numpy as np
from pyspark.sql import functions as F

from loomspark.llm import leakage
from loomspark.llm.leakage import find_leaks, lcs_length, words_of


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(30))] for _ in range(2))
        assert lcs_length(a, b) == lcs(a, b)
    pairs = [([rng.randrange(6) for _ in range(rng.randrange(1, 25))], [rng.randrange(-1, 6) for _ in range(rng.randrange(49))]) for _ in range(300)]
    pad = lambda rows, n, by: np.array([r + [by] * (n - len(r)) for r in rows], dtype=np.int32)
    many = leakage.lcs_lengths(pad([a for a, _ in pairs], 24, 99), np.array([len(a) for a, _ in pairs]), pad([b for _, b in pairs], 48, -1))
    assert many.tolist() == [lcs(a, b) for a, b in pairs]


def brute(docs, items):
    runs = {}
    for i, t in items:
        w = words_of(t)
        for k in range(len(w) - 11):
            runs.setdefault(tuple(w[k : k + 12]), set()).add(i)
    return {(d, i) for d, t in docs for w in [words_of(t)] for k in range(len(w) - 11) for i in runs.get(tuple(w[k : k + 12]), ())}


def corpus(seed=7):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(8, 90)))) for i in range(40)]
    docs = []
    for d in range(300):
        words = rng.choices(vocabulary + [f"z{i}" for i in range(30)], k=rng.randrange(0, 200))
        if d % 3 == 0:
            source = words_of(rng.choice(items)[1])
            n = rng.choice([11, 12, 13, 30])
            at = rng.randrange(max(1, len(source) - n + 1))
            place = rng.randrange(len(words) + 1)
            words[place:place] = source[at : at + n]
        docs.append((d, "".join(w + rng.choice([" ", ", ", "\n", " **"]) for w in words).title()))
    return docs, items


DOCS, ITEMS = "doc_id bigint, text string, item_id int, share string", "item_id bigint, kind string, text string"


def frames(spark, docs, items):
    return spark.createDataFrame([(d, t, 0, "clash") for d, t in docs], DOCS), spark.createDataFrame([(i, "k", t) for i, t in items], ITEMS)


def test_all_leaks_are_found(spark):
    docs, items = corpus()
    extra = [(900, None), (901, ""), (902, items[3][1] * 2000 if len(words_of(items[3][1])) > 12 else items[4][1] * 2000), (0, docs[0][1])]
    out = find_leaks(*frames(spark, docs + extra, items + [(77, None), (78, ""), (79, items[5][1])])).collect()
    assert {(r.doc_id, r.item_id) for r in out} == brute(docs + extra, items + [(79, items[5][1])]) and len(out) == len({(r.doc_id, r.item_id) for r in out})


def test_paraphrases_include_what_is_nearly_copied(spark):
    docs, items = corpus()
    item = next(t for _, t in items if len(words_of(t)) > 40)
    words = words_of(item)
    changed = " ".join(w if k % 8 else "zzz9" for k, w in enumerate(words))
    out = find_leaks(*frames(spark, [(1, changed), (2, "nothing of it at all here")], items), exact=False)
    assert {r.doc_id for r in out.collect()} == {1} and out.filter(F.col("share") < 0.6).count() == 0


def test_paraphrases_need_no_run_of_known_words(spark):
    _, items = corpus()
    item, words = next((i, words_of(t)) for i, t in items if len(words_of(t)) > 40)
    changed = " ".join(w if k % 8 else "zzz9" for k, w in enumerate(words))
    short = next(t for _, t in items if len(words_of(t)) < 12)
    out = find_leaks(*frames(spark, [(1, changed), (2, short + " zzz9"), (3, "zzz9 " * 40)], items), exact=False).collect()
    assert (1, item) in {(r.doc_id, r.item_id) for r in out} and {r.doc_id for r in out} == {1, 2}


def test_paraphrases_do_not_depend_on_their_place(spark):
    _, items = corpus()
    item, words = next((i, words_of(t)) for i, t in items if 36 <= len(words_of(t)))
    changed = [w if k % 4 else "zzz9" for k, w in enumerate(words[:24])]  # three quarters of a passage
    longer = changed[:8] + ["zzz8"] * 5 + changed[8:16] + ["zzz7"] * 5 + changed[16:]
    docs = [(100 * n + at, " ".join(["zzz6"] * at + text + ["zzz5"] * 40)) for n, text in enumerate((changed, longer)) for at in range(25)]
    out = find_leaks(*frames(spark, docs, items), exact=False).filter(F.col("item_id") == item).collect()
    assert {r.doc_id for r in out} == {d for d, _ in docs} and {r.share for r in out} == {0.75}


def test_empty_sides(spark):
    docs, items = corpus()
    assert find_leaks(*frames(spark, [], items)).count() == 0 and find_leaks(*frames(spark, docs[:5], [])).count() == 0


def test_items_in_blocks(spark):
    docs, items = corpus()
    out = find_leaks(*frames(spark, docs, items), block_chars=3000).collect()
    assert {(r.doc_id, r.item_id) for r in out} == brute(docs, items) and len(out) == len({(r.doc_id, r.item_id) for r in out})


def test_retrieval_decides(spark):
    """What the cosine doesn't reach isn't found: the rows come through the latent vectors."""
    docs, items = corpus()
    assert find_leaks(*frames(spark, docs, items), least_cosine=1.01).count() == 0


def test_shared_runs():
    runs = lambda *words: leakage.runs_of(np.array(words, dtype=np.int32))
    a = list(range(20))
    assert runs(*a) & runs(*[99] * 5, *a[3:15]) and not runs(*a) & runs(*a[3:14], 99, *a[14:]) and runs() == set() == runs(*[-1] * 12) == runs(*a[:5], -1, *a[5:11])
