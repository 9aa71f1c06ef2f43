import pytest

from loomspark.llm import splitting, tokenizer

pytest.importorskip("tiktoken")
TEXTS = [
    (1, "Hello world, it's 2025!  two  blanks\n\n\nnext\tline \r\n"), (2, ""), (3, None), (4, "日本語 🙂 <|endoftext|> é\u200b\ufeff\u00a0x"), (5, "a" * 30_000), (6, " " * 5_000 + "x"), (7, "word " * 20_000),
    (8, "Hello world"), (8, "Hello world"), (9, "zz"), (9, "aa"), (None, "x"), (10, "'s 't're 1234567 ñandú — …"), (11, "\u0301 lone \u2028 sep"),
]
SCHEMA = "doc_id bigint, text string, ids string, words int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA)


def test_ids_equal_the_library(spark):
    enc = tokenizer.encoding(tokenizer.VOCABULARY)
    want = {}
    for k, t in TEXTS:
        if k is not None:
            want[k] = min(want[k], t) if k in want else t
    for block in (10, 4_000_000):
        out = {r.doc_id: r.ids for r in tokenizer.encode(frame(spark, TEXTS).repartition(3), block_chars=block).collect()}
        assert out == {k: enc.encode_ordinary(t) if t else [] for k, t in want.items()}


def test_round_trip(spark):
    rows = [r for r in TEXTS if r[0] not in (None, 9)]
    out = {r.doc_id: r.text for r in tokenizer.decode(tokenizer.encode(frame(spark, rows))).collect()}
    assert out == {k: t or "" for k, t in rows}


def test_empty_table(spark):
    assert tokenizer.encode(frame(spark, [])).count() == 0 and splitting.split_oversized(frame(spark, [])).count() == 0


def test_pieces(spark):
    enc = tokenizer.encoding(tokenizer.VOCABULARY)
    doc = "# one\n\n" + "A sentence of words here. " * 30 + "\n\n## two\n" + "user: more text follows, and on it goes.\n" * 40 + "日本語🙂" * 60
    rows = [(1, doc), (2, "short"), (3, None), (4, "x" * 700), (5, " ".join(["tail"] * 64)), (6, "🙂" * 200)]
    out = {}
    for r in splitting.pieces(splitting.split_oversized(frame(spark, rows), limit=64, overlap=8)).collect():
        out.setdefault(r.doc_id, []).append(r)
    over = {k for k, t in rows if t and len(enc.encode_ordinary(t)) > 64}
    assert set(out) == over and 1 in over and 2 not in over
    for key, parts in out.items():
        text = dict(rows)[key]
        ids = enc.encode_ordinary(text)
        parts.sort(key=lambda r: r.piece)
        assert parts[0].start == parts[0].cut == 0 and parts[-1].end == len(ids)
        for a, b in zip(parts, parts[1:], strict=False):
            assert b.cut == a.end and b.start == max(0, b.cut - 8)
        for p in parts:
            assert p.end - p.start <= 64 and p.text in text and enc.decode(ids[p.start : p.end], errors="ignore").strip("�") in p.text
        at = 0
        for p in parts:  # the new parts put together are the text
            new = enc.decode(ids[: p.end], errors="ignore")
            at = len(new)
        assert at == len(text)
    first = out[1][0]
    assert enc.decode(enc.encode_ordinary(doc)[: first.end]).endswith((". ", ".", "\n", " here", "here."))


def test_boundaries_win_by_strength():
    import re

    cut = re.compile(splitting.cut_pattern(10).replace(r"\z", r"\Z"))
    assert cut.match("c" * 6 + "h" + "cpcc" + "c" * 9).group() == "c" * 6  # a heading before a later paragraph
    assert cut.match("w" * 30).group() == "w" * 10 and cut.match("c" * 7).group() == "c" * 7


def test_limits_are_checked(spark):
    with pytest.raises(ValueError):
        splitting.split_oversized(frame(spark, []), limit=5, overlap=5)


def test_a_boundary_in_the_first_half_is_better_than_none():
    import re

    cut = re.compile(splitting.cut_pattern(20).replace(r"\z", r"\Z"))
    weak, strong, plain = splitting.STRENGTHS[-1], splitting.STRENGTHS[0], splitting.NONE
    assert len(cut.match(plain * 4 + strong + plain * 2 + weak + plain * 60).group()) == 4
    assert len(cut.match(plain * 4 + strong + plain * 8 + weak + plain * 60).group()) == 13
    assert len(cut.match(plain * 80).group()) == 20
