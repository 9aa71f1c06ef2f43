"""Cutting oversized texts at natural boundaries, sizes counted in tokens.

A text becomes a boundary string: one character per token, naming the strongest boundary in front of that token.  A
bounded-quantifier regular expression then consumes it piece by piece.  Its alternatives are ordered by strength:
whatever is left, else the last heading within the limit, else the last turn, paragraph, line, sentence, word, and
at last any token; the quantifier's upper bound is the limit.  Lookback offsets (each later piece
starts 128 tokens before the cut) and token offsets are array functions in SQL.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.tokenizer import VOCABULARY, encoding, read_ranks, unique_by
from loomspark.session import spread

LIMIT, OVERLAP = 2048, 128

#: Boundaries by strength: the code for a token that follows one.  ``x`` marks a token inside a character, where no cut is allowed.
HEADING, TURN, PARAGRAPH, LINE, SENTENCE, WORD, NONE, INSIDE = "h", "t", "p", "l", "s", "w", "c", "x"
STRENGTHS = HEADING + TURN + PARAGRAPH + LINE + SENTENCE + WORD
_NEWLINE = rb"(?:\r\n|\r|\n)"
_FINDERS = [  # weakest first: a stronger boundary overwrites
    (WORD, re.compile(rb"[ \t]+(?=\S)")),
    (SENTENCE, re.compile(rb"(?:[.!?]+[\"')\]]*(?=[ \t])|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)")),
    (LINE, re.compile(_NEWLINE)),
    (PARAGRAPH, re.compile(_NEWLINE + rb"[ \t]*" + _NEWLINE + rb"+")),
    (TURN, re.compile(_NEWLINE + rb"+(?=[ \t]*(?:\*\*)?(?:user|assistant|human|ai|system|tool|observer|model)(?:\*\*)?[ \t]*[>:])", re.I)),
    (HEADING, re.compile(_NEWLINE + rb"+(?=#{1,6}[ \t])")),
]


def boundary_string(text: bytes, starts: np.ndarray) -> str:
    """The codes of the tokens that begin at the byte offsets ``starts``."""
    codes = np.full(len(text) + 1, ord(NONE), dtype=np.uint8)
    raw = np.frombuffer(text, dtype=np.uint8)
    for code, finder in _FINDERS:
        # words and sentences break before the white space that the next token carries, the others after the line feed
        before = code in (WORD,)
        at = [m.start() if before else m.end() for m in finder.finditer(text)]
        codes[at] = ord(code)
    codes[:-1][(raw & 0xC0) == 0x80] = ord(INSIDE)
    return codes[starts].tobytes().decode("ascii")


def _prepare(vocabulary: str, limit: int, with_offsets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        lengths = np.zeros(max(read_ranks(vocabulary).values()) + 1, dtype=np.int64)
        for piece, rank in read_ranks(vocabulary).items():
            lengths[rank] = len(piece)
        for batch in batches:
            keys, counts, shapes, offsets = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.asarray(enc.encode_ordinary(text), dtype=np.int64)
                if len(ids) <= limit:
                    continue
                data = text.encode("utf-8")
                starts = np.zeros(len(ids), dtype=np.int64)
                np.cumsum(lengths[ids][:-1], out=starts[1:])
                keys.append(key)
                counts.append(len(ids))
                shapes.append(boundary_string(data, starts))
                if with_offsets:
                    is_start = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
                    chars = np.cumsum(is_start) - 1  # the character each byte belongs to
                    offsets.append(np.append(chars[starts], len(text)).astype(np.int32))
                else:
                    offsets.append(None)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(counts, pa.int32()), pa.array(shapes, pa.string()), pa.array(offsets, pa.list_(pa.int32()))], names=["id", "n_tokens", "shape", "offsets"])

    return run


def cut_pattern(limit: int) -> str:
    """The alternation for pieces of at most ``limit`` tokens; boundaries in the first half of a piece count if the second has none."""
    low = max(1, limit // 2)
    cuts = [rf".{{{least},{most}}}(?={code})" for least, most in ((low, limit), (1, low)) for code in STRENGTHS]
    return "|".join([rf".{{1,{limit}}}\z", *cuts, rf".{{1,{limit}}}(?!{INSIDE})", rf".{{1,{limit}}}"])


def piece_table(shape: Column, limit: int, overlap: int) -> Column:
    """array<struct<start, cut, end>> in tokens: a piece is [start, end); from ``cut`` on it is new."""
    first = F.regexp_extract(shape, f"^(?:{cut_pattern(limit)})", 0)
    rest = F.regexp_extract_all(F.substring(shape, F.length(first) + 1, F.length(shape)), F.lit(f"({cut_pattern(limit - overlap)})"), F.lit(1))
    lengths = F.transform(F.concat(F.array(first), rest), lambda s: F.length(s))
    add = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["ends"], F.array(acc["at"] + n)).alias("ends"))
    ends = F.aggregate(lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends")), add, lambda acc: acc["ends"])
    cuts = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
    return F.zip_with(cuts, ends, lambda cut, end: F.struct(F.greatest(cut - overlap, F.lit(0)).alias("start"), cut.alias("cut"), end.alias("end")))


def split_oversized(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = VOCABULARY, with_text: bool = True) -> DataFrame:
    """key, n_tokens, pieces of every document of more than ``limit`` tokens; pieces has start, cut, end (tokens) and, ``with_text``, text.

    Texts of at most ``limit`` bytes can't have more tokens and are never encoded; all others are encoded whole.  Null and
    empty texts are never oversized.  Rows repeated under one key count once.  Cuts never fall inside a character
    unless a single character had more tokens than the limit; where an overlap begins inside one, its text
    begins with that whole character.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    rows = docs.select(F.col(key).cast("bigint").alias(key), text).filter(F.col(key).isNotNull() & (F.octet_length(text) > limit))
    rows = unique_by(spread(rows), key, text)
    shaped = rows.mapInArrow(_prepare(vocabulary, limit, with_text), "id bigint, n_tokens int, shape string, offsets array<int>").withColumnRenamed("id", key)
    cut = shaped.select(key, "n_tokens", "offsets", piece_table(F.col("shape"), limit, overlap).alias("pieces"))
    if not with_text:
        return cut.drop("offsets")
    at = lambda i: F.get("offsets", i)
    whole = cut.join(rows, key)
    cut_text = F.transform("pieces", lambda p: F.struct(p["start"].alias("start"), p["cut"].alias("cut"), p["end"].alias("end"), F.col(text).substr(at(p["start"]) + 1, at(p["end"]) - at(p["start"])).alias("text")))
    return whole.select(key, "n_tokens", cut_text.alias("pieces"))


def pieces(split: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per piece: key, piece, start, cut, end, text."""
    return split.select(key, F.posexplode("pieces").alias("piece", "p")).select(key, "piece", "p.*")
