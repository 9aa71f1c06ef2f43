"""Evaluation texts leaking into training text: latent semantic retrieval with exact and paraphrase checks.

1. Items and documents are cut into overlapping passages of ``WIDTH`` words, every ``RUN`` words, so that any ``RUN`` consecutive words lie
   inside one passage on either side.  What follows from the check alone is used to leave passages out: a run of ``RUN`` words needs as many
   words of items in a row; a paraphrase needs no run, only as many words of items, anywhere in its reach, as the common subsequence asked for.
2. Passages become TF-IDF vectors over the words of the items.  A distributed randomised SVD finds a latent basis: random
   directions are multiplied by the passages' Gram matrix in the executors, partial products summed by word, and the small
   result orthogonalised; what reaches the driver is bounded by the vocabulary of a block of items times the rank.
3. Every document passage is projected and compared by cosine with all item passages: the items are a stated set of queries, taken in
   blocks of ``BLOCK_CHARS`` characters.  Pairs above the threshold are the candidates; only they are looked at again.
4. Each candidate pair is verified: enough words in common, then ``RUN`` consecutive ones (a leak) or, for paraphrases, the item passage's numbers
   and rare words (the answer check) and a longest common subsequence that is long enough, looked for in the passage and ``RUN`` words on either
   side, wherever it begins.

Documents are processed whole; nothing is sampled or capped.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.session import Scratch, spread

RUN, WIDTH, RANK = 12, 24, 96
#: Least cosine of a candidate, of leaks and of paraphrases; low, because a check follows (recall against brute force is in the README).
LEAST_COSINE, PARAPHRASE_COSINE = 0.4, 0.25
#: Characters of items searched at once: their vocabulary, vectors and passages are handed to every task.
BLOCK_CHARS = 2_000_000
#: Cells of the matrix of cosines a task holds at once.
CELLS = 1 << 23

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """The longest runs of letters and digits, compared without case."""
    return _WORD.findall(text.lower()) if text else []


def starts(n: int) -> range:
    """Where passages of a sequence of ``n`` words begin."""
    return range(0, max(1, n - RUN + 1), RUN)


class Items:
    """The evaluation side of a block: vocabulary with idf, and the passages of every item."""

    def __init__(self, rows: list[tuple[int, str]]):
        texts = [(i, words_of(t)) for i, t in sorted(rows)]
        self.word: dict[str, int] = {}
        for _, words in texts:
            for w in words:
                self.word.setdefault(w, len(self.word))
        self.passages: list[tuple[int, np.ndarray]] = []
        for item, words in texts:
            ids = np.array([self.word[w] for w in words], dtype=np.int32)
            for s in starts(len(ids)) if len(ids) else []:
                self.passages.append((item, ids[s : s + WIDTH]))
        df = Counter(w for _, p in self.passages for w in set(p.tolist()))
        n = max(1, len(self.passages))
        self.idf = np.array([math.log((1 + n) / (1 + df.get(k, 0))) + 1.0 for k in range(len(self.word))])
        self.owner = np.array([i for i, _ in self.passages], dtype=np.int64)


def tfidf_rows(passages: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the unit TF-IDF vectors of passages of word ids (-1 for words outside the vocabulary)."""
    rows = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
    cols = np.concatenate(passages) if passages else np.zeros(0, np.int64)
    known = cols >= 0
    rows, cols = rows[known], cols[known]
    width = max(1, len(idf))
    cells, counts = np.unique(rows.astype(np.int64) * width + cols, return_counts=True)
    rows, cols = cells // width, cells % width
    values = counts * idf[cols]
    norm = np.sqrt(np.bincount(rows, values * values, minlength=len(passages)))
    return rows, cols, values / np.maximum(norm[rows], 1e-12)


def times(passages: list[np.ndarray], idf: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The TF-IDF matrix of the passages times ``matrix`` (words by k)."""
    rows, cols, values = tfidf_rows(passages, idf)
    out = np.zeros((len(passages), matrix.shape[1]))
    if len(rows):
        firsts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        out[rows[firsts]] = np.add.reduceat(matrix[cols] * values[:, None], firsts, axis=0)
    return out


def transposed_times(passages: list[np.ndarray], idf: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The transposed TF-IDF matrix times ``matrix`` (passages by k)."""
    rows, cols, values = tfidf_rows(passages, idf)
    out = np.zeros((len(idf), matrix.shape[1]))
    if len(cols):
        order = np.argsort(cols, kind="stable")
        rows, cols, values = rows[order], cols[order], values[order]
        firsts = np.flatnonzero(np.concatenate([[True], cols[1:] != cols[:-1]]))
        out[cols[firsts]] = np.add.reduceat(matrix[rows] * values[:, None], firsts, axis=0)
    return out


def least_known(passages: list[np.ndarray], lcs_share: float) -> int:
    """The least number of words a passage must share with some item passage for a common subsequence of ``lcs_share`` of it."""
    return min(next(k for k in range(n + 1) if k / n >= lcs_share) for n in {len(p) for p in passages})


def _cut(items_bc, least: int | None = None):
    """Documents to their passages: id, word ids (-1 outside the items' vocabulary) with the margin on either side, and the length of the left margin.

    Without ``least`` only passages in which ``RUN`` known words in a row begin, without margins; else those that hold so many known words, the
    margins of ``RUN`` words included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = items_bc.value.word.get
        for batch in batches:
            ids, lefts, passages = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = np.array([get(w, -1) for w in words_of(text)], dtype=np.int32)
                if len(codes) < (RUN if least is None else 1):
                    continue
                outside = np.concatenate([[0], np.cumsum(codes < 0)])
                if least is None:  # places where RUN known words in a row begin
                    places, margin = np.unique(np.flatnonzero(outside[RUN:] == outside[:-RUN]) // RUN), 0
                else:
                    places, margin = np.arange(len(starts(len(codes)))), RUN
                begins, ends = np.maximum(places * RUN - margin, 0), np.minimum(places * RUN + WIDTH + margin, len(codes))
                known = ends - begins - (outside[ends] - outside[begins])
                for k in np.flatnonzero(known >= (least or 0)).tolist():
                    ids.append(doc)
                    lefts.append(places[k] * RUN - begins[k])
                    passages.append(codes[begins[k] : ends[k]])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(lefts, pa.int32()), pa.array(passages, pa.list_(pa.int32()))], names=["id", "left", "codes"])

    return run


def _passages(batch: pa.RecordBatch, left: int, codes: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The passages of a batch, without their margins and with them."""
    lists = batch.column(codes)
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    wide = [flat[begin:end] for begin, end in zip([0, *ends], ends, strict=False)]
    return [p[k : k + WIDTH] for p, k in zip(wide, batch.column(left).to_pylist(), strict=True)], wide


def _gram_product(items_bc, matrix_bc):
    """Per partition: the partial product of the passages' Gram matrix with the broadcast matrix, a row per word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, matrix = items_bc.value.idf, matrix_bc.value
        total = np.zeros(matrix.shape)
        for batch in batches:
            passages, _ = _passages(batch, 0, 1)
            if passages:
                total += transposed_times(passages, idf, times(passages, idf, matrix))
        yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["word", "part"])

    return run


def latent_basis(passages: DataFrame, items: Items, items_bc, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """words x rank: right singular vectors of the TF-IDF matrix of all item and document passages, by randomised subspace iteration."""
    sc = passages.sparkSession.sparkContext
    width = len(items.word)
    rank = max(1, min(rank, width))
    own = [p for _, p in items.passages]
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, rank)))[0]
    for last in (False, True):
        product = transposed_times(own, items.idf, times(own, items.idf, q))
        matrix_bc = sc.broadcast(q)
        parts = passages.select("left", "codes").mapInArrow(_gram_product(items_bc, matrix_bc), "word int, part array<double>")
        cells = parts.select("word", F.posexplode("part").alias("k", "v")).groupBy("word", "k").agg(F.sum("v").alias("v"))
        for word, k, v in cells.toPandas().itertuples(index=False):  # width x rank numbers
            product[word, k] += v
        matrix_bc.unpersist()
        if not last:
            q = np.linalg.qr(product)[0]
    small = q.T @ product
    return q @ np.linalg.eigh((small + small.T) / 2)[1][:, ::-1]


def unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)


def runs_of(codes: np.ndarray, n: int = RUN) -> set[bytes]:
    """The runs of ``n`` known words of a passage."""
    known = np.concatenate([[0], np.cumsum(codes < 0)])
    return {codes[i : i + n].tobytes() for i in range(len(codes) - n + 1) if known[i + n] == known[i]}


def lcs_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit rows: a word of bits per step."""
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | (1 << i)
    row, full = 0, (1 << len(a)) - 1
    for w in b:
        x = row | places.get(w, 0)
        row = x & (x ^ (x - ((row << 1) | 1))) & full
    return row.bit_count()


def lcs_lengths(targets: np.ndarray, lengths: np.ndarray, passages: np.ndarray) -> np.ndarray:
    """``lcs_length`` of many pairs at once: rows of word ids, the targets' first ``lengths`` (at most 64) count; what equals no word of the other side may pad."""
    one = np.uint64(1)
    bits = one << np.arange(targets.shape[1], dtype=np.uint64)
    full = np.where(lengths < 64, (one << lengths.astype(np.uint64)) - one, ~np.uint64(0))
    row = np.zeros(len(targets), dtype=np.uint64)
    for k in range(passages.shape[1]):
        places = np.where(targets == passages[:, k, None], bits, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        x = row | places
        row = x & (x ^ (x - ((row << one) | one))) & full
    return np.bitwise_count(row).astype(np.int64)


class Targets:
    """The items' passages as a matrix of word ids, to tell for many pairs at once which can pass the checks of a paraphrase."""

    def __init__(self, items: Items):
        self.words = [p.tolist() for _, p in items.passages]
        self.runs = [runs_of(p) for _, p in items.passages]
        self.absent = len(items.word)
        self.matrix = np.full((len(self.words), WIDTH), self.absent, dtype=np.int32)
        self.rare = np.zeros(self.matrix.shape, dtype=bool)
        rare = np.quantile(items.idf, 0.6)
        for k, target in enumerate(self.words):
            self.matrix[k, : len(target)] = target
            for at, w in enumerate(target):  # every rare word once
                self.rare[k, at] = items.idf[w] >= rare and w not in target[:at]
        self.length = np.array([len(t) for t in self.words])
        self.answers = self.rare.sum(axis=1)

    def possible(self, wide: list[np.ndarray], near: np.ndarray, least: np.ndarray, answers: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs (passage, target) of ``near`` with ``least`` words of the target in common, in any order, and a share ``answers`` of its rare words."""
        held = np.zeros((len(wide), self.absent + 1), dtype=bool)
        for i, passage in enumerate(wide):
            held[i, passage[passage >= 0]] = True
        rows, targets = np.nonzero(near)
        for at in range(0, len(rows), 1 << 17):
            i, p = rows[at : at + (1 << 17)], targets[at : at + (1 << 17)]
            common = held[i[:, None], self.matrix[p]]
            fits = common.sum(axis=1) >= least[p]
            i, p, common = i[fits], p[fits], common[fits]
            fits = (common & self.rare[p]).sum(axis=1) >= answers * self.answers[p]
            yield i[fits], p[fits]

    def shares(self, wide: list[np.ndarray], i: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The longest common subsequence of each pair as a share of the target."""
        passages = np.full((len(wide), max(map(len, wide), default=1)), -1, dtype=np.int32)
        for k, passage in enumerate(wide):
            passages[k, : len(passage)] = passage
        parts = [slice(at, at + (1 << 14)) for at in range(0, len(i), 1 << 14)]
        common = [lcs_lengths(self.matrix[p[at]], self.length[p[at]], passages[i[at]]) for at in parts]
        return np.concatenate(common) / self.length[p] if common else np.zeros(0)


def _search(items_bc, basis_bc, exact: bool, least_cosine: float, lcs_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, basis = items_bc.value, basis_bc.value
        latent = unit(times([p for _, p in items.passages], items.idf, basis)).astype(np.float32)
        targets = Targets(items)
        least = np.full(len(targets.words), RUN) if exact else np.ceil(lcs_share * targets.length - 1e-9)
        step = max(1, min(2048, CELLS // max(len(items.word), len(targets.words))))
        for batch in batches:
            docs, hits, scores = [], [], []
            codes, wide = _passages(batch, 1, 2)
            ids = batch.column(0).to_pylist()
            for at in range(0, len(codes), step):
                near = unit(times(codes[at : at + step], items.idf, basis)).astype(np.float32) @ latent.T >= least_cosine
                part, of, runs = wide[at : at + step], -1, set()
                for found, aims in targets.possible(part, near, least, 0.0 if exact else 0.5):
                    shares = np.zeros(len(found)) if exact else targets.shares(part, found, aims)
                    for n, (i, p) in enumerate(zip(found.tolist(), aims.tolist(), strict=True)) if exact else ():
                        if i != of:  # pairs come passage by passage
                            of, runs = i, runs_of(part[i])
                        shares[n] = not runs.isdisjoint(targets.runs[p])
                    kept = shares > 0 if exact else shares * targets.length[aims] >= least[aims] - 1e-9
                    docs += [ids[at + i] for i in found[kept].tolist()]
                    hits += items.owner[aims[kept]].tolist()
                    scores += shares[kept].tolist()
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(hits, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "item_id", "share"])

    return run


def find_leaks(
    docs: DataFrame, eval_items: DataFrame, exact: bool = True, least_cosine: float | None = None, lcs_share: float = 0.6, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """doc_id, item_id, share of every document that leaks an item, each pair once.

    ``exact``: at least ``RUN`` consecutive words of the item occur consecutively (share 1).  Otherwise paraphrases: candidates whose
    longest common subsequence with an item's passage covers ``lcs_share`` of it and which hold half its rare words and
    numbers; share is the best such cover.  Items of any number are searched, in blocks.  Other columns are not read; null and empty texts,
    and items of fewer than ``RUN`` words, leak nothing; repeated rows change nothing; an empty table on either side gives no rows.
    """
    rows = eval_items.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    blocks = max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    source = spread(docs.select(F.col(key).cast("bigint").alias(key), text).filter(F.col(key).isNotNull() & F.col(text).isNotNull()))
    cosine = least_cosine if least_cosine is not None else LEAST_COSINE if exact else PARAPHRASE_COSINE
    found = [_block_leaks(source, rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), exact, cosine, lcs_share) for b in range(blocks)]
    return reduce(lambda a, b: a.unionByName(b), found).groupBy(F.col("doc_id").alias(key), "item_id").agg(F.max("share").alias("share"))


def _block_leaks(source: DataFrame, rows: DataFrame, exact: bool, least_cosine: float, lcs_share: float) -> DataFrame:
    spark = source.sparkSession
    schema = "doc_id bigint, item_id bigint, share double"
    items = Items([tuple(r) for r in rows.collect()])
    if not items.word:
        return spark.createDataFrame([], schema)
    items_bc = spark.sparkContext.broadcast(items)
    least_words = None if exact else least_known([p for _, p in items.passages], lcs_share)
    passages = Scratch(spark, "leaks").keep(source.mapInArrow(_cut(items_bc, least_words), "id bigint, left int, codes array<int>"), "passages")
    basis_bc = spark.sparkContext.broadcast(latent_basis(passages, items, items_bc))
    return passages.select("id", "left", "codes").mapInArrow(_search(items_bc, basis_bc, exact, least_cosine, lcs_share), schema)
