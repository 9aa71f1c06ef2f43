"""Points of many tasks against batches of documents, by posting lists of a block of tasks.  Runs in Arrow batches: adding up small whole numbers is array work.

A batch's documents hold the ids of the sought texts that their title and aliases contain and that their keywords are; each sought text lists
the tasks (numbered within the block) it is a term or the whole of.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Points of a term and of the whole task by where they stand, and points added up at once (memory: some 50 MB).
POINTS = {"in_title": (3, 20), "in_aliases": (4, 24), "in_keywords": (4, 0)}
AT_ONCE = 1_000_000


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all spans, one after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class Postings:
    """The tasks of a block by sought text.  ask: the task's number, sought_id, whole: whether it is the whole task; texts: what the ids stand for."""

    def __init__(self, ask: np.ndarray, sought_id: np.ndarray, whole: np.ndarray, texts: list[str]):
        self.ids, first = np.unique(sought_id, return_index=True)
        self.texts = [texts[i] for i in first]
        self.asks = int(ask.max()) + 1 if len(ask) else 0
        at = np.searchsorted(self.ids, sought_id)
        self.lists = []
        for kind in (False, True):
            own = np.flatnonzero(whole == kind)
            own = own[np.argsort(at[own], kind="stable")]
            counts = np.bincount(at[own], minlength=len(self.ids))
            self.lists.append((ask[own], np.cumsum(counts) - counts, counts))

    def known(self, keywords: pa.Array) -> pa.Array:
        """Lists of keywords as lists of the ids of those that are sought."""
        place = pc.index_in(keywords.flatten(), value_set=pa.array(self.texts, pa.string()))
        row = np.repeat(np.arange(len(keywords)), pc.list_value_length(keywords).to_numpy(zero_copy_only=False))
        found = place.is_valid().to_numpy(zero_copy_only=False)
        ids = self.ids[place.filter(place.is_valid()).to_numpy()]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row[found], minlength=len(keywords)))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int64()))

    def points(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """row, ask, points of every pair with points, in the order of rows (and asks), some million points at once."""
        parts = []
        for column, worth in POINTS.items():
            lists = batch.column(column)
            row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(self.ids, ids), max(len(self.ids) - 1, 0))
            here = self.ids[at] == ids if len(self.ids) else np.zeros(len(ids), bool)  # the others belong to other blocks
            row, at = row[here], at[here]
            parts += [(row, at, np.full(len(row), kind), np.full(len(row), p)) for kind, p in enumerate(worth) if p]
        row, at, kind, worth = (np.concatenate(x) for x in zip(*parts, strict=True))
        counts = np.where(kind == 1, self.lists[1][2][at], self.lists[0][2][at]) if len(at) else at
        some = np.flatnonzero(counts)
        some = some[np.argsort(row[some], kind="stable")]
        row, at, kind, worth, counts = row[some], at[some], kind[some], worth[some], counts[some]
        so_far = np.cumsum(np.bincount(row, weights=counts, minlength=batch.num_rows)) // AT_ONCE
        bounds = np.searchsorted(row, np.concatenate([[0], np.flatnonzero(np.diff(so_far)) + 1, [batch.num_rows]]))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a == b:
                continue
            rows, local = np.unique(row[a:b], return_inverse=True)
            gained = []
            for k, (asks, starts, _) in enumerate(self.lists):
                own = np.flatnonzero(kind[a:b] == k)
                n = counts[a:b][own]
                gained.append((np.repeat(local[own], n), asks[_spans(starts[at[a:b][own]], n)], np.repeat(worth[a:b][own], n)))
            doc, ask, p = (np.concatenate(x) for x in zip(*gained, strict=True))
            active = np.flatnonzero(np.bincount(ask, minlength=self.asks))
            to = np.zeros(self.asks, np.int64)
            to[active] = np.arange(len(active))
            key = doc * len(active) + to[ask]
            if len(rows) * len(active) <= 8 * len(key):
                sums = np.bincount(key, weights=p)
                pair = np.flatnonzero(sums)
                sums = sums[pair]
            else:  # few of the pairs share anything
                pair, inverse = np.unique(key, return_inverse=True)
                sums = np.bincount(inverse, weights=p)
            yield rows[pair // len(active)], active[pair % len(active)], sums.astype(np.int64)


class Best:
    """The best ``limit`` documents of each task so far; documents come in the order that decides ties."""

    def __init__(self, asks: int, min_score: int, limit: int):
        self.limit = limit
        self.least = np.full(asks, max(1, min_score) - 1)  # what a further document must exceed
        self.ask = self.score = self.doc = np.zeros(0, np.int64)

    def add(self, doc: np.ndarray, ask: np.ndarray, score: np.ndarray) -> None:
        better = score > self.least[ask]
        if not better.any():
            return
        ask, score, doc = (np.concatenate([old, new[better]]) for old, new in ((self.ask, ask), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, ask))
        ask, score, doc = ask[order], score[order], doc[order]
        first = np.concatenate([[True], ask[1:] != ask[:-1]])
        nth = np.arange(len(ask)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        last = nth == self.limit - 1
        self.least[ask[last]] = score[last]
        kept = nth < self.limit
        self.ask, self.score, self.doc = ask[kept], score[kept], doc[kept]
