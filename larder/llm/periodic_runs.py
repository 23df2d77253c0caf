"""Periodic runs of words, by Lyndon roots from Baier grouping.

A run is a maximal stretch of words with smallest period q and at least twice that length. Every run holds a root, a word
sequence of length q, that is the longest Lyndon sequence from its start on under one of two orders: some order of the
words, or the same order turned round. So the longest Lyndon sequences from every position under both orders name all
candidates, two a position.

Lyndon arrays come straight from phase one of Baier's suffix sorter, without the suffix array. Suffixes start in groups by
first word. Groups are taken from the highest down; each member finds the nearest suffix to its left that is in a
lower group, and suffixes found l times leave their group for a new one right above it, whose context is the old one and l
times the taken group's. When the lowest group is done, a suffix's context is its longest Lyndon prefix. Suffixes of taken
groups are never found again, so "nearest to the left" is a search over sets that only ever merge.

A candidate is extended to both sides by longest common extensions (LCE): ranks of all stretches of 1, 2, 4, ... words are
sorted once, and common extensions of all candidates are then added up from the longest stretch down, in numpy.

Where no word sequence of six words comes twice there is no run of ``min_length`` 12: a run of length L and period q repeats
L - q >= 6 words at distance q. Stretches covered by six-word windows that come twice in the text hold every run whole, with the
neighbours that would extend it, so grouping works on those stretches only. The filter's 64-bit fingerprints may err towards
more work, never towards less; within a stretch words are compared as they are.

Plan: a map over the documents, no shuffle. A task holds one text at a time.

Defined cases: null, empty and blank texts have no words and no run; null ids are kept (and never rewritten); repeated rows are
rows of their own; of runs of the greatest length the one with the smallest start, then period, is reported; texts of any
length are taken whole, in time n log n; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import keyed, raw_texts
from .wordhash import covered, window_hashes, word_hashes, word_spans

_RESULT = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
           "collapsed_sha256 string")


def lyndon_array(symbols: list[int]) -> list[int]:
    """Length of the longest Lyndon sequence from each position on (symbols are small numbers, a prefix is smaller than what
    it begins), by the grouping phase of Baier's suffix sorter. A group is known by its first slot."""
    n = len(symbols)
    size = [0] * (max(symbols, default=0) + 1)
    for c in symbols:
        size[c] += 1
    first, total = [], 0
    for count in size:
        first.append(total)
        total += count
    group = [first[c] for c in symbols]  # by suffix: first slot of its group
    members, context = [0] * n, [1] * n  # by first slot: suffixes in the group, length of what they share
    at, slot = [0] * n, [0] * n  # suffix in a slot, slot of a suffix
    for i, g in enumerate(group):
        slot[i] = s = g + members[g]
        at[s] = i
        members[g] += 1
    left = list(range(n + 1))  # by suffix + 1: itself, or where to look further left once its group is taken
    end = n
    while end:
        low = group[at[end - 1]]
        taken = at[low:end]
        end = low
        for i in taken:
            left[i + 1] = i
        found: dict[int, int] = {}
        for i in taken:
            j = i
            while left[j] != j:
                left[j] = left[left[j]]
                j = left[j]
            if j:
                found[j - 1] = found.get(j - 1, 0) + 1
        if not found:
            continue
        shared = context[low]
        times = sorted(set(found.values()), reverse=True)
        for l in times:
            moving = found if len(times) == 1 else [j for j, k in found.items() if k == l]
            olds = []
            for j in moving:  # to the end of its group's slots
                g = group[j]
                olds.append(g)
                members[g] -= 1
                last = g + members[g]
                s, other = slot[j], at[last]
                at[s], slot[other] = other, s
                at[last], slot[j] = j, last
            fresh = {g: (g + members[g], context[g] + l * shared) for g in olds}
            for start, length in fresh.values():
                members[start], context[start] = 0, length
            for j, g in zip(moving, olds):
                group[j] = start = fresh[g][0]
                members[start] += 1
    return [context[g] for g in group]


class Extensions:
    """Longest common extensions of positions of one sequence, to the right and to the left."""

    def __init__(self, symbols: np.ndarray):
        self.n = n = symbols.size
        self.ranks = [np.asarray(symbols, np.int64)]  # of stretches of 1, 2, 4, ... symbols, by start
        step = 1
        while 2 * step <= n:
            last = self.ranks[-1]
            pair = last[:n - 2 * step + 1] * np.int64(n + 1) + last[step:n - step + 1]
            distinct, rank = np.unique(pair, return_inverse=True)
            self.ranks.append(rank.astype(np.int64))
            step *= 2
            if distinct.size == pair.size:  # no longer stretch comes twice either
                break

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from ``i`` on equal those from ``j`` on; i < j <= n."""
        length = np.zeros(i.size, np.int64)
        for k in reversed(range(len(self.ranks))):
            rank, step = self.ranks[k], 1 << k
            while True:  # a longest level may fit more than once
                fits = j + length + step <= self.n
                fits[fits] = rank[(i + length)[fits]] == rank[(j + length)[fits]]
                length += step * fits
                if k < len(self.ranks) - 1 or not fits.any():
                    break
        return length

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols before ``i`` equal those before ``j``; i < j."""
        length = np.zeros(i.size, np.int64)
        for k in reversed(range(len(self.ranks))):
            rank, step = self.ranks[k], 1 << k
            while True:
                fits = i - length - step >= 0
                fits[fits] = rank[(i - length - step)[fits]] == rank[(j - length - step)[fits]]
                length += step * fits
                if k < len(self.ranks) - 1 or not fits.any():
                    break
        return length


def runs(symbols: list[int], min_length: int = 2) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least ``min_length``, by start, then period. Symbols are 0, 1, 2, ..."""
    n = len(symbols)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    top = max(symbols)
    length = np.array([lyndon_array(symbols), lyndon_array([top - c for c in symbols])], np.int64)
    start = np.tile(np.arange(n), 2)
    after = start + length.ravel()
    keys = np.unique(start[after < n] * np.int64(n + 1) + after[after < n])
    i, j = keys // (n + 1), keys % (n + 1)
    lce = Extensions(np.array(symbols))
    before, beyond = lce.left(i, j), lce.right(i, j)
    period, begin = j - i, i - before
    size = j + beyond - begin
    whole = size >= np.maximum(2 * period, min_length)
    if not whole.any():
        return np.zeros((0, 3), np.int64)
    return np.unique(np.stack([begin, period, size], 1)[whole], axis=0)[:, [0, 2, 1]]


def text_runs(words: list[bytes], prints: np.ndarray, min_length: int = 12) -> np.ndarray:
    """``runs`` of a text's words; ``prints`` are fingerprints of the words, used only to leave out stretches without runs."""
    width = (min_length + 1) // 2
    windows = window_hashes(prints, width)
    none = np.zeros((0, 3), np.int64)
    if windows.size < 2:
        return none
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return none
    again = np.zeros(windows.size, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    inside = np.diff(covered(np.flatnonzero(again), width, len(words)).astype(np.int8), prepend=0, append=0)
    out = []
    for a, b in zip(np.flatnonzero(inside == 1).tolist(), np.flatnonzero(inside == -1).tolist()):
        if b - a < min_length:
            continue
        number: dict[bytes, int] = {}
        found = runs([number.setdefault(w, len(number)) for w in words[a:b]], min_length)
        if found.size:
            out.append(found + np.array([a, 0, 0]))
    return np.concatenate(out) if out else none


def dropped(found: np.ndarray, n: int) -> np.ndarray:
    """Mask over ``n`` words: those that some run holds after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, found[:, 0] + found[:, 2], 1)
    np.add.at(steps, found[:, 0] + found[:, 1], -1)
    return np.cumsum(steps[:n]) > 0


def repeat_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a text of ``n`` words that is to be rewritten as a repetition; None where
    it is not. A tenth of the ids, by checksum."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def _digest(parts: Iterator[str] | str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _rows(rewrite: Callable[[int | None, int], np.ndarray | None] | None, min_length: int):
    """``mapInArrow`` function over (id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                words, prints = raw.split(), word_hashes(raw, *word_spans(raw))
                places = rewrite(doc_id, len(words)) if rewrite else None
                if places is not None:
                    words, prints = [words[k] for k in places.tolist()], prints[places]
                found = text_runs(words, prints, min_length)
                if found.size:
                    best = max(found.tolist(), key=lambda r: (r[1], -r[0], -r[2]))
                    gone = dropped(found, len(words)).tolist()
                    words = [w for w, g in zip(words, gone) if not g]
                    top = (*best, 1000 * best[1] // best[2])
                else:
                    top = (None,) * 4
                out.append((doc_id, len(found), *top, _digest("%d,%d,%d\n" % tuple(r) for r in found.tolist()),
                            hashlib.sha256(b" ".join(words)).hexdigest()))
            if out:
                fields = [f.split() for f in _RESULT.split(", ")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64() if kind == "long" else pa.string()) for x, (_, kind) in zip(zip(*out), fields)],
                    [name for name, _ in fields])
    return run


def periodic_runs(docs: DataFrame, min_length: int = 12,
                  rewrite: Callable[[int | None, int], np.ndarray | None] | None = None,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_runs``, the longest run's ``start, length, period, exponent_milli``, ``runs_sha256`` of all runs and
    ``collapsed_sha256`` of the words left when every run keeps its first period only, per row. ``rewrite(id, n)`` may first
    give the original place of the word to stand at each of a text's ``n`` places."""
    return keyed(docs, id_col, text_col).mapInArrow(_rows(rewrite, min_length), _RESULT)
