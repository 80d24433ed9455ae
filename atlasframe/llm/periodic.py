"""Periodic runs of words, found on a harmonic grid, and texts without their repetitions.

A run is a stretch of words of smallest period q (words q apart are equal), of at least ``least`` words
and ``times`` periods, that can't be extended at either end.  For each period p the multiples of p are
a grid, n/p points, so all grids together have n log n points.  A run of period p holds ``times``
neighbouring grid points at least; from a pair jp and (j+1)p of them, the longest common extension (LCE)
forward and that backward give the run's ends.  LCEs are range minima (a sparse table) over the common
prefixes of neighbours in a suffix array, forward over the words and backward over the reversed words.
Pairs whose words differ have an LCE of 0, and a run has ``times`` - 1 neighbouring pairs with equal
words: only such pairs are asked, and only texts that have any get their arrays.

The same stretch comes up for multiples of its smallest period too (by Fine and Wilf, only for these):
of equal stretches the smallest period stays.

Words are what ASCII white space separates.  Null texts count as empty: no words, no runs, and an empty
collapsed text.  Equal and repeated rows give equal results; an empty table gives an empty result; texts
are taken whole at any length.  Input columns other than the id and the text are ignored, so their names
can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Words whose texts share their arrays, unless one text has more; pairs of grid points tried at once.
BATCH_WORDS, PAIRS = 65_536, 1 << 20
Runs = list[tuple[int, int, int]]


class Extensions:
    """Longest common extensions within each of several texts, laid one after another.

    ``words`` are numbers from 1, with a 0 after each text; ``owner`` is the text of each place.
    """

    def __init__(self, words: np.ndarray, owner: np.ndarray):
        n = len(words)
        key = owner * (int(words.max(initial=0)) + 1) + words
        suffixes = np.argsort(key, kind="stable")
        begins = np.r_[True, np.diff(key[suffixes]) > 0]
        ranks = np.empty(n, dtype=np.int64)  # of a suffix: the first place of those alike so far
        ranks[suffixes] = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        levels, reach = [], 1  # ranks by the first 1, 2, 4, ... words
        while True:
            levels.append(ranks.astype(np.int32))
            ties = ~begins[1:]
            at = np.flatnonzero(np.r_[ties, False] | np.r_[False, ties])
            if not len(at):
                break
            open_ = suffixes[at]
            pair = ranks[open_] * n + ranks[open_ + reach]  # a text's end is alike to nothing, so this stays in the text
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
            suffixes[at] = open_[order]
            begins[at] = np.r_[True, pair[1:] != pair[:-1]]
            ranks = ranks.copy()
            ranks[suffixes[at]] = at[np.maximum.accumulate(np.where(begins[at], np.arange(len(at)), 0))]
            reach *= 2
        self.place = ranks
        common = np.zeros(n, dtype=np.int32)  # with the suffix before
        if len(levels) > 1:
            left, right = suffixes[:-1], suffixes[1:]
            for k in range(len(levels) - 2, -1, -1):
                common[1:] += np.where(levels[k][left + common[1:]] == levels[k][right + common[1:]], 1 << k, 0).astype(np.int32)
        self.least = [common]  # of 1, 2, 4, ... entries from each place on
        longest = int(np.bincount(owner).max(initial=1))
        for k in range(longest.bit_length() - 1):
            last = self.least[-1]
            self.least.append(np.minimum(last, np.r_[last[1 << k :], last[len(last) - (1 << k) :]]) if n > 1 << k else last)
        self.least = np.stack(self.least)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` on equal those from ``b`` on (of the same text, and not the same place)."""
        low, high = np.minimum(self.place[a], self.place[b]), np.maximum(self.place[a], self.place[b])
        power = np.frexp(high - low)[1] - 1
        return np.minimum(self.least[power, low + 1], self.least[power, high + 1 - (1 << power)]).astype(np.int64)


def _grid(sizes: np.ndarray, begins: np.ndarray, ids: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and period of the grid pairs that begin ``times`` - 1 neighbouring pairs with equal words."""
    most = sizes // times
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    pairs = (sizes[text] - 1) // period
    part = (np.cumsum(pairs) - pairs) // PAIRS
    found = []
    for cut in np.split(np.arange(len(text)), np.flatnonzero(np.diff(part)) + 1):
        n = pairs[cut]
        owner = np.repeat(cut, n)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        p = period[owner]
        at = begins[text[owner]] + nth * p
        equal = ids[at] == ids[at + p]
        for _ in range(times - 2):
            equal = equal & np.r_[equal[1:], False]
        hit = np.flatnonzero(equal & (nth + times - 1 <= pairs[owner]))
        found.append((text[owner[hit]], at[hit], p[hit]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))


def find_runs(texts: list[list[bytes]], least: int = 6, times: int = 4) -> list[Runs]:
    """Start, length and period of each text's runs, by start and period; ``times`` is 2 at least."""
    out: list[Runs] = [[] for _ in texts]
    known: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ids = np.array([known.setdefault(w, len(known) + 1) for t in texts for w in t], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    text, at, period = _grid(sizes, begins, ids, times)
    if not len(text):
        return out
    held, owner = np.unique(text, return_inverse=True)  # texts with candidates, each followed by a 0
    ends = np.cumsum(sizes[held] + 1)
    firsts = ends - sizes[held] - 1
    words = np.zeros(int(ends[-1]), dtype=np.int64)
    inner = np.ones(len(words), dtype=bool)
    inner[ends - 1] = False
    words[inner] = np.concatenate([ids[begins[t] : begins[t] + sizes[t]] for t in held])
    texts_of = np.repeat(np.arange(len(held)), sizes[held] + 1)
    back = np.repeat(firsts + ends - 2, sizes[held] + 1) - np.arange(len(words))  # where a place is in its reversed text
    back[ends - 1] = ends - 1
    turned = np.zeros_like(words)
    turned[back] = words
    forward, backward = Extensions(words, texts_of), Extensions(turned, texts_of)
    parts = []
    for begin in range(0, len(text), PAIRS):
        cut = slice(begin, begin + PAIRS)
        own, place, p = owner[cut], at[cut] - begins[text[cut]], period[cut]
        a = firsts[own] + place
        after = forward.of(a, a + p)
        before = np.zeros_like(after)
        some = np.flatnonzero(place > 0)
        before[some] = backward.of(back[a[some] - 1], back[a[some] + p[some] - 1])
        start, length = place - before, before + p + after
        fits = length >= np.maximum(least, times * p)
        parts.append(np.unique(np.stack([text[cut], start, length, p], axis=1)[fits], axis=0))
    rows = np.unique(np.concatenate(parts), axis=0)
    if len(rows):
        first = np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]
        rows = rows[first]
        for t, s, n, p in rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))].tolist():
            out[t].append((s, n, p))
    return out


def collapsed(words: list[bytes], runs: Runs) -> bytes:
    """The words that no run repeats, joined by spaces."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()])


def _groups(sizes: list[int]) -> Iterator[slice]:
    begin = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > BATCH_WORDS:
            yield slice(begin, k)
            begin, total = k, 0
        total += n
    yield slice(begin, len(sizes))


def collapse_runs(docs: DataFrame, least: int = 6, times: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, ``runs`` (start, length, period) and ``collapsed``, the text without repetitions."""
    kind = docs.schema[id_col].dataType.simpleString()
    run = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column(1).to_pylist()]
            runs = [r for part in _groups([len(w) for w in words]) for r in find_runs(words[part], least, times)]
            shown = pa.array([[dict(zip(run.names, x, strict=True)) for x in r] for r in runs], pa.list_(run))
            texts = pa.array([collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int64()), shown, texts], [id_col, "n_words", "runs", "collapsed"])

    return docs.select(id_col, text_col).mapInArrow(found, f"`{id_col}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
