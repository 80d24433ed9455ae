"""Byte-pair learning over tables: the same vocabulary as ``bpe.train``, with nothing but pair tops on the driver.

Words and pair counts are tables.  A round takes the most frequent pairs and fixes as many merges as are
certain to be the next ones, one after another:

* merges of a round don't touch each other (no pair ends with the symbol that another begins with), so
  none changes another's count;
* a pair that a merge creates, (x, ab) or (ab, y), occurs no more often than (x, a) or (b, y) did, which are
  pairs that touch the merge.  So a pair is certainly next if it occurs more often than every pair that
  touches one of the round's merges, whatever those create.  The pairs beyond those on the driver count as
  often as the last one there;
* a pair of one symbol twice touches itself, so it ends its round; a merge whose text is a token already
  gets a round of its own.

The merges go over each word once.  Only words that a merge touches take their old pairs back and add their
new ones: the pair table is the one before plus these differences, summed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from .bpe import MOST_WORDS, UNKNOWN, Pair, Vocabulary, fetched, train_words, word_counts

#: Pairs that a round looks at.
TOP = 512


def certain_merges(tops: list[tuple[Pair, int]], tokens: list[str], room: int, whole: bool) -> list[tuple[int, int, str]]:
    """The merges that surely come next, from pairs and counts in order; ``whole``: there are no other pairs.
    Each is (left, right, text)."""
    known = set(tokens)
    rest = 0 if whole else tops[-1][1]  # no pair beyond has more
    out: list[tuple[int, int, str]] = []
    ends: set[int] = set()
    begins: set[int] = set()
    for k, ((a, b), n) in enumerate(tops):
        text = tokens[a] + tokens[b]
        if not out:
            out.append((a, b, text))
            if text in known:
                break
        else:
            touching = (m for (x, y), m in tops if (y in begins or x in ends) and (x, y) not in {(p, q) for p, q, _ in out})
            if a in ends or b in begins or text in known or n <= max([rest, *touching]):
                break
            out.append((a, b, text))
        if len(out) >= room or a == b:
            break
        begins.add(a)
        ends.add(b)
        known.add(text)
    return out


def _merge(ids: list[int], merges: dict[Pair, int]) -> list[int]:
    out: list[int] = []
    fresh = False  # what was just joined isn't joined again in its round
    for i in ids:
        new = merges.get((out[-1], i)) if out and not fresh else None
        if new is None:
            out.append(i)
            fresh = False
        else:
            out[-1] = new
            fresh = True
    return out


_WORDS = "word string, n long, ids array<int>, changes array<struct<left:int,right:int,n:bigint>>"


def _round(words: DataFrame, merges: dict[Pair, int]) -> DataFrame:
    """``words`` after the merges, and what each does to the pair counts."""
    change = pa.struct([("left", pa.int32()), ("right", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, changes = [], []
            for n, ids in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                joined = _merge(ids, merges)
                diff = []
                if len(joined) < len(ids):
                    diff = [{"left": a, "right": b, "n": -n} for a, b in pairwise(ids)] + [{"left": a, "right": b, "n": n} for a, b in pairwise(joined)]
                done.append(joined)
                changes.append(diff)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(done, pa.list_(pa.int32())), pa.array(changes, pa.list_(change))], ["word", "n", "ids", "changes"])

    return words.select("word", "n", "ids").mapInArrow(run, _WORDS)


def learn_tables(names: DataFrame, column: str = "name", vocab_size: int = 1000, least: int = 1, extra: int | None = None, top: int = TOP) -> Vocabulary:
    """Learn a vocabulary of ``vocab_size`` tokens, or of ``extra`` tokens beside the characters.

    Equal to ``bpe.learn``; words and pairs stay distributed however many there are.  The characters and the
    tokens, of which a vocabulary consists, are on the driver.
    """
    counts = scratch.written(word_counts(names, column).where((F.col("n") >= least) & (F.col("word") != "")))
    letters = sorted(r[0] for r in counts.select(F.explode(F.array_distinct(F.split("word", "")))).distinct().toLocalIterator() if r[0])
    tokens = [UNKNOWN, *letters]
    size = len(tokens) + extra if extra is not None else vocab_size
    numbers = {t: k for k, t in enumerate(tokens)}

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([[numbers[c] for c in w] for w in batch.column(0).to_pylist()], pa.list_(pa.int32()))], ["word", "n", "ids"])

    words = scratch.written(counts.mapInArrow(spelled, "word string, n long, ids array<int>"))
    scratch.forget_written(counts)
    each = words.select("n", "ids", F.explode(F.when(F.size("ids") > 1, F.sequence(F.lit(0), F.size("ids") - 2))).alias("at"))
    pairs = scratch.written(each.groupBy(F.get("ids", F.col("at")).alias("left"), F.get("ids", F.col("at") + 1).alias("right")).agg(F.sum("n").alias("n")))
    merges: list[tuple[int, int, int]] = []
    while len(tokens) < size:
        rows = pairs.orderBy(F.desc("n"), "left", "right").limit(top + 1).collect()
        tops = [((r["left"], r["right"]), r["n"]) for r in rows[:top]]
        if not tops:
            break
        step: dict[Pair, int] = {}
        for a, b, text in certain_merges(tops, tokens, size - len(tokens), len(rows) <= top):
            if text not in numbers:
                numbers[text] = len(tokens)
                tokens.append(text)
            step[a, b] = numbers[text]
            merges.append((a, b, numbers[text]))
        after = scratch.written(_round(words, step))
        diff = after.select(F.inline("changes"))
        summed = scratch.written(pairs.unionAll(diff).groupBy("left", "right").agg(F.sum("n").alias("n")).where("n > 0"))
        scratch.forget_written(words)
        scratch.forget_written(pairs)
        words, pairs = after.drop("changes"), summed
    return Vocabulary(tuple(tokens), tuple(merges))


def learn(names: DataFrame, column: str = "name", vocab_size: int = 1000, least: int = 1, most_words: int = MOST_WORDS) -> Vocabulary:
    """A vocabulary of any number of words: up to ``most_words`` distinct ones the driver's loop learns it in one
    go, beyond that the tables do.  Both give the same."""
    counts = scratch.written(word_counts(names, column).where(F.col("n") >= least))
    if counts.count() > most_words:
        scratch.forget_written(counts)
        return learn_tables(names, column, vocab_size, least)
    out = train_words(*fetched(counts), vocab_size)
    scratch.forget_written(counts)
    return out
