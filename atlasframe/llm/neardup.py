"""Near-duplicates by the Jaccard similarity of word shingles: operator 10 where a similarity is asked for.

Candidates come from two sides, and all are compared exactly.  SimHash fingerprints of the shingle sets
are linked through vantage-point trees (``simhash.links``, given as ``near``).  At a similarity of 0.8 two
of them differ in about 10 of 64 bits, though, and at such a radius the trees' bounds rule out nothing
(README has the figures), so that every fingerprint would meet every other.  What lies beyond the trees'
radius comes from MinHash: BANDS independent fingerprints of ROWS minima each, so that a pair at
similarity 0.8 shares none with a chance of 3 in 100,000, and fewer above.

Texts that share a fingerprint are a group (texts with equal shingle sets are one node).  Links are
found without ever meeting a group in one task: each member is compared exactly with two hubs of its
group, those with the most and the fewest fellows; what these links join needs no further comparison.
In groups of four or more that they don't join, the members outside the largest joined part are
compared with all others in blocks of bounded size, so no link between different texts is lost.

A text of fewer words than a shingle is one shingle, a null or blank text the empty set.  Rows without
an id take part and come last in the order; of repeated rows (same id and text) one stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep_rows, row_identity, slices, written
from .graph import Forest, components

BANDS, ROWS = 20, 4
#: Members, and shingles in all, that a block of a group is meant to hold.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
_SLICE = 16_384
_drawn = np.random.default_rng(42).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64)
_TIMES, _PLUS = _drawn[0] * np.uint64(2) + np.uint64(1), _drawn[1]


def shingles(text: str | None, words_per_shingle: int = 5) -> np.ndarray:
    """The set of XXH64 of the shingles, sorted; words as in ``simhash.fingerprint``."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words_per_shingle, len(words))
    cut = map(joined.__getitem__, map(slice, starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(42)), dtype=np.uint64, count=len(words) - k + 1))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, total: int) -> int:
    """The SimHash: a bit is set if over half of ``total`` hashes have it."""
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprint(s: np.ndarray) -> int:
    """The SimHash of a shingle set; zero of the empty one."""
    return majority(sum((bit_counts(s[at : at + _SLICE]) for at in range(0, len(s), _SLICE)), np.zeros(64, dtype=np.int64)), len(s))


def node(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.tobytes(), 42)


def bands(s: np.ndarray) -> list[int]:
    import xxhash

    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), _SLICE):
        np.minimum(least, (s[at : at + _SLICE, None] * _TIMES + _PLUS).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _marked(docs: DataFrame, words_per_shingle: int, id_col: str, text_col: str) -> DataFrame:
    """key (of the row), id, node, size (of its set), SimHash and bands of every row."""
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("node", T.LongType()), T.StructField("size", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t, words_per_shingle) for t in batch.column(2).to_pylist()]
            at = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
            ids = pa.ListArray.from_arrays(at, _signed([b for s in sets for b in bands(s)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _signed([node(s) for s in sets]), pa.array([len(s) for s in sets], pa.int64()), _signed([fingerprint(s) for s in sets]), ids], schema.names)

    return docs.select(row_identity(id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(mark, schema)


def _sets(docs: DataFrame, keys: DataFrame, words_per_shingle: int, id_col: str, text_col: str) -> DataFrame:
    """node and its set ``s`` for the rows with ``keys``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t, words_per_shingle) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([_signed([node(s) for s in sets]), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "s"])

    texts = docs.select(row_identity(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    return texts.join(keys, "key", "left_semi").select("text").mapInArrow(cut, "node long, s array<long>").dropDuplicates(["node"])


def _similar(both: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * both >= percent * (a + b - both)


def _near(nodes: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a, b), each once, of the nodes with equal fingerprints (each with the least of them) and of those
    that ``near`` links."""
    of = written(nodes.groupBy("fp").agg(F.min("node").alias("least")))  # so that the join of a hot fingerprint can be split
    same = nodes.select("node", "fp").join(of, "fp").select(F.col("node").alias("x"), F.col("least").alias("y"))
    x, y = (of.select(F.col("fp").alias(c), F.col("least").alias(v)) for c, v in (("a", "x"), ("b", "y")))
    linked = near(of.select("fp")).join(x, "a").join(y, "b").select("x", "y")
    return same.unionByName(linked).where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _with_hubs(members: DataFrame) -> DataFrame:
    """Pairs (a, b), each once, of the members of a band with its two hubs."""
    fellows = members.groupBy("node").agg(F.sum("n").alias("fellows"))
    known = members.join(fellows, "node").select("band", F.struct("fellows", "node").alias("m"))
    hubs = written(known.groupBy("band").agg(F.max("m").alias("hi"), F.min("m").alias("lo")))  # so that the join of a hot band can be split
    met = known.join(hubs, "band").select(F.col("m.node").alias("x"), F.explode(F.array("hi.node", "lo.node")).alias("y"))
    return met.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _rest_links(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, block: int, block_shingles: int) -> DataFrame:
    """Links (a, b) between members of a band that ``roots`` doesn't join yet, by exact comparison.

    Only bands of four or more members can have pairs that no hub has met.  Of bands with the same
    members one is taken.  Members outside the band's largest joined part meet all members in blocks
    (part, turn): each block holds one part of the members and one of those outside.
    """
    at = members.where("n > 3").join(roots, "node", "left").select("band", "node", "size", F.coalesce("root", "node").alias("root"))
    counts = at.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    total = counts.groupBy("band").agg(F.max(F.struct("n", "size", "root")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("main.n < n")
    once = total.groupBy("n", "x", "y").agg(F.min(F.struct("band", "size", "main")).alias("b"))
    blocks = lambda n, size: F.ceil(F.greatest(n / F.lit(float(block)), size / F.lit(float(block_shingles))))
    open_bands = once.select("b.band", F.col("b.main.root").alias("main"), blocks(F.col("n"), F.col("b.size")).alias("parts"), blocks(F.col("n") - F.col("b.main.n"), F.col("b.size") - F.col("b.main.size")).alias("turns"))
    met = at.join(open_bands, "band")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    of = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n))
    own = met.select("band", of("parts", 2).alias("part"), every("turns").alias("turn"), "node", "root", F.lit(False).alias("asks"))
    outside = met.where("root != main").select("band", every("parts").alias("part"), of("turns", 3).alias("turn"), "node", "root", F.lit(True).alias("asks"))

    def join(group: pa.Table) -> pa.Table:
        nodes, roots_of, asks = group["node"].to_numpy(), group["root"].to_numpy(), group["asks"].to_numpy(zero_copy_only=False)
        held = [np.asarray(x) for x in group["s"].to_numpy()]
        inside, asked = np.nonzero(~asks)[0], np.nonzero(asks)[0]
        pairs: tuple[list[int], list[int]] = ([], [])
        if len(inside) and len(asked):
            n = np.array([len(held[i]) for i in inside])
            flat = np.concatenate([held[i] for i in inside])
            owner, order = np.repeat(np.arange(len(inside)), n), np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            label = {r: k for k, r in enumerate(np.unique(roots_of))}
            label_of = np.array([label[r] for r in roots_of])
            forest = Forest(len(label))
            for i in asked.tolist():
                lo, hi = np.searchsorted(flat, held[i], "left"), np.searchsorted(flat, held[i], "right")
                hits = np.concatenate([owner[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if b > a] or [owner[:0]])
                both = np.bincount(hits, minlength=len(inside))
                found = np.nonzero(100 * both >= percent * (n + len(held[i]) - both))[0]
                for j in inside[found].tolist():
                    if forest.label[label_of[i]] != forest.label[label_of[j]]:
                        forest.join(label_of[[i]], label_of[[j]])
                        pairs[0].append(nodes[i])
                        pairs[1].append(nodes[j])
        return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})

    return own.unionByName(outside).join(sets, "node").groupBy("band", "part", "turn").applyInArrow(join, "a long, b long")


def similar_roots(docs: DataFrame, marked: DataFrame, percent: int, words_per_shingle: int, id_col: str, text_col: str, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """node and ``root`` for the nodes of ``marked`` that some link joins, and ``nodes`` (node, first row).
    ``near``: of a table of distinct ``fp``, its links (a, b); what it gives is compared exactly like all else."""
    nodes = written(marked.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "key")).alias("first"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    each = nodes.select("node", "size", F.explode("bands").alias("band"))
    shared = written(each.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = written(each.join(shared, "band"))
    met, pairs = members.select("node"), _with_hubs(members)
    if near:
        close_by = written(_near(nodes, near))
        met, pairs = met.union(close_by.select(F.explode(F.array("a", "b")))), pairs.union(close_by).distinct()
    keys = nodes.join(met.distinct(), "node", "left_semi").select("first.key")
    sets = written(_sets(docs, keys, words_per_shingle, id_col, text_col))
    a, b = (sets.select(F.col("node").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    compared = pairs.join(a, "a").join(b, "b")
    close = _similar(F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb"), percent)
    links = written(compared.where(close).select("a", "b"))
    rest = written(_rest_links(members, components(links), sets, percent, block, block_shingles))
    return components(links.unionByName(rest)), nodes


def keep_one(docs: DataFrame, percent: int = 80, words_per_shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``docs`` with one document (the smallest id) of each group that is linked, directly or over others, by
    shingle sets with a Jaccard similarity of ``percent`` or more; of repeated rows one stays."""
    marked = written(_marked(docs, words_per_shingle, id_col, text_col))
    roots, nodes = similar_roots(docs, marked, percent, words_per_shingle, id_col, text_col, block, block_shingles, near)
    rooted = nodes.join(roots, "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    return keep_rows(docs, rooted.groupBy("root").agg(F.min("first").alias("f")).select("f.key"), id_col, text_col)
