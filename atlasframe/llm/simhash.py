"""Near-duplicates by 64-bit SimHash fingerprints, joined through vantage-point trees.

A small tree, fitted on a bounded sample of fingerprints, cuts Hamming space into shards; every
fingerprint has one home shard and visits those others that the triangle bound can't rule out.  Each
shard joins its own points with its points and visitors, with a tree of its own, and reports a
spanning forest of the links it found, never all pairs of a group.  Connected components then run as
star contractions over those links.

A null or blank text has fingerprint zero and is linked like any other.  Rows without an id take part
and get their group's smallest id (null if none has one).  Repeated rows get equal results.  An empty
table gives an empty result.  Input columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import neardup
from .common import keep_rows, row_identity, slices, written
from .graph import Forest, components

#: Fingerprints for each shard that the shards' tree is fitted on.
SAMPLE = 16
#: Distinct fingerprints, at most, that a shard is meant to hold: 8 MB of them.  Fewer and larger shards
#: mean fewer visits, so memory alone bounds them, but work is dealt to SPREAD shards if they get LEAST each.
SHARD_POINTS, SPREAD, LEAST = 1 << 20, 24, 4_096
_BLOCK = 512
_SLICE = 65_536


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """The fingerprint as an unsigned integer: a bit is set if over half the shingles' XXH64 have it."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: 1 - words_per_shingle], ends[words_per_shingle - 1 :]
    total, bits = len(starts), np.zeros(64, dtype=np.int64)
    for at in range(0, total, _SLICE):
        a, z = starts[at : at + _SLICE].tolist(), ends[at : at + _SLICE].tolist()
        shingles = map(joined.__getitem__, map(slice, a, z))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype=np.uint64, count=len(a))
        bits += neardup.bit_counts(hashes)
    return neardup.majority(bits, total)


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``fp``, the fingerprint as a signed 64-bit integer."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.fromiter((fingerprint(t, words_per_shingle) for t in batch.column(1).to_pylist()), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _split(points: np.ndarray, reach: int) -> tuple[np.uint64, int] | None:
    """A vantage point and radius that halve ``points`` with few of them within ``reach`` of the border."""
    best = None
    for vantage in points[:: max(1, len(points) // 8)][:8]:
        d = np.sort(np.bitwise_count(points ^ vantage))
        radius = int(d[(len(d) - 1) // 2])
        inner = int(np.searchsorted(d, radius, side="right"))
        if inner == len(d):
            radius -= 1
            inner = int(np.searchsorted(d, radius, side="right"))
        if 0 < inner < len(d):
            cost = max(inner, len(d) - inner) + int(((d > radius) & (d <= radius + reach)).sum())
            if best is None or cost < best[0]:
                best = (cost, vantage, radius)
    return best and (best[1], best[2])


def fit_tree(sample: np.ndarray, shards: int, reach: int = 2) -> list:
    """Nodes [vantage, radius, inner, outer]; a child of -1 - s is shard s."""
    nodes: list = []
    leaves = 0

    def grow(points: np.ndarray, parts: int) -> int:
        nonlocal leaves
        found = _split(points, reach) if parts > 1 and len(points) >= 8 else None
        if found is None:
            leaves += 1
            return -leaves
        near = np.bitwise_count(points ^ found[0]) <= found[1]
        nodes.append([int(found[0]), found[1], 0, 0])
        at = len(nodes) - 1
        half = min(parts - 1, max(1, round(parts * near.mean())))
        nodes[at][2], nodes[at][3] = grow(points[near], half), grow(points[~near], parts - half)
        return at

    root = grow(sample, shards)
    return [root, nodes]


def _routes(tree: list, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(shard, indices, home) for ``points``: each is at home once.

    Of two linked points on either side of a border the outer one visits the inner side, so no pair
    is missed; visitors may go both ways.
    """
    root, nodes = tree
    stack = [(root, np.arange(len(points)), True)]
    while stack:
        at, idx, home = stack.pop()
        if not len(idx):
            continue
        if at < 0:
            yield -1 - at, idx, home
            continue
        vantage, mu, inner, outer = nodes[at]
        d = np.bitwise_count(points[idx] ^ np.uint64(vantage)).astype(np.int64)
        if home:
            stack += [(inner, idx[d <= mu], True), (outer, idx[d > mu], True), (inner, idx[(d > mu) & (d <= mu + radius)], False)]
        else:
            stack += [(inner, idx[d <= mu + radius], False), (outer, idx[d > mu - radius], False)]


def _link_within(points: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (two index arrays) of the links that touch a home point."""
    forest = Forest(len(points))
    stack = [(np.nonzero(home)[0], np.arange(len(points)))]
    while stack:
        own, others = stack.pop()
        if not len(own) or not len(others):
            continue
        found = _split(points[own], radius) if len(own) > _BLOCK else None
        if found is None:
            for at in range(0, len(own), _BLOCK):
                block = own[at : at + _BLOCK]
                for to in range(0, len(others), 64 * _BLOCK):
                    part = others[to : to + 64 * _BLOCK]
                    i, j = np.nonzero(np.bitwise_count(points[block][:, None] ^ points[part][None, :]) <= radius)
                    forest.join(block[i], part[j])
            continue
        d, e = (np.bitwise_count(points[x] ^ found[0]).astype(np.int64) for x in (own, others))
        stack += [(own[d <= found[1]], others[e <= found[1] + radius]), (own[d > found[1]], others[e > found[1] - radius])]
    node = np.nonzero(forest.label != np.arange(len(points)))[0]
    return forest.label[node], node


def links(distinct: DataFrame, radius: int = 2, shard_points: int = SHARD_POINTS, least: int = LEAST, sample: int = SAMPLE) -> DataFrame:
    """Links (a, b) between distinct fingerprints at most ``radius`` apart: a spanning forest of each
    shard's, so that the components are those of all links.  ``distinct``: column ``fp``, no repeats."""
    n = distinct.count()
    shards = max(1, -(-n // shard_points), min(SPREAD, -(-n // least)))
    drawn = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample * shards)
    points = np.array([r["fp"] for r in drawn.collect()], dtype=np.int64).view(np.uint64)
    tree = fit_tree(points, shards, radius)
    routed = "shard int, fp long, home boolean"

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            routes = list(_routes(tree, fps, radius))
            if routes:
                long = [len(idx) for _, idx, _ in routes]
                shard, home = (np.repeat(np.array([r[k] for r in routes], kind), long) for k, kind in ((0, np.int32), (2, bool)))
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fps[np.concatenate([idx for _, idx, _ in routes])].view(np.int64)), pa.array(home)], ["shard", "fp", "home"])

    def join(group: pa.Table) -> pa.Table:
        fps, home = group["fp"].to_numpy().view(np.uint64), group["home"].to_numpy(zero_copy_only=False)
        a, b = _link_within(fps, home, radius)
        return pa.table({"a": fps[a].view(np.int64), "b": fps[b].view(np.int64)})

    return distinct.select("fp").mapInArrow(route, routed).groupBy("shard").applyInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, words_per_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", shard_points: int = SHARD_POINTS, least: int = LEAST) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id (smallest id linked directly or over others)."""
    marked = written(fingerprints(docs, words_per_shingle, id_col, text_col))
    nodes = written(marked.groupBy("fp").agg(F.min(id_col).alias("first")))
    roots = components(links(nodes, radius, shard_points, least))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    of = rooted.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "r")
    by_fp = rooted.join(of, rooted.root == of.r).select("fp", "component_id")
    return marked.join(by_fp, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 2, words_per_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document (the smallest id; rows without one come last) of each group; of repeated
    rows (same id and text) one stays."""
    keyed = docs.select(F.col(id_col).alias("id"), F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"), row_identity(id_col, text_col).alias("key")).alias("row"), F.col(text_col).alias("text"))
    rows = written(fingerprints(keyed, words_per_shingle, "row", "text"))
    nodes = written(rows.groupBy("fp").agg(F.min("row").alias("first")))
    rooted = nodes.join(components(links(nodes, radius)).withColumnRenamed("node", "fp"), "fp", "left").select("first", F.coalesce("root", "fp").alias("root"))
    return keep_rows(docs, rooted.groupBy("root").agg(F.min("first").alias("f")).select("f.key"), id_col, text_col)


def keep_similar(docs: DataFrame, percent: int = 80, words_per_shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """``docs`` with one document (the smallest id) of each group linked by a Jaccard similarity of their
    shingle sets of ``percent`` or more.  Fingerprints at most ``radius`` apart are found through the trees and
    compared exactly; pairs that similar further apart, which no radius that trees can prune finds, see ``neardup``."""
    return neardup.keep_one(docs, percent, words_per_shingle, id_col, text_col, near=partial(links, radius=radius))
