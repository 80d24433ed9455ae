"""Exact top-k search by inner product over an impact-ordered index.

Vectors are dealt to blocks; a block's index, built once, holds the postings (row and quantised value) of
each dimension in segments of one value.  A segment's impact for a query is the size of what its value
contributes to the score.  Segments of all dimensions are processed in batches of falling impact: a batch
is everything down to the next level, and adds the contributions to the rows' scores so far.  Segments
of a dimension lie in order of value, so a batch takes a stretch at each end.  What a row can still gain
or lose is bounded by the sum of the dimensions' next impacts.  A query stops once the rows that these
bounds leave possible are few, or all segments are done; the possible rows are scored exactly.  Nothing
is dropped without that proof.

Vectors that are null, or hold a null or non-finite component, and rows without an id take no part.
Components may be of any size: rows and queries whose sums could pass 2**52 are scored in whole numbers
of any length instead, and only pairs whose score doesn't fit a long are left out.  Vectors are compared
with those of the same length only.  Repeated rows are candidates each on its own; a query that is
repeated is asked once.  Rows with the query's id are no candidates.  Equal scores go to the smaller id.
An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices

#: Rows of a block of the index at most, and at least where there are fewer than TASKS blocks.
BLOCK_ROWS, LEAST_ROWS, TASKS = 65_536, 16_384, 24
#: Queries that are taken from a task's input at once.
QUERIES = 512
#: Levels of the batches, as parts of the largest impact; what is possible after the last is scored exactly.
LEVELS = (0.2, 0.06, 0.014)
#: A query stops when no more than one row in so many is possible.
STOP_PART = 8
#: Queries that go through the segments together, and rows at a time, so that their scores stay in a core's cache.
TOGETHER, ROWS = 16, 2_048
#: Values below this are indexed; a row with a larger one is scored by itself.
_ORDINARY, _EXACT = 2.0**24, 2.0**52


class ImpactIndex:
    """The segments of a block, by dimension and value, and the segment that each row is in for each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        outsized = (np.abs(vectors) >= _ORDINARY).any(axis=1)
        self.far_ids, self.far = ids[outsized], vectors[outsized]
        self.ids, self.vectors = ids[~outsized], np.ascontiguousarray(vectors[~outsized])
        self.dims = vectors.shape[1]
        self.peaks = np.abs(self.vectors).max(axis=0, initial=0)
        found = [np.unique(c, return_inverse=True, return_counts=True) for c in self.vectors.T]
        self.counts = np.array([len(v) for v, _, _ in found], dtype=np.int64)  # segments of each dimension
        self.offsets = np.cumsum(self.counts) - self.counts
        self.segments = np.concatenate([np.zeros(0), *[v for v, _, _ in found]])
        self.sizes = np.concatenate([np.zeros(0, np.int64), *[s for _, _, s in found]])
        self.segment_of = [at.ravel() + first for (_, at, _), first in zip(found, self.offsets.tolist(), strict=True)]
        self.processed = 0  # postings

    def search(self, own: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query ids and scores of the ``k`` best rows but those with its own id, best first."""
        weights = np.abs(queries) @ self.peaks
        indexed = np.flatnonzero(weights < _EXACT)
        found: dict[int, np.ndarray] = {}
        for at in range(0, len(indexed), TOGETHER):
            part = indexed[at : at + TOGETHER]
            skipped = np.searchsorted(self.ids, own[part], "right") - np.searchsorted(self.ids, own[part], "left")
            found |= zip(part.tolist(), self.possible(queries[part], k + skipped), strict=True)
        return [self._best(int(i), q, found.get(r), k) for r, (i, q) in enumerate(zip(own.tolist(), queries, strict=True))]

    def _best(self, own: int, query: np.ndarray, found: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best of the rows that are possible; without an answer of the index, of all rows."""
        if found is not None:
            far_ids, far = _whole_scores(self.far_ids, self.far, query)
            ids, scores = np.r_[self.ids[found], far_ids], np.r_[(self.vectors[found] @ query).astype(np.int64), far]
        else:
            ids, scores = _whole_scores(np.r_[self.ids, self.far_ids], np.r_[self.vectors, self.far], query)
        ids, scores = ids[ids != own], scores[ids != own]
        if len(scores) > 4 * k:
            top = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            ids, scores = ids[top], scores[top]
        best = np.lexsort((ids, ~scores))[:k]  # ~ turns the order round, without overflow
        return ids[best], scores[best]

    def possible(self, queries: np.ndarray, want: np.ndarray) -> list[np.ndarray]:
        """For each query the rows that may be among its ``want`` best: a proven superset."""
        n = len(self.ids)
        found = [np.arange(n)] * len(queries)
        gains = self.segments[:, None] * np.repeat(queries.T, self.counts, axis=0)
        impacts = np.abs(gains)
        tops = impacts.max(axis=0, initial=0.0)
        live = np.flatnonzero(tops) if n else np.zeros(0, np.int64)
        gains, impacts, tops = gains[:, live], impacts[:, live], tops[live]
        kind = np.float32 if float((np.abs(queries) @ self.peaks).max(initial=0.0)) < 2.0**23 else np.float64  # sums of whole numbers stay exact
        scores, done = np.zeros((n, len(live)), kind), impacts == 0
        for level in LEVELS:
            if not len(live):
                break
            batch = (impacts >= level * tops) & ~done
            done |= batch
            gained, part = np.where(batch, gains, 0.0).astype(kind, order="C"), np.empty((ROWS, len(live)), kind)
            reached = np.flatnonzero(np.logical_or.reduceat(batch.any(axis=1), self.offsets)).tolist()
            for at in range(0, n, ROWS):
                here = scores[at : at + ROWS]
                for d in reached:
                    here += np.take(gained, self.segment_of[d][at : at + ROWS], axis=0, out=part[: len(here)], mode="clip")
            self.processed += int((self.sizes @ batch).sum())
            rest = np.maximum.reduceat(np.where(done, 0.0, impacts), self.offsets, axis=0).sum(axis=0)
            going = []
            for c, (i, r) in enumerate(zip(live.tolist(), rest.tolist(), strict=True)):
                own, least = np.ascontiguousarray(scores[:, c]), min(n, int(want[i]))
                found[i] = np.flatnonzero(own >= np.partition(own, n - least)[n - least] - 2 * r)
                if len(found[i]) > max(8 * least, n // STOP_PART):
                    going.append(c)
            live, gains, impacts, tops, scores, done = live[going], gains[:, going], impacts[:, going], tops[going], np.ascontiguousarray(scores[:, going]), done[:, going]
        return found


def _whole_scores(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores in whole numbers of any length, those that fit a long."""
    q = [int(x) for x in query.tolist()]
    scores = [sum(int(a) * b for a, b in zip(v, q, strict=True)) for v in vectors.tolist()]
    fits = [k for k, s in enumerate(scores) if -(2**63) <= s < 2**63]
    return ids[fits], np.array([scores[k] for k in fits], dtype=np.int64)


def _impacts(of: Column, scale: int) -> Column:
    def one(x: Column) -> Column:
        scaled = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(scaled) < _EXACT, F.floor(scaled).cast("double")).otherwise(scaled)  # beyond, all doubles are whole

    return F.transform(of, one)


def impact_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """id and ``v``, the quantised impacts (whole numbers as doubles), of the rows that take part."""
    bad = F.exists(F.col(vec_col), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double") * scale) == float("inf")))
    good = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.coalesce(bad, F.lit(False))
    return rows.where(good).select(F.col(id_col).cast("long").alias("id"), _impacts(F.col(vec_col), scale).alias("v"))


_FOUND = ["query_id", "key", "vec_id", "score"]


def _searching(k: int):
    """A function over a task's rows, sorted by (dims, block, asks): a block's vectors come before the queries
    that are asked of it, which pass by in small batches."""

    def matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
        return batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[int, int] | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        index: ImpactIndex | None = None
        for batch in slices(batches, QUERIES):
            dims, blocks, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2))
            edges = np.flatnonzero(np.r_[True, (dims[1:] != dims[:-1]) | (blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1]), True]).tolist()
            for a, z in zip(edges, edges[1:], strict=False):
                part = batch.slice(a, z - a)
                key = (int(dims[a]), int(blocks[a]))
                if key != now:
                    now, held, index = key, [], None
                ids, vectors = part.column(3).to_numpy(), matrix(part, key[0])
                if not asks[a]:
                    held.append((ids, vectors))
                    continue
                if index is None and held:
                    index, held = ImpactIndex(*[np.concatenate(c) for c in zip(*held, strict=True)]), []
                if index is None:
                    continue
                out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in _FOUND]
                for own, hashed, (found, scores) in zip(ids.tolist(), part.column(5).to_pylist(), index.search(ids, vectors, k), strict=True):
                    for column, x in zip(out, (np.full(len(found), own), np.full(len(found), hashed), found, scores), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], _FOUND)

    return run


def top_k(index: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's ``k`` best rows.

    ``index`` and ``queries`` have columns id and v.  A row goes to one block, whose index one task
    builds once; queries are copied to every block and pass by the index, a batch in memory at a time.
    What a block finds for a query, ``k`` rows at most, is merged at the end.
    """
    rows = index.count()
    blocks = max(1, -(-rows // block_rows), min(TASKS, -(-rows // LEAST_ROWS)))
    hashed = F.xxhash64("v").alias("key")
    data = index.select(F.size("v").alias("dims"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.lit(False).alias("asks"), "id", "v", hashed)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    asks = queries.distinct().select(F.size("v").alias("dims"), every.alias("block"), F.lit(True).alias("asks"), "id", "v", hashed)
    met = data.unionByName(asks).repartition(blocks, "dims", "block").sortWithinPartitions("dims", "block", "asks")
    found = met.mapInArrow(_searching(k), ", ".join(f"{n} long" for n in _FOUND))
    best = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
