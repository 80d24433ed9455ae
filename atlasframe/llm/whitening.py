"""Whitening of embeddings by a covariance that is computed in tiles.

Entries become integers: floor(scale * c) + shift.  The fit list has each distinct vector once.  Its
dimensions are cut into tiles; a row block (a part of the fit list, by hash) sends its columns of tiles
I and J to the tile key (block, I, J), a task multiplies the two centred column blocks, and the products
are summed by tile.  A pair's columns travel in one row, so a task that is run again can't pair columns
of different rows.  The driver gets dims * dims sums (``MOST_DIMS`` bounds them), puts the covariance
together and decomposes it.  Rows are then projected where they lie.

Vectors that are null, or hold a null or non-finite entry, are dropped.  Vectors of different lengths
are whitened apart, each length by its own fit list; empty vectors give no rows.  Entries beyond 2**61
after scaling count as that.  Repeated vectors count once in the fit and get their rows each; a null id
stays.  A component without variance has null ``whitened`` and stays out of ``identity_error``;
``explained`` is null where nothing varies.  ``deviation`` is null where it doesn't fit a long.  An empty table gives an empty result.
Input columns other than the id and the vector are ignored, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Dimensions of a tile at least, tiles a side at most, and rows of a block on average.
TILE, SIDE, BLOCK_ROWS = 32, 4, 16_384
#: Dimensions at most: the driver holds the square of it.
MOST_DIMS = 8_192
_LIMIT = 2.0**61


@dataclass(frozen=True)
class Fit:
    """What the distinct vectors of one length have in common: their number, the sums of their entries, the
    components (a column each, by falling eigenvalue), eigenvalues and trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def middles(self) -> list[int]:
        """The integers next to the means: what is taken off before anything is multiplied."""
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    def rest(self) -> np.ndarray:
        """Means less ``middles``."""
        return np.array([(s - m * self.n) / self.n for s, m in zip(self.sums, self.middles, strict=True)])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array(self.middles, dtype=np.int64)).astype(np.float64) - self.rest()

    def scales(self) -> np.ndarray:
        """The root of each eigenvalue; not a number where a component has no variance."""
        least = max(self.trace, 0.0) * 1e-12
        return np.sqrt(np.where(self.eigenvalues > least, self.eigenvalues, np.nan))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / self.scales()

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - sum) ** 2, exactly."""
        far = x - np.array(self.middles, dtype=np.int64)
        rest = [s - m * self.n for s, m in zip(self.sums, self.middles, strict=True)]
        rough = self.n * np.abs(far).max(axis=1, initial=0).astype(np.float64) + self.n
        small = rough**2 * max(1, x.shape[1]) < 2.0**62
        out: list[int | None] = [None] * len(x)
        exact = ((self.n * far[small] - np.array(rest, dtype=np.int64)) ** 2).sum(axis=1).tolist() if small.any() else []
        for k, v in zip(np.flatnonzero(small).tolist(), exact, strict=True):
            out[k] = v
        for k in np.flatnonzero(~small).tolist():
            v = sum((self.n * int(a) - r) ** 2 for a, r in zip(far[k], rest, strict=True))
            out[k] = v if v < 2**63 else None
        return out


def _entries(vector: Column, scale: int, shift: int) -> Column:
    def of(c: Column) -> Column:
        scaled = F.floor(F.lit(float(scale)) * c.cast("double"))
        return F.when(F.abs(c.cast("double") * scale) < _LIMIT, scaled).otherwise(F.lit(int(_LIMIT)) * F.signum(c.cast("double")).cast("long")) + F.lit(shift).cast("long")

    return F.transform(vector, of)


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """id, dims and x, the integer entries, of the rows that take part."""
    bad = F.exists(F.col(vec_col), lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    good = F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ~F.coalesce(bad, F.lit(False))
    return rows.where(good).select(F.col(id_col).alias("id"), F.size(vec_col).alias("dims"), _entries(F.col(vec_col), scale, shift).alias("x"))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _tiles(dims: int) -> list[tuple[int, int]]:
    """First dimension and width of each tile."""
    width = max(TILE, -(-dims // SIDE))
    return [(a, min(width, dims - a)) for a in range(0, dims, width)]


def _sums(fit_list: DataFrame) -> dict[int, tuple[int, tuple[int, ...]]]:
    """For each length the number of vectors and the sums of their entries."""
    each = fit_list.select("dims", F.posexplode("x").alias("at", "c"))
    found: dict[int, dict[int, tuple[int, int]]] = {}
    for r in each.groupBy("dims", "at").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c").cast("decimal(19,0)")).alias("s")).toLocalIterator():
        if r["dims"] > MOST_DIMS:
            raise ValueError(f"vectors of {r['dims']} dimensions: the covariance of over {MOST_DIMS} isn't held by the driver")
        found.setdefault(r["dims"], {})[r["at"]] = (r["n"], int(r["s"]))
    return {d: (of[0][0], tuple(of[k][1] for k in range(d))) for d, of in found.items()}


def tiled_covariance(fit_list: DataFrame, sums: dict[int, tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """The covariance (divisor n) of the vectors of each length, computed tile by tile."""
    centres = {d: Fit(n, s, np.zeros((d, 0)), np.zeros(0), 0.0) for d, (n, s) in sums.items()}
    tiles = {d: _tiles(d) for d in sums}
    blocks = max(1, -(-sum(n for n, _ in sums.values()) // BLOCK_ROWS))
    keys = F.lit(None)
    for d, cuts in tiles.items():
        pairs = [(i, j) for i in range(len(cuts)) for j in range(i, len(cuts))]
        listed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])
        keys = F.when(F.col("dims") == d, listed).otherwise(keys)
    cut = lambda k: F.slice("x", _first(k, tiles) + 1, _width(k, tiles))
    paired = fit_list.withColumn("block", F.pmod(F.xxhash64("x"), F.lit(blocks)).cast("int")).withColumn("_key", F.explode(keys))
    blocked = paired.select("dims", "block", F.col("_key.i").alias("i"), F.col("_key.j").alias("j"), "x").select(
        "dims", "block", "i", "j", cut("i").alias("left"), F.when(F.col("i") != F.col("j"), cut("j")).alias("right")
    )

    def multiply(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        d, _, i, j = (k.as_py() for k in key)
        centre, (a, wide), (b, high) = centres[d], tiles[d][i], tiles[d][j]
        middles, rest = np.array(centre.middles, dtype=np.int64), centre.rest()
        left = (_matrix(group["left"], wide) - middles[a : a + wide]).astype(np.float64) - rest[a : a + wide]
        right = left if i == j else (_matrix(group["right"], high) - middles[b : b + high]).astype(np.float64) - rest[b : b + high]
        product = left.T @ right
        at = np.indices(product.shape)
        columns = [np.full(product.size, d), at[0].ravel() + a, at[1].ravel() + b]
        return pa.table([*[pa.array(c.astype(np.int32)) for c in columns], pa.array(product.ravel())], ["dims", "row", "col", "product"])

    products = blocked.groupBy("dims", "block", "i", "j").applyInArrow(multiply, "dims int, row int, col int, product double")
    out = {d: np.zeros((d, d)) for d in sums}
    for r in products.groupBy("dims", "row", "col").agg(F.sum("product").alias("s")).toLocalIterator():
        out[r["dims"]][r["row"], r["col"]] = out[r["dims"]][r["col"], r["row"]] = r["s"] / sums[r["dims"]][0]
    return out


def _first(k: str, tiles: dict[int, list[tuple[int, int]]]) -> Column:
    return F.col(k) * _by_dims({d: cuts[0][1] for d, cuts in tiles.items()})


def _width(k: str, tiles: dict[int, list[tuple[int, int]]]) -> Column:
    return _by_dims({d: cuts[0][1] for d, cuts in tiles.items()})


def _by_dims(values: dict[int, int]) -> Column:
    out = F.lit(0)
    for d, v in values.items():
        out = F.when(F.col("dims") == d, F.lit(v)).otherwise(out)
    return out


def fit(vectors: DataFrame, components: int = 16) -> dict[int, Fit]:
    """A ``Fit`` for each length of the vectors of ``integer_vectors``, with up to so many components."""
    fit_list = written(vectors.select("dims", "x").distinct())
    sums = _sums(fit_list)
    found = {}
    for d, v in (tiled_covariance(fit_list, sums) if sums else {}).items():
        values, columns = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:components]
        found[d] = Fit(*sums[d], columns[:, order], values[order], float(np.trace(v)))
    errors = _identity_errors(fit_list, found) if found else {}
    forget(fit_list)
    return {d: Fit(f.n, f.sums, f.components, f.eigenvalues, f.trace, errors.get(d)) for d, f in found.items()}


def _identity_errors(fit_list: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """How far the whitened vectors' own covariance is from the identity: products of a batch, summed."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for d in np.unique(dims).tolist():
                w = fits[d].whitened(_matrix(batch.filter(pa.array(dims == d)).column(1), d))
                w = np.c_[w, np.ones(len(w))]  # the last row and column are sums
                product = w.T @ w
                at = np.indices(product.shape)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(product.size, d, dtype=np.int32)), pa.array(at[0].ravel().astype(np.int32)), pa.array(at[1].ravel().astype(np.int32)), pa.array(product.ravel())], ["dims", "row", "col", "product"])

    found = {d: np.zeros((len(f.eigenvalues) + 1,) * 2) for d, f in fits.items()}
    for r in fit_list.mapInArrow(products, "dims int, row int, col int, product double").groupBy("dims", "row", "col").agg(F.sum("product").alias("s")).toLocalIterator():
        found[r["dims"]][r["row"], r["col"]] = r["s"] / fits[r["dims"]].n
    out = {}
    for d, m in found.items():
        off = np.abs(m[:-1, :-1] - np.outer(m[:-1, -1], m[:-1, -1]) - np.eye(len(m) - 1))
        if np.isfinite(off).any():
            out[d] = float(np.nanmax(off))
    return out


def whiten(vectors: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """id, n, deviation, ``whitened`` (a value for each component; null without variance), ``explained`` and identity_error of every vector."""
    kind = vectors.schema["id"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                f, x = fits[d], _matrix(part.column(2), d)
                w = f.whitened(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), pa.array(w.ravel(), pa.float64(), from_pandas=True))
                shares = [float(v) / f.trace if f.trace > 0 else None for v in f.eigenvalues]
                same = lambda value, of: pa.array([value] * len(x), of)  # noqa: B023, E731
                columns = [part.column(0), same(f.n, pa.int64()), pa.array(f.deviations(x), pa.int64()), lists, same(shares, pa.list_(pa.float64())), same(f.identity_error, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select("id", "dims", "x").mapInArrow(project, f"id {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
