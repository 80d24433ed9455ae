"""Reading a bundle, or its column files, in ranges of bytes.

Rows of the format are of no fixed size, so a reader can begin nowhere but at a section's begin.  An
index beside the file, one row for each BLOCK rows of the cities, makes every block a place to begin: it
has the offset of the block's keys and tokens, the key and ids before it, and its first key.  Writing a
bundle computes the index in the tasks that encode it; for a bundle from elsewhere one scan makes it.

With it, a scan is many tasks, each reading its own ranges, and a condition on the key (equality, a
list, bounds, a prefix) that ``read_ranges`` is given is a binary search over the blocks' first keys: blocks
that can't hold such a key are never read.  A later ``where`` reads all blocks: Spark 4.1 keeps what it pushed
into a Python source at the relation's last scan for all scans of that relation, so pushing loses rows.
Ranges are read through Arrow's file systems on the workers; a store that only Spark
reads, and a bundle without an index, are parsed whole (``bundle.read_bundle``).
"""

from __future__ import annotations

import json
import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.window import Window

from ..functions.codec import MAX_PART
from . import bundle

#: Rows of a block, and blocks of a task.
BLOCK, TASK_BLOCKS = 4_096, 16
#: What is appended to a bundle's path for its index.
SUFFIX = ".index"
#: Bytes that are fetched at once where the end isn't known.
_CHUNK = 1 << 16
_INDEX = "block long, row long, rows int, first_key string, before_key string, keys_at long, tokens_at long, region_before int, country_before int"
_LAST = "\U0010ffff"


def open_file(path: str) -> pa.NativeFile:
    """The file at ``path``, for reading at any place."""
    from pyarrow import fs

    if "://" in path:
        store, path = fs.FileSystem.from_uri(path)
    else:
        store, path = fs.LocalFileSystem(), path.removeprefix("file:")
    return store.open_input_file(path)


@dataclass(frozen=True)
class Layout:
    """Where a bundle's parts are: header counts, the vocabulary's place, place and size of each section's rows."""

    counts: tuple[int, int, int, int]
    vocabulary: tuple[int, int]
    sections: dict[str, tuple[int, int]]


def _exactly(f: pa.NativeFile, n: int, at: int) -> bytes:
    data = f.read_at(n, at) if n else b""
    if len(data) != n:
        raise bundle.BundleError(f"{n} bytes wanted at {at}, {len(data)} there")
    return data


def layout(f: pa.NativeFile) -> Layout:
    """Found by the sizes alone: the header, the vocabulary and each section's size are read, no rows."""
    head = _exactly(f, bundle.HEADER_BYTES, 0)
    if head[:8] != bundle.MAGIC:
        raise bundle.BundleError(f"not a bundle: it begins with {head[:8]!r}")
    counts = struct.unpack("<4I", head[8:24])
    at, kept, data = bundle.HEADER_BYTES, 0, b""  # ``data`` is what is at ``at`` + ``kept``
    for _ in range(counts[0]):
        if kept + 258 > len(data):
            at, data, kept = at + kept, f.read_at(_CHUNK, at + kept), 0
        if kept + 3 > len(data) or kept + 3 + data[kept + 2] > len(data):
            raise bundle.BundleError(f"vocabulary: it ends at {at + len(data)}")
        kept += 3 + data[kept + 2]
    vocabulary, at = (bundle.HEADER_BYTES, at + kept - bundle.HEADER_BYTES), at + kept
    sections = {}
    for name in bundle.SECTIONS:
        (size,) = struct.unpack("<I", _exactly(f, 4, at))
        if size < 4 or at + 4 + size > f.size():
            raise bundle.BundleError(f"{name}: {size} bytes at {at + 4}, the file has {f.size()}")
        sections[name] = (at + 8, size - 4)
        at += 4 + size
    return Layout(counts, vocabulary, sections)


# ---- the index

def index_of(placed: DataFrame, keys: DataFrame, tokens: DataFrame, block: int = BLOCK) -> DataFrame:
    """The index from the rows that a bundle is written of: ``placed`` (pos, geohash, region_id, country_id)
    and the encoded ``keys`` and ``tokens`` (pos, data).  A block is one small row in every shuffle."""

    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.floor(F.col("pos") / block).alias("block")).agg(F.sum(F.octet_length("data")).alias(name))

    ends = placed.groupBy(F.floor(F.col("pos") / block).alias("block")).agg(
        F.min("pos").alias("row"),
        F.count(F.lit(1)).cast("int").alias("rows"),
        F.min_by("geohash", "pos").alias("first_key"),
        F.max_by(F.struct("geohash", "region_id", "country_id"), "pos").alias("last"),
    )
    each = ends.join(sizes(keys, "_keys"), "block").join(sizes(tokens, "_tokens"), "block")
    w = Window.orderBy("block")  # a row for each block
    so_far = lambda c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    before = lambda c, none: F.coalesce(F.lag("last").over(w)[c], F.lit(none))
    return each.select("block", "row", "rows", "first_key", before("geohash", "").alias("before_key"), so_far("_keys").alias("keys_at"), so_far("_tokens").alias("tokens_at"), before("region_id", 0).cast("int").alias("region_before"), before("country_id", 0).cast("int").alias("country_before"))


def save_index(index: DataFrame, path: str) -> None:
    """Write the index of the bundle at ``path`` beside it."""
    index.orderBy("block").coalesce(1).write.mode("overwrite").parquet(path + SUFFIX)


def scanned_index(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """The index of a bundle that has none: one task walks over the sizes of its rows, as the format allows no other way."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for _ in batches:
            places = layout(open_file(path))
            names = ("geohash", "region_id", "country_id", "city_tokens")
            files = []
            for name in names:
                files.append(io.BufferedReader(open_file(path), 1 << 20))
                files[-1].seek(places.sections[name][0])
            keys, regions, countries, tokens = files
            key, region, country, keys_at, tokens_at = "", 0, 0, 0, 0
            for row in range(0, places.counts[1], block):
                n = min(block, places.counts[1] - row)
                start = [row // block, row, n, None, key, keys_at, tokens_at, region, country]
                for k in range(n):
                    (sizes,) = keys.read(1)
                    key = key[: sizes >> 4] + keys.read(sizes & 15).decode("ascii")
                    keys_at += 1 + (sizes & 15)
                    (size,) = tokens.read(1)
                    tokens.seek(size, 1)
                    tokens_at += 1 + size
                    if k == 0:
                        start[3] = key
                region += int(np.frombuffer(regions.read(2 * n), "<i2").sum())
                country += int(np.frombuffer(countries.read(2 * n), "<i2").sum())
                yield pa.RecordBatch.from_pylist([dict(zip(_arrow_index().names, start, strict=True))], schema=_arrow_index())

    return spark.range(0, 1, 1, 1).mapInArrow(scan, _INDEX)


def _arrow_index() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in _INDEX.split(", "))])


def has_index(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path + SUFFIX + "/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def reachable(path: str) -> bool:
    """Whether Arrow has a file system for ``path``."""
    from pyarrow import fs

    try:
        return "://" not in path or fs.FileSystem.from_uri(path) is not None
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def _read_index(path: str) -> list[dict]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return sorted(pq.read_table(where, filesystem=store).to_pylist(), key=lambda b: b["block"])


# ---- conditions on keys

@dataclass(frozen=True)
class KeyRange:
    """Keys from ``low`` to ``high``, both included."""

    low: str = ""
    high: str = _LAST

    def meet(self, other: KeyRange) -> KeyRange:
        return KeyRange(max(self.low, other.low), min(self.high, other.high))


def ranges_of(filters: Iterable[Filter]) -> list[KeyRange]:
    """Ranges that hold every key that all ``filters`` let pass; conditions on other columns say nothing."""
    out = [KeyRange()]
    for f in filters:
        if getattr(f, "attribute", None) != ("geohash",):
            continue
        if isinstance(f, EqualTo):
            own = [KeyRange(f.value, f.value)]
        elif isinstance(f, In):
            own = [KeyRange(v, v) for v in sorted({v for v in f.value if v is not None})]
        elif isinstance(f, StringStartsWith):
            own = [KeyRange(f.value, f.value + _LAST)]
        elif isinstance(f, GreaterThan | GreaterThanOrEqual):
            own = [KeyRange(low=f.value)]
        elif isinstance(f, LessThan | LessThanOrEqual):
            own = [KeyRange(high=f.value)]
        else:
            continue
        met = [a.meet(b) for a in out for b in own] if len(out) == 1 or len(own) == 1 else out
        out = [r for r in met if r.low <= r.high]
    return out


def passing(filters: Iterable[Filter]) -> Column:
    """The condition that all ``filters`` let a row pass."""
    tests = {EqualTo: Column.__eq__, In: lambda c, v: c.isin(*v), StringStartsWith: lambda c, v: F.startswith(c, F.lit(v)), GreaterThan: Column.__gt__, GreaterThanOrEqual: Column.__ge__, LessThan: Column.__lt__, LessThanOrEqual: Column.__le__}
    return reduce(Column.__and__, [tests[type(f)](F.col(".".join(f.attribute)), f.value) for f in filters], F.lit(True))


def blocks_with(first_keys: list[str], ranges: list[KeyRange]) -> list[int]:
    """Blocks that may hold a key of the ranges, by binary search; ``first_keys`` never falls."""
    found: set[int] = set()
    for r in ranges:
        # a key equal to a block's first one may begin in the block before
        found.update(range(max(0, bisect_left(first_keys, r.low) - 1), bisect_right(first_keys, r.high)))
    return sorted(found)


# ---- decoding a range

def keys_in(data: bytes, rows: int, before: str) -> list[str]:
    values = []
    at = 0
    try:
        for _ in range(rows):
            sizes = data[at]
            before = before[: sizes >> 4] + data[at + 1 : at + 1 + (sizes & 15)].decode("ascii")
            values.append(before)
            at += 1 + (sizes & 15)
    except IndexError:
        at = -1
    if at != len(data):
        raise bundle.BundleError(f"geohash: {rows} rows don't fill {len(data)} bytes")
    return values


def blobs_in(data: bytes, rows: int) -> list[bytes]:
    values = []
    at = 0
    for _ in range(rows):
        n = data[at] if at < len(data) else 0
        values.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    if at != len(data):
        raise bundle.BundleError(f"tokens: {rows} rows don't fill {len(data)} bytes")
    return values


def numbers_in(data: bytes, before: int) -> np.ndarray:
    return before + np.cumsum(np.frombuffer(data, "<i2").astype(np.int64))


@dataclass
class BlockRange(InputPartition):
    """Neighbouring blocks of cities: their rows, the byte ranges to read, and what is before them."""

    row: int
    rows: int
    spans: dict[str, tuple[int, int]]
    before: tuple[str, int, int]

    @property
    def size(self) -> int:
        return sum(n for _, n in self.spans.values())


def city_ranges(places: Layout, index: list[dict], blocks: list[int], most: int = TASK_BLOCKS) -> list[BlockRange]:
    """The tasks that read ``blocks``: runs of neighbours, of ``most`` at most."""
    starts = [b["row"] for b in index] + [places.counts[1]]
    at = {
        "geohash": [b["keys_at"] for b in index] + [places.sections["geohash"][1]],
        "region_id": [2 * r for r in starts],
        "country_id": [2 * r for r in starts],
        "city_tokens": [b["tokens_at"] for b in index] + [places.sections["city_tokens"][1]],
    }
    out = []
    while blocks:
        n = next((k for k in range(1, min(most, len(blocks))) if blocks[k] != blocks[0] + k), min(most, len(blocks)))
        a, z, blocks = blocks[0], blocks[0] + n, blocks[n:]
        spans = {name: (places.sections[name][0] + o[a], o[z] - o[a]) for name, o in at.items()}
        out.append(BlockRange(starts[a], starts[z] - starts[a], spans, (index[a]["before_key"], index[a]["region_before"], index[a]["country_before"])))
    return out


def cities_in(f: pa.NativeFile, part: BlockRange) -> pa.RecordBatch:
    data = {name: _exactly(f, n, at) for name, (at, n) in part.spans.items()}
    key, region, country = part.before
    regions = numbers_in(data["region_id"], region)
    columns = [
        pa.array(np.arange(part.row, part.row + part.rows), pa.int32()),
        pa.array(keys_in(data["geohash"], part.rows, key), pa.string()),
        pa.array(regions, pa.int32(), mask=regions == 0),
        pa.array(numbers_in(data["country_id"], country), pa.int32()),
        pa.array(blobs_in(data["city_tokens"], part.rows), pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=bundle._arrow("cities"))


class RangedBundleSource(DataSource):
    """``spark.read.format("citybundle_ranges").option("table", ...).load(path)``; option ``index``: where the index is,
    if not beside the file; option ``ranges``: pairs of keys in JSON, only blocks that may hold keys between them are read."""

    @classmethod
    def name(cls) -> str:
        return "citybundle_ranges"

    def schema(self) -> str:
        return bundle.SCHEMAS[self.options.get("table", "cities")]

    def reader(self, schema) -> DataSourceReader:
        path = self.options["path"]
        reader = BlockReader(path, self.options.get("table", "cities"), self.options.get("index", path + SUFFIX))
        if "ranges" in self.options:
            reader.ranges = [KeyRange(*r) for r in json.loads(self.options["ranges"])]
        return reader


class BlockReader(DataSourceReader):
    def __init__(self, path: str, table: str, index: str):
        self.path, self.table, self.index = path, table, index
        self.ranges = [KeyRange()]

    def partitions(self) -> list[InputPartition]:
        if self.table != "cities":
            return [InputPartition(0)]
        index = _read_index(self.index)
        return city_ranges(layout(open_file(self.path)), index, blocks_with([b["first_key"] for b in index], self.ranges))

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no block can hold such keys
            return
        f = open_file(self.path)
        if self.table == "cities":
            yield cities_in(f, partition)
            return
        places = layout(f)
        if self.table == "header":
            rows = [places.counts]
        elif self.table == "vocabulary":
            data, rows, at = _exactly(f, places.vocabulary[1], places.vocabulary[0]), [], 0
            while at < len(data):
                rows.append((struct.unpack_from(">H", data, at)[0], data[at + 3 : at + 3 + data[at + 2]].decode("utf-8")))
                at += 3 + data[at + 2]
        else:
            name, n = ("region_tokens", places.counts[2]) if self.table == "regions" else ("country_tokens", places.counts[3])
            start, size = places.sections[name]
            rows = list(enumerate(blobs_in(_exactly(f, size, start), n), 1))
        schema = bundle._arrow(self.table)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(schema.types)], schema=schema)


class RangedReader(BlockReader):
    """A reader of the blocks that can hold what filters let pass.  Not for Spark to push into (see above)."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        if self.table == "cities":
            self.ranges = ranges_of(filters)
        return filters  # blocks hold other keys too, so rows are tested again


def read_ranges(spark: SparkSession, path: str, table: str = "cities", index: str | None = None, filters: Iterable[Filter] = ()) -> DataFrame:
    """Rows of a table of the bundle at ``path``, which has an index (or ``index`` names one), that pass all
    ``filters``; those on geohash choose what is read."""
    index, filters = index or path + SUFFIX, list(filters)
    reader = RangedReader(path, table, index)
    kept = passing(reader.pushFilters(filters))
    ranges = json.dumps([[r.low, r.high] for r in reader.ranges])
    spark.dataSource.register(RangedBundleSource)
    rows = spark.read.format("citybundle_ranges").option("table", table).option("index", index).option("ranges", ranges).load(path)
    return rows.where(kept) if filters else rows


def _last_key(data: bytes, rows: int) -> list[str | None]:
    """What a block makes of the key before it: its last key's character at each place; None where it is still the
    one before the block, none where the key has ended."""
    unknown = "\0" * MAX_PART
    last = keys_in(data, rows, unknown)[-1] if rows else unknown
    return [None if c == "\0" else c for c in last] + [""] * (2 * MAX_PART - len(last))


def read_column(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """pos and value of the column file ``name``, a task for each range of its index.

    Of the index only places are used: sums and keys are carried from block to block by what the file itself
    holds, one small row a block, so that a damaged row counts in all that a sequential reader would misread.
    """
    path = f"{folder}/{bundle.FILES[name]}"
    index = spark.read.parquet(f"{folder}/cities{SUFFIX}")
    kind, arrow = {"geohash": ("string", pa.string()), "region_id": ("int", pa.int32()), "country_id": ("int", pa.int32())}.get(name, ("binary", pa.binary()))
    at = {"geohash": F.col("keys_at"), "city_tokens": F.col("tokens_at")}.get(name, 2 * F.col("row"))
    ends = F.coalesce(F.lead("_at").over(Window.orderBy("block")), F.lit(-1))
    spans = index.withColumn("_at", at).select("block", "row", "rows", F.col("_at").alias("at"), ends.alias("end"))
    tasks = max(1, -(-spans.count() // TASK_BLOCKS))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes]]:
        f = open_file(path)
        for batch in batches:
            for b in batch.to_pylist():
                yield b, _exactly(f, (f.size() - 4 if b["end"] < 0 else b["end"]) - b["at"], 4 + b["at"])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data in blocks(batches):
            step = 0 if name == "geohash" else int(np.frombuffer(data, "<i2").sum(dtype=np.int64))
            chars = _last_key(data, b["rows"]) if name == "geohash" else []
            yield pa.RecordBatch.from_pydict({"block": [b["block"]], "step": [step], "chars": pa.array([chars], pa.list_(pa.string()))})

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data in blocks(batches):
            values = keys_in(data, b["rows"], b["before_key"]) if name == "geohash" else blobs_in(data, b["rows"]) if name == "city_tokens" else numbers_in(data, b["before"])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(b["row"], b["row"] + b["rows"])), pa.array(values, arrow)], ["pos", "value"])

    if name != "city_tokens":
        carried = spans.repartitionByRange(tasks, "row").mapInArrow(carry, "block long, step long, chars array<string>")
        w = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
        newest = [F.coalesce(F.last(F.get("chars", F.lit(k)), ignorenulls=True).over(w), F.lit("")) for k in range(2 * MAX_PART)] if name == "geohash" else [F.lit("")]
        spans = spans.join(carried.select("block", F.coalesce(F.sum("step").over(w), F.lit(0)).alias("before"), F.concat(*newest).alias("before_key")), "block")
    return spans.repartitionByRange(tasks, "row").mapInArrow(decode, f"pos long, value {kind}")
