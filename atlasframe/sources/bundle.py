"""The single-file bundle: a header, the vocabulary, six column sections.

Decoding works on a file's bytes, read by Spark's ``binaryFile`` source (any store that Spark reads)
or by the ``citybundle`` data source (a store that Arrow reads, on every worker).  Writing streams the rows, already
encoded as bytes by expressions, in order through the driver to one file, as the format demands.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import scratch

# The format's mark, and its sections in order.
MAGIC = b"CITYDB01"
SECTIONS = ("geohash", "region_id", "country_id", "city_tokens", "region_tokens", "country_tokens")
HEADER_BYTES = 32
# The names of the section files, when the columns are kept as files of their own.
FILES = {
    "geohash": "cities_geohash.bin",
    "region_id": "cities_region_id.bin",
    "country_id": "cities_country_id.bin",
    "city_tokens": "cities_name_tokens.bin",
    "region_tokens": "regions_name_tokens.bin",
    "country_tokens": "countries_name_tokens.bin",
}

SCHEMAS = {
    "header": "vocabulary long, cities long, regions long, countries long",
    "vocabulary": "token_id int, token string",
    "cities": "pos int, geohash string, region_id int, country_id int, tokens binary",
    "regions": "region_id int, tokens binary",
    "countries": "country_id int, tokens binary",
}


class BundleError(ValueError):
    """The bytes are no bundle."""


@dataclass
class Bundle:
    counts: tuple[int, int, int, int] = (0, 0, 0, 0)
    vocabulary: list[tuple[int, str]] = field(default_factory=list)
    sections: dict[str, list] = field(default_factory=dict)
    left_over: int = 0


class _Bytes:
    """A cursor that refuses to run past its end."""

    def __init__(self, data: bytes, what: str):
        self.data, self.at, self.what = data, 0, what

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise BundleError(f"{self.what}: {n} bytes wanted at {self.at}, {len(self.data) - self.at} there")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str) -> int:
        return struct.unpack(kind, self.take(struct.calcsize(kind)))[0]


def _front_coded(c: _Bytes) -> Iterator[str]:
    last = ""
    while True:
        sizes = c.take(1)[0]
        last = last[: sizes >> 4] + c.take(sizes & 15).decode("ascii")
        yield last


def _deltas(c: _Bytes) -> Iterator[int]:
    value = 0
    while True:
        value += c.number("<h")
        yield value


def _blobs(c: _Bytes) -> Iterator[bytes]:
    while True:
        yield c.take(c.take(1)[0])


_DECODERS = dict(zip(SECTIONS, (_front_coded, _deltas, _deltas, _blobs, _blobs, _blobs), strict=True))


def parse_section(name: str, data: bytes) -> list:
    """The values of one section: a row count, then the rows."""
    part = _Bytes(data, name)
    values = _DECODERS[name](part)
    out = [next(values) for _ in range(part.number("<I"))]
    if part.at != len(data):
        raise BundleError(f"{name}: {len(data) - part.at} bytes too many")
    return out


def parse(data: bytes) -> Bundle:
    """Decode a bundle; BundleError if a mark, count or size doesn't hold."""
    c = _Bytes(data, "bundle")
    if data[:8] != MAGIC:
        raise BundleError(f"not a bundle: it begins with {data[:8]!r}")
    c.take(8)
    counts = tuple(c.number("<I") for _ in range(4))
    c.take(8)
    out = Bundle(counts)
    for _ in range(counts[0]):
        token = c.number(">H")
        out.vocabulary.append((token, c.take(c.take(1)[0]).decode("utf-8")))
    for name in SECTIONS:
        out.sections[name] = parse_section(name, c.take(c.number("<I")))
    out.left_over = len(data) - c.at
    for name, want in zip(SECTIONS, (counts[1],) * 4 + counts[2:], strict=True):
        if len(out.sections[name]) != want:
            raise BundleError(f"{name}: {len(out.sections[name])} rows, the header says {want}")
    return out


class _Walk:
    """A cursor over a stream that refuses to run past its end and holds no more than what is taken."""

    def __init__(self, f: BinaryIO, size: int, what: str):
        self.f, self.size, self.at, self.what = f, size, 0, what

    def want(self, n: int) -> None:
        if self.at + n > self.size:
            raise BundleError(f"{self.what}: {n} bytes wanted at {self.at}, {self.size - self.at} there")

    def take(self, n: int) -> bytes:
        self.want(n)
        self.at += n
        return self.f.read(n)

    def number(self, kind: str) -> int:
        return struct.unpack(kind, self.take(struct.calcsize(kind)))[0]

    def skip(self, n: int) -> None:
        self.want(n)
        self.at += n
        self.f.seek(n, 1)


def _walk_section(name: str, part: _Walk) -> tuple[int, list[str]]:
    """Rows of a section, and its first five keys that are below the one before; its rows are tested, none is kept."""
    n, unsorted, last = part.number("<I"), [], ""
    if name == "geohash":
        for i in range(n):
            sizes = part.take(1)[0]
            key = last[: sizes >> 4] + part.take(sizes & 15).decode("ascii")
            if i and key < last and len(unsorted) < 5:
                unsorted.append(f"key {i} is below the one before it")
            last = key
    elif name in ("region_id", "country_id"):
        part.skip(2 * min(n, (part.size - part.at) // 2))
        if part.at < 4 + 2 * n:
            part.want(2)
    else:
        for _ in range(n):
            part.skip(part.take(1)[0])
    if part.at != part.size:
        raise BundleError(f"{name}: {part.size - part.at} bytes too many")
    return n, unsorted


def stream_problems(f: BinaryIO, size: int) -> list[str]:
    """What is wrong with the bundle of ``size`` bytes that ``f`` reads, in one pass; see ``problems``."""
    c = _Walk(f, size, "bundle")
    try:
        mark = c.take(min(8, size))
        if mark != MAGIC:
            raise BundleError(f"not a bundle: it begins with {mark!r}")
        counts = [c.number("<I") for _ in range(4)]
        c.take(8)
        for _ in range(counts[0]):
            c.take(2)
            c.take(c.take(1)[0]).decode("utf-8")
        found, unsorted = [], []
        for name in SECTIONS:
            long = c.number("<I")
            c.want(long)
            n, low = _walk_section(name, _Walk(f, long, name))
            c.at += long
            found.append(n)
            unsorted += low
        for name, n, want in zip(SECTIONS, found, (counts[1],) * 4 + tuple(counts[2:]), strict=True):
            if n != want:
                raise BundleError(f"{name}: {n} rows, the header says {want}")
    except (BundleError, UnicodeDecodeError) as e:
        return [str(e)]
    return ([f"{size - c.at} bytes after the last section"] if c.at < size else []) + unsorted


def problems(data: bytes) -> list[str]:
    """What is wrong with a bundle; left-over bytes and unsorted keys count, an odd blob doesn't."""
    return stream_problems(io.BytesIO(data), len(data))


def faults(spark: SparkSession, path: str) -> DataFrame:
    """file and fault: what is wrong with the bundles at ``path`` (a file, a folder or a pattern, in any store that
    Spark reads); a sound one gives no row.  A task checks a bundle, as it streams by from stores that Arrow
    reads; from others Spark hands over its bytes."""
    from . import ranged

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                f = io.BytesIO(row["content"]) if "content" in row else io.BufferedReader(ranged.open_file(row["path"]), 1 << 20)
                with f:
                    found = stream_problems(f, row["length"])
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(found), pa.string()), pa.array(found, pa.string())], ["file", "fault"])

    columns = ["path", "length"] if ranged.reachable(path) else ["path", "length", "content"]
    return spark.read.format("binaryFile").load(path).select(columns).mapInArrow(run, "file string, fault string")


def rows(b: Bundle, table: str) -> list[tuple]:
    """The rows of one of the tables of ``SCHEMAS``; region 0 is none."""
    s = b.sections
    if table == "header":
        return [b.counts]
    if table == "vocabulary":
        return b.vocabulary
    if table == "cities":
        return list(zip(range(b.counts[1]), s["geohash"], (r or None for r in s["region_id"]), s["country_id"], s["city_tokens"], strict=True))
    return list(enumerate(s["region_tokens" if table == "regions" else "country_tokens"], 1))


def read_bundle(spark: SparkSession, path: str, table: str = "cities") -> DataFrame:
    """A table of the bundle at ``path``; ids of regions and countries are their places from 1."""
    names = [f.split()[0] for f in SCHEMAS[table].split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                found = rows(parse(data), table)
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in found], schema=_arrow(table))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMAS[table])


def _arrow(table: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in SCHEMAS[table].split(", "))])


def header_counts(spark: SparkSession, path: str) -> DataFrame:
    """The header's counts; no more than the header is read, whatever the file's size."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    file = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        head = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(file, HEADER_BYTES))
    finally:
        file.close()
    if head[:8] != MAGIC:
        raise BundleError(f"not a bundle: it begins with {head[:8]!r}")
    counts = zip(("vocabulary", "cities", "regions", "countries"), struct.unpack("<4I", head[8:24]), strict=True)
    return spark.range(1).select(*[F.lit(n).cast("long").alias(name) for name, n in counts])


class CityBundleSource(DataSource):
    """``spark.read.format("citybundle").option("table", ...).load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "citybundle"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "cities")]

    def reader(self, schema) -> DataSourceReader:
        return _BundleReader(self.options["path"], self.options.get("table", "cities"))


class _BundleReader(DataSourceReader):
    def __init__(self, path: str, table: str):
        self.path, self.table = path, table

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        with store.open_input_stream(path) as f:
            yield from rows(parse(f.read()), self.table)


def _create(spark: SparkSession, path: str, overwrite: bool):
    """A Hadoop output stream for ``path``, in any store that Spark writes."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, overwrite)


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file in any store that Spark writes."""
    out = _create(spark, path, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def put_changed(spark: SparkSession, path: str, out: str, changed: dict[int, bytes], cut: int = 0, more: bytes = b"") -> None:
    """Write the file at ``path`` as ``out`` with the bytes at some places ``changed``, the last ``cut`` bytes left out and
    ``more`` after them.  It streams from store to store; nothing holds it whole."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store, utils = where.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.commons.io.IOUtils
    end = store.getFileStatus(where).getLen() - cut
    source, target, at = store.open(where), _create(spark, out, True), 0
    try:
        for place, data in sorted(changed.items()):
            utils.copyLarge(source, target, 0, place - at)
            utils.skipFully(source, len(data))
            target.write(bytearray(data))
            at = place + len(data)
        utils.copyLarge(source, target, 0, end - at)
        target.write(bytearray(more))
    finally:
        source.close()
        target.close()


def some_bytes(spark: SparkSession, path: str, at: int, n: int) -> bytes:
    """``n`` bytes of the file at ``path``; no more are read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    source = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        source.seek(at)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source, n))
    finally:
        source.close()


#: Rows that a task joins before they go to the driver.
_RUN = 65_536


def _section_parts(df: DataFrame, n: int) -> tuple[int, Iterator[bytes]]:
    """A section's size, and its bytes in parts: rows are joined by tasks, a run of rows each, and the
    runs stream through the driver in order."""
    size = df.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("n")).first()["n"]
    runs = df.groupBy(F.floor(F.col("pos") / _RUN).alias("run")).agg(F.array_sort(F.collect_list(F.struct("pos", "data"))).alias("rows"))
    joined = runs.select("run", F.unhex(F.array_join(F.transform("rows", lambda r: F.hex(r["data"])), "")).alias("data"))

    def parts() -> Iterator[bytes]:
        yield struct.pack("<I", n)
        for r in joined.orderBy("run").toLocalIterator():
            yield bytes(r["data"])

    return 4 + size, parts()


def write_sections(spark: SparkSession, folder: str, sections: dict[str, tuple[DataFrame, int]], overwrite: bool = True) -> dict[str, int]:
    """Write each section as a file of its own; their sizes are returned."""
    sizes = {}
    made = scratch.at_once(partial(_section_parts, df, n) for df, n in sections.values())
    for name, (size, parts) in zip(sections, made, strict=True):
        sizes[name] = size
        out = _create(spark, f"{folder}/{FILES[name]}", overwrite)
        try:
            for part in parts:
                out.write(bytearray(part))
        finally:
            out.close()
    return sizes


def read_section(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """pos and value of the section file ``name`` in ``folder``."""
    kind, arrow = {"geohash": ("string", pa.string()), "region_id": ("int", pa.int32()), "country_id": ("int", pa.int32())}.get(name, ("binary", pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                values = parse_section(name, data)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int64()), pa.array(values, arrow)], ["pos", "value"])

    return spark.read.format("binaryFile").load(f"{folder}/{FILES[name]}").select("content").mapInArrow(run, f"pos long, value {kind}")


def composition(data: bytes) -> dict[str, int]:
    """Bytes of a bundle's parts: header, vocabulary, and each section with its size field."""
    b = parse(data)
    c = _Bytes(data, "bundle")
    c.take(HEADER_BYTES)
    out = {"header": HEADER_BYTES, "vocabulary": sum(3 + len(t.encode("utf-8")) for _, t in b.vocabulary)}
    c.take(out["vocabulary"])
    for name in SECTIONS:
        at = c.at
        c.take(c.number("<I"))
        out[name] = c.at - at
    return out | {"total": len(data)}


def write_bundle(spark: SparkSession, path: str, vocabulary: DataFrame, sections: dict[str, tuple[DataFrame, int]], overwrite: bool = True) -> int:
    """Write a bundle; its size is returned.

    ``vocabulary``: token_id and token.  ``sections``: for each name a DataFrame with ``pos`` and
    ``data`` (the encoded row) and its row count.  Rows stream through the driver in order.
    """
    made = dict(zip(SECTIONS, scratch.at_once(partial(_section_parts, *sections[name]) for name in SECTIONS), strict=True))
    counts = [vocabulary.count(), sections["geohash"][1], sections["region_tokens"][1], sections["country_tokens"][1]]
    out = _create(spark, path, overwrite)
    total = 0

    def put(data: bytes) -> None:
        nonlocal total
        out.write(bytearray(data))
        total += len(data)

    try:
        put(MAGIC + struct.pack("<4I", *counts) + bytes(8))
        for r in vocabulary.orderBy("token_id").toLocalIterator():
            text = r["token"].encode("utf-8")
            put(struct.pack(">HB", r["token_id"], len(text)) + text)
        for name in SECTIONS:
            size, parts = made[name]
            put(struct.pack("<I", size))
            for part in parts:
                put(part)
    finally:
        out.close()
    return total
