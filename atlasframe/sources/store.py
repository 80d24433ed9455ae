"""The engine's own tables as Parquet, laid out for lookups, in versions that appear whole.

A build writes all its tables into a new version's folder and publishes it by one write: the file
``versions/<number>`` that names the folder.  Readers take the highest number when they open the store
and stay with that version; a build that dies before its end leaves nothing but a folder that no number
names.  Of two builds that publish at once, one gets the number and the other fails.

Lookups by columns that the files aren't sorted by skip files too: beside a table is a list of its files
with each column's least and greatest value, and a Bloom filter for each file and column, as rows of 64 bits.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch

#: Bits of a Bloom filter for each distinct value, and places of a value: about 1 in 120 is a false alarm.
BITS, PLACES = 10, 7
_LOG = "versions"


def save(tables: dict[str, DataFrame], path: str, mode: str = "overwrite", city_files: int | None = None) -> None:
    """Write ``tables`` below ``path``; cities are range-partitioned and sorted by key, so that the
    row groups' least and greatest keys let lookups and prefix scans skip most of them."""

    def write(name: str, df: DataFrame) -> None:
        if name == "cities" and "geohash" in df.columns:
            df = (df.repartitionByRange(city_files, "geohash") if city_files else df.repartitionByRange("geohash")).sortWithinPartitions("geohash")
        df.write.mode(mode).parquet(f"{path}/{name}")

    scratch.at_once(partial(write, name, df) for name, df in tables.items())


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of ``path``, and a way to name paths in it."""
    name = spark._jvm.org.apache.hadoop.fs.Path
    return name(path).getFileSystem(spark._jsc.hadoopConfiguration()), name


def _numbers(spark: SparkSession, path: str) -> list[int]:
    store, name = _files(spark, path)
    at = name(f"{path}/{_LOG}")
    return sorted(int(s.getPath().getName()) for s in store.listStatus(at) if s.getPath().getName().isdigit()) if store.exists(at) else []


def _named(spark: SparkSession, path: str, number: int) -> str:
    return spark.read.text(f"{path}/{_LOG}/{number:010d}").first()[0]


def current(spark: SparkSession, path: str) -> str:
    """The folder of the version that the store at ``path`` shows now; ``path`` itself if it has no versions."""
    numbers = _numbers(spark, path)
    return f"{path}/{_named(spark, path, numbers[-1])}" if numbers else path


@dataclass
class Version:
    """A version of the store at ``path`` that is being built in ``folder``."""

    spark: SparkSession
    path: str
    folder: str

    @classmethod
    def begin(cls, spark: SparkSession, path: str) -> Version:
        return cls(spark, path, f"v-{uuid.uuid4().hex}")

    @property
    def place(self) -> str:
        return f"{self.path}/{self.folder}"

    def save(self, tables: dict[str, DataFrame], city_files: int | None = None) -> None:
        save(tables, self.place, "error", city_files)

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.place}/{name}")

    def publish(self) -> int:
        """Show this version from now on; its number.  RuntimeError if another build took the number."""
        store, name = _files(self.spark, self.path)
        number = max(_numbers(self.spark, self.path), default=0) + 1
        draft, final = name(f"{self.path}/{_LOG}/.{self.folder}"), name(f"{self.path}/{_LOG}/{number:010d}")
        out = store.create(draft, True)
        try:
            out.write(bytearray(self.folder.encode()))
        finally:
            out.close()
        if store.exists(final) or not store.rename(draft, final):
            store.delete(draft, False)
            raise RuntimeError(f"{self.path}: version {number} was published by another build")
        return number


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete the folders of all but the last ``keep`` versions (their readers fail from now on); names the folders."""
    store, name = _files(spark, path)
    gone = _numbers(spark, path)[: -max(1, keep)]
    folders = [_named(spark, path, n) for n in gone]
    for number, folder in zip(gone, folders, strict=True):
        store.delete(name(f"{path}/{_LOG}/{number:010d}"), False)
        store.delete(name(f"{path}/{folder}"), True)
    return folders


def refuse_or_replace(spark: SparkSession, path: str, mode: str) -> None:
    """FileExistsError if ``mode`` is "error" and a store is at ``path``."""
    store, name = _files(spark, path)
    if mode in ("error", "errorifexists") and (_numbers(spark, path) or store.exists(name(f"{path}/cities"))):
        raise FileExistsError(f"{path} is there already")


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the store's current version, or of a folder of tables."""
    return spark.read.parquet(f"{current(spark, path)}/{name}")


# ---- which files hold a value

def _places(value: Column, bits: Column) -> Column:
    """The places of ``value`` in a filter of so many bits, by as many hashes."""
    return F.array(*[F.pmod(F.xxhash64(value, F.lit(k)), bits) for k in range(PLACES)])


def _bit(at: Column) -> Column:
    """A place's bit within its word."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))


def add_paths(spark: SparkSession, place: str, table: str, columns: list[str]) -> None:
    """Write ``<table>_files`` (file, rows, and for each column least, greatest and the filter's bits) and
    ``<table>_bits`` (column, file, word, bits) beside the table in the folder ``place``."""
    rows = spark.read.parquet(f"{place}/{table}").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), *columns)
    of = [F.struct(F.min(c).alias("least"), F.max(c).alias("greatest"), (64 * F.ceil((F.lit(BITS) * F.approx_count_distinct(c) + 1) / 64)).cast("long").alias("bits")).alias(c) for c in columns]
    rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), *of).coalesce(1).write.mode("overwrite").parquet(f"{place}/{table}_files")
    files = spark.read.parquet(f"{place}/{table}_files")
    parts = []
    for c in columns:
        values = rows.where(F.col(c).isNotNull()).select("file", F.col(c).alias("value")).distinct().join(files.select("file", F.col(f"{c}.bits").alias("bits")), "file")
        at = values.select("file", F.explode(_places(F.col("value"), F.col("bits"))).alias("at"))
        words = at.groupBy("file", F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(_bit(F.col("at"))).alias("bits"))
        parts.append(words.select(F.lit(c).alias("column"), "file", "word", "bits"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out.repartitionByRange("column", "word").sortWithinPartitions("column", "word").write.mode("overwrite").partitionBy("column").parquet(f"{place}/{table}_bits")


def files_with(spark: SparkSession, place: str, table: str, column: str, value) -> list[str]:
    """Names of the files of a table that may hold ``value``: all that do, and few others."""
    files = spark.read.parquet(f"{place}/{table}_files")
    wanted = F.lit(value).cast(files.schema[column].dataType["least"].dataType)
    near = files.where((F.col(f"{column}.least") <= wanted) & (F.col(f"{column}.greatest") >= wanted))
    asked = near.select("file", F.explode(_places(wanted, F.col(f"{column}.bits"))).alias("at")).distinct().select("file", F.floor(F.col("at") / 64).alias("word"), _bit(F.col("at")).alias("bit"))
    words = asked.groupBy("file", "word").agg(F.bit_or("bit").alias("need"))
    bits = spark.read.parquet(f"{place}/{table}_bits").where(F.col("column") == column).select("file", "word", "bits")
    met = words.join(bits, ["file", "word"], "left")
    all_set = F.bool_and(F.coalesce(F.col("bits").bitwiseAND(F.col("need")) == F.col("need"), F.lit(False)))
    return sorted(r["file"] for r in met.groupBy("file").agg(all_set.alias("ok")).where("ok").collect())


def find(spark: SparkSession, path: str, table: str, column: str, value) -> DataFrame:
    """The rows of a table whose ``column`` is ``value``; only files that may hold it are opened."""
    place = current(spark, path)
    whole = spark.read.parquet(f"{place}/{table}")
    files = files_with(spark, place, table, column, value)
    if not files:
        return whole.where(F.lit(False))
    return spark.read.schema(whole.schema).parquet(*[f"{place}/{table}/{f}" for f in files]).where(F.col(column) == F.lit(value))
