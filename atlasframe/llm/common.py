"""Helpers that several training-data operators share.

Scratch tables: what an operator must read twice, or must cut from its lineage, is written as
Parquet to the folder that the driver and all executors share (see ``atlasframe.scratch``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import scratch


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: later uses don't compute it again,
    and a lost executor costs no more than the tasks it ran."""
    spark = df.sparkSession
    path = scratch.new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the scratch table behind ``df``, once nothing reads it any more."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for path in [p for p in scratch.given() if file.endswith(p.rsplit("/", 1)[1])]:
            scratch.forget(df.sparkSession, path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts (without copying), so that a worker holds few texts as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_identity(id_col: str, text_col: str) -> Column:
    """128 bits that tell rows apart by id and text; repeated rows have the same."""
    text = F.coalesce(F.concat(F.lit("="), F.col(text_col)), F.lit("-"))
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), text)))


def keep_rows(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose ``row_identity`` is among ``keys`` (column key, no repeats), each once.

    Texts are shuffled once: the window over repeated rows has the join's partitioning and order.
    Column names that begin with ``_dedup_`` are its own.
    """
    marked = docs.withColumn("_dedup_key", row_identity(id_col, text_col))
    met = marked.join(keys.select(F.col("key").alias("_dedup_key")).hint("merge"), "_dedup_key", "left_semi")
    nth = F.row_number().over(Window.partitionBy("_dedup_key").orderBy("_dedup_key"))
    return met.withColumn("_dedup_nth", nth).where("_dedup_nth = 1").select(docs.columns)


def salts_for(rows: int, per_part: int = 2_000, most: int = 4_096) -> int:
    """How many parts a group of at most ``rows`` rows is split into, so that a part stays small.
    ``most`` bounds the table of parts, not the rows: beyond it the parts grow."""
    return max(1, min(most, -(-rows // per_part)))


def running(df: DataFrame, group: list[str], parts: list[tuple[str, Column]], order: list[Column], value: Column, name: str, carry: DataFrame | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows before this one in its ``group``.

    No group meets in one task: ``parts`` (name and value; in order, "-" before a name for falling)
    cut it, and rows are summed within (group, parts).  The parts' sums, one small row each, give each
    part's start.  ``order`` orders rows within a part; equal rows are interchangeable.  ``carry``, a
    table keyed by ``group``, adds its columns by way of the parts, so a hot group's rows never meet
    its single row of the table.
    """
    names = [n.lstrip("-") for n, _ in parts]
    keys = [*group, *names]
    cut = df.withColumns({n.lstrip("-"): c for n, c in parts} | {"_value": value})
    sums = cut.groupBy(*keys).agg(F.sum("_value").alias("_n"))
    rising = [F.desc(n[1:]) if n[0] == "-" else F.asc(n) for n, _ in parts]
    before = Window.partitionBy(*group).orderBy(*rising).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    added = []
    if carry is not None:
        added = [c for c in carry.columns if c not in group]
        s, c = starts.alias("s"), carry.alias("c")
        starts = s.join(c, [F.col(f"s.{g}").eqNullSafe(F.col(f"c.{g}")) for g in group], "left").select("s.*", *[F.col(f"c.{x}") for x in added])
    within = F.coalesce(F.sum("_value").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left, right = cut.withColumn("_in", within).alias("l"), starts.alias("r")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    out = left.join(right, on, "inner")
    return out.select(*[F.col(f"l.{c}") for c in df.columns], *[F.col(f"r.{c}") for c in added], (F.col("l._in") + F.col("r._start")).cast("long").alias(name))


def ranked(df: DataFrame, group: list[str], order: list[Column], salts: int, name: str, salt_by: list[Column], carry: DataFrame | None = None) -> DataFrame:
    """``df`` with ``name``: a gapless rank from 0 within ``group``, by salt and then by ``order``.

    A row's salt comes from a hash of ``salt_by``; see ``running``.
    """
    salt = F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int")
    return running(df, group, [("_salt", salt)], order, F.lit(1), name, carry)
