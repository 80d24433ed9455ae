"""Tab-separated dumps with quoting, comments and rejects.

A quoted field may hold tabs and line ends, so whether a line begins a row depends on all lines before
it.  Lines are read in splits by Spark's text source, in two passes.  Where a line begins is one of two
states, outside or inside a quoted field; a line without a quote keeps the state, any other maps each
state to one.  The first pass counts each split's lines and maps both states through its lines with
quotes; one small row a split, chained along each file, tells where the splits really begin and with
which row.  The second pass cuts the rows: a split without quotes that begins outside needs numbers
only, others go through a small loop over their lines with quotes.  Only a row that crosses a border of
splits is put together by a shuffle; all others stay in the task that read them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import scratch

#: Splits whose begins are sent to all tasks at most (about 100 bytes each); beyond, lines are shuffled to meet them.
MOST_SENT = 1_000_000


@dataclass(frozen=True)
class Dump:
    """Rows of the expected layout, and those that don't have it: file, row (its number in the file, from 1),
    fields (how many it has) and line (its text)."""

    rows: DataFrame
    rejects: DataFrame


def _closes(piece: str) -> bool:
    """Whether text inside quotes has the quote that ends them: one that isn't doubled."""
    return '"' in piece.replace('""', "")


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that begins inside quotes, or outside, ends inside.  Quotes open at a field's begin only."""
    for piece in line.split("\t"):
        if inside:
            inside = not _closes(piece)
        elif piece.startswith('"'):
            inside = not _closes(piece[1:])
    return inside


def _parts(batch: pa.RecordBatch, keys: int) -> Iterator[pa.RecordBatch]:
    """A batch cut where another split begins, by its first ``keys`` columns."""
    if batch.num_rows:
        other = np.zeros(batch.num_rows - 1, dtype=bool)
        for column in batch.columns[:keys]:
            other |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(other) + 1).tolist(), batch.num_rows]
        for a, z in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, z - a)


_QUOTED = "file string, block long, first long, last long, out_end boolean, out_inside long, in_end boolean, in_inside long"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a split's lines with quotes: the numbers of the first and last of them and, for each state before the
    first, the state after the last and how many of the lines between them (after the first) begin inside."""
    now: dict | None = None
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[k]) for n, k in (c.split() for c in _QUOTED.split(", "))])
    for batch in batches:
        for part in _parts(batch, 2):
            key = (part.column(0)[0].as_py(), part.column(1)[0].as_py())
            if now is None or (now["file"], now["block"]) != key:
                if now is not None:
                    yield pa.RecordBatch.from_pylist([now], schema)
                now = {"file": key[0], "block": key[1], "first": None, "out_end": False, "out_inside": 0, "in_end": True, "in_inside": 0}
            for at, line in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                for state in ("out", "in"):
                    if now["first"] is not None:
                        now[f"{state}_inside"] += (at - now["last"]) * now[f"{state}_end"]
                    now[f"{state}_end"] = ends_inside(line, now[f"{state}_end"])
                now["first"] = at if now["first"] is None else now["first"]
                now["last"] = at
    if now is not None:
        yield pa.RecordBatch.from_pylist([now], schema)


def _splits(numbered: DataFrame) -> DataFrame:
    """A row for each split: split (a number, rising along a file), file, inside, row (rows begun before),
    least (the number of its first line) and plain (no quotes, and begun outside)."""
    sizes = numbered.groupBy("file", "block").agg(F.min("nth").alias("least"), F.max("nth").alias("most"))
    quoted = numbered.where(F.contains("line", F.lit('"'))).select("file", "block", "nth", "line").mapInArrow(_survey, _QUOTED)
    all_of = sizes.join(quoted, ["file", "block"], "left")
    lines = F.col("most") - F.col("least") + 1

    def rows(state: str, begins: int) -> Column:  # lines less those that begin inside
        tail = (F.col("most") - F.col("last")) * F.col(f"{state}_end").cast("long")
        head = (F.col("first") - F.col("least") + 1) * begins
        return F.when(F.col("first").isNull(), lines * (1 - begins)).otherwise(lines - head - F.col(f"{state}_inside") - tail)

    end = lambda state, begins: F.coalesce(f"{state}_end", F.lit(begins))
    surveys = all_of.select("file", "block", "least", F.col("first").isNotNull().alias("quotes"), end("out", False).alias("out_end"), rows("out", 0).alias("out_rows"), end("in", True).alias("in_end"), rows("in", 1).alias("in_rows"))

    def chain(done: Column, split: Column) -> Column:
        here = F.struct(split["block"].alias("block"), split["least"].alias("least"), done["inside"].alias("inside"), done["row"].alias("row"), (~done["inside"] & ~split["quotes"]).alias("plain"))
        after = F.when(done["inside"], split["in_end"]).otherwise(split["out_end"])
        begun = F.when(done["inside"], split["in_rows"]).otherwise(split["out_rows"])
        return F.struct(after.alias("inside"), (done["row"] + begun).alias("row"), F.concat(done["splits"], F.array(here)).alias("splits"))

    none = F.array().cast("array<struct<block:bigint,least:bigint,inside:boolean,row:bigint,plain:boolean>>")
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("row"), none.alias("splits"))
    of_file = surveys.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "least", "quotes", "out_end", "out_rows", "in_end", "in_rows"))).alias("all"))
    chained = of_file.select("file", F.inline(F.aggregate("all", start, chain, lambda d: d["splits"])))
    return chained.withColumn("split", F.row_number().over(Window.orderBy("file", "block")))  # a row for each split


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """split, row, text and whole of the rows, or of the parts that a split has of rows across its borders."""
    key, inside, row = None, False, 0
    held: list[str] = []  # lines of the row not ended yet; its first may be in a split before
    begun_here = False

    def shown(rows: np.ndarray, texts: pa.Array, whole: bool) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, key), pa.int32()), pa.array(rows, pa.int64()), texts.cast(pa.string()), pa.array(np.full(n, whole))], ["split", "row", "text", "whole"])

    for batch in batches:
        for part in _parts(batch, 1):
            here = part.column(0)[0].as_py()
            if here != key:
                if held:
                    yield shown(np.array([row]), pa.array(["\n".join(held)]), False)
                key, inside, row, held, begun_here = here, part.column(1)[0].as_py(), part.column(2)[0].as_py(), [], False
            lines = part.column(3)
            begins, ends = _states(lines, inside)
            goes_on = np.r_[begins[1:], ends]  # whether the line's row has more lines
            alone = ~begins & ~goes_on
            numbers = row + np.cumsum(~begins)
            if alone.any():
                yield shown(numbers[alone], lines.filter(pa.array(alone)), True)
            for k in np.flatnonzero(~alone).tolist():
                if not begins[k]:
                    held, begun_here = [], True
                held.append(lines[k].as_py())
                if not goes_on[k]:
                    yield shown(numbers[k : k + 1], pa.array(["\n".join(held)]), begun_here)
                    held = []
            inside, row = ends, int(numbers[-1])
    if held:
        yield shown(np.array([row]), pa.array(["\n".join(held)]), False)


def _states(lines: pa.Array, inside: bool) -> tuple[np.ndarray, bool]:
    """Whether each line begins inside quotes, and whether the last one ends there."""
    begins = np.empty(len(lines), dtype=bool)
    at = 0
    for k in np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)).tolist():
        begins[at : k + 1] = inside
        inside, at = ends_inside(lines[k].as_py(), inside), k + 1
    begins[at:] = inside
    return begins, inside


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """file, row (number in the file, from 1) and text of every row of the files at ``path``, as the csv rules
    cut them: a quoted field may hold tabs, line ends (one ``\\n`` each) and doubled quotes.

    At any size of splits the rows are the same.  A quote that is never closed takes all lines to the file's
    end into its row.  Line ends are ``\\n``, ``\\r\\n`` and ``\\r``.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    numbered = lines.withColumn("nth", F.monotonically_increasing_id())  # in the order of the lines of a split
    splits = scratch.written(_splits(numbered))
    sent = splits.count() <= MOST_SENT
    met = numbered.join(F.broadcast(splits) if sent else splits.hint("merge"), ["file", "block"])
    plain = met.where("plain").select("file", (F.col("row") + F.col("nth") - F.col("least") + 1).alias("row"), F.col("line").alias("text"))
    rest = met.where(~F.col("plain"))
    rest = (rest if sent else rest.sortWithinPartitions("split", "nth")).select("split", "inside", "row", "line")
    cut = rest.mapInArrow(_cut_rows, "split int, row long, text string, whole boolean")
    names = splits.select("split", "file")
    named = cut.join(F.broadcast(names) if sent else names, "split")
    across = named.where(~F.col("whole")).groupBy("file", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "text"))), lambda p: p["text"]), "\n").alias("text"))
    return plain.unionByName(named.where("whole").select("file", "row", "text")).unionByName(across)


def fields_of(text: Column) -> Column:
    """The fields of a row: quotes at a field's begin are taken off, doubled ones inside them are one."""
    quote, two = F.lit('"'), F.lit('""')
    end = lambda inner: F.locate('"', F.replace(inner, two, F.lit("..")))
    undoubled = lambda inner: F.replace(inner, two, quote)
    plain = lambda inner: F.when(end(inner) == 0, undoubled(inner)).otherwise(F.concat(undoubled(F.left(inner, end(inner) - 1)), F.substr(inner, end(inner) + 1)))

    def step(done: Column, piece: Column) -> Column:
        opens = done["open"].isNull() & F.startswith(piece, quote)
        inner = F.when(done["open"].isNull(), F.substr(piece, F.lit(2))).otherwise(F.concat(done["open"], F.lit("\t"), piece))
        ended = end(F.when(done["open"].isNull(), F.substr(piece, F.lit(2))).otherwise(piece)) > 0
        literal = done["open"].isNull() & ~opens
        added = F.when(literal, F.array(piece)).when(ended, F.array(plain(inner))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.concat(done["fields"], added).alias("fields"), F.when(~literal & ~ended, inner).alias("open"))

    none = F.struct(F.array().cast("array<string>").alias("fields"), F.lit(None).cast("string").alias("open"))
    last = lambda d: F.when(d["open"].isNull(), d["fields"]).otherwise(F.concat(d["fields"], F.array(plain(d["open"]))))
    cut = F.split(text, "\t")
    return F.when(F.contains(text, quote), F.aggregate(cut, none, step, last)).otherwise(cut)


def read_dump(spark: SparkSession, path: str, layout: T.StructType) -> Dump:
    """Read a dump.

    Empty lines and rows whose first field begins with ``#``, quoted or not, count as rows but are none.
    Of the rest, those with another number of fields are rejects.  Empty text fields are empty strings;
    numbers that can't be read are null.  What is parsed is written to the shared folder once.
    """
    comment = F.rlike(F.col("text"), F.lit('^"{0,2}#'))  # in a quoted field, or after an empty pair of quotes, too
    found = csv_rows(spark, path).where((F.col("text") != "") & ~comment).withColumn("_f", fields_of(F.col("text")))
    fits = F.size("_f") == len(layout.fields)

    def typed(k: int, field: T.StructField) -> Column:
        value = F.when(fits, F.get("_f", F.lit(k)))
        return (value if isinstance(field.dataType, T.StringType) else value.try_cast(field.dataType)).alias(field.name)

    reject = F.when(~fits, F.struct("file", "row", F.size("_f").alias("fields"), F.col("text").alias("line")))
    parsed = scratch.written(found.select(*[typed(k, f) for k, f in enumerate(layout.fields)], reject.alias("_reject")))
    return Dump(parsed.where("_reject is null").drop("_reject"), parsed.where("_reject is not null").select("_reject.*"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that more than one row has."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, key: str, what: str) -> DataFrame:
    """``df``, once it is known that ``key`` has no repeats; else ValueError names some."""
    found = [str(r[0]) for r in duplicate_keys(df, key).orderBy(key).limit(5).collect()]
    if found:
        raise ValueError(f"{what}: repeated {key}: {', '.join(found)}")
    return df
