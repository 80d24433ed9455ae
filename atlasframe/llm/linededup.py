"""Deleting runs of lines that occurred before, found by winnowing.

Lines are compared without the spaces, tabs and carriage returns at their ends; blank lines don't
count.  A window is the shortest stretch of lines with ``min_words`` words or more that begins, or
ends, at a given line.  The smallest line hash of a window is its fingerprint, so equal windows are
certain to share it (winnowing's guarantee), and neighbouring windows mostly select the same place.

1. The selected places alone are counted by their line hash; those of a hash selected at two places or
   more are matched places.
2. A matched place brings the windows that selected it.  Each is joined, by a 128-bit hash of its lines,
   with the place where the window occurred first in the order (id, line): one row a window content,
   never pairs of occurrences.
3. A window's match is extended both ways: windows that overlap or touch and lie the same way from the
   same earlier document are one match, as far as lines agree on either side.
4. The lines of each match, in the later place, are deleted.

So every repeated stretch of ``min_words`` words is found whole, and shorter ones stay.

A null or blank text stays as it is.  Rows without an id come last in the order.  Repeated rows (same
id and text) are compared as one document, of which the first keeps its text and the others are later
repeats of it.  An empty table gives an empty result.  Other columns pass through; columns n_lines and
removed_lines are replaced, and names that begin with ``_dedup_`` are the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import row_identity, slices, written

#: Words that a repeated run has at least.
MIN_WORDS = 50
_BLANK = " \t\r\x0b\x0c"


def line_windows(text: str, min_words: int) -> tuple[list[tuple[int, str]], list[tuple[int, int, int]]]:
    """The lines that count (number and content), and every window: its first and last of these lines
    and the one it selects."""
    import xxhash

    lines = [(at, kept, len(kept.encode().split())) for at, line in enumerate(text.split("\n")) if (kept := line.strip(_BLANK))]
    total = [0]
    for line in lines:
        total.append(total[-1] + line[2])
    if total[-1] < min_words:
        return [], []
    pairs, e = set(), 0
    for p in range(len(lines)):  # forwards: the smallest end; backwards: the largest start
        while e < len(lines) and total[e + 1] - total[p] < min_words:
            e += 1
        if e < len(lines):
            pairs.add((p, e))
    s = 0
    for q in range(len(lines)):
        while total[q + 1] - total[s + 1] >= min_words:
            s += 1
        if total[q + 1] - total[s] >= min_words:
            pairs.add((s, q))
    hashes = [xxhash.xxh64_intdigest(line[1]) for line in lines]
    return [(at, kept) for at, kept, _ in lines], [(p, e, min(range(p, e + 1), key=hashes.__getitem__)) for p, e in sorted(pairs)]


def windows(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each document with windows: id, rid (of the document), the line hashes of the selected
    places, and for each place the windows that selected it: first and last line (by number, and as
    ordinals among those that count) and content hash."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, rid binary, places array<bigint>, windows array<array<struct<first: int, last: int, begin: int, end: int, window: binary>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches):
            rows, place_ends, window_ends, hashes, columns = [], [0], [0], [], [[] for _ in range(5)]
            for row, text in enumerate(batch.column(2).to_pylist()):
                lines, found = line_windows(text or "", min_words)
                by_place: dict[int, list[tuple[int, int]]] = {}
                for p, e, at in found:
                    by_place.setdefault(at, []).append((p, e))
                for at, spans in by_place.items():
                    hashes.append(xxhash.xxh64_intdigest(lines[at][1]) - (1 << 63))
                    for p, e in spans:
                        content = xxhash.xxh3_128_digest("\n".join(x[1] for x in lines[p : e + 1]))
                        for column, value in zip(columns, (lines[p][0], lines[e][0], p, e, content), strict=True):
                            column.append(value)
                    window_ends.append(len(columns[0]))
                if found:
                    rows.append(row)
                    place_ends.append(len(hashes))
            kept, ends = pa.array(rows, pa.int64()), pa.array(place_ends, pa.int32())
            spans = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, [*[pa.int32()] * 4, pa.binary()], strict=True)], ["first", "last", "begin", "end", "window"])
            nested = pa.ListArray.from_arrays(ends, pa.ListArray.from_arrays(pa.array(window_ends, pa.int32()), spans))
            places = pa.ListArray.from_arrays(ends, pa.array(hashes, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), places, nested], ["id", "rid", "places", "windows"])

    return docs.select(F.col(id_col).alias("id"), row_identity(id_col, text_col).alias("rid"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _matches(found: DataFrame) -> DataFrame:
    places = found.select("rid", F.posexplode("places").alias("nth", "least"))
    place = F.xxhash64("rid", "nth")
    twice = places.groupBy("least").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select("least")
    twice = written(twice)  # read back, so that a join with a hot hash can be split
    matched = places.join(twice, "least", "left_semi").groupBy("rid").agg(F.collect_set("nth").alias("matched"))
    brought = F.flatten(F.transform("matched", lambda nth: F.get("windows", nth)))
    spans = found.join(matched, "rid").select("id", "rid", F.explode(brought).alias("w")).select("id", "rid", "w.*")
    placed = spans.withColumn("place", F.struct(F.col("id").isNull().alias("n"), "id", "rid", "begin"))
    firsts = placed.groupBy("window").agg(F.min("place").alias("source"), F.max("place").alias("final")).where("source < final").select("window", "source")
    firsts = written(firsts)
    seeds = placed.join(firsts, "window").where("place > source").select("rid", "first", "last", "begin", "end", "source", (F.col("begin") - F.col("source.begin")).alias("shift"))
    same_way = Window.partitionBy("rid").orderBy("source.rid", "shift", "begin", "end").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("rid", "source.rid", "shift").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = seeds.withColumn("reached", F.max("end").over(before))
    begins = F.when(F.col("begin") <= F.col("reached") + 1, 0).otherwise(1)
    runs = reached.withColumn("run", F.sum(begins).over(same_way))
    return runs.groupBy("rid", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("source").alias("source")).select("rid", "first", "last", F.col("source.id").alias("source_id"), F.col("source.rid").alias("source_rid"), F.col("source.begin").alias("source_begin"))


def matches(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every match, as far as its lines agree: rid, first and last line, and the id, rid and ordinal
    (among the lines that count) of the first line in the earlier place.

    Hashes are only ever joined with one row each (counts and firsts, summed before the shuffle), so a
    line or passage in a third of all documents makes no pairs, and its rows can be split.
    """
    return _matches(written(windows(docs, min_words, id_col, text_col)))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later repeats deleted from the text, n_lines (before) and removed_lines.

    The documents' texts are shuffled once, to meet their deletions; the join hashes the narrow side.
    """
    found = written(windows(docs, min_words, id_col, text_col))
    spans = _matches(found).groupBy("rid").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    gone = spans.select(F.col("rid").alias("_dedup_rid"), F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"])))).alias("_dedup_lines"))
    joined = docs.withColumn("_dedup_rid", row_identity(id_col, text_col)).join(gone.hint("shuffle_hash"), "_dedup_rid", "left")
    lines = F.split(F.col(text_col), "\n", -1)
    if not found.groupBy("rid").count().where("count > 1").isEmpty():  # all that counts in a repeated row is a match
        nth = F.row_number().over(Window.partitionBy("_dedup_rid").orderBy("_dedup_rid"))
        counting = F.filter(F.transform(lines, lambda x, i: F.when(F.length(F.trim(x, F.lit(_BLANK))) > 0, i)), lambda i: i.isNotNull())
        long = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) >= min_words
        whole = F.sequence(F.array_min(counting), F.array_max(counting))
        joined = joined.withColumn("_dedup_nth", nth).withColumn("_dedup_lines", F.when((F.col("_dedup_nth") > 1) & long, whole).otherwise(F.col("_dedup_lines")))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_dedup_lines"))
    text = F.when(F.col("_dedup_lines").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    kept = [c for c in docs.columns if c not in ("n_lines", "removed_lines")]
    counts = [F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(of)).cast("long").alias(name) for c, of, name in ((text_col, lines, "n_lines"), ("_dedup_lines", F.col("_dedup_lines"), "removed_lines"))]
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in kept], *counts)
