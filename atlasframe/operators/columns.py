"""Order-dependent column codecs as windows: front coding and delta coding.

``pos`` (0..N-1) is the order.  Rows are worked on in parts of PART rows, each in a task of its own;
what a part needs of those before it (a last value, a sum, the newest characters) is one small row a
part, so that no order of all rows is needed.  With ``block`` the coding itself restarts every so many
rows; a sequential reader reads the result as it reads any other, because a first row that shares
nothing with the one before it is always allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import scratch
from ..functions.codec import MAX_PART, checked, hex_bytes, little_endian, pack_nibbles
from ..functions.geo import common_prefix


#: Rows of a part.
PART = 65_536


def _cut(df: DataFrame, rows: int) -> tuple[DataFrame, Window]:
    """``df`` with its part, and a window over it."""
    return df.withColumn("_part", F.floor(F.col("pos") / rows)), Window.partitionBy("_part").orderBy("pos")


def _before(df: DataFrame, value: str, block: int | None, part: int = PART) -> DataFrame:
    """``df`` with ``_before``: the value of the row before; null for the first row, of each block if any."""
    cut, w = _cut(df, block or part)
    inside = cut.withColumn("_before", F.lag(value).over(w))
    if block:
        return inside.drop("_part")
    ends = cut.groupBy("_part").agg(F.max_by(value, "pos").alias("_end")).withColumn("_part", F.col("_part") + 1)
    joined = inside.join(ends, "_part", "left")
    return joined.withColumn("_before", F.when(F.col("pos") % part == 0, F.col("_end")).otherwise(F.col("_before"))).drop("_part", "_end")


def neighbours(df: DataFrame, value: str, part: int = PART) -> DataFrame:
    """``df`` with ``_before`` and ``_after``: the values of the rows before and after in the order of ``pos``."""
    cut, w = _cut(df, part)
    inside = cut.withColumns({"_before": F.lag(value).over(w), "_after": F.lead(value).over(w)})
    ends = cut.groupBy("_part").agg(F.min_by(value, "pos").alias("_first"), F.max_by(value, "pos").alias("_last"))
    earlier = ends.select((F.col("_part") + 1).alias("_part"), F.col("_last"))
    later = ends.select((F.col("_part") - 1).alias("_part"), F.col("_first"))
    met = inside.join(earlier, "_part", "left").join(later, "_part", "left")
    before = F.when(F.col("pos") % part == 0, F.col("_last")).otherwise(F.col("_before"))
    after = F.when(F.col("pos") % part == part - 1, F.col("_first")).otherwise(F.col("_after"))
    return met.select(*df.columns, before.alias("_before"), after.alias("_after"))


def positions(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``pos``, 0..N-1 in ``order``.

    Spark samples the order for splitters and sorts the ranges between them; equal values may fall into
    several ranges, by a hash of the row, so neither a dense stretch nor a repeated value is one task.  Rows
    are numbered as they lie in their range, and the ranges' counts, one small row each, say where each
    begins.  The sorted rows are written to the shared folder once, so that later uses sort nothing.
    """
    tie = F.xxhash64(*df.columns)
    by = [F.col(c) for c in order]
    ranged = (df.repartitionByRange(parts, *by, tie) if parts else df.repartitionByRange(*by, tie)).sortWithinPartitions(*by, tie)
    kept = scratch.written(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return kept.join(F.broadcast(starts), part == F.col("_part")).select(*df.columns, (F.col("_start") + inside).alias("pos"))


def by_key(cities: DataFrame) -> DataFrame:
    """``cities`` with ``pos`` in the order of their keys."""
    return positions(cities, ["geohash"])


def front_encode(df: DataFrame, value: str, block: int | None = None, part: int = PART) -> DataFrame:
    """``df`` with shared (characters shared with the row before) and suffix (the rest)."""
    shared = common_prefix(F.col(value), F.coalesce("_before", F.lit("")), 2 * MAX_PART)
    met = _before(df, value, block, part).withColumn("shared", shared.cast("int")).drop("_before")
    return met.withColumn("suffix", F.substr(F.col(value), F.col("shared") + 1))


def front_rows(encoded: DataFrame) -> DataFrame:
    """pos and data: each row's bytes; parts over 15 characters fail."""
    ok = (F.col("shared") <= MAX_PART) & (F.length("suffix") <= MAX_PART)
    sizes = F.unhex(hex_bytes(pack_nibbles(F.col("shared"), F.length("suffix")), 1))
    return encoded.select("pos", checked(ok, F.concat(sizes, F.encode("suffix", "US-ASCII")), F.concat(F.lit("shared or new part too long at "), F.col("pos").cast("string"))).alias("data"))


def front_decode(df: DataFrame, shared: str = "shared", suffix: str = "suffix", longest: int = 2 * MAX_PART, block: int | None = None, part: int = PART) -> DataFrame:
    """``df`` with ``value``: character k is the newest one written at k, in this part or one before (in
    this block, if there are any)."""
    cut, w = _cut(df, block or part)

    def char(k: int) -> Column:
        here = (F.lit(k) >= F.col(shared)) & (F.lit(k) < F.col(shared) + F.length(suffix))
        return F.when(here, F.substr(F.col(suffix), F.lit(k + 1) - F.col(shared), F.lit(1)))

    upto, places = w.rowsBetween(Window.unboundedPreceding, 0), range(longest)
    spread = cut.select("*", *[F.last(char(k), ignorenulls=True).over(upto).alias(f"_c{k}") for k in places])
    if block:
        value = F.left(F.concat(*[F.coalesce(f"_c{k}", F.lit("")) for k in places]), F.col(shared) + F.length(suffix))
        return spread.select(*df.columns, value.alias("value"))
    ends = cut.groupBy("_part").agg(*[F.max_by(char(k), F.when(char(k).isNotNull(), F.col("pos"))).alias(f"_e{k}") for k in places])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_part", *[F.last(f"_e{k}", ignorenulls=True).over(earlier).alias(f"_e{k}") for k in places])
    spread = spread.join(ends, "_part")
    newest = [F.coalesce(f"_c{k}", f"_e{k}", F.lit("")) for k in places]
    return spread.select(*df.columns, F.left(F.concat(*newest), F.col(shared) + F.length(suffix)).alias("value"))


def delta_encode(df: DataFrame, value: str, block: int | None = None, part: int = PART) -> DataFrame:
    """``df`` with ``delta``: the step from the row before; the first row's is its value."""
    return _before(df, value, block, part).withColumn("delta", F.col(value) - F.coalesce("_before", F.lit(0))).drop("_before")


def step_bytes(step: Column, where: Column) -> Column:
    """A step as two little-endian bytes; one beyond 16 bits, or none, fails."""
    ok = F.coalesce(step.between(-32768, 32767), F.lit(False))
    return checked(ok, little_endian(step, 2), F.concat(F.lit("step too large at "), where.cast("string")))


def delta_rows(encoded: DataFrame) -> DataFrame:
    """pos and data: two little-endian bytes a row; steps beyond 16 bits fail."""
    return encoded.select("pos", step_bytes(F.col("delta"), F.col("pos")).alias("data"))


def delta_decode(df: DataFrame, delta: str = "delta", block: int | None = None, part: int = PART) -> DataFrame:
    """``df`` with ``value``: the sum of the steps so far, of the block if there are any."""
    cut, w = _cut(df, block or part)
    summed = cut.withColumn("value", F.sum(delta).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if block:
        return summed.drop("_part")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("_part").agg(F.sum(delta).alias("_sum"))
    sums = sums.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_so_far"))
    return summed.join(sums, "_part").withColumn("value", F.col("value") + F.col("_so_far")).drop("_part", "_so_far")


def unsorted_rows(df: DataFrame, value: str, order: str) -> DataFrame:
    """One row: how many values are below the one before them.

    Rows are compared within ranges of the order; each range's ends, one small row, are compared with
    those of its neighbours.
    """
    ranges = df.select(F.col(order).alias("_at"), F.col(value).alias("_v")).repartitionByRange("_at").withColumn("_range", F.spark_partition_id())
    w = Window.partitionBy("_range").orderBy("_at")
    below = ranges.withColumn("_low", F.col("_v") < F.lag("_v").over(w))
    each = below.groupBy("_range").agg(F.count_if("_low").alias("_n"), F.min("_at").alias("_from"), F.min_by(F.struct("_v"), "_at").alias("_first"), F.max_by(F.struct("_v"), "_at").alias("_final"))
    border = F.col("_first._v") < F.lag("_final").over(Window.orderBy("_from"))["_v"]
    return each.withColumn("_border", border).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_in"), F.count_if("_border").alias("_out")).select((F.col("_in") + F.col("_out")).alias("unsorted"))
