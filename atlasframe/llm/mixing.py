"""Mixing sources to target weights along a time-varying curriculum.

Each source gets a target number of words: its weight's share of the whole, but at most ``repeats``
times what it has; what a capped source can't use goes to the others by weight until none is above.
A source's documents stand in a fixed shuffled order; passes over it are taken while the middle of a
document lies within the target.  The source's weight schedule, a piecewise linear rate over training
time 0 to 1, is integrated to the share of its target that is due by any time; inverting that at a
document's place in its source's word count gives its training position, by which rows are sorted.

Null texts have no words, are taken no time and have no position; null is a source of its own, last.
Equal ids (repeated rows) follow each other in the order and may fare differently.  Sources without
words get target 0.  An empty table gives an empty result.  Column names that begin with ``_mix_``
are the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Rates over time, in turn for the sources in order: knots (time, rate). Only their shape counts.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.5), (1.0, 1.0)), ((0.0, 0.25), (1.0, 1.75)))


def words_of(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """``sizes`` (_mix_group, _mix_source, _mix_total) with _mix_rank and _mix_target.

    Water filling in closed form: in the order of cap over weight, a source is capped if its cap is
    below its weight's part of what the ones before it leave.  One row per source goes to one task.
    """
    ordered = Window.orderBy(F.col("_mix_source").isNull(), "_mix_source")
    ranked = sizes.withColumn("_mix_rank", F.row_number().over(ordered) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("_mix_rank"), F.lit(len(weights))).cast("int") + 1)
    whole = Window.partitionBy()
    by_ratio = Window.orderBy("_mix_ratio", "_mix_rank").rowsBetween(Window.unboundedPreceding, -1)
    df = ranked.withColumn("_mix_weight", weight).withColumn("_mix_cap", F.lit(float(repeats)) * F.col("_mix_total"))
    df = df.withColumn("_mix_ratio", F.col("_mix_cap") / F.col("_mix_weight"))
    left = F.lit(share) * F.sum("_mix_total").over(whole) - F.coalesce(F.sum("_mix_cap").over(by_ratio), F.lit(0.0))
    weights_left = F.sum("_mix_weight").over(whole) - F.coalesce(F.sum("_mix_weight").over(by_ratio), F.lit(0.0))
    df = df.withColumn("_mix_level", left / weights_left)
    open_level = F.max(F.when(F.col("_mix_ratio") > F.col("_mix_level"), F.col("_mix_level"))).over(whole)
    target = F.when(F.col("_mix_ratio") <= F.col("_mix_level"), F.col("_mix_cap")).otherwise(F.col("_mix_weight") * open_level)
    return df.withColumn("_mix_target", target).select("_mix_group", "_mix_source", "_mix_total", "_mix_rank", "_mix_target")


def _position(part: Column, rank: Column, schedules: tuple) -> Column:
    """The time at which a source of ``rank`` has met the share ``part`` of its whole demand."""

    def inverse(knots: tuple) -> Column:
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
        due, begun, out = part * sum(areas), 0.0, None
        for (a, b), area in list(zip(zip(knots, knots[1:], strict=False), areas, strict=True)):
            slope = (b[1] - a[1]) / (b[0] - a[0])
            rest = due - begun
            root = F.sqrt(F.greatest(F.lit(a[1] * a[1]) + 2 * slope * rest, F.lit(0.0)))
            time = F.least(F.lit(b[0]), F.lit(a[0]) + F.when(rest > 0, 2 * rest / (root + a[1])).otherwise(0.0))
            out = F.when(due <= begun + area, time) if out is None else out.when(due <= begun + area, time)
            begun += area
        return out.otherwise(F.lit(float(knots[-1][0])))

    turn = F.pmod(rank, F.lit(len(schedules)))
    out = F.when(turn == 0, inverse(schedules[0]))
    for k, knots in enumerate(schedules[1:], 1):
        out = out.when(turn == k, inverse(knots))
    return out


def mix(docs: DataFrame, weights: tuple = WEIGHTS, schedules: tuple = SCHEDULES, share: float = 1.5, repeats: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None) -> DataFrame:
    """``docs`` with _mix_size, _mix_total and _mix_target (of the source), _mix_times (passes taken)
    and _mix_positions (ascending, one for each pass).

    A source's order is by MD5 of the id.  Its first three digits cut every source, a hot one too,
    into 4096 parts; running counts come from the parts' sums (one small row each) and a window
    within the part, which has the partitioning of the join with these sums: ``docs`` is shuffled once.
    ``size_col`` names a column that holds the sizes, if they were counted before.
    """
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    size = F.col(size_col) if size_col else words_of(text_col)
    group = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))  # never null: joins and windows share it
    sized = docs.withColumns({"_mix_size": size, "_mix_key": key, "_mix_part": F.substring(key, 1, 3), "_mix_group": group, "_mix_source": F.col(source_col)})
    parts = sized.groupBy("_mix_group", "_mix_part").agg(F.sum("_mix_size").alias("_mix_n"), F.first("_mix_source").alias("_mix_source"))
    targets = source_targets(parts.groupBy("_mix_group").agg(F.sum("_mix_n").alias("_mix_total"), F.first("_mix_source").alias("_mix_source")), weights, share, repeats)
    before = Window.partitionBy("_mix_group").orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_mix_start", F.coalesce(F.sum("_mix_n").over(before), F.lit(0))).drop("_mix_n", "_mix_source")
    starts = starts.join(targets.drop("_mix_source"), "_mix_group")
    within = Window.partitionBy("_mix_group", "_mix_part").orderBy("_mix_key", "_mix_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_mix_within", F.coalesce(F.sum("_mix_size").over(within), F.lit(0)))
    joined = placed.join(starts, ["_mix_group", "_mix_part"])
    middle = F.col("_mix_start") + F.col("_mix_within") + F.col("_mix_size") / F.lit(2.0)
    passes = F.floor((F.col("_mix_target") - middle) / F.col("_mix_total")) + 1
    times = F.when(F.col("_mix_size") > 0, F.greatest(F.lit(0), F.least(F.lit(repeats), passes))).otherwise(0).cast("int")
    at = [F.when(F.col("_mix_times") > e, _position((middle + e * F.col("_mix_total")) / F.col("_mix_target"), F.col("_mix_rank"), schedules)) for e in range(repeats)]
    out = joined.withColumn("_mix_times", times).withColumn("_mix_positions", F.array_compact(F.array(*at)))
    return out.select(*docs.columns, "_mix_size", "_mix_total", "_mix_target", "_mix_times", "_mix_positions")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The training rows: ``docs``' columns, a row for each pass taken, range-sorted by position."""
    rows = mix(docs, id_col=id_col, **options).select(*docs.columns, F.explode("_mix_positions").alias("_mix_position"))
    return rows.orderBy("_mix_position", id_col).drop("_mix_position")
