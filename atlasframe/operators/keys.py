"""Shortest unique geohash keys, prefix joins and locating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions.geo import MAX_PRECISION, common_prefix
from .columns import PART, neighbours, positions

#: Rows whose prefixes are a task's: a file of any size may be one task, and each row has twelve.
SPREAD = 32_768


def _parts(rows: int) -> int:
    return max(1, -(-rows // SPREAD))


def _prefixes(key: Column) -> Column:
    """All prefixes of a key but the empty one; of an empty or null key none."""
    return F.when(F.length(key) > 0, F.transform(F.sequence(F.lit(1), F.length(key)), lambda n: F.left(key, n)))


def _finish(gh: Column, length: Column, row_id: Column) -> list[Column]:
    unique = length <= MAX_PRECISION
    return [F.when(unique, F.left(gh, length)).otherwise(F.concat(gh, F.lit("_"), row_id.cast("string"))).alias("key"), F.least(length, F.lit(MAX_PRECISION)).cast("int").alias("precision")]


def shortest_unique_keys(df: DataFrame, gh: str, row_id: str) -> DataFrame:
    """``df`` with ``key``, the shortest prefix of ``gh`` that no other row has, and ``precision``.

    Rows that share all 12 characters get ``hash_id``.  Every prefix is counted by hash aggregation,
    partial counts first, so that a cell with a third of all rows is a few rows when it is shuffled;
    no order of all rows is needed.  Rows are counted and dealt to tasks of about SPREAD rows before their prefixes
    are made, and the counts to as many tasks, whatever the session's number of partitions: a task's share doesn't grow.
    ``row_id`` identifies a row; rows without a hash are left out.
    """
    rows = df.select(F.col(row_id).alias("_id"), F.left(gh, F.lit(MAX_PRECISION)).alias("_hash"))
    parts = _parts(df.count())
    if parts > 1:
        rows = rows.withColumn("_deal", F.pmod(F.xxhash64("_id"), F.lit(8 * parts))).repartition(parts, "_deal")
        each = rows.select("_deal", "_id", F.explode(_prefixes(F.col("_hash"))).alias("_prefix"))
        some = each.groupBy("_deal", "_prefix").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_id"))  # no shuffle
        counts = some.repartition(parts, "_prefix").groupBy("_prefix").agg(F.sum("_n").alias("_n"), F.min("_id").alias("_id"))
        alone = counts.where("_n = 1").repartition(parts, "_id")
    else:
        each = rows.select("_id", F.explode(_prefixes(F.col("_hash"))).alias("_prefix"))
        alone = each.groupBy("_prefix").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_id")).where("_n = 1")
    shortest = alone.groupBy("_id").agg(F.min(F.length("_prefix")).alias("_length"))
    joined = df.join(shortest, df[row_id] == shortest["_id"], "left")
    # A null hash gives a null key; testing the key keeps the hash from being computed for a filter below.
    return joined.select(*df.columns, *_finish(F.col(gh), F.coalesce("_length", F.lit(MAX_PRECISION + 1)), F.col(row_id))).where("key is not null")


def shortest_unique_keys_sorted(df: DataFrame, gh: str, row_id: str, part: int = PART) -> DataFrame:
    """The same from each row's neighbours in the order of hashes: fewer rows are shuffled, but all are sorted.
    Ranges of the order are tasks of their own; what a range needs of those beside it is one row each."""
    placed = neighbours(positions(df.where(F.col(gh).isNotNull()), [gh, row_id]), gh, part)
    shared = F.greatest(common_prefix(F.col(gh), F.col("_before"), MAX_PRECISION), common_prefix(F.col(gh), F.col("_after"), MAX_PRECISION))
    return placed.withColumn("_length", shared + 1).select(*df.columns, *_finish(F.col(gh), F.col("_length"), F.col(row_id)))


def key_precisions(keyed: DataFrame) -> DataFrame:
    """How many keys have each precision, in order."""
    return keyed.groupBy("precision").agg(F.count(F.lit(1)).alias("keys")).orderBy("precision")


def uniqueness(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, and whether they agree."""
    out = df.agg(F.count(F.lit(1)).alias("total"), F.count_distinct(key).alias("unique_keys"))
    return out.withColumn("all_unique", F.col("total") == F.col("unique_keys"))


def prefix_join(probes: DataFrame, prefix: str, cities: DataFrame, key: str) -> DataFrame:
    """Every probe with every row whose key begins with it.

    A ``startswith`` join compares all pairs; here each key is expanded into its prefixes, as many as
    it is long (a key's format bounds that), and met by equality.  The empty prefix meets all.  Cities are written
    once and counted, so that a task has the prefixes of about SPREAD of them.
    """
    kept = scratch.written(cities.where(F.col(key).isNotNull()))
    parts = _parts(kept.count())
    every = F.concat(F.array(F.lit("")), F.coalesce(_prefixes(F.col(key)), F.array().cast("array<string>")))
    expanded = (kept.repartition(parts, key) if parts > 1 else kept).withColumn("_prefix", F.explode(every))
    if parts > 1:
        probes, expanded = probes.repartition(parts, prefix), expanded.repartition(parts, "_prefix")
    return probes.join(expanded, probes[prefix] == expanded["_prefix"]).drop("_prefix")


def locate(points: DataFrame, gh: str, cities: DataFrame, key: str) -> DataFrame:
    """Every point with the city whose key is the longest prefix of its geohash (an extension: the
    lookup functions match stored keys only).  Points in no city's cell keep their row.

    Distinct hashes are resolved, by aggregation, and points meet the answers by their hash: rows need no
    number of their own, and many points at one place are one hash.
    """
    hashes = points.select(F.col(gh).alias("_hash")).where("_hash is not null").distinct()
    expanded = hashes.withColumn("_prefix", F.explode(_prefixes(F.left("_hash", F.lit(MAX_PRECISION)))))
    hits = expanded.join(cities, expanded["_prefix"] == cities[key])
    best = hits.groupBy("_hash").agg(F.max_by(F.struct(*[F.col(c).alias(c) for c in cities.columns]), F.length("_prefix")).alias("_city"))
    return points.join(best, points[gh] == best["_hash"], "left").select(*[points[c] for c in points.columns], *[F.col(f"_city.{c}").alias(c) for c in cities.columns])
