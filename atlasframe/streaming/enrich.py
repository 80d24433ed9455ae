"""Structured Streaming over the gazetteer; the database itself is static."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import geohash


def with_city(events: DataFrame, cities: DataFrame, lat: str, lon: str, precision: int = 12) -> DataFrame:
    """A stream (or table) of points with the city whose key is a prefix of their geohash.

    Keys are prefix-free, so a point meets one city at most; points outside every cell are dropped.  Only
    prefixes as long as some key are tried; the cities' lengths, thirteen numbers at most, are read first.
    """
    lengths = sorted(r[0] for r in cities.select(F.length("geohash").alias("n")).where(F.col("n").between(1, precision)).distinct().collect())
    hashed = events.withColumn("_hash", geohash(F.col(lat), F.col(lon), precision)).where("_hash is not null")
    tried = hashed.withColumn("_prefix", F.explode(F.array(*[F.left("_hash", F.lit(n)) for n in lengths]).cast("array<string>")))
    return tried.join(cities, tried["_prefix"] == cities["geohash"]).drop("_prefix", "_hash")


def city_counts(enriched: DataFrame, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events for each city and window of time; rows later than ``late`` are left out."""
    counted = enriched.withWatermark(time, late).groupBy(F.window(time, window), "geohash", "city_name").agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.col("window.start").alias("window_start"), "geohash", "city_name", "events")


def run_counts(points: DataFrame, cities: DataFrame, time: str, out: str, state: str, lat: str = "lat", lon: str = "lon", window: str = "5 minutes", late: str = "10 minutes") -> None:
    """Run a stream of points to its present end: what changed in each batch goes to ``<out>/batch=<number>``.

    Progress and counts are kept in the checkpoint ``state``, so a later run goes on where this one ended.
    A batch that is run again, after a failure between its writing and its mark, replaces its own folder:
    each batch counts once.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    counted = city_counts(with_city(points, cities, lat, lon), time, window, late)
    query = counted.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    """The newest count of each window and city that ``run_counts`` wrote."""
    kept = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    return kept.groupBy("window_start", "geohash", "city_name").agg(F.max_by("events", "batch").alias("events"))
