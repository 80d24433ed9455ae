"""Lookups over a built database."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, Filter, StringStartsWith

from .. import scratch
from ..functions.codec import decode_tokens, tokens_from_blob
from ..functions.text import label
from ..operators import bpe, keys, search
from ..sources import bundle, ranged, store


class NotLoaded(RuntimeError):
    """A lookup before a database was loaded."""


def cities_by_prefix(cities: DataFrame, prefix: str, limit: int = 50, key: str = "geohash") -> DataFrame:
    """Rows whose key begins with ``prefix``, in key order; an empty prefix matches all, a limit below
    1 gives none.  The predicate reaches the Parquet scan; the limit is a top-k."""
    return cities.where(F.startswith(key, F.lit(prefix))).orderBy(key).limit(max(0, limit))


def labelled(cities: DataFrame, regions: DataFrame, countries: DataFrame) -> DataFrame:
    """``cities`` with region_name, country_name and label; unknown ids leave their part out."""
    joined = cities.join(regions.select("region_id", "region_name"), "region_id", "left").join(countries.select("country_id", "country_name"), "country_id", "left")
    return joined.select(*cities.columns, "region_name", "country_name", label(F.col("city_name"), F.col("region_name"), F.col("country_name")).alias("label"))


class Gazetteer:
    """Cities, regions, countries and the vocabulary as DataFrames, and the lookups over them.

    Lookups of one key return a Row, a string or None; those that end in ``_all`` and prefix searches
    take or return DataFrames, for batches.
    """

    def __init__(self) -> None:
        self.tables: dict[str, DataFrame] | None = None
        self.place: str | None = None
        self.ranged: Callable[..., DataFrame] | None = None

    @classmethod
    def of(cls, cities: DataFrame, regions: DataFrame, countries: DataFrame, vocabulary: DataFrame) -> Gazetteer:
        out = cls()
        out.tables = {"cities": cities, "regions": regions, "countries": countries, "vocabulary": vocabulary}
        return out

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Gazetteer:
        """From the Parquet store that a build wrote: the version that it shows now, whatever is published later."""
        place = store.current(spark, path)
        out = cls.of(*[spark.read.parquet(f"{place}/{t}") for t in ("cities", "regions", "countries", "vocabulary")])
        out.place = place
        return out

    @classmethod
    def load_bundle(cls, spark: SparkSession, path: str) -> Gazetteer:
        """From a bundle: names are decoded, and so without white space.

        Cities are read in ranges, and lookups of keys and prefixes read only the blocks that can hold
        them.  A bundle without an index gets one in the shared folder, by one scan.
        """
        if not ranged.reachable(path):
            read = lambda table, *filters: bundle.read_bundle(spark, path, table).where(ranged.passing(filters))
        else:
            index = path + ranged.SUFFIX
            if not ranged.has_index(spark, path):
                index = scratch.new_path(spark)
                ranged.scanned_index(spark, path).write.parquet(index)
            read = lambda table, *filters: ranged.read_ranges(spark, path, table, index, filters)
        vocabulary = read("vocabulary")
        token_map = bpe.token_map(vocabulary)

        def named(table: str, name: str, *filters: Filter) -> DataFrame:
            return read(table, *filters).withColumn(name, decode_tokens(tokens_from_blob(F.col("tokens")), token_map)).drop("tokens")

        def cities(*filters: Filter) -> DataFrame:
            return named("cities", "city_name", *filters).select("geohash", "city_name", "region_id", "country_id")

        out = cls.of(cities(), named("regions", "region_name"), named("countries", "country_name"), vocabulary)
        out.ranged = cities
        return out

    def table(self, name: str) -> DataFrame:
        if self.tables is None:
            raise NotLoaded("no database is loaded")
        return self.tables[name]

    def stats(self) -> dict[str, int] | None:
        """Row counts; None before loading."""
        if self.tables is None:
            return None
        return {name: df.count() for name, df in self.tables.items()}

    def cities_where(self, *filters: Filter) -> DataFrame:
        """Cities that pass all ``filters`` (of ``pyspark.sql.datasource``): those on geohash choose the blocks of a
        bundle that are read, and reach the scan of a store."""
        cities = self.table("cities")
        return self.ranged(*filters) if self.ranged else cities.where(ranged.passing(filters))

    def city_rows(self, key: str) -> DataFrame:
        """The rows stored under exactly ``key``: the predicate reaches the scan."""
        return self.cities_where(EqualTo(("geohash",), key))

    def find_by_geohash(self, key: str) -> Row | None:
        """The city stored under exactly ``key``."""
        return self.city_rows(key).select("geohash", "city_name", "region_id", "country_id").first()

    def find_by_geohash_all(self, probes: DataFrame, column: str) -> DataFrame:
        """Every probe with its city, or nulls."""
        return probes.join(self.table("cities"), probes[column] == self.table("cities")["geohash"], "left")

    def city_label(self, key: str) -> str | None:
        """``city, region, country`` of exactly ``key``."""
        hit = labelled(self.city_rows(key), self.table("regions"), self.table("countries")).first()
        return hit and hit["label"]

    def find_by_prefix(self, prefix: str, limit: int = 50) -> DataFrame:
        return cities_by_prefix(self.cities_where(StringStartsWith(("geohash",), prefix)), prefix, limit)

    def find_by_prefix_all(self, probes: DataFrame, column: str) -> DataFrame:
        return keys.prefix_join(probes, column, self.table("cities"), "geohash")

    def cities_with(self, column: str, value: int | str) -> DataFrame:
        """Cities by country_id, region_id or city_name; of a stored database only files that may hold such are opened."""
        cities = self.table("cities")
        return cities.where(F.col(column) == F.lit(value)) if self.place is None else store.find(cities.sparkSession, self.place, "cities", column, value)

    def search_text(self, query: str) -> DataFrame:
        """The full-text rows that match ``query`` (see ``search.match_text``), of a stored database."""
        if self.place is None:
            raise NotLoaded("no stored database is loaded")
        spark = self.table("cities").sparkSession
        rows, index = (spark.read.parquet(f"{self.place}/{t}") for t in ("fulltext", "fulltext_terms"))
        return rows.join(search.match_text(index, query, "geonameid", search.FIELDS), "geonameid", "left_semi")

    def locate(self, points: DataFrame, geohash: str) -> DataFrame:
        """Every point with the city in whose cell it lies (an extension)."""
        return keys.locate(points, geohash, self.table("cities"), "geohash")

    def search_name_prefix(self, prefix: str, limit: int = 50) -> DataFrame:
        return search.name_prefix(self.table("cities"), "city_name", prefix, limit)

    def create_views(self) -> None:
        """Temporary views cities, regions and countries, for SQL."""
        for name in ("cities", "regions", "countries"):
            self.table(name).createOrReplaceTempView(name)
