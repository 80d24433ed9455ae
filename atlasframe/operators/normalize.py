"""From dumps to dimension tables and de-duplicated cities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import scratch
from ..functions.exact import round_half_even
from ..functions.text import admin_key, long_name

#: Rows that make a place crowded, and crowded places that are sent to all tasks at most.
HOT_ROWS, MOST_HOT = 100_000, 100_000


def dense_ids(df: DataFrame, id_name: str, order: list[Column]) -> DataFrame:
    """``df`` with ids 1..N in ``order``, a total order.  For dimension tables: all rows meet once."""
    return df.withColumn(id_name, F.row_number().over(Window.orderBy(*order)).cast("int"))


def dimension(df: DataFrame, key: str, name: str, id_name: str, out_name: str) -> DataFrame:
    """Distinct (key, name) pairs with ids in name order; equal names are ordered by key."""
    pairs = df.select(F.col(key).alias("key"), F.col(name).alias(out_name)).distinct()
    return dense_ids(pairs, id_name, [F.col(out_name), F.col("key")]).select(id_name, out_name, "key")


def countries_of(country: DataFrame) -> DataFrame:
    return dimension(country, "ISO", "Country", "country_id", "country_name")


def regions_of(admin1: DataFrame) -> DataFrame:
    return dimension(admin1, "key", "name", "region_id", "region_name")


def first_wins(df: DataFrame, place: list[Column], order: list[Column], resolved: Column, hot: int = HOT_ROWS) -> DataFrame:
    """``df`` with ``outcome``: ``inserted``, ``duplicate`` or ``skipped``.

    Rows of one place are taken in ``order`` (rising; a total order): once a resolved row was inserted the
    later ones are duplicates; an unresolved row before it is skipped and doesn't take the place.  So the
    first resolved row of each place, found with partial aggregation, decides for every row by itself.
    Rows of a place with ``hot`` rows or more meet that decision where they lie, as long as there are no
    more than ``MOST_HOT`` such places (100 bytes each are sent); others by a join, which adaptive execution splits.
    """
    at = [f"_p{i}" for i in range(len(place))]
    rows = df.select("*", *[c.alias(n) for c, n in zip(place, at, strict=True)], F.struct(*order).alias("_order"), resolved.alias("_ok"))
    claims = scratch.written(rows.groupBy(*at).agg(F.min(F.when(F.col("_ok"), F.col("_order"))).alias("_first"), F.count(F.lit(1)).alias("_rows")))
    crowded = claims.where(F.col("_rows") >= hot)
    met = lambda left, right, how: left.alias("l").join(right.alias("r"), [F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for n in at], how)
    if 0 < crowded.count() <= MOST_HOT:
        here = met(rows, F.broadcast(crowded), "inner").select("l.*", "r._first")
        rest = met(rows, F.broadcast(crowded), "left_anti").select("l.*")
        decided = here.unionAll(met(rest, claims.where(F.col("_rows") < hot), "inner").select("l.*", "r._first"))
    else:
        decided = met(rows, claims, "inner").select("l.*", "r._first")
    first = F.col("_first")
    outcome = F.when(first.isNull() | (F.col("_order") < first), "skipped").when(F.col("_order") == first, "inserted").otherwise("duplicate")
    return decided.withColumn("outcome", outcome).select(*df.columns, "outcome")


def classify_cities(geoname: DataFrame, countries: DataFrame, regions: DataFrame) -> DataFrame:
    """Populated places with their ids and outcome: larger populations first, then smaller geonameid.

    Country and region ids come by left joins (dimension tables are small, Spark broadcasts them when
    they are); a place's country is needed, its region isn't.
    """
    c = countries.select(F.col("key").alias("_iso"), "country_id")
    r = regions.select(F.col("key").alias("_admin"), "region_id")
    places = geoname.where((F.col("fclass") == "P") & (F.col("population") > 0))
    joined = places.join(c, F.col("country") == F.col("_iso"), "left").join(r, admin_key(F.col("country"), F.col("admin1")) == F.col("_admin"), "left")
    at = [round_half_even(F.col("latitude"), 6), round_half_even(F.col("longitude"), 6)]
    return first_wins(joined.drop("_iso", "_admin"), at, [-F.col("population"), F.col("geonameid")], F.col("country_id").isNotNull())


def cities_of(classified: DataFrame) -> DataFrame:
    return classified.where("outcome = 'inserted'").select("geonameid", F.col("name").alias("city_name"), "latitude", "longitude", "country_id", "region_id")


def outcome_counts(classified: DataFrame) -> DataFrame:
    """One row: inserted, duplicates, skipped."""
    count = lambda what: F.count_if(F.col("outcome") == what)
    return classified.agg(count("inserted").alias("inserted"), count("duplicate").alias("duplicates"), count("skipped").alias("skipped"))


def fulltext_rows(geoname: DataFrame, admin1: DataFrame, country: DataFrame) -> DataFrame:
    """The search table: places with a known country and region, joined over a computed key."""
    g, a, c = geoname.alias("g"), admin1.alias("a"), country.alias("c")
    joined = g.join(c, F.col("g.country") == F.col("c.ISO")).join(a, admin_key(F.col("g.country"), F.col("g.admin1")) == F.col("a.key"))
    return joined.select(
        "g.geonameid",
        long_name(F.col("g.asciiname"), F.col("a.asciiname"), F.col("c.Country")).alias("longname"),
        "g.asciiname",
        F.col("a.asciiname").alias("admin1"),
        F.col("c.Country").alias("country"),
        "g.population",
        "g.latitude",
        "g.longitude",
        "g.timezone",
    )
