"""The operators as queries over the test tables, each with the same in DuckDB's SQL.

Customers stand for places: name, population (account balance), country (nation), region (nation and
market segment); coordinates follow from the key by integer arithmetic and one IEEE division, so both
engines agree to the bit.  Where an operator has two formulations, the SQL uses the other one.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThanOrEqual, In, LessThanOrEqual, StringStartsWith

from . import schema, scratch
from .functions import codec, exact, geo, text
from .operators import bpe, bpe_tables, columns, keys, normalize, search, verify
from .plans import build, gazetteer
from .sources import bundle, ranged, sqlite, store, tsv
from .streaming import enrich

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str, lat_mod: int = 17999, lon_mod: int = 35999) -> DataFrame:
    lat = (F.col("c_custkey") * 7919 % lat_mod).cast("double") / 100.0 - 90.0
    lon = (F.col("c_custkey") * 104729 % lon_mod).cast("double") / 100.0 - 180.0
    return table(spark, sf_dir, "customer").withColumns({"lat": lat, "lon": lon})


def hashed(spark: SparkSession, sf_dir: str, **mods: int) -> DataFrame:
    return places(spark, sf_dir, **mods).withColumn("gh", geo.geohash(F.col("lat"), F.col("lon")))


def keyed(spark: SparkSession, sf_dir: str, **mods: int) -> DataFrame:
    return keys.shortest_unique_keys(hashed(spark, sf_dir, **mods), "gh", "c_custkey")


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(spark, sf_dir).select(F.col("key").alias("geohash"), F.col("c_name").alias("city_name"), F.col("c_nationkey").alias("country_id"), "c_custkey")


def dimensions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation = table(spark, sf_dir, "nation")
    return nation.select(F.col("n_nationkey").alias("country_id"), F.col("n_name").alias("country_name"), F.col("n_regionkey").alias("region_id")), table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region_name"))


def _sql_char(k: int) -> str:
    bits = " | ".join(f"((({'la' if (5 * k + i) % 2 else 'lo'} >> {29 - (5 * k + i) // 2}) & 1) << {4 - i})" for i in range(5))
    return f"substr('{geo.ALPHABET}', CAST({bits} AS INTEGER) + 1, 1)"


def _hashed_sql(lat_mod: int = 17999, lon_mod: int = 35999) -> str:
    return f"""places AS (
  SELECT *, CAST((c_custkey * 7919) % {lat_mod} AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(90 AS DOUBLE) AS lat,
         CAST((c_custkey * 104729) % {lon_mod} AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE) AS lon FROM customer),
cells AS (
  SELECT *, CAST(floor((lat + 90) / 180 * 1073741824) AS BIGINT) AS la, CAST(floor((lon + 180) / 360 * 1073741824) AS BIGINT) AS lo FROM places),
hashed AS (SELECT *, {" || ".join(_sql_char(k) for k in range(12))} AS gh FROM cells)"""


_HASHED = _hashed_sql()
_LCP = "len(list_filter(range(1, 13), lambda i: left(gh, i) = left({}, i)))"


def _keyed_sql(hashed_sql: str = _HASHED) -> str:
    """Keys from the neighbours in sorted order."""
    return f"""{hashed_sql},
shared AS (
  SELECT *, 1 + greatest({_LCP.format("coalesce(before, '')")}, {_LCP.format("coalesce(after, '')")}) AS n
  FROM (SELECT *, lag(gh) OVER w AS before, lead(gh) OVER w AS after FROM hashed WINDOW w AS (ORDER BY gh, c_custkey))),
keyed AS (
  SELECT *, CASE WHEN n <= 12 THEN left(gh, n) ELSE gh || '_' || c_custkey END AS key, CAST(least(n, 12) AS INTEGER) AS "precision" FROM shared)"""


_KEYED = _keyed_sql()
_CITIES = f"{_KEYED}, cities AS (SELECT key AS geohash, c_name AS city_name, c_nationkey AS country_id, c_custkey FROM keyed)"
_FALLBACK = {"lat_mod": 97, "lon_mod": 89}


@query(f"WITH {_HASHED} SELECT c_custkey, gh FROM hashed")
def geohash_encode(spark, d):
    return hashed(spark, d).select("c_custkey", "gh")


@query(f"WITH {_KEYED} SELECT c_custkey, key, \"precision\" FROM keyed")
def shortest_unique_key(spark, d):
    return keyed(spark, d).select("c_custkey", "key", "precision")


@query(f"""WITH {_HASHED},
each AS (SELECT c_custkey, gh, n, left(gh, n) AS p FROM hashed, (SELECT unnest(range(1, 13)) AS n)),
counted AS (SELECT *, count(*) OVER (PARTITION BY p) AS c FROM each)
SELECT c_custkey, coalesce(min_by(p, n) FILTER (WHERE c = 1), max(gh) || '_' || c_custkey) AS key,
  CAST(coalesce(min(n) FILTER (WHERE c = 1), 12) AS INTEGER) AS "precision" FROM counted GROUP BY c_custkey""")
def shortest_unique_key_sorted(spark, d):
    return keys.shortest_unique_keys_sorted(hashed(spark, d), "gh", "c_custkey").select("c_custkey", "key", "precision")


@query(f"WITH {_keyed_sql(_hashed_sql(**_FALLBACK))} SELECT c_custkey, key, \"precision\" FROM keyed")
def shortest_unique_key_fallback(spark, d):
    """Coordinates repeat here, so that many keys need the id."""
    return keyed(spark, d, **_FALLBACK).select("c_custkey", "key", "precision")


@query(f"WITH {_KEYED} SELECT \"precision\", count(*) AS keys FROM keyed GROUP BY \"precision\"")
def key_precision_histogram(spark, d):
    return keys.key_precisions(keyed(spark, d))


@query(f"WITH {_KEYED} SELECT count(*) AS total, count(DISTINCT key) AS unique_keys, count(*) = count(DISTINCT key) AS all_unique FROM keyed")
def key_uniqueness(spark, d):
    return keys.uniqueness(keyed(spark, d), "key")


@query(f"WITH {_CITIES} SELECT geohash, city_name, country_id FROM cities WHERE starts_with(geohash, 's') ORDER BY geohash LIMIT 50")
def prefix_search_topk(spark, d):
    return gazetteer.cities_by_prefix(cities(spark, d), "s").select("geohash", "city_name", "country_id")


@query(f"WITH {_CITIES} SELECT geohash, city_name, country_id FROM cities ORDER BY geohash LIMIT 20")
def prefix_search_empty(spark, d):
    """The empty prefix matches every key."""
    return gazetteer.cities_by_prefix(cities(spark, d), "", 20).select("geohash", "city_name", "country_id")


@query(f"WITH {_CITIES} SELECT geohash, city_name, country_id FROM cities WHERE geohash = (SELECT max(geohash) FROM cities)")
def point_lookup(spark, d):
    """A stored key, looked up in the stored table: the predicate reaches the scan."""
    path = scratch.new_path(spark)
    store.save({"cities": cities(spark, d)}, path)
    stored = store.load(spark, path, "cities")
    key = stored.agg(F.max("geohash")).first()[0]
    return gazetteer.Gazetteer.of(stored, None, None, None).city_rows(key).select("geohash", "city_name", "country_id")


@query(f"""WITH {_CITIES}, digits AS (SELECT c_custkey AS id, (c_custkey * 48271) % 2176782336 AS n FROM customer),
probes AS (SELECT id, {" || ".join(f"substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((n // {36**k}) % 36 AS INTEGER) + 1, 1)" for k in range(5, -1, -1))} AS probe FROM digits
  UNION ALL SELECT -c_custkey, geohash FROM cities)
SELECT p.id, p.probe, c.city_name FROM probes p LEFT JOIN cities c ON c.geohash = p.probe""")
def invented_key_probes(spark, d):
    """Six base-36 digits for each customer, which mostly are no key, and every stored key."""
    c = cities(spark, d)
    invented = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.base36(F.col("c_custkey") * 48271 % 36**6, 6).alias("probe"))
    probes = invented.unionAll(c.select(-F.col("c_custkey"), "geohash"))
    return gazetteer.Gazetteer.of(c.select("geohash", "city_name"), None, None, None).find_by_geohash_all(probes, "probe").select("id", "probe", "city_name")


@query(f"""WITH {_CITIES},
probes AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN gh ELSE key END AS probe, c_custkey AS id FROM keyed)
SELECT p.id, p.probe, c.city_name FROM probes p LEFT JOIN cities c ON c.geohash = p.probe""")
def batch_lookup_join(spark, d):
    """Every customer is a probe.  Keys match exactly: a whole 12-character hash in a city's cell finds nothing."""
    probes = keyed(spark, d).select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("gh")).otherwise(F.col("key")).alias("probe"))
    found = gazetteer.Gazetteer.of(cities(spark, d).select("geohash", "city_name"), None, None, None).find_by_geohash_all(probes, "probe")
    return found.select("id", "probe", "city_name")


@query(f"""WITH {_CITIES},
probes AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN gh ELSE key END AS probe FROM keyed)
SELECT count(*) AS probes, count(c.geohash) AS hits FROM probes p LEFT JOIN cities c ON c.geohash = p.probe""")
def probe_hit_count(spark, d):
    return batch_lookup_join(spark, d).agg(F.count(F.lit(1)).alias("probes"), F.count("city_name").alias("hits"))


@query(f"""WITH {_CITIES}, probes AS (SELECT left(key, 2) AS probe FROM keyed UNION SELECT key FROM keyed UNION SELECT gh FROM keyed UNION SELECT 'zzzz')
SELECT p.probe, c.geohash, c.city_name FROM probes p JOIN cities c ON starts_with(c.geohash, p.probe)""")
def batch_prefix_join(spark, d):
    """Of every customer the key, its first two characters and the whole hash, which mostly finds nothing."""
    probes = keyed(spark, d).select(F.explode(F.array(F.left("key", F.lit(2)), "key", "gh")).alias("probe")).unionAll(spark.range(1).select(F.lit("zzzz").alias("probe"))).distinct()
    return keys.prefix_join(probes, "probe", cities(spark, d), "geohash").select("probe", "geohash", "city_name")


@query(f"""WITH {_CITIES}, points AS (SELECT c_custkey AS id, gh FROM hashed UNION ALL SELECT -1 - c_custkey, reverse(gh) FROM hashed)
SELECT p.id, c.geohash FROM points p LEFT JOIN cities c ON starts_with(p.gh, c.geohash)""")
def locate_points(spark, d):
    """Every customer's own hash, and the hash reversed, which mostly lies in no city's cell, against all cities."""
    at = hashed(spark, d)
    points = at.select(F.col("c_custkey").alias("id"), "gh").unionAll(at.select(-1 - F.col("c_custkey"), F.reverse("gh")))
    return keys.locate(points, "gh", cities(spark, d).select("geohash"), "geohash").select("id", "geohash")


@query(f"""WITH {_CITIES} SELECT c.geohash, c.city_name || CASE WHEN r.r_name <> '' THEN ', ' || r.r_name ELSE '' END || coalesce(', ' || n.n_name, '') AS label
FROM cities c LEFT JOIN nation n ON n.n_nationkey = c.country_id LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""")
def city_label(spark, d):
    countries, regions = dimensions(spark, d)
    placed = cities(spark, d).join(countries.select("country_id", "region_id"), "country_id", "left")
    return gazetteer.labelled(placed, regions, countries).select("geohash", "label")


@query("SELECT CAST(row_number() OVER (ORDER BY n_name, n_nationkey) AS INTEGER) AS country_id, n_name AS country_name, n_nationkey AS key FROM nation")
def dense_dimension_ids(spark, d):
    return normalize.dimension(table(spark, d, "nation"), "n_nationkey", "n_name", "country_id", "country_name")


@query("SELECT CAST(row_number() OVER (ORDER BY t, b) AS INTEGER) AS type_id, t AS type_name, b AS key FROM (SELECT DISTINCT p_type AS t, p_brand AS b FROM part)")
def dense_ids_with_ties(spark, d):
    return normalize.dimension(table(spark, d, "part"), "p_brand", "p_type", "type_id", "type_name")


def _classified(spark, d):
    """Orders as places: coordinates repeat, some countries are unknown."""
    o = table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_custkey") % 101 / 100.0, 6).alias("lat"), F.round(F.col("o_orderkey") % 7 / 10.0, 6).alias("lon"), F.col("o_totalprice").alias("population"), (F.col("o_custkey") % 40).alias("iso"))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("country_id"))
    joined = o.join(nation, o.iso == nation.country_id, "left")
    return normalize.first_wins(joined, [F.col("lat"), F.col("lon")], [-F.col("population"), F.col("o_orderkey")], F.col("country_id").isNotNull())


_CLASSIFIED = """places AS (
  SELECT o_orderkey, o_custkey % 101 AS lat, o_orderkey % 7 AS lon, o_totalprice AS population, n_nationkey AS country_id
  FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 40),
firsts AS (
  SELECT *, min(CASE WHEN country_id IS NOT NULL THEN place END) OVER (PARTITION BY lat, lon) AS claimed
  FROM (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY population DESC, o_orderkey) AS place FROM places)),
classified AS (
  SELECT *, CASE WHEN place > claimed THEN 'duplicate' WHEN place = claimed THEN 'inserted' ELSE 'skipped' END AS outcome FROM firsts)"""


@query(f"WITH {_CLASSIFIED} SELECT o_orderkey, population, outcome FROM classified")
def first_wins_dedup(spark, d):
    return _classified(spark, d).select("o_orderkey", "population", "outcome")


@query(f"WITH {_CLASSIFIED} SELECT count(*) FILTER (WHERE outcome = 'inserted') AS inserted, count(*) FILTER (WHERE outcome = 'duplicate') AS duplicates, count(*) FILTER (WHERE outcome = 'skipped') AS skipped FROM classified")
def dedup_stats(spark, d):
    return normalize.outcome_counts(_classified(spark, d))


@query(f"""WITH {_CLASSIFIED.replace("o_custkey % 101 AS lat, o_orderkey % 7 AS lon", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS lat, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 7 END AS lon")}
SELECT o_orderkey, outcome FROM classified""")
def first_wins_crowded(spark, d):
    """A third of all rows is at one place, which has no latitude."""
    third = F.col("o_orderkey") % 3 == 0
    o = table(spark, d, "orders").select("o_orderkey", F.when(~third, F.col("o_custkey")).alias("lat"), F.when(third, 0).otherwise(F.col("o_orderkey") % 7).alias("lon"), F.col("o_totalprice").alias("population"), (F.col("o_custkey") % 40).alias("iso"))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("country_id"))
    joined = o.join(nation, o.iso == nation.country_id, "left")
    done = normalize.first_wins(joined, [F.col("lat"), F.col("lon")], [-F.col("population"), F.col("o_orderkey")], F.col("country_id").isNotNull(), hot=100)
    return done.select("o_orderkey", "outcome")


@query("SELECT o_orderkey, o_custkey % 40 AS iso FROM orders WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = o_custkey % 40)")
def unmatched_countries(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("iso"))
    return o.join(table(spark, d, "nation"), F.col("iso") == F.col("n_nationkey"), "left_anti")


@query("SELECT o_orderkey, n_name FROM orders JOIN nation ON n_nationkey = o_custkey % 40")
def required_fk_filter(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("iso"))
    return o.join(table(spark, d, "nation"), F.col("iso") == F.col("n_nationkey")).select("o_orderkey", "n_name")


_ADMIN = "admin AS (SELECT DISTINCT c_nationkey || '.' || c_mktsegment AS key, c_mktsegment AS name FROM customer WHERE c_nationkey % 3 <> 0)"


def _admin(spark, d):
    c = table(spark, d, "customer").where("c_nationkey % 3 <> 0")
    return c.select(text.admin_key(F.col("c_nationkey").cast("string"), F.col("c_mktsegment")).alias("key"), F.col("c_mktsegment").alias("name")).distinct()


@query(f"WITH {_ADMIN} SELECT c_custkey, c_name || ', ' || a.name || ', ' || n_name AS longname FROM customer, nation, admin a WHERE c_nationkey = n_nationkey AND c_nationkey || '.' || c_mktsegment = a.key")
def computed_key_join(spark, d):
    c = table(spark, d, "customer")
    g = c.select(F.col("c_custkey").alias("geonameid"), F.col("c_name").alias("asciiname"), F.col("c_nationkey").cast("string").alias("country"), F.col("c_mktsegment").alias("admin1"), F.lit(1).alias("population"), F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"), F.lit("").alias("timezone"))
    admin1 = _admin(spark, d).select("key", F.col("name").alias("asciiname"))
    country = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("ISO"), F.col("n_name").alias("Country"))
    return normalize.fulltext_rows(g, admin1, country).select(F.col("geonameid").alias("c_custkey"), "longname")


@query(f"WITH {_ADMIN} SELECT c_custkey, a.key AS region_key FROM customer LEFT JOIN admin a ON c_nationkey || '.' || c_mktsegment = a.key")
def optional_fk_join(spark, d):
    c, a = table(spark, d, "customer"), _admin(spark, d).select(F.col("key").alias("region_key"))
    return c.join(a, text.admin_key(F.col("c_nationkey").cast("string"), F.col("c_mktsegment")) == F.col("region_key"), "left").select("c_custkey", "region_key")


@query(f"WITH {_ADMIN} SELECT c_custkey, c_name, coalesce(a.name, 'No region') AS region FROM customer LEFT JOIN admin a ON c_nationkey || '.' || c_mktsegment = a.key JOIN nation ON n_nationkey = c_nationkey ORDER BY c_custkey LIMIT 5")
def sample_default(spark, d):
    c, a = table(spark, d, "customer"), _admin(spark, d)
    joined = c.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(a, text.admin_key(F.col("c_nationkey").cast("string"), F.col("c_mktsegment")) == F.col("key"), "left")
    return joined.select("c_custkey", "c_name", text.or_default(F.col("name")).alias("region")).orderBy("c_custkey").limit(5)


def _views(spark, d):
    countries, regions = dimensions(spark, d)
    c = places(spark, d).select(F.col("c_name").alias("city_name"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("c_nationkey").alias("country_id"), "c_custkey")
    placed = c.join(countries.select("country_id", "region_id"), "country_id")
    g = gazetteer.Gazetteer.of(placed, regions, countries.drop("region_id"), None)
    g.create_views()
    return g


@query(f"WITH {_HASHED} SELECT c_name AS city_name, lat AS latitude, lon AS longitude FROM hashed JOIN nation ON n_nationkey = c_nationkey WHERE n_name = 'NATION_7'")
def cities_in_country(spark, d):
    _views(spark, d)
    return spark.sql("SELECT city_name, latitude, longitude FROM cities JOIN countries USING (country_id) WHERE country_name = 'NATION_7'")


@query("SELECT c_name AS city_name, r_name AS region_name, n_name AS country_name FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey WHERE r_name ILIKE '%eric%'")
def region_like(spark, d):
    _views(spark, d)
    return spark.sql("SELECT city_name, region_name, country_name FROM cities LEFT JOIN regions USING (region_id) JOIN countries USING (country_id) WHERE region_name ILIKE '%eric%'")


@query("SELECT n_name AS country_name, count(*) AS city_count FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def count_per_country(spark, d):
    _views(spark, d)
    return spark.sql("SELECT country_name, count(*) AS city_count FROM cities JOIN countries USING (country_id) GROUP BY country_name ORDER BY city_count DESC, country_name")


def _corpus(spark, d):
    return bpe.corpus((table(spark, d, "part"), "p_name"), (table(spark, d, "region"), "r_name"), (table(spark, d, "nation"), "n_name"))


_CORPUS = "corpus AS (SELECT p_name AS name FROM part UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation)"


@query(f"WITH {_CORPUS} SELECT name, count(*) AS n FROM corpus GROUP BY name")
def corpus_union_all(spark, d):
    return _corpus(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CORPUS} SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(name, '\\w+|[^\\w\\s]+')) AS word FROM corpus) GROUP BY word")
def word_frequency(spark, d):
    return bpe.word_counts(_corpus(spark, d))


@query(r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+')) AS word FROM documents) GROUP BY word")
def word_frequency_unicode(spark, d):
    return bpe.word_counts(table(spark, d, "documents"), "text")


@query()
def bpe_vocabulary(spark, d):
    return bpe.vocabulary_table(spark, bpe.learn(_corpus(spark, d), vocab_size=200))


_MERGES = 12


def _learned_sql() -> str:
    """Merges one at a time: a word is its tokens in marks, a merge replaces two neighbours by one."""
    start, end = "chr(1)", "chr(2)"
    out = [rf"""counts AS (
  SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]+')) AS word FROM documents) GROUP BY word),
letters AS (SELECT DISTINCT unnest(string_split(word, '')) AS token FROM counts),
t0 AS (SELECT 0 AS token_id, '<unk>' AS token UNION ALL SELECT row_number() OVER (ORDER BY token), token FROM letters),
w0 AS (SELECT n, {start} || array_to_string(string_split(word, ''), {end} || {start}) || {end} AS spelled FROM counts)"""]
    for k in range(1, _MERGES + 1):
        out.append(f"""best{k} AS MATERIALIZED (
  SELECT l.token AS a, r.token AS b FROM (
    SELECT s[i] AS a, s[i + 1] AS b, sum(n) AS n FROM (SELECT n, s, unnest(range(1, len(s))) AS i FROM (SELECT n, string_split(spelled[2:-2], {end} || {start}) AS s FROM w{k - 1})) GROUP BY ALL) p
  JOIN t{k - 1} l ON l.token = p.a JOIN t{k - 1} r ON r.token = p.b ORDER BY p.n DESC, l.token_id, r.token_id LIMIT 1),
t{k} AS MATERIALIZED (SELECT * FROM t{k - 1} UNION ALL SELECT (SELECT count(*) FROM t{k - 1}), a || b FROM best{k} WHERE a || b NOT IN (SELECT token FROM t{k - 1})),
w{k} AS MATERIALIZED (SELECT n, replace(spelled, {start} || a || {end} || {start} || b || {end}, {start} || a || b || {end}) AS spelled FROM w{k - 1}, best{k})""")
    return "WITH " + ",\n".join(out) + f"\nSELECT CAST(token_id AS INTEGER) AS token_id, token FROM t{_MERGES}"


@query(_learned_sql())
def bpe_learned(spark, d):
    """A vocabulary of all documents' words: their characters and the first merges, learned over tables."""
    vocabulary = bpe_tables.learn_tables(table(spark, d, "documents"), "text", extra=_MERGES)
    return bpe.vocabulary_table(spark, vocabulary)


@query("SELECT p_partkey, replace(p_name, ' ', '') AS text FROM part")
def bpe_roundtrip(spark, d):
    """What encoding and decoding leave of a name: all but its white space."""
    vocabulary = bpe.learn(_corpus(spark, d), vocab_size=200)
    ids = bpe.encode(vocabulary, F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", bpe.decode(ids, bpe.vocabulary_table(spark, vocabulary)).alias("text"))


@query("SELECT p_partkey, regexp_replace(p_name, '\\s+', '', 'g') AS bundle_name FROM part")
def packed_names(spark, d):
    return table(spark, d, "part").select("p_partkey", text.packed_name(F.col("p_name")).alias("bundle_name"))


def _front(spark, d):
    return columns.front_encode(columns.by_key(cities(spark, d)), "geohash")


_FRONT = f"""{_CITIES}, ordered AS (SELECT geohash, row_number() OVER (ORDER BY geohash) - 1 AS pos, coalesce(lag(geohash) OVER (ORDER BY geohash), '') AS before FROM cities),
coded AS (SELECT pos, geohash, len(list_filter(range(1, 31), lambda i: i <= least(length(geohash), length(before)) AND left(geohash, i) = left(before, i))) AS shared FROM ordered)"""


@query(f"WITH {_FRONT} SELECT pos, CAST(shared AS INTEGER) AS shared, substr(geohash, shared + 1) AS suffix FROM coded")
def front_code_encode(spark, d):
    return _front(spark, d).select("pos", "shared", "suffix")


@query(f"WITH {_FRONT} SELECT pos, geohash AS value FROM coded")
def front_code_decode(spark, d):
    return columns.front_decode(_front(spark, d).select("pos", "shared", "suffix")).select("pos", "value")


@query(f"WITH {_FRONT} SELECT pos, printf('%02X', CAST((shared << 4) | (length(geohash) - shared) AS INTEGER)) || hex(substr(geohash, shared + 1)) AS data FROM coded")
def front_code_bytes(spark, d):
    """Every coded row's bytes, in hexadecimal."""
    return columns.front_rows(_front(spark, d)).select("pos", F.hex("data").alias("data"))


def _deltas(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("v"))
    return columns.delta_encode(columns.positions(o, ["o_orderkey"]), "v", block=4096)


@query("SELECT pos, v - coalesce(lag(v) OVER (PARTITION BY pos // 4096 ORDER BY pos), 0) AS delta FROM (SELECT o_custkey AS v, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)")
def delta_encode(spark, d):
    return _deltas(spark, d).select("pos", "delta")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_custkey AS value FROM orders")
def delta_decode(spark, d):
    return columns.delta_decode(_deltas(spark, d), block=4096).select("pos", "value")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY v NULLS FIRST, o_orderkey) - 1 AS pos FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 50 WHEN o_orderkey % 50 = 1 THEN NULL ELSE o_custkey END AS v FROM orders)")
def positions_dense(spark, d):
    """Places in an order where a third of the rows has one value."""
    key = F.col("o_orderkey")
    v = F.when(key % 3 == 0, 50).when(key % 50 != 1, F.col("o_custkey"))
    return columns.positions(table(spark, d, "orders").select(key, v.alias("v")), ["v", "o_orderkey"]).select("o_orderkey", "pos")


@query("SELECT pos, v - coalesce(lag(v) OVER (ORDER BY pos), 0) AS delta, v AS value FROM (SELECT o_custkey AS v, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)")
def delta_carried(spark, d):
    """Steps without restarts: sums go on from one part to the next."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("v"))
    coded = columns.delta_encode(columns.positions(o, ["o_orderkey"]), "v", part=4096)
    return columns.delta_decode(coded.select("pos", "delta"), part=4096).select("pos", "delta", "value")


def _tokens(spark, d):
    return table(spark, d, "part").select("p_partkey", F.transform(F.sequence(F.lit(0), F.col("p_size") % 5), lambda i: ((F.col("p_partkey") * 31 + i * 997) % 65536).cast("int")).alias("ids"))


_TOKENS = "tokens AS (SELECT p_partkey, list_transform(range(0, p_size % 5 + 1), lambda i: (p_partkey * 31 + i * 997) % 65536) AS ids FROM part)"


@query(f"WITH {_TOKENS} SELECT p_partkey, array_to_string(list_transform(ids, lambda i: printf('%04X', i)), '') AS blob_hex FROM tokens")
def pack_tokens(spark, d):
    return _tokens(spark, d).select("p_partkey", F.hex(codec.tokens_to_blob(F.col("ids"))).alias("blob_hex"))


@query(f"WITH {_TOKENS} SELECT p_partkey, array_to_string(ids, ',') AS csv FROM tokens")
def unpack_tokens(spark, d):
    """Packed, length-prefixed, cut again and unpacked."""
    row = codec.length_prefixed(codec.tokens_to_blob(F.col("ids")))
    return _tokens(spark, d).withColumn("row", row).select("p_partkey", codec.tokens_to_csv(codec.tokens_from_blob(F.expr("substring(row, 2)"))).alias("csv"))


@query("SELECT p_partkey, ((p_size % 16) << 4) | (p_partkey % 16) AS packed, CAST(p_size % 16 AS BIGINT) AS high, p_partkey % 16 AS low FROM part")
def nibble_pack(spark, d):
    packed = codec.pack_nibbles((F.col("p_size") % 16).cast("long"), F.col("p_partkey") % 16)
    return table(spark, d, "part").withColumn("packed", packed).select("p_partkey", "packed", codec.high_nibble(F.col("packed")).alias("high"), codec.low_nibble(F.col("packed")).alias("low"))


@query("SELECT p_partkey, p_partkey AS u32, (p_partkey * 7919) % 65536 - 32768 AS i16 FROM part")
def little_endian_read(spark, d):
    data = F.concat(codec.little_endian(F.col("p_partkey"), 4), codec.little_endian(F.col("p_partkey") * 7919 % 65536 - 32768, 2))
    return table(spark, d, "part").withColumn("data", data).select("p_partkey", codec.read_little_endian(F.col("data"), 0, 4).alias("u32"), codec.read_little_endian(F.col("data"), 4, 2, signed=True).alias("i16"))


_VOCABULARY = "vocabulary AS (SELECT CAST(p_partkey AS INTEGER) AS token_id, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_brand END AS token FROM part WHERE p_partkey < 40)"
_DECODED = f"""WITH {_VOCABULARY}, each AS (SELECT p_partkey, i AS n, (p_partkey + i * 7) % 45 AS id FROM part, range(0, 4) r(i))
SELECT p_partkey, string_agg(coalesce(nullif(token, ''), '<UNK:' || id || '>'), '' ORDER BY n) AS text FROM each LEFT JOIN vocabulary ON token_id = id GROUP BY p_partkey"""


def _coded(spark, d):
    p = table(spark, d, "part")
    vocabulary = p.where("p_partkey < 40").select(F.col("p_partkey").cast("int").alias("token_id"), F.when(F.col("p_partkey") % 10 == 0, "").otherwise(F.col("p_brand")).alias("token"))
    return p.select("p_partkey", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: ((F.col("p_partkey") + i * 7) % 45).cast("int")).alias("ids")), vocabulary


@query(_DECODED)
def decode_tokens(spark, d):
    rows, vocabulary = _coded(spark, d)
    return rows.select("p_partkey", bpe.decode(F.col("ids"), vocabulary).alias("text"))


@query(_DECODED)
def decode_tokens_joined(spark, d):
    rows, vocabulary = _coded(spark, d)
    return bpe.decode_joined(rows, "p_partkey", "ids", vocabulary)


@query("SELECT count(*) FILTER (WHERE p_name < before) AS unsorted FROM (SELECT p_name, lag(p_name) OVER (ORDER BY p_partkey) AS before FROM part)")
def sortedness_check(spark, d):
    return columns.unsorted_rows(table(spark, d, "part"), "p_name", "p_partkey")


@query(f"""WITH {_FRONT} SELECT count(*) FILTER (WHERE pos % 7 = 0) AS missing, CAST(0 AS BIGINT) AS extra, count(*) FILTER (WHERE pos % 7 > 0 AND pos % 5 = 1 AND upper(geohash) <> geohash) AS geohash_differs FROM coded""")
def verify_roundtrip(spark, d):
    """Keys against their decoded front coding, of which rows were lost and changed afterwards."""
    coded = _front(spark, d)
    back = columns.front_decode(coded.select("pos", "shared", "suffix")).where(F.col("pos") % 7 > 0)
    back = back.select("pos", F.when(F.col("pos") % 5 == 1, F.upper("value")).otherwise(F.col("value")).alias("geohash"))
    return verify.mismatches(coded.select("pos", "geohash"), back, "pos", ["geohash"])


@query("""WITH a AS (SELECT c_custkey, c_name, c_nationkey FROM customer),
b AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN -c_custkey ELSE c_custkey END AS c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS c_name, c_nationkey + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS c_nationkey FROM customer)
SELECT count(*) FILTER (WHERE b.c_custkey IS NULL) AS missing, count(*) FILTER (WHERE a.c_custkey IS NULL) AS extra,
  count(*) FILTER (WHERE a.c_custkey = b.c_custkey AND a.c_name IS DISTINCT FROM b.c_name) AS c_name_differs,
  count(*) FILTER (WHERE a.c_custkey = b.c_custkey AND a.c_nationkey IS DISTINCT FROM b.c_nationkey) AS c_nationkey_differs
FROM a FULL JOIN b ON a.c_custkey = b.c_custkey""")
def verify_corrupted(spark, d):
    """The comparison of a table with a copy that lost, gained and changed rows."""
    a = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    key = F.col("c_custkey")
    b = a.select(F.when(key % 11 == 0, -key).otherwise(key).alias("c_custkey"), F.when(key % 7 != 0, F.col("c_name")).alias("c_name"), (F.col("c_nationkey") + F.when(key % 5 == 0, 1).otherwise(0)).alias("c_nationkey"))
    return verify.mismatches(a, b, "c_custkey", ["c_name", "c_nationkey"])


@query("SELECT 'cities' AS table_name, count(*) AS n FROM customer UNION ALL SELECT 'regions', count(*) FROM region UNION ALL SELECT 'countries', count(*) FROM nation UNION ALL SELECT 'vocabulary', count(*) FROM part")
def db_stats(spark, d):
    return verify.table_counts({"cities": table(spark, d, "customer"), "regions": table(spark, d, "region"), "countries": table(spark, d, "nation"), "vocabulary": table(spark, d, "part")})


@query("SELECT CAST(sum(strlen(p_name)) AS BIGINT) AS p_name_bytes, CAST(sum(strlen(p_type)) AS BIGINT) AS p_type_bytes FROM part")
def byte_sizes(spark, d):
    return verify.byte_sizes(table(spark, d, "part"), ["p_name", "p_type"])


@query("SELECT CAST(sum(strlen(p_name) + 3) AS BIGINT) AS vocabulary_bytes FROM part")
def vocabulary_bytes(spark, d):
    return verify.vocabulary_bytes(table(spark, d, "part").select(F.col("p_name").alias("token")))


@query("SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS term, p_partkey FROM part")
def fulltext_postings(spark, d):
    return search.postings(table(spark, d, "part"), "p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'widget') AND regexp_matches(lower(p_name), '(^| )co')")
def fulltext_match(spark, d):
    p = table(spark, d, "part")
    hits = search.match(search.postings(p, "p_partkey", "p_name"), "Widget co*", "p_partkey")
    return p.join(hits, "p_partkey", "left_semi").select("p_partkey", "p_name")


_TERMS = r"terms AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS t FROM documents), lined AS (SELECT doc_id, t, ' ' || array_to_string(t, ' ') || ' ' AS line FROM terms)"


def _placed(spark, d) -> DataFrame:
    """All documents' postings with places, stored in the order of terms."""
    path = scratch.new_path(spark)
    search.save_postings(search.positional_postings(table(spark, d, "documents"), "doc_id", "text"), path)
    return spark.read.parquet(path)


@query(f"WITH {_TERMS} SELECT doc_id, 'phrase' AS asked FROM lined WHERE contains(line, ' apache license ') UNION ALL SELECT doc_id, 'prefix' FROM lined WHERE contains(line, ' mit li') UNION ALL SELECT doc_id, 'query' FROM lined WHERE contains(line, ' apache license ') AND contains(line, ' under ') AND contains(line, ' ver')")
def fulltext_phrases(spark, d):
    """Neighbouring words, neighbouring words of which the last is a prefix, and a query of a phrase and terms."""
    index = _placed(spark, d)
    found = {"phrase": search.phrase(index, "Apache License", "doc_id"), "prefix": search.phrase(index, "mit li*", "doc_id"), "query": search.match_text(index, 'under "apache license" ver*', "doc_id")}
    return found["phrase"].withColumn("asked", F.lit("phrase")).unionByName(found["prefix"].withColumn("asked", F.lit("prefix"))).unionByName(found["query"].withColumn("asked", F.lit("query")))


@query(f"""WITH {_TERMS}, places AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM terms)
SELECT DISTINCT a.doc_id FROM places a JOIN places b ON a.doc_id = b.doc_id AND abs(a.i - b.i) - 1 BETWEEN 0 AND 5 WHERE a.term = 'license' AND b.term = 'version'""")
def fulltext_near(spark, d):
    return search.near(_placed(spark, d), "license", "version", 5, "doc_id")


@query("SELECT c_name, c_custkey FROM customer WHERE starts_with(c_name, 'Customer#00000001') ORDER BY c_name, c_custkey LIMIT 20")
def name_prefix_search(spark, d):
    return search.name_prefix(table(spark, d, "customer").select("c_name", "c_custkey"), "c_name", "Customer#00000001", 20)


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 AND c_name IS NOT NULL")
def filter_project(spark, d):
    return table(spark, d, "customer").dropna(subset=["c_name"]).where("c_mktsegment = 'BUILDING' AND c_acctbal > 0").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name, strlen(p_name) AS p_name_bytes FROM part")
def column_insert(spark, d):
    """A column put in after another, the rest in their order."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return p.select(*[c for name in p.columns for c in ([F.col(name)] if name != "p_name" else [F.col(name), F.octet_length(name).cast("long").alias("p_name_bytes")])])


@query("SELECT c_custkey, round(lat, 6) AS lat6, format('{:,}', c_custkey * 1000) AS shown FROM (SELECT c_custkey, CAST((c_custkey * 7919) % 17999 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(90 AS DOUBLE) AS lat FROM customer)")
def round_and_format(spark, d):
    return places(spark, d).select("c_custkey", F.round("lat", 6).alias("lat6"), text.thousands(F.col("c_custkey") * 1000).alias("shown"))


@query("""WITH each AS (SELECT l_orderkey, l_linenumber, (l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 15485863 + l_linenumber * 611953) % 1799999983 + 100000 AS k FROM lineitem),
exact AS (SELECT *, CAST(CAST(k AS DOUBLE) / CAST(10000000 AS DOUBLE) * CAST(1152921504606846976 AS DOUBLE) AS HUGEINT) * 1000000 AS whole FROM each),
cut AS (SELECT *, whole // 1152921504606846976 AS units, whole % 1152921504606846976 AS rest FROM exact)
SELECT l_orderkey, l_linenumber, k, CAST(units + CASE WHEN rest > 576460752303423488 OR (rest = 576460752303423488 AND units % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / CAST(1000000 AS DOUBLE) AS rounded FROM cut""")
def exact_rounding(spark, d):
    """Values of seven decimals to six; the SQL takes the binary fraction as an integer."""
    k = (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_suppkey") * 15485863 + F.col("l_linenumber") * 611953) % 1799999983 + 100000
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", k.alias("k"))
    return rows.withColumn("rounded", exact.round_half_even(F.col("k").cast("double") / 1e7, 6))


@query("SELECT c_custkey, printf('%s (%.4f, %.4f) - %s, %s', c_name, lat, lat / 2, c_mktsegment, CAST(c_nationkey AS VARCHAR)) AS shown, printf('%.2f', lat) AS lat2, printf('%.3f', lat) AS lat3 FROM (SELECT *, CAST((c_custkey * 7919) % 17999 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(90 AS DOUBLE) AS lat FROM customer)")
def fixed_decimals(spark, d):
    p = places(spark, d)
    shown = text.coordinate_label(F.col("c_name"), F.col("lat"), F.col("lat") / 2, F.col("c_mktsegment"), F.col("c_nationkey").cast("string"))
    return p.select("c_custkey", shown.alias("shown"), text.fixed(F.col("lat"), 2).alias("lat2"), text.fixed(F.col("lat"), 3).alias("lat3"))


@query("SELECT o_orderkey FROM orders WHERE (o_orderkey % 200) - 100 < -90 OR (o_orderkey % 200) - 100 >= 90")
def quarantined_coordinates(spark, d):
    lat = (F.col("o_orderkey") % 200 - 100).cast("double")
    return table(spark, d, "orders").where(~geo.valid_coordinate(lat, F.lit(0.0))).select("o_orderkey")


@query("SELECT 'customer' AS table_name, column_name FROM (DESCRIBE SELECT * FROM customer)")
def schema_columns(spark, d):
    names = [f.name for f in table(spark, d, "customer").schema.fields]
    return spark.range(1).select(F.lit("customer").alias("table_name"), F.explode(F.array(*[F.lit(n) for n in names])).alias("column_name"))


@query("""SELECT event_id, n_name AS city_name FROM events JOIN nation ON n_nationkey = user_id % 25""")
def stream_enrichment(spark, d):
    """The batch form of the stream-static join: events at the places of nations."""
    spot = lambda k: ((k * 7 - 88).cast("double"), (k * 13 - 170).cast("double"))
    nation = table(spark, d, "nation")
    named = keys.shortest_unique_keys(nation.withColumn("gh", geo.geohash(*spot(F.col("n_nationkey")))), "gh", "n_nationkey").select(F.col("key").alias("geohash"), F.col("n_name").alias("city_name"))
    lat, lon = spot(F.col("user_id") % 25)
    return enrich.with_city(table(spark, d, "events").select("event_id", lat.alias("lat"), lon.alias("lon")), named, "lat", "lon").select("event_id", "city_name")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, n_name AS city_name, count(*) AS events FROM events JOIN nation ON n_nationkey = user_id % 25 GROUP BY ALL")
def stream_counts(spark, d):
    """Events in files, a quarter of them a batch, taken by a stream that meets the cities and keeps hourly counts; it stops when
    all are read.  A file has 250,000 events or fewer, so that a batch is many tasks."""
    base = scratch.new_path(spark)
    spot = lambda k: ((k * 7 - 88).cast("double"), (k * 13 - 170).cast("double"))
    named = keys.shortest_unique_keys(table(spark, d, "nation").withColumn("gh", geo.geohash(*spot(F.col("n_nationkey")))), "gh", "n_nationkey")
    named.select(F.col("key").alias("geohash"), F.col("n_name").alias("city_name")).write.parquet(f"{base}/cities")
    lat, lon = spot(F.col("user_id") % 25)
    points = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), lat.alias("lat"), lon.alias("lon"))
    files = max(1, -(-points.count() // 1_000_000))
    points.repartition(4 * files).write.parquet(f"{base}/events")
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/events")
    enrich.run_counts(stream, spark.read.parquet(f"{base}/cities"), "ts", f"{base}/out", f"{base}/state", window="1 hour", late="3650 days")
    return enrich.latest_counts(spark, f"{base}/out").select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "city_name", "events")


def _dumps(spark, d, places_of: DataFrame | None = None) -> dict[str, DataFrame]:
    """The test tables in the dumps' layouts."""
    p = places_of or places(spark, d)
    text_or = lambda layout, known: [known.get(f.name, F.lit("")).cast(f.dataType if f.name in known else "string").alias(f.name) for f in layout.fields]
    g = {"geonameid": F.col("c_custkey"), "name": F.col("c_name"), "asciiname": F.col("c_name"), "latitude": F.col("lat"), "longitude": F.col("lon"), "fclass": F.lit("P"), "country": F.concat(F.lit("N"), F.col("c_nationkey")), "admin1": F.col("c_mktsegment"), "population": F.abs("c_acctbal").cast("long") + 1}
    a = p.select(F.concat(F.lit("N"), F.col("c_nationkey"), F.lit("."), F.col("c_mktsegment")).alias("key"), F.concat_ws(" ", "c_mktsegment", "c_nationkey").alias("name")).distinct()
    c = {"ISO": F.concat(F.lit("N"), F.col("n_nationkey")), "Country": F.col("n_name"), "Population": F.lit(1), "Area": F.lit(1.5), "geonameid": F.col("n_nationkey")}
    return {"geoname": p.select(*text_or(schema.GEONAME, g)), "admin1": a.select("key", "name", F.col("name").alias("asciiname"), F.lit("1").alias("geonameid")), "country": table(spark, d, "nation").select(*text_or(schema.COUNTRY, c))}


def _written_dumps(spark, d, places_of: DataFrame | None = None) -> dict[str, str]:
    base = scratch.new_path(spark)
    out = {}
    for name, df in _dumps(spark, d, places_of).items():
        out[name] = f"{base}/{name}"
        df.write.csv(out[name], sep="\t", quote='"', escape='"', emptyValue="")
    return out


@query("""SELECT c_custkey AS geonameid, c_name || CASE WHEN c_custkey % 5 = 0 THEN chr(10) || '"' || c_mktsegment || '"' || chr(9) || 'end' ELSE '' END AS name, c_mktsegment AS admin1 FROM customer""")
def tsv_scan(spark, d):
    """Every fifth name holds a line end, quotes and a tab."""
    more = F.concat(F.lit('\n"'), "c_mktsegment", F.lit('"\tend'))
    named = places(spark, d).withColumn("c_name", F.concat("c_name", F.when(F.col("c_custkey") % 5 == 0, more).otherwise("")))
    return tsv.read_dump(spark, _written_dumps(spark, d, named)["geoname"], schema.GEONAME).rows.select("geonameid", "name", "admin1")


@query("""SELECT c_nationkey, n AS "row", 2 AS fields, c_custkey || chr(9) || CASE WHEN c_custkey % 5 = 0 THEN '"' || c_name || chr(10) || chr(10) || repeat('"', 2) || 'x' || repeat('"', 3) ELSE c_name END AS line
FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) WHERE c_custkey % 7 = 0 AND c_custkey % 11 > 0""")
def tsv_rejects(spark, d):
    """A file for each nation; every seventh row lacks a field, every eleventh is a comment, every fifth holds line ends."""
    base = scratch.new_path(spark)
    key = F.col("c_custkey")
    name = F.when(key % 5 == 0, F.concat(F.lit('"'), "c_name", F.lit('\n\n""x"""'))).otherwise(F.col("c_name"))
    line = F.concat_ws("\t", F.concat(F.when(key % 11 == 0, "#").otherwise(""), key), name, F.when(key % 7 != 0, F.col("c_mktsegment")))
    rows = table(spark, d, "customer").select("c_nationkey", "c_custkey", line.alias("value")).repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    rows.select("c_nationkey", "value").write.partitionBy("c_nationkey").text(base)
    rejects = tsv.read_dump(spark, base, schema.layout(key="bigint", name="string", segment="string")).rejects
    return rejects.select(F.regexp_extract("file", r"c_nationkey=(\d+)", 1).cast("long").alias("c_nationkey"), "row", "fields", "line")


@query(f"""WITH {_KEYED} SELECT key AS geohash, replace(c_name, ' ', '') AS city_name FROM keyed""")
def bundle_roundtrip(spark, d):
    """Dumps to a store, the store to a bundle, the bundle read back and decoded."""
    base = scratch.new_path(spark)
    build.build(spark, _written_dumps(spark, d), f"{base}/store", vocab_size=300)
    build.build_bundle(spark, f"{base}/store", f"{base}/cities.bin")
    return gazetteer.Gazetteer.load_bundle(spark, f"{base}/cities.bin").table("cities").select("geohash", "city_name")


_REGIONS = "regions AS (SELECT key, name, row_number() OVER (ORDER BY name, key) AS id FROM (SELECT DISTINCT 'N' || c_nationkey || '.' || c_mktsegment AS key, c_mktsegment || ' ' || c_nationkey AS name FROM customer))"


def _bundle(spark, d) -> str:
    """A bundle of the test tables, with its index; its path."""
    base = scratch.new_path(spark)
    build.build(spark, _written_dumps(spark, d), f"{base}/store", vocab_size=300)
    build.build_bundle(spark, f"{base}/store", f"{base}/cities.bin")
    return f"{base}/cities.bin"


@query(f"""WITH {_KEYED} SELECT key AS geohash, replace(c_name, ' ', '') AS city_name FROM keyed
WHERE starts_with(key, 's') OR key IN (SELECT max(key) FROM keyed UNION SELECT min(key) FROM keyed) OR key BETWEEN 'b' AND 'c'""")
def bundle_ranges(spark, d):
    """A prefix, two keys and an interval of keys, each looked up in a bundle: their conditions choose the blocks that are read."""
    g = gazetteer.Gazetteer.load_bundle(spark, _bundle(spark, d))
    ends = g.table("cities").agg(F.min("geohash"), F.max("geohash")).first()
    geohash = ("geohash",)
    found = [g.cities_where(StringStartsWith(geohash, "s")), g.cities_where(In(geohash, tuple(ends))), g.cities_where(GreaterThanOrEqual(geohash, "b"), LessThanOrEqual(geohash, "c"))]
    return found[0].unionByName(found[1]).unionByName(found[2]).distinct().select("geohash", "city_name")


@query(f"""WITH {_KEYED}, {_REGIONS}
SELECT k.key AS geohash, replace(r.name, ' ', '') AS region_name, n.n_name AS country_name FROM keyed k JOIN regions r ON r.key = 'N' || c_nationkey || '.' || c_mktsegment JOIN nation n ON n_nationkey = c_nationkey""")
def bundle_scanned(spark, d):
    """A bundle whose index is lost: one scan makes another, then cities are read in ranges."""
    path = _bundle(spark, d)
    scratch.delete(spark, path + ranged.SUFFIX)
    g = gazetteer.Gazetteer.load_bundle(spark, path)
    return g.table("cities").join(g.table("regions"), "region_id").join(g.table("countries"), "country_id").select("geohash", "region_name", "country_name")


@query("""SELECT 'behind.bin' AS file, '1 bytes after the last section' AS fault UNION ALL SELECT 'mark.bin', 'not a bundle' UNION ALL
SELECT 'short.bin', 'bytes wanted' UNION ALL SELECT 'counts.bin', (SELECT count(*) FROM customer) || ' rows, the header says ' || (SELECT count(*) + 1 FROM customer)""")
def bundle_faults(spark, d):
    """A sound bundle and four damaged copies, checked: which is damaged, and how."""
    path = _bundle(spark, d)
    folder = scratch.new_path(spark)
    n = int.from_bytes(bundle.some_bytes(spark, path, 12, 4), "little") + 1
    copies = {"sound": {}, "behind": {"more": b"x"}, "mark": {"changed": {0: b"X"}}, "short": {"cut": 1}, "counts": {"changed": {12: n.to_bytes(4, "little")}}}
    for name, how in copies.items():
        bundle.put_changed(spark, path, f"{folder}/{name}.bin", **{"changed": {}} | how)
    found = bundle.faults(spark, folder).select(F.element_at(F.split("file", "/"), -1).alias("file"), "fault")
    kind = F.regexp_extract("fault", r"(\d+ bytes after the last section|not a bundle|bytes wanted|\d+ rows, the header says \d+)", 1)
    return found.select("file", kind.alias("fault"))


@query("SELECT count(*) AS cities, (SELECT count(*) FROM nation) AS countries, (SELECT count(DISTINCT c_nationkey || '.' || c_mktsegment) FROM customer) AS regions FROM customer")
def bundle_header(spark, d):
    base = scratch.new_path(spark)
    build.build(spark, _written_dumps(spark, d), f"{base}/store", vocab_size=300)
    build.build_bundle(spark, f"{base}/store", f"{base}/cities.bin")
    return bundle.header_counts(spark, f"{base}/cities.bin").select("cities", "countries", "regions")


def _built(spark, d) -> str:
    """A store of the test tables and its column files; their folder."""
    base = scratch.new_path(spark)
    build.build(spark, _written_dumps(spark, d), f"{base}/store", vocab_size=300)
    build.build_sections(spark, f"{base}/store", f"{base}/columns")
    return base




@query(f"""WITH {_KEYED}, {_REGIONS}
SELECT row_number() OVER (ORDER BY k.key) - 1 AS pos, k.key AS geohash, CAST(r.id AS INTEGER) AS region_id, CAST(n.id AS INTEGER) AS country_id FROM keyed k
JOIN regions r ON r.key = 'N' || c_nationkey || '.' || c_mktsegment JOIN (SELECT n_nationkey, row_number() OVER (ORDER BY n_name, n_nationkey) AS id FROM nation) n ON n.n_nationkey = c_nationkey""")
def section_files(spark, d):
    """Three of the column files, decoded on their own and put side by side."""
    folder = f"{_built(spark, d)}/columns"
    out = build.column_values(spark, folder, "geohash").withColumnRenamed("value", "geohash")
    for name in ("region_id", "country_id"):
        out = out.join(build.column_values(spark, folder, name).withColumnRenamed("value", name), "pos")
    return out.select("pos", "geohash", "region_id", "country_id")


@query("""SELECT name, CAST(0 AS BIGINT) AS faults, damaged FROM (SELECT unnest(['geohash', 'region_id', 'country_id', 'city_tokens', 'region_tokens', 'country_tokens']) AS name), (SELECT unnest([true, false]) AS damaged) WHERE NOT (name = 'region_id' AND damaged)
UNION ALL SELECT 'region_id', count(*), true FROM customer""")
def section_verify(spark, d):
    """Column files against the store they were made of, before and after one of them is damaged: faults by column.
    The first step of a column counts in all its rows."""
    base = _built(spark, d)
    sound = build.verify_sections(spark, f"{base}/store", f"{base}/columns")
    path = f"{base}/columns/{bundle.FILES['region_id']}"
    first = bundle.some_bytes(spark, path, 4, 1)[0]
    scratch.move(spark, path, f"{base}/sound.bin")
    bundle.put_changed(spark, f"{base}/sound.bin", path, {4: bytes([first ^ 1])})
    found = build.verify_sections(spark, f"{base}/store", f"{base}/columns")
    return spark.createDataFrame([(name, n, damaged) for damaged, of in ((False, sound), (True, found)) for name, n in of.items()], "name string, faults long, damaged boolean")


@query("SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def sqlite_scan(spark, d):
    """A table written to a SQLite file in the shared folder and read back in ranges of its rows."""
    folder = scratch.new_path(spark).removeprefix("file:")
    if "://" in folder:
        raise ValueError("SQLite files need a shared folder that is mounted everywhere")
    os.makedirs(folder, exist_ok=True)
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    sqlite.write_sqlite(c, f"{folder}/places.db", "customer")
    spark.dataSource.register(sqlite.SqliteSource)
    return spark.read.format("sqlitefile").option("table", "customer").load(f"{folder}/places.db")


@query("SELECT c_custkey AS geonameid, c_name || ', ' || c_mktsegment || ' ' || c_nationkey || ', ' || n_name AS longname FROM customer JOIN nation ON n_nationkey = c_nationkey")
def fulltext_table(spark, d):
    """The full-text table that a build writes, read back."""
    base = scratch.new_path(spark)
    build.build(spark, _written_dumps(spark, d), base, vocab_size=300)
    return store.load(spark, base, "fulltext").select("geonameid", "longname")


@query(f"""WITH {_KEYED} SELECT key AS geohash, c_name AS city_name, replace(c_name, ' ', '') AS decoded FROM keyed""")
def tokenized_tables(spark, d):
    """A store's tables with names as tokens beside the names, the tokens decoded again."""
    base = scratch.new_path(spark)
    build.build(spark, _written_dumps(spark, d), f"{base}/store", vocab_size=300)
    build.tokenize(spark, f"{base}/store", f"{base}/tokens", keep_original=True, packing="csv")
    ids = codec.tokens_from_csv(F.col("city_name_tokens"))
    return store.load(spark, f"{base}/tokens", "cities").select("geohash", "city_name", bpe.decode(ids, store.load(spark, f"{base}/tokens", "vocabulary")).alias("decoded"))


@query("SELECT 'before' AS reader, c_custkey FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'after', c_custkey FROM customer")
def store_versions(spark, d):
    """A reader that opened the store before a new version was published, and one after; a version that never was."""
    path = scratch.new_path(spark)
    c = table(spark, d, "customer").select("c_custkey")
    versions = [store.Version.begin(spark, path) for _ in range(3)]
    for version, rows in zip(versions, (c.where("c_custkey % 2 = 0"), c, c.limit(0)), strict=True):
        version.save({"cities": rows})
    versions[0].publish()
    before = store.load(spark, path, "cities")
    versions[1].publish()
    return before.select(F.lit("before").alias("reader"), "c_custkey").unionAll(store.load(spark, path, "cities").select(F.lit("after"), "c_custkey"))


@query("""SELECT 'country_id' AS "by", c_custkey, c_name FROM customer WHERE c_nationkey = 7 UNION ALL
SELECT 'region_id', c_custkey, c_name FROM customer WHERE c_nationkey = 7 AND c_custkey % 3 = 1 UNION ALL SELECT 'city_name', c_custkey, c_name FROM customer WHERE c_custkey = 11""")
def secondary_lookups(spark, d):
    """Cities stored in the order of their keys, looked up by country, region and name: each file's filters choose what is opened."""
    base = scratch.new_path(spark)
    key = F.col("c_custkey")
    near = geo.geohash(F.col("c_nationkey") * 6.0 - 75 + key % 97 / 100.0, F.col("c_nationkey") * 13.0 - 160 + key % 89 / 100.0)  # nations lie apart
    stored = table(spark, d, "customer").select(F.concat(near, F.lit("_"), key).alias("geohash"), F.col("c_name").alias("city_name"), F.col("c_nationkey").alias("country_id"), (F.col("c_nationkey") * 3 + key % 3).alias("region_id"), key)
    store.save({"cities": stored}, base, city_files=12)
    store.add_paths(spark, base, "cities", ["country_id", "region_id", "city_name"])
    asked = {"country_id": 7, "region_id": 22, "city_name": "Customer#000000011"}
    parts = [store.find(spark, base, "cities", c, v).select(F.lit(c).alias("by"), "c_custkey", F.col("city_name").alias("c_name")) for c, v in asked.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT c_custkey AS geonameid, c_name || CASE WHEN c_custkey % 10 = 1 THEN ' Ends-in-One' ELSE '' END || ', ' || c_mktsegment || ' ' || c_nationkey || ', ' || n_name AS longname FROM customer JOIN nation ON n_nationkey = c_nationkey
WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3 OR n_name = 'NATION_7' AND c_custkey % 10 <> 1""")
def fulltext_search(spark, d):
    """The full-text index that a build writes, asked for a phrase in a field or a word, without some rows."""
    base = scratch.new_path(spark)
    last = F.when(F.col("c_custkey") % 10 == 1, " Ends-in-One").otherwise("")
    build.build(spark, _written_dumps(spark, d, places(spark, d).withColumn("c_name", F.concat("c_name", last))), base, vocab_size=300)
    return gazetteer.Gazetteer.load(spark, base).search_text('admin1:"building 3" OR "nation 7" NOT ends-in-one').select("geonameid", "longname")


@query("SELECT o_orderkey, CASE WHEN o_custkey * 50 <= 65535 THEN printf('%04X', o_custkey * 50) END AS token, CASE WHEN o_custkey * 50 - 20000 <= 32767 THEN CAST(o_custkey * 50 - 20000 AS INTEGER) END AS step FROM orders")
def range_guards(spark, d):
    """What fits two bytes is coded and read back; what doesn't never gets there (it would fail)."""
    n = F.col("o_custkey") * 50
    token = F.when(n <= codec.MAX_TOKEN, F.hex(codec.tokens_to_blob(F.array(F.when(n <= codec.MAX_TOKEN, n).otherwise(0)))))
    fits = n - 20000 <= 32767
    step = codec.read_little_endian(columns.step_bytes(F.when(fits, n - 20000).otherwise(0), F.col("o_orderkey")), 0, 2, signed=True)
    return table(spark, d, "orders").select("o_orderkey", token.alias("token"), F.when(fits, step).cast("int").alias("step"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with their shortest unique keys and labels, those below one prefix, in key order."""
    countries, regions = dimensions(spark, sf_dir)
    placed = cities(spark, sf_dir).join(countries.select("country_id", "region_id"), "country_id")
    return gazetteer.cities_by_prefix(gazetteer.labelled(placed, regions, countries), "s").select("geohash", "city_name", "label")
