"""The build: dumps to a Parquet store, and from it to a single-file bundle."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema, scratch
from ..functions.codec import length_prefixed, tokens_to_blob
from ..functions.geo import geohash, valid_coordinate
from ..operators import bpe, bpe_tables, columns, keys, normalize, search, verify
from ..sources import bundle, ranged, store, tsv


def simplified(dumps: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """countries, regions, and places classified as inserted, duplicate or skipped."""
    countries, regions = normalize.countries_of(dumps["country"]), normalize.regions_of(dumps["admin1"])
    return {"countries": countries, "regions": regions, "classified": normalize.classify_cities(dumps["geoname"], countries, regions)}


def keyed_cities(cities: DataFrame, require_region: bool = True) -> tuple[DataFrame, DataFrame]:
    """Cities with their shortest unique geohash as ``geohash``, and those whose coordinates can't be
    encoded.  Cities without a region are left out unless ``require_region`` is false."""
    kept = cities.dropna(subset=["city_name"]).where(F.col("region_id").isNotNull() | F.lit(not require_region))
    ok = valid_coordinate(F.col("latitude"), F.col("longitude"))
    hashed = kept.where(ok).withColumn("_hash", geohash(F.col("latitude"), F.col("longitude")))
    found = keys.shortest_unique_keys(hashed, "_hash", "geonameid")
    return found.select(F.col("key").alias("geohash"), "precision", "city_name", "region_id", "country_id", "geonameid"), kept.where(~ok)


def build(spark: SparkSession, source: dict[str, str], out: str, vocab_size: int = 1000, require_region: bool = True, mode: str = "overwrite", city_files: int | None = None) -> dict[str, int]:
    """Build a store at ``out`` from the dumps at ``source`` (geoname, admin1, country: paths).

    The classified places and the keyed cities are written and read back, once each: the natural
    places to cut the plan.  All tables belong to a new version, which is shown when the last one is
    written; the version before stays for readers that have it open.  With ``mode`` "error" a store that
    is there stays as it is and FileExistsError is raised.  Returns counts, also of rejected lines and of
    places left out.
    """
    store.refuse_or_replace(spark, out, mode)
    read = dict(zip(source, scratch.at_once(partial(tsv.read_dump, spark, path, schema.DUMPS[name]) for name, path in source.items()), strict=True))
    rows = {name: d.rows for name, d in read.items()}
    scratch.at_once(partial(tsv.require_unique, rows[name], key, name) for name, key in (("geoname", "geonameid"), ("admin1", "key"), ("country", "ISO")))
    version = store.Version.begin(spark, out)
    made = simplified(rows)
    version.save({"classified": made["classified"], "countries": made["countries"], "regions": made["regions"], "fulltext": normalize.fulltext_rows(rows["geoname"], rows["admin1"], rows["country"])})
    classified, countries, regions = (version.load(t) for t in ("classified", "countries", "regions"))
    cities, quarantine = keyed_cities(normalize.cities_of(classified), require_region)
    version.save({"cities": cities, "quarantine": quarantine}, city_files)
    cities = version.load("cities")
    corpus = bpe.corpus((cities, "city_name"), (regions, "region_name"), (countries, "country_name"))
    terms = search.positional_postings(version.load("fulltext"), "geonameid", *search.FIELDS)
    vocabulary, *_ = scratch.at_once([
        lambda: bpe_tables.learn(corpus, "name", vocab_size),
        lambda: store.add_paths(spark, version.place, "cities", ["country_id", "region_id", "city_name"]),
        lambda: search.save_postings(terms, f"{version.place}/fulltext_terms"),
    ])
    version.save({"placed": columns.by_key(cities), "vocabulary": bpe.vocabulary_table(spark, vocabulary), "merges": bpe.merges_table(spark, vocabulary)})
    counted = {f"{name}_rejects": d.rejects for name, d in read.items()} | {"cities": cities, "quarantined": version.load("quarantine"), "regions": regions, "countries": countries}
    outcomes, *numbers = scratch.at_once([normalize.outcome_counts(classified).first, *[df.count for df in counted.values()]])
    counts = outcomes.asDict() | dict(zip(counted, numbers, strict=True)) | {"vocabulary": len(vocabulary.tokens)}
    version.publish()
    store.vacuum(spark, out)
    return counts


def token_rows(df: DataFrame, name: str, vocabulary: bpe.Vocabulary) -> DataFrame:
    """pos and data: the encoded token row of each name."""
    return df.select("pos", length_prefixed(tokens_to_blob(bpe.encode(vocabulary, F.col(name)))).alias("data"))


def region_numbers(placed: DataFrame) -> DataFrame:
    """``placed`` with no region as region 0, as the format has it."""
    return placed.withColumn("region_id", F.coalesce("region_id", F.lit(0)))


def bundle_sections(placed: DataFrame, regions: DataFrame, countries: DataFrame, vocabulary: bpe.Vocabulary) -> dict[str, tuple[DataFrame, int]]:
    """The six encoded columns of cities with ``pos``; ids of regions and countries must be 1..N."""
    placed = region_numbers(placed)
    n, m, k = scratch.at_once([placed.count, regions.count, countries.count])
    return {
        "geohash": (columns.front_rows(columns.front_encode(placed, "geohash")), n),
        "region_id": (columns.delta_rows(columns.delta_encode(placed, "region_id")), n),
        "country_id": (columns.delta_rows(columns.delta_encode(placed, "country_id")), n),
        "city_tokens": (token_rows(placed, "city_name", vocabulary), n),
        "region_tokens": (token_rows(regions.withColumn("pos", F.col("region_id") - 1), "region_name", vocabulary), m),
        "country_tokens": (token_rows(countries.withColumn("pos", F.col("country_id") - 1), "country_name", vocabulary), k),
    }


def _stored(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], bpe.Vocabulary]:
    """The tables of the store's current version; ``placed`` are the cities in the order of their keys."""
    place = store.current(spark, path)
    tables = {t: spark.read.parquet(f"{place}/{t}") for t in ("cities", "regions", "countries", "vocabulary", "merges", "placed")}
    return tables, bpe.load_vocabulary(tables["vocabulary"], tables["merges"])


def tokenize(spark: SparkSession, path: str, out: str, keep_original: bool = False, packing: str = "blob") -> dict[str, int]:
    """Write the store's cities, regions and countries with names as tokens, and the vocabulary; returns row counts."""
    tables, vocabulary = _stored(spark, path)
    done = {t: bpe.tokenize_table(tables[t], vocabulary, keep_original, packing) for t in ("cities", "regions", "countries")}
    store.save(done | {"vocabulary": tables["vocabulary"]}, out)
    return {t: store.load(spark, out, t).count() for t in (*done, "vocabulary")}


def _encoded(tables: dict[str, DataFrame], vocabulary: bpe.Vocabulary) -> tuple[dict[str, tuple[DataFrame, int]], DataFrame]:
    """The encoded columns, each written once, and the index that lets readers begin within them."""
    sections = bundle_sections(tables["placed"], tables["regions"], tables["countries"], vocabulary)
    kept = dict(zip(sections, zip(scratch.at_once(partial(scratch.written, df) for df, _ in sections.values()), [n for _, n in sections.values()], strict=True), strict=True))
    return kept, ranged.index_of(region_numbers(tables["placed"]), kept["geohash"][0], kept["city_tokens"][0])


def build_sections(spark: SparkSession, path: str, folder: str) -> dict[str, int]:
    """Write the six columns of the store at ``path`` as files, and their index; returns the files' sizes."""
    sections, index = _encoded(*_stored(spark, path))
    sizes = bundle.write_sections(spark, folder, sections)
    ranged.save_index(index, f"{folder}/cities")
    for df, _ in sections.values():
        scratch.forget_written(df)
    return sizes


def column_values(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """pos and value of a column file: columns of cities in ranges where they can be, else in one task."""
    if name in ("region_tokens", "country_tokens") or not ranged.reachable(folder) or not ranged.has_index(spark, f"{folder}/cities"):
        return bundle.read_section(spark, folder, name)
    return ranged.read_column(spark, folder, name)


def verify_sections(spark: SparkSession, path: str, folder: str) -> dict[str, int]:
    """How many rows of the column files differ from the store, are missing or too many, by column."""
    tables, vocabulary = _stored(spark, path)
    placed = region_numbers(tables["placed"])
    tokens = lambda name: tokens_to_blob(bpe.encode(vocabulary, F.col(name)))
    want = {name: placed.select("pos", F.col(name).alias("value")) for name in ("geohash", "region_id", "country_id")}
    want["city_tokens"] = placed.select("pos", tokens("city_name").alias("value"))
    for table, name in (("regions", "region"), ("countries", "country")):
        want[f"{name}_tokens"] = tables[table].select((F.col(f"{name}_id") - 1).alias("pos"), tokens(f"{name}_name").alias("value"))
    return {name: sum(verify.mismatches(df, column_values(spark, folder, name), "pos", ["value"]).first()) for name, df in want.items()}


def build_bundle(spark: SparkSession, path: str, out: str) -> int:
    """Write the store at ``path`` as the bundle ``out``, and its index beside it; returns the bundle's size in bytes."""
    tables, vocabulary = _stored(spark, path)
    sections, index = _encoded(tables, vocabulary)
    size = bundle.write_bundle(spark, out, tables["vocabulary"], sections)
    ranged.save_index(index, out)
    for df, _ in sections.values():
        scratch.forget_written(df)
    return size
