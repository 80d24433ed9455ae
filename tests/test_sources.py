"""Dumps, bundles, SQLite files, the build and the lookups over it, and the stream."""

import struct

import pytest
from pyspark.sql import functions as F

from atlasframe import schema
from atlasframe.__main__ import main
from atlasframe.plans.build import build, build_bundle, build_sections, verify_sections
from atlasframe.plans.gazetteer import Gazetteer, NotLoaded
from atlasframe.sources import bundle, sqlite, tsv
from atlasframe.streaming import enrich


def place(**known):
    known = {k: str(v) for k, v in known.items()}
    return "\t".join(known.get(f.name, "") for f in schema.GEONAME.fields)


GEONAME = "\n".join(
    [
        "# comment",
        '"#7"\tquoted comment',
        "",
        place(geonameid=1, name="Ārdamatā", asciiname="Ardamata", latitude="13.48", longitude="22.37", fclass="P", country="AA", admin1="01", population=50, timezone="T"),
        place(geonameid=2, name="New York City", asciiname="New York City", latitude="40.71", longitude="-74.0", fclass="P", country="BB", admin1="02", population=900),
        place(geonameid=3, name="Same Spot", asciiname="Same Spot", latitude="40.71", longitude="-74.0", fclass="P", country="BB", admin1="02", population=10),
        place(geonameid=4, name="Nowhere", asciiname="Nowhere", latitude="13.48", longitude="22.37", fclass="P", country="ZZ", admin1="01", population=70),
        place(geonameid=5, name="No Region", asciiname="No Region", latitude="1.5", longitude="2.5", fclass="P", country="AA", admin1="99", population=5),
        place(geonameid=6, name="Hill", asciiname="Hill", latitude="1", longitude="2", fclass="T", country="AA", admin1="01", population=5),
        place(geonameid=7, name="Empty", asciiname="Empty", latitude="1", longitude="3", fclass="P", country="AA", admin1="01", population=0),
        place(geonameid=8, name="Unknown", asciiname="Unknown", latitude="1", longitude="3", fclass="P", country="AA", admin1="01", population=""),
        place(geonameid=9, name="Pole", asciiname="Pole", latitude="90", longitude="3", fclass="P", country="AA", admin1="01", population=1),
        place(geonameid=10, name='"\'s-Gravenzande ""x"""', asciiname="s", latitude="52.0", longitude="4.16", fclass="P", country="BB", admin1="02", population=20),
        "too\tfew",
        place(geonameid=11) + "\tone more",
    ]
)
ADMIN1 = "AA.01\tFirst\tFirst\t1\nBB.02\tSecond Region\tSecond Region\t2\n"
COUNTRY = "#ISO\n" + "\n".join("\t".join([iso, "", "", "", name, "", "0.44", "12"] + [""] * 11) for iso, name in (("BB", "Bland"), ("AA", "Aland"))) + "\n"


@pytest.fixture(scope="module")
def dumps(tmp_path_factory):
    base = tmp_path_factory.mktemp("dumps")
    out = {}
    for name, text in (("geoname", GEONAME), ("admin1", ADMIN1), ("country", COUNTRY)):
        (base / f"{name}.txt").write_text(text, encoding="utf-8")
        out[name] = str(base / f"{name}.txt")
    return out


@pytest.fixture(scope="module")
def built(spark, dumps, tmp_path_factory):
    base = tmp_path_factory.mktemp("built")
    counts = build(spark, dumps, f"{base}/store", vocab_size=120)
    size = build_bundle(spark, f"{base}/store", f"{base}/cities.bin")
    return base, counts, size


def test_dump_rows_and_rejects(spark, dumps):
    found = tsv.read_dump(spark, dumps["geoname"], schema.GEONAME)
    rows = {r["geonameid"]: r for r in found.rows.collect()}
    assert sorted(rows) == list(range(1, 11)) and found.rejects.count() == 2
    assert rows[10]["name"] == "'s-Gravenzande \"x\"" and rows[1]["admin2"] == "" and rows[8]["population"] is None and rows[1]["elevation"] is None
    country = tsv.read_dump(spark, dumps["country"], schema.COUNTRY).rows.collect()
    assert sorted((r["ISO"], r["Area"], r["Population"]) for r in country) == [("AA", 0.44, 12), ("BB", 0.44, 12)]


def test_repeated_key_fails(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    with pytest.raises(ValueError, match="repeated id: 1"):
        tsv.require_unique(df, "id", "places")


def test_build_counts(built):
    _, counts, size = built
    assert counts == {"inserted": 5, "duplicates": 1, "skipped": 1, "geoname_rejects": 2, "admin1_rejects": 0, "country_rejects": 0, "cities": 3, "quarantined": 1, "regions": 2, "countries": 2, "vocabulary": counts["vocabulary"]}
    assert size > 32


def test_lookups(spark, built):
    g = Gazetteer.load(spark, f"{built[0]}/store")
    by_name = {r["city_name"]: r["geohash"] for r in g.table("cities").collect()}
    assert set(by_name) == {"Ārdamatā", "New York City", "'s-Gravenzande \"x\""}
    ny = by_name["New York City"]
    assert g.city_label(ny) == "New York City, Second Region, Bland"
    assert g.find_by_geohash(ny)["city_name"] == "New York City" and g.find_by_geohash("nonexistent") is None and g.city_label("nonexistent") is None
    assert g.find_by_geohash(ny + "0") is None
    assert [r["geohash"] for r in g.find_by_prefix("").collect()] == sorted(by_name.values())
    assert g.find_by_prefix("", 0).count() == 0 and g.find_by_prefix("", -1).count() == 0 and g.find_by_prefix("", 2).count() == 2
    assert g.stats() == {"cities": 3, "regions": 2, "countries": 2, "vocabulary": built[1]["vocabulary"]}
    g.create_views()
    assert spark.sql("SELECT city_name FROM cities JOIN countries USING (country_id) WHERE country_name = 'Aland'").count() == 1


def test_point_lookup_is_pushed_down(spark, built):
    plan = Gazetteer.load(spark, f"{built[0]}/store").find_by_prefix("u1")._jdf.queryExecution().toString()
    assert "StringStartsWith(geohash,u1)" in plan and "TakeOrderedAndProject" in plan


def test_not_loaded():
    assert Gazetteer().stats() is None
    with pytest.raises(NotLoaded):
        Gazetteer().find_by_geohash("u")


def test_bundle_round_trip(spark, built):
    path = f"{built[0]}/cities.bin"
    data = open(path, "rb").read()
    assert len(data) == built[2] and bundle.problems(data) == [] and data[:8] == b"CITYDB01"
    assert main(["verify", path]) == 0
    g, store = Gazetteer.load_bundle(spark, path), Gazetteer.load(spark, f"{built[0]}/store")
    want = {(r["geohash"], r["city_name"].replace(" ", ""), r["region_id"], r["country_id"]) for r in store.table("cities").collect()}
    assert {tuple(r) for r in g.table("cities").collect()} == want
    spark.dataSource.register(bundle.CityBundleSource)
    assert spark.read.format("citybundle").option("table", "regions").load(path).count() == 2
    assert bundle.header_counts(spark, path).first()["cities"] == 3


def test_column_files(spark, built, tmp_path):
    store = f"{built[0]}/store"
    sizes = build_sections(spark, store, str(tmp_path))
    assert set(verify_sections(spark, store, str(tmp_path)).values()) == {0}
    data = open(f"{built[0]}/cities.bin", "rb").read()
    parts = bundle.composition(data)
    assert {n: parts[n] - 4 for n in bundle.SECTIONS} == sizes and sum(parts.values()) == 2 * len(data)
    (tmp_path / f".{bundle.FILES['region_id']}.crc").unlink()  # the file system's own checksum
    with open(tmp_path / bundle.FILES["region_id"], "r+b") as f:
        f.seek(4)
        f.write(b"\x09\x00")
    found = verify_sections(spark, store, str(tmp_path))
    assert found["region_id"] > 0 and found["geohash"] == 0


def packed(vocabulary=(), keys=(), regions=(), countries=(), blobs=(), region_blobs=(), country_blobs=()):
    """A bundle by hand; keys as (sizes byte, suffix)."""
    out = b"CITYDB01" + struct.pack("<4I", len(vocabulary), len(keys), len(region_blobs), len(country_blobs)) + bytes(8)
    for k, t in vocabulary:
        out += struct.pack(">HB", k, len(t)) + t
    rows = [[bytes([s]) + t for s, t in keys], *[[struct.pack("<h", v) for v in c] for c in (regions, countries)], *[[bytes([len(b)]) + b for b in c] for c in (blobs, region_blobs, country_blobs)]]
    for r in rows:
        body = struct.pack("<I", len(r)) + b"".join(r)
        out += struct.pack("<I", len(body)) + body
    return out


TWO = dict(vocabulary=[(0, b"<unk>"), (1, b"A")], keys=[(0x03, b"u1a"), (0x21, b"b")], regions=[1, 0], countries=[2, -1], blobs=[b"\0\1", b"\0\1\0"], region_blobs=[b""], country_blobs=[b"", b""])


def test_bundle_by_hand():
    b = bundle.parse(packed(**TWO))
    assert bundle.rows(b, "cities") == [(0, "u1a", 1, 2, b"\0\1"), (1, "u1b", 1, 1, b"\0\1\0")]
    assert bundle.rows(bundle.parse(packed()), "cities") == []


@pytest.mark.parametrize(
    ("data", "what"),
    [
        (b"XXXXXXXX" + packed()[8:], "not a bundle"),
        (packed(**TWO)[:-1], "wanted"),
        (packed(**TWO) + b"x", "after the last section"),
        (packed(**TWO | {"keys": [(0x03, b"u1b"), (0x21, b"a")]}), "below the one before"),
        (packed(**TWO | {"blobs": [b""]}), "the header says 2"),
    ],
)
def test_bundle_faults(data, what):
    assert any(what in p for p in bundle.problems(data))


def test_sqlite_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5, bytearray(b"x")), (2, None, None, None), (3, "c", 0.0, bytearray())], "i long, s string, d double, b binary")
    sqlite.write_sqlite(df, str(tmp_path / "x.db"), "t", batch=2)
    spark.dataSource.register(sqlite.SqliteSource)
    back = spark.read.format("sqlitefile").option("table", "t").load(str(tmp_path / "x.db"))
    assert back.schema.simpleString() == "struct<i:bigint,s:string,d:double,b:binary>"
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_sqlite_views_and_tables_without_rowids(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "y.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (k TEXT PRIMARY KEY, n INTEGER) WITHOUT ROWID")
        db.execute("CREATE TABLE e (n INTEGER)")
        db.execute("CREATE TABLE far (n INTEGER)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(f"k{i}", i) for i in range(20)])
        db.executemany("INSERT INTO far (rowid, n) VALUES (?, ?)", [(-5, 1), (0, 2), (10**6, 3)])
        db.execute("CREATE VIEW v AS SELECT n FROM t WHERE n > 4")
    spark.dataSource.register(sqlite.SqliteSource)
    read = lambda t: sorted(r["n"] for r in spark.read.format("sqlitefile").option("table", t).load(path).collect())
    assert read("t") == list(range(20)) and read("v") == list(range(5, 20)) and read("e") == [] and read("far") == [1, 2, 3]


def test_places_without_a_region_go_through_the_bundle(spark, dumps, tmp_path):
    build(spark, dumps, f"{tmp_path}/store", vocab_size=120, require_region=False)
    build_bundle(spark, f"{tmp_path}/store", f"{tmp_path}/cities.bin")
    rows = {r["city_name"]: r["region_id"] for r in Gazetteer.load_bundle(spark, f"{tmp_path}/cities.bin").table("cities").collect()}
    assert len(rows) == 4 and rows["NoRegion"] is None and None not in {v for k, v in rows.items() if k != "NoRegion"}
    build_sections(spark, f"{tmp_path}/store", f"{tmp_path}/columns")
    assert set(verify_sections(spark, f"{tmp_path}/store", f"{tmp_path}/columns").values()) == {0}


def test_command_line(spark, dumps, built, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr("atlasframe.__main__.session", lambda: spark)
    store = f"{tmp_path}/store"
    args = ["build", dumps["country"], dumps["geoname"], dumps["admin1"], store, "--vocab-size", "50"]
    assert main(args) == 0 and main(args) == 1 and "nothing is changed" in capsys.readouterr().out
    assert main([*args, "--overwrite"]) == 0
    assert main(["tokenize", store, f"{tmp_path}/csv", "--keep-original", "--token-format", "csv"]) == 0
    cities = spark.read.parquet(f"{tmp_path}/csv/cities")
    assert {"city_name", "city_name_tokens"} <= set(cities.columns) and dict(cities.dtypes)["city_name_tokens"] == "string"
    assert main(["tokenize", store, f"{tmp_path}/blob"]) == 0
    assert dict(spark.read.parquet(f"{tmp_path}/blob/cities").dtypes)["city_name_tokens"] == "binary"
    assert main(["columns", store, f"{tmp_path}/columns", "--verify"]) == 0 and main(["decode", f"{tmp_path}/columns"]) == 0
    assert "geohash: 3" in capsys.readouterr().out


def test_lookups_from_the_command_line(spark, built, capsys, monkeypatch):
    monkeypatch.setattr("atlasframe.__main__.session", lambda: spark)
    store, file = f"{built[0]}/store", f"{built[0]}/cities.bin"
    key = next(r["geohash"] for r in Gazetteer.load(spark, store).table("cities").collect() if r["city_name"] == "New York City")
    said = lambda *args: (main(list(args)), capsys.readouterr().out.strip())
    assert said("lookup", store, key) == (0, "New York City, Second Region, Bland")
    assert said("lookup", file, key, "--bundle") == (0, "NewYorkCity, SecondRegion, Bland")
    assert said("lookup", file, key[:1], "--bundle", "--prefix")[1].count("NewYorkCity") == 1
    assert said("lookup", store, "New York City", "--by", "city_name") == (0, f"{key} New York City")
    assert said("lookup", store, "77", "--by", "country_id") == (0, "")
    assert said("search", store, '"new york" NOT hill') == (0, "2 New York City, Second Region, Bland")
    assert said("vacuum", store) == (0, "0 versions deleted")


def test_header_alone_is_read(spark, tmp_path):
    (tmp_path / "head.bin").write_bytes(packed(**TWO)[:32])  # what follows is cut off
    assert bundle.header_counts(spark, str(tmp_path / "head.bin")).first().asDict() == {"vocabulary": 2, "cities": 2, "regions": 1, "countries": 2}
    (tmp_path / "bad.bin").write_bytes(bytes(40))
    with pytest.raises(bundle.BundleError):
        bundle.header_counts(spark, str(tmp_path / "bad.bin"))


def test_stream_meets_gazetteer(spark, built, tmp_path):
    cities = Gazetteer.load(spark, f"{built[0]}/store").table("cities").select("geohash", "city_name")
    events = spark.createDataFrame([(k, f"2024-01-01 00:0{k}:00", 40.71, -74.0) for k in range(3)] + [(9, "2024-01-01 00:09:00", -80.0, -170.0)], "id int, ts string, lat double, lon double")
    events.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, ts timestamp, lat double, lon double").parquet(str(tmp_path / "in"))
    counted = enrich.city_counts(enrich.with_city(stream, cities, "lat", "lon"), "ts", "1 hour")
    q = counted.writeStream.format("memory").queryName("seen").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["city_name"], r["events"]) for r in spark.table("seen").collect()] == [("New York City", 3)]


def test_points_try_only_prefixes_as_long_as_a_key(spark):
    cities = spark.createDataFrame([("dr5", "a"), ("u1", "b"), ("9q8yyk8ytpxr_7", "c")], "geohash string, city_name string")
    points = spark.createDataFrame([(1, 40.71, -74.0), (2, -80.0, -170.0), (3, None, 1.0)], "id int, lat double, lon double")
    met = enrich.with_city(points, cities, "lat", "lon")
    assert [(r["id"], r["city_name"]) for r in met.collect()] == [(1, "a")]
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(" in plan and "lambda" not in plan
    assert enrich.with_city(points, cities.limit(0), "lat", "lon").count() == 0
