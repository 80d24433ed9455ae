"""Expressions: geohashes, byte and token codecs, labels."""

import math
import random

import pytest
from pyspark.sql import functions as F

from atlasframe.functions import codec, geo, text


def bisected(lat, lon, precision=12):
    """Geohash by halving intervals, the textbook way."""
    lat_range, lon_range, out, bits, even = [-90.0, 90.0], [-180.0, 180.0], "", [], True
    while len(out) < precision:
        value, around = (lon, lon_range) if even else (lat, lat_range)
        mid = (around[0] + around[1]) / 2
        bits.append(value >= mid)
        around[0 if value >= mid else 1] = mid
        even = not even
        if len(bits) == 5:
            out += geo.ALPHABET[sum(b << (4 - i) for i, b in enumerate(bits))]
            bits = []
    return out


def test_geohash_matches_bisection(spark):
    rng = random.Random(1)
    points = [(57.64911, 10.40744)] + [(rng.uniform(-90, 89.999), rng.uniform(-180, 179.999)) for _ in range(3000)]
    rows = spark.createDataFrame(points, "lat double, lon double").select("lat", "lon", geo.geohash(F.col("lat"), F.col("lon")).alias("gh")).collect()
    assert rows[0]["gh"] == "u4pruydqqvj8"
    assert all(r["gh"] == bisected(r["lat"], r["lon"]) for r in rows)


def test_geohash_rejects_and_wraps(spark):
    points = [(90.0, 0.0), (-90.1, 0.0), (math.nan, 0.0), (0.0, math.inf), (None, 1.0), (1.0, None), (10.0, 200.0), (10.0, -160.0)]
    got = [r[0] for r in spark.createDataFrame(points, "lat double, lon double").select(geo.geohash(F.col("lat"), F.col("lon"))).collect()]
    assert got[:6] == [None] * 6 and got[6] == got[7] is not None


def test_token_codecs_round_trip(spark):
    rows = [([],), ([0],), ([65535, 1, 256],), ([7] * 127,)]
    df = spark.createDataFrame(rows, "ids array<int>")
    blob = codec.tokens_to_blob(F.col("ids"))
    for r in df.select("ids", codec.tokens_from_blob(blob).alias("a"), codec.tokens_from_csv(codec.tokens_to_csv(F.col("ids"))).alias("b"), codec.length_prefixed(blob).alias("row")).collect():
        assert r["a"] == r["b"] == r["ids"] and bytes(r["row"])[0] == 2 * len(r["ids"]) == len(r["row"]) - 1


def test_odd_blob_ignores_last_byte(spark):
    df = spark.createDataFrame([(bytearray(b"\x01\x02\x03"),), (bytearray(b"\x03"),)], "b binary")
    assert [r[0] for r in df.select(codec.tokens_from_blob(F.col("b"))).collect()] == [[258], []]


@pytest.mark.parametrize("ids", [[65536], [-1], [1] * 128])
def test_token_limits(spark, ids):
    df = spark.createDataFrame([(ids,)], "ids array<int>")
    with pytest.raises(Exception, match="token"):
        df.select(codec.length_prefixed(codec.tokens_to_blob(F.col("ids")))).collect()


def test_integers_little_endian(spark):
    values = [0, 1, 127, 128, 255, 256, 32767, -1, -128, -32768]
    df = spark.createDataFrame([(v,) for v in values], "v long").withColumn("b", codec.little_endian(F.col("v"), 2))
    rows = df.select("v", "b", codec.read_little_endian(F.col("b"), 0, 2, signed=True).alias("back")).collect()
    assert all(bytes(r["b"]) == r["v"].to_bytes(2, "little", signed=True) and r["back"] == r["v"] for r in rows)


def test_decode_unknown_tokens(spark):
    df = spark.createDataFrame([([1, 2, 9],)], "ids array<int>")
    vocabulary = F.create_map(F.lit(1), F.lit("ab"), F.lit(2), F.lit(""))
    assert df.select(codec.decode_tokens(F.col("ids"), vocabulary)).first()[0] == "ab<UNK:2><UNK:9>"


def test_text_helpers(spark):
    df = spark.createDataFrame([("New York City", "", None), ("Ārdamatā", "R", "C"), ("'s-Gravenzande", None, "C")], "n string, r string, c string")
    rows = df.select(text.label(F.col("n"), F.col("r"), F.col("c")), text.packed_name(F.col("n")), text.name_words(F.col("n")), text.or_default(F.col("r")), text.admin_key(F.col("c"), F.col("r"))).collect()
    assert [r[0] for r in rows] == ["New York City", "Ārdamatā, R, C", "'s-Gravenzande, C"]
    assert [r[1] for r in rows] == ["NewYorkCity", "Ārdamatā", "'s-Gravenzande"]
    assert [r[2] for r in rows] == [["New", "York", "City"], ["Ārdamatā"], ["'", "s", "-", "Gravenzande"]]
    assert [r[3] for r in rows] == ["No region", "R", "No region"] and [r[4] for r in rows] == [None, "C.R", None]


def test_a_hash_computes_its_coordinates_once(spark):
    """Not once a character: such code is too long for the JVM to compile."""
    df = spark.range(5).select(geo.geohash(F.col("id") % 7 * 1.5, F.col("id") * 3.25).alias("gh"))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    assert 0 < df._jdf.queryExecution().explainString(mode).count("floor(") <= 12
