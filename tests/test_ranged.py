"""Bundles read in ranges against bundles parsed whole."""

import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringStartsWith

from atlasframe.operators import columns, verify
from atlasframe.sources import bundle, ranged


def bundle_of(seed, n):
    """A bundle of ``n`` cities by hand, with its sorted keys."""
    rng = random.Random(seed)
    keys = sorted({"".join(rng.choice("bcd") for _ in range(rng.randrange(1, 9))) for _ in range(2 * n)})[:n]
    before, coded = "", b""
    for k in keys:
        shared = next((i for i in range(min(len(k), len(before))) if k[i] != before[i]), min(len(k), len(before)))
        coded += bytes([shared << 4 | len(k) - shared]) + k[shared:].encode()
        before = k
    numbers = [[rng.randrange(0, 9) for _ in keys] for _ in range(2)]
    steps = [b"".join(struct.pack("<h", v - w) for v, w in zip(col, [0, *col], strict=False)) for col in numbers]
    blobs = [rng.randbytes(2 * rng.randrange(0, 5)) for _ in keys]
    names = [b"".join(bytes([len(b)]) + b for b in x) for x in (blobs, [b"\0\1"] * 8, [b"\0\0"] * 8)]
    out = bundle.MAGIC + struct.pack("<4I", 300, len(keys), 8, 8) + bytes(8)
    for i in range(300):
        token = ("é" * (i % 100)).encode()
        out += struct.pack(">HB", i, len(token)) + token
    for count, body in zip([len(keys)] * 4 + [8, 8], [coded, *steps, *names], strict=True):
        out += struct.pack("<II", 4 + len(body), count) + body
    return out, keys


@pytest.fixture
def small(spark, tmp_path):
    data, keys = bundle_of(1, 60)
    path = str(tmp_path / "small.bin")
    (tmp_path / "small.bin").write_bytes(data)
    ranged.save_index(ranged.scanned_index(spark, path, block=7), path)
    return path, data, keys


@pytest.mark.parametrize("table", ["cities", "regions", "countries", "vocabulary", "header"])
def test_tables_are_the_same(spark, small, table):
    path, data, _ = small
    assert sorted(map(tuple, ranged.read_ranges(spark, path, table).collect())) == sorted(bundle.rows(bundle.parse(data), table))


def test_a_scan_is_many_tasks_and_each_byte_is_read_once(small, monkeypatch):
    path, data, _ = small
    places, index = ranged.layout(ranged.open_file(path)), ranged._read_index(path + ranged.SUFFIX)
    assert len(index) == 9
    parts = ranged.city_ranges(places, index, list(range(9)), most=2)
    assert len(parts) == 5
    spans = sorted(s for p in parts for s in p.spans.values())
    assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    assert sum(p.size for p in parts) == sum(places.sections[n][1] for n in ("geohash", "region_id", "country_id", "city_tokens"))
    got = [r for p in parts for r in ranged.cities_in(ranged.open_file(path), p).to_pylist()]
    assert [tuple(r.values()) for r in got] == bundle.rows(bundle.parse(data), "cities")


def test_lookups_read_the_blocks_that_can_hold_the_key(small):
    path, _, keys = small
    index = ranged._read_index(path + ranged.SUFFIX)
    first = [b["first_key"] for b in index]
    at = lambda *filters: ranged.blocks_with(first, ranged.ranges_of(filters))
    geohash = ("geohash",)
    for i, key in enumerate(keys):
        assert i // 7 in at(EqualTo(geohash, key)) and len(at(EqualTo(geohash, key))) <= 2
        assert {j // 7 for j, k in enumerate(keys) if k.startswith(key[:2])} <= set(at(StringStartsWith(geohash, key[:2])))
        assert {j // 7 for j, k in enumerate(keys) if k > key} <= set(at(GreaterThan(geohash, key)))
    assert at() == list(range(9)) == at(EqualTo(("region_id",), 3))
    assert at(EqualTo(geohash, "a")) == [0] or at(EqualTo(geohash, "a")) == []
    assert at(GreaterThan(geohash, "c"), LessThanOrEqual(geohash, "b")) == []
    assert set(at(In(geohash, (keys[0], keys[-1], None)))) == {0, 8}
    reader = ranged.RangedReader(path, "cities", path + ranged.SUFFIX)
    assert list(reader.pushFilters([EqualTo(geohash, keys[30])])) == [EqualTo(geohash, keys[30])]
    parts = reader.partitions()
    assert len(parts) == 1 and parts[0].rows <= 14


@pytest.mark.parametrize("condition", ["geohash = '{k}'", "geohash like 'c%'", "geohash between 'bc' and 'cb'", "geohash in ('{k}', 'x')", "geohash > '{k}' and region_id = 3", "geohash = 'zzz'", "geohash < 'a'", "geohash is null"])
def test_conditions_give_the_rows_of_a_whole_scan(spark, small, condition):
    path, data, keys = small
    condition = condition.format(k=keys[23])
    want = spark.createDataFrame(bundle.rows(bundle.parse(data), "cities"), bundle.SCHEMAS["cities"]).where(condition)
    df = ranged.read_ranges(spark, path).where(condition)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))


def test_index_of_written_rows_is_the_scanned_one(spark, tmp_path):
    data, _ = bundle_of(3, 50)
    path = str(tmp_path / "x.bin")
    (tmp_path / "x.bin").write_bytes(data)
    rows = [(p, k, r or 0, c, b) for p, k, r, c, b in bundle.rows(bundle.parse(data), "cities")]
    placed = spark.createDataFrame(rows, "pos long, geohash string, region_id int, country_id int, blob binary").repartition(3)
    keys = columns.front_rows(columns.front_encode(placed, "geohash"))
    tokens = placed.select("pos", F.concat(F.unhex(F.lpad(F.hex(F.octet_length("blob")), 2, "0")), "blob").alias("data"))
    made = ranged.index_of(placed, keys, tokens, block=8)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, ranged.scanned_index(spark, path, block=8).select(made.columns).collect()))


def test_an_empty_bundle_and_damaged_ones(spark, tmp_path):
    data, _ = bundle_of(2, 0)
    path = str(tmp_path / "empty.bin")
    (tmp_path / "empty.bin").write_bytes(data)
    ranged.save_index(ranged.scanned_index(spark, path), path)
    assert ranged.read_ranges(spark, path).count() == 0 and ranged.read_ranges(spark, path, "regions").count() == 8
    for bad, what in ((b"X" + data[1:], "not a bundle"), (data[:40], "vocabulary"), (data[:-5], "country_tokens")):
        (tmp_path / "bad.bin").write_bytes(bad)
        with pytest.raises(bundle.BundleError, match=what):
            ranged.layout(ranged.open_file(str(tmp_path / "bad.bin")))
    with pytest.raises(bundle.BundleError):
        ranged.keys_in(b"\x03ab", 1, "")
    with pytest.raises(bundle.BundleError):
        ranged.blobs_in(b"\x03ab", 1)


def test_lookups_in_one_bundle_do_not_share_their_ranges(spark, small):
    """Conditions of one scan must not choose the blocks of another, of the same table or in the same plan."""
    path, _, keys = small
    geohash = ("geohash",)
    cities = ranged.read_ranges(spark, path)
    assert cities.where(F.col("geohash") == keys[30]).count() == 1 and cities.count() == len(keys)
    one = cities.where(F.col("geohash") == keys[-1])
    assert one.unionAll(cities.where("geohash like 'b%'")).count() == 1 + sum(k.startswith("b") for k in keys)
    asked = {EqualTo(geohash, keys[-1]): {keys[-1]}, StringStartsWith(geohash, "b"): {k for k in keys if k[0] == "b"}, In(geohash, (keys[0], keys[40])): {keys[0], keys[40]}}
    found = [ranged.read_ranges(spark, path, filters=[f]) for f in asked]
    for df, want in zip(found, asked.values(), strict=True):
        assert {r["geohash"] for r in df.collect()} == want
    both = found[0].unionAll(found[1]).unionAll(found[2])
    assert both.count() == sum(map(len, asked.values()))


@pytest.mark.parametrize("name", ["geohash", "region_id", "country_id"])
def test_a_damaged_row_counts_in_every_block_that_it_reaches(spark, tmp_path, name):
    """Column files are decoded by what they hold, as a sequential reader does, not by what the index says is before a block."""
    data, _ = bundle_of(4, 60)
    path = str(tmp_path / "cities")
    (tmp_path / "cities").write_bytes(data)
    ranged.save_index(ranged.scanned_index(spark, path, block=7), path)
    start, size = ranged.layout(ranged.open_file(path)).sections[name]
    body = bytearray(data[start - 4 : start + size])
    for changed in (False, True):
        body[5 if name == "geohash" else 4] ^= changed
        (tmp_path / bundle.FILES[name]).write_bytes(body)
        got = ranged.read_column(spark, str(tmp_path), name)
        want = bundle.parse_section(name, bytes(body))
        assert [r["value"] for r in got.orderBy("pos").collect()] == want
        sound = spark.createDataFrame(list(enumerate(bundle.parse(data).sections[name])), got.schema)
        assert (sum(verify.mismatches(sound, got, "pos", ["value"]).first()) > (7 if name != "geohash" else 0)) == changed


def test_faults_are_found_as_the_file_streams_by(spark, tmp_path):
    """The checks hold no rows: they say of every damaged copy what parsing it whole says."""
    data, _ = bundle_of(5, 40)
    rng = random.Random(6)
    copies = [data, data[:-1], data + b"x", b"X" + data[1:], data[:7], data[:30], data[:400], data[:-40]]
    for _ in range(300):
        bad = bytearray(data)
        for _ in range(rng.randrange(1, 3)):
            bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
        copies.append(bytes(bad))
    said = 0
    for copy in copies:
        try:
            b = bundle.parse(copy)
            keys = b.sections["geohash"]
            want = [f"{b.left_over} bytes after the last section"] * (b.left_over > 0) + [f"key {i} is below the one before it" for i in range(1, len(keys)) if keys[i] < keys[i - 1]][:5]
        except (bundle.BundleError, UnicodeDecodeError) as e:
            want = [str(e)]
        assert bundle.problems(copy) == want
        said += bool(want)
    assert said > 50
    (tmp_path / "in.bin").write_bytes(data)
    bundle.put_changed(spark, str(tmp_path / "in.bin"), str(tmp_path / "out" / "a.bin"), {0: b"X", 12: b"ab"}, cut=3, more=b"yz")
    assert (tmp_path / "out" / "a.bin").read_bytes() == b"X" + data[1:12] + b"ab" + data[14:-3] + b"yz"
    assert bundle.some_bytes(spark, str(tmp_path / "in.bin"), 12, 4) == data[12:16]
    plan = bundle.faults(spark, str(tmp_path / "out"))._jdf.queryExecution().toString()
    assert "content" not in plan.split("Optimized Logical Plan")[1].split("Relation")[0] and bundle.faults(spark, str(tmp_path / "out")).count() == 1
