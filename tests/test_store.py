"""Versions of a store, and lookups that skip files."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from atlasframe.operators import bpe_tables
from atlasframe.plans.build import build
from atlasframe.plans.gazetteer import Gazetteer
from atlasframe.sources import store
from tests.test_sources import dumps  # noqa: F401


def test_a_build_that_dies_leaves_the_old_store(spark, dumps, tmp_path, monkeypatch):  # noqa: F811
    path = str(tmp_path / "store")
    build(spark, dumps, path, vocab_size=60)
    old = Gazetteer.load(spark, path)
    want = sorted(map(tuple, old.table("cities").collect()))
    with monkeypatch.context() as m:
        m.setattr(bpe_tables, "learn", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            build(spark, dumps, path, vocab_size=60, require_region=False)
    assert len(glob.glob(f"{path}/v-*")) == 2 and len(glob.glob(f"{path}/versions/0*")) == 1
    for g in (old, Gazetteer.load(spark, path)):
        assert sorted(map(tuple, g.table("cities").collect())) == want and g.stats()["regions"] == 2
    build(spark, dumps, path, vocab_size=60, require_region=False)
    assert old.table("cities").count() == 3 and Gazetteer.load(spark, path).table("cities").count() == 4  # both versions are readable


def test_versions(spark, tmp_path):
    path = str(tmp_path / "s")
    assert store.current(spark, path) == path
    made = []
    for n in range(4):
        v = store.Version.begin(spark, path)
        v.save({"t": spark.range(n)})
        made.append(v)
    assert [v.publish() for v in made[:3]] == [1, 2, 3]
    assert store.load(spark, path, "t").count() == 2
    with pytest.raises(FileExistsError):
        store.refuse_or_replace(spark, path, "error")
    assert store.vacuum(spark, path, keep=2) == [made[0].folder] and not os.path.exists(made[0].place)
    assert store.vacuum(spark, path, keep=2) == [] and store.load(spark, path, "t").count() == 2
    assert made[3].publish() == 4 and store.load(spark, path, "t").count() == 3


def test_of_two_builds_one_gets_the_number(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    a, b = store.Version.begin(spark, path), store.Version.begin(spark, path)
    for v in (a, b):
        v.save({"t": spark.range(1)})
    a.publish()
    monkeypatch.setattr(store, "_numbers", lambda *_: [])  # b looked before a published
    with pytest.raises(RuntimeError, match="another build"):
        b.publish()
    monkeypatch.undo()
    assert store.current(spark, path) == a.place and glob.glob(f"{path}/versions/.v-*") == []


@pytest.fixture(scope="module")
def placed(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("paths"))
    rows = spark.range(6000).select(
        F.format_string("k%06d", "id").alias("geohash"),
        F.concat(F.lit("city "), (F.col("id") * 7919 % 6000).cast("string")).alias("city_name"),
        (F.col("id") / 500 + F.col("id") % 2 * 12).cast("int").alias("country_id"),
        F.when(F.col("id") % 10 > 0, (F.col("id") / 100).cast("int")).alias("region_id"),
    )
    store.save({"cities": rows}, base, city_files=16)
    store.add_paths(spark, base, "cities", ["country_id", "region_id", "city_name"])
    return base, rows.collect()


@pytest.mark.parametrize(("column", "values", "most"), [("country_id", range(-1, 26), 4), ("region_id", range(0, 61, 7), 3), ("city_name", [f"city {i}" for i in range(0, 6000, 499)], 3), ("city_name", ["nowhere", ""], 2)])
def test_lookups_skip_files_and_lose_no_row(spark, placed, column, values, most):
    base, rows = placed
    assert len(glob.glob(f"{base}/cities/*.parquet")) == 16
    opened = []
    for v in values:
        found = store.find(spark, base, "cities", column, v)
        want = sorted(tuple(r) for r in rows if r[column] == v)
        assert sorted(map(tuple, found.collect())) == want
        opened.append(len(store.files_with(spark, base, "cities", column, v)))
        if opened[-1]:
            assert len(found.inputFiles()) == opened[-1]
    assert max(opened) <= most


def test_gazetteer_by_other_columns(spark, dumps, tmp_path):  # noqa: F811
    build(spark, dumps, str(tmp_path / "s"), vocab_size=60, city_files=3)
    g = Gazetteer.load(spark, str(tmp_path / "s"))
    ny = g.cities_with("city_name", "New York City").first()
    assert ny["city_name"] == "New York City" and g.cities_with("country_id", ny["country_id"]).count() == 2 and g.cities_with("region_id", 99).count() == 0
    assert len(g.cities_with("city_name", "New York City").inputFiles()) <= len(g.table("cities").inputFiles())
