"""Dumps against the standard library's csv reader, at any size of splits."""

import csv
import random

import pytest

from atlasframe.sources import tsv
from pyspark.sql import types as T

CONFS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum", "spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.fixture
def splits(spark):
    """Sets the size of splits in bytes, and of batches in rows; undone at the end."""
    old = {c: spark.conf.get(c, None) for c in CONFS}

    def choose(size, batch=10_000):
        for c, v in zip(CONFS, (str(size), "0", "1", str(batch)), strict=True):
            spark.conf.set(c, v)

    yield choose
    for c, v in old.items():
        spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def dump_of(seed, rows, ends="\n"):
    rng = random.Random(seed)
    out = []
    for _ in range(rows):
        fields = []
        for _ in range(rng.choice([1, 2, 3, 3, 3, 3])):
            kind = rng.random()
            word = "".join(rng.choice("abé# ") for _ in range(rng.randrange(6)))
            if kind < 0.25:
                inner = "".join(rng.choice(["x", "\t", ends, '""', "é", ends + ends]) for _ in range(rng.randrange(7)))
                word = f'"{inner}"' + rng.choice(["", "", "tail", 'q"q', '""'])
            elif kind < 0.35:
                word += rng.choice(['"', 'a"b', '""', "x\"\"y"]) if word else "'\""
            fields.append(word)
        out.append("\t".join(fields))
    return ends.join(out) + ends


@pytest.mark.parametrize(("seed", "size", "batch", "ends"), [(1, 7, 3, "\n"), (2, 64, 10_000, "\n"), (3, 1_000_000, 2, "\n"), (4, 40, 5, "\r\n"), (5, 300, 10_000, "\n")])
def test_rows_as_the_csv_rules_cut_them(spark, splits, tmp_path, seed, size, batch, ends):
    names = []
    for k in range(2):
        names.append(tmp_path / f"dump{k}.txt")
        names[-1].write_bytes(dump_of(seed * 10 + k, 60, ends).encode())
    splits(size, batch)
    got = tsv.csv_rows(spark, str(tmp_path)).withColumn("f", tsv.fields_of(tsv.F.col("text"))).collect()
    for name in names:
        with open(name, encoding="utf-8") as f:
            want = [(i, row) for i, row in enumerate(csv.reader(f, delimiter="\t"), 1)]
        found = sorted((r["row"], [] if r["text"] == "" else r["f"]) for r in got if r["file"].endswith(name.name))
        assert found == want
    if size < 1000:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4


def test_lines_that_are_shuffled_to_their_begins(spark, splits, tmp_path, monkeypatch):
    (tmp_path / "d.txt").write_text(dump_of(9, 80))
    splits(50)
    want = sorted(map(tuple, tsv.csv_rows(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(tsv, "MOST_SENT", 0)
    assert sorted(map(tuple, tsv.csv_rows(spark, str(tmp_path)).collect())) == want


def test_a_row_over_many_splits_and_an_open_quote(spark, splits, tmp_path):
    text = 'a\t"' + "\n".join(f"line {i}" for i in range(200)) + '"\tz\nplain\tb\tc\nlast\t"open\nto the end'
    (tmp_path / "d.txt").write_text(text)
    splits(32)
    rows = sorted(map(tuple, tsv.csv_rows(spark, str(tmp_path)).select("row", tsv.fields_of(tsv.F.col("text"))).collect()))
    assert rows == [(1, ["a", "\n".join(f"line {i}" for i in range(200)), "z"]), (2, ["plain", "b", "c"]), (3, ["last", "open\nto the end"])]


def test_rejects_have_file_and_row(spark, splits, tmp_path):
    layout = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("x", T.DoubleType())])
    (tmp_path / "a.txt").write_text('# about\n\n1\t"two\nlines"\t0.5\ntoo\tfew\n"#"\tx\n2\tb\t\n3\tc\t1\tmore\nx\t"a ""b"""\tz\n')
    (tmp_path / "b.txt").write_text("only one\n")
    (tmp_path / "c.txt").write_text("")
    splits(9)
    found = tsv.read_dump(spark, str(tmp_path), layout)
    assert sorted(map(tuple, found.rows.collect()), key=str) == [(1, "two\nlines", 0.5), (2, "b", None), (None, 'a "b"', None)]
    assert sorted((r["file"][-5:], r["row"], r["fields"], r["line"]) for r in found.rejects.collect()) == [("a.txt", 4, 2, "too\tfew"), ("a.txt", 7, 4, "3\tc\t1\tmore"), ("b.txt", 1, 1, "only one")]


def test_nothing_but_line_scans_is_shuffled_by_the_rows(spark, tmp_path):
    (tmp_path / "d.txt").write_text(dump_of(11, 10))
    plan = tsv.csv_rows(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    plain, whole, across = plan.split("Union")[1].split("Scan text")[:3]
    assert "MapInArrow" not in plain and "BroadcastHashJoin" in plain and "MapInArrow" in whole and "Exchange hashpartitioning" not in plain + whole.split("Aggregate")[0] and across
