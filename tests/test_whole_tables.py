"""Operators that need no task with all rows, or all of a hot key: against plain Python, and by the sizes of their tasks."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from atlasframe import scratch
from atlasframe.functions.exact import round_half_even
from atlasframe.operators import bpe, bpe_tables, columns, keys, normalize, search
from atlasframe.streaming import enrich


def rounded(spark, values, digits):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    return [r["r"] for r in df.select("i", round_half_even(F.col("v"), digits).alias("r")).orderBy("i").collect()]


def test_a_million_values_of_seven_decimals(spark):
    df = spark.range(1_000_000).select(((F.col("id") * 1_799_999_983 + 12_345) % 3_600_000_007 - 1_800_000_000).alias("k"))
    got = df.select("k", round_half_even(F.col("k").cast("double") / 1e7, 6).alias("r")).toPandas()
    assert (got["r"] == [round(k / 1e7, 6) for k in got["k"].tolist()]).all()


@pytest.mark.parametrize("digits", [0, 1, 6, 11])
def test_rounding_of_odd_values(spark, digits):
    rng = random.Random(digits)
    values = [0.5, 1.5, 2.5, -0.5, -2.5, 0.0078125, 0.0234375, 2.0**-7 * 3, 1e-300, -1e-9, 0.0, 4503599627370495.5, 4503599627.3704955, 9007199254.740993, 1e17, -1e300, 5e-7, 1.0000005, 2.675, 1.005]
    values += [rng.uniform(-180, 180) for _ in range(300)] + [rng.randrange(-(10**9), 10**9) / 2**k for k in range(40) for _ in range(10)]
    values += [round(rng.uniform(-180, 180), digits) + 0.5 * 10.0**-digits for _ in range(300)]
    assert rounded(spark, values, digits) == [round(v, digits) for v in values]
    odd = rounded(spark, [None, float("inf"), float("nan")], digits)
    assert odd[0] is None and odd[1] == float("inf") and math.isnan(odd[2])
    with pytest.raises(ValueError):
        round_half_even(F.lit(1.0), 12)


def claims(rows):
    """Each row's outcome, one row after another."""
    taken, out = set(), {}
    for i, place, n, iso in sorted(rows, key=lambda r: (-r[2], r[0])):
        out[i] = "duplicate" if place in taken else "inserted" if iso != "x" else "skipped"
        if out[i] == "inserted":
            taken.add(place)
    return out


@pytest.mark.parametrize("hot", [1, 5, 40, 10**6])
def test_claims_with_a_crowded_place(spark, hot, monkeypatch):
    rng = random.Random(hot)
    rows = [(i, None if i % 3 == 0 else rng.randrange(40), rng.randrange(1, 20), rng.choice("abxx")) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, place int, population int, iso string").repartition(6)
    for most in (normalize.MOST_HOT, 0):
        monkeypatch.setattr(normalize, "MOST_HOT", most)
        done = normalize.first_wins(df, [F.col("place")], [-F.col("population"), F.col("id")], F.col("iso") != "x", hot)
        assert done.columns == [*df.columns, "outcome"]
        assert {r["id"]: r["outcome"] for r in done.collect()} == claims(rows) and done.count() == len(rows)
    assert normalize.first_wins(df.limit(0), [F.col("place")], [F.col("id")], F.lit(True)).count() == 0


def test_no_task_holds_a_crowded_place(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("place")).repartition(12)
    done = normalize.first_wins(df, [F.col("place")], [F.col("id")], F.col("id") > 100, hot=1000)
    assert "Window" not in done._jdf.queryExecution().optimizedPlan().toString()
    assert done.where("place = 7").groupBy("outcome").count().collect() != []
    sizes = [r["count"] for r in done.where("place = 7").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * 10_000 / len(sizes) and len(sizes) > 4


def test_positions_of_a_dense_cell(spark):
    cell = F.when(F.col("id") % 3 == 0, "u1hx").otherwise(F.substr(F.md5(F.col("id").cast("string")), F.lit(1), F.lit(4)))
    df = spark.range(24_000).select(F.concat(cell, F.lpad((F.col("id") * 7919 % 24_000).cast("string"), 5, "0")).alias("geohash"))
    placed = columns.positions(df, ["geohash"], parts=12)
    rows = placed.orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(24_000)) and [r["geohash"] for r in rows] == sorted(r["geohash"] for r in rows)
    sizes = [r["count"] for r in spark.read.parquet(scratch.given()[-1]).groupBy(F.input_file_name()).count().collect()]  # a file for each task
    assert len(sizes) == 12 and max(sizes) < 2 * 24_000 / 12


def test_positions_of_ties_nulls_and_nothing(spark):
    rows = [(None, 1), (None, 2)] + [("a", i) for i in range(500)] + [("a", 3)] * 4
    df = spark.createDataFrame(rows, "w string, i int")
    got = columns.positions(df, ["w"], parts=5).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(len(rows))) and [r["w"] for r in got] == [None] * 2 + ["a"] * 504
    assert sorted((r["w"] or "", r["i"]) for r in got) == sorted((w or "", i) for w, i in rows)
    assert columns.positions(df.limit(0), ["w"]).count() == 0


@pytest.mark.parametrize("part", [1, 7, 64])
def test_sorted_keys_in_ranges_equal_the_counted_ones(spark, part):
    rng = random.Random(part)
    rows = [(i, "".join(rng.choice("01b") for _ in range(12))[: rng.choice([12, 12, 5])] if rng.random() > 0.1 else None) for i in range(200)]
    rows += [(1000 + i, "u1hxu1hxu1hx") for i in range(20)]
    df = spark.createDataFrame([(i, g and (g + "0" * 12)[:12]) for i, g in rows], "id long, gh string").repartition(5)
    want = {r["id"]: (r["key"], r["precision"]) for r in keys.shortest_unique_keys(df, "gh", "id").collect()}
    assert {r["id"]: (r["key"], r["precision"]) for r in keys.shortest_unique_keys_sorted(df, "gh", "id", part).collect()} == want


def test_locate_keeps_repeated_points(spark):
    cities = spark.createDataFrame([("u1", "big"), ("u1a", "small"), ("s", "other")], "geohash string, name string")
    points = spark.createDataFrame([("u1aaa", 1), ("u1aaa", 1), ("u1b", 2), (None, 3), ("zz", 4)], "gh string, n int")
    got = sorted(map(tuple, keys.locate(points, "gh", cities, "geohash").collect()), key=str)
    assert got == sorted([("u1aaa", 1, "u1a", "small")] * 2 + [("u1b", 2, "u1", "big"), (None, 3, None, None), ("zz", 4, None, None)], key=str)


WORDS = ["new", "york", "newer", "yorks", "x", "é"]


def naive_places(text, words):
    terms = text.lower().split()
    asked = words.lower().split()
    fits = lambda t, a: t.startswith(a[:-1]) if a.endswith("*") else t == a
    return [(i, i + len(asked) - 1) for i in range(len(terms) - len(asked) + 1) if all(fits(terms[i + k], a) for k, a in enumerate(asked))]


def test_phrases_and_nearness_against_all_places(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(12))), rng.choice(["York new", None, ""])) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, name string, more string")
    path = str(tmp_path / "index")
    search.save_postings(search.positional_postings(df, "id", "name", "more"), path, files=3)
    index = spark.read.parquet(path)
    fields = lambda r: [t for t in r[1:] if t]
    for words in ("new york", "New", "york new york", "new new", "é x", "new york*", "york new*", "nowhere", "new nowhere"):
        want = sorted(r[0] for r in rows if any(naive_places(t, words) for t in fields(r)))
        assert sorted(r["id"] for r in search.phrase(index, words, "id").collect()) == want, words
    for a, b, within in (("new", "york", 0), ("new york", "x", 1), ("é", "é", 3), ("x", "york new", 4), ("new", "new", 0)):
        want = sorted(r[0] for r in rows if any(0 <= max(p - z, i - q) - 1 <= within for t in fields(r) for (i, z), (p, q) in itertools.product(naive_places(t, a), naive_places(t, b))))
        assert sorted(r["id"] for r in search.near(index, a, b, within, "id").collect()) == want, (a, b, within)
    assert search.phrase(index, "", "id").count() == 0


QUERIES = ["new york", '"new york"', "NEW*", "a:new b:york", "york NOT x", "x OR é", "york NEAR/0 new", '"new york" OR é york', "new york NOT newer", "york NEAR x", "york OR new x", 'x AND "york new" NOT é', "new NEAR/1 york", '"x new*"', "nowhere OR x", "b:york OR a:é NOT yorks", "É", "É OR é", "x-y", "york x-y"]


def test_full_text_queries_as_sqlite_answers_them(spark):
    import sqlite3

    rng = random.Random(12)
    words = [*WORDS, "É", "New", "x-y"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(9))), rng.choice(["York, new", None, "", "second york"])) for i in range(90)]
    index = search.positional_postings(spark.createDataFrame(rows, "id int, a string, b string"), "id", "a", "b").cache()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts3(a, b)")
    db.executemany("INSERT INTO t (docid, a, b) VALUES (?, ?, ?)", rows)
    for q in QUERIES:
        want = sorted(r[0] for r in db.execute("SELECT docid FROM t WHERE t MATCH ?", (q,)))
        assert sorted(r["id"] for r in search.match_text(index, q, "id", ("a", "b")).collect()) == want, q
    hits = lambda q: {r["id"] for r in search.match_text(index, q, "id", ("a", "b")).collect()}
    assert hits('b:"second york"') == {r[0] for r in rows if r[2] == "second york"}
    assert hits("") == hits('""') == hits("NOT x") == set() and hits("OR x OR") == hits("x")
    index.unpersist()


def replayed_merges(counts, size, top):
    """The rounds of ``bpe_tables`` on plain lists."""
    tokens = ["<unk>", *sorted({c for w in counts for c in w})]
    numbers = {t: k for k, t in enumerate(tokens)}
    words, merges, rounds = [([numbers[c] for c in w], n) for w, n in counts.items() if w], [], 0
    while len(tokens) < size:
        pairs = Counter()
        for w, n in words:
            for p in itertools.pairwise(w):
                pairs[p] += n
        rows = sorted(pairs.items(), key=lambda x: (-x[1], x[0]))
        if not rows:
            break
        step, rounds = {}, rounds + 1
        for a, b, text in bpe_tables.certain_merges(rows[:top], tokens, size - len(tokens), len(rows) <= top):
            if text not in numbers:
                numbers[text] = len(tokens)
                tokens.append(text)
            step[a, b] = numbers[text]
            merges.append((a, b, numbers[text]))
        words = [(bpe_tables._merge(w, step), n) for w, n in words]
    return (tuple(tokens), tuple(merges)), rounds


def test_rounds_fix_the_merges_that_come_one_at_a_time():
    saved = 0
    for seed in range(300):
        rng = random.Random(seed)
        letters = "abcdef"[: rng.choice([2, 3, 6])]
        counts = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))): rng.randrange(1, rng.choice([3, 50])) for _ in range(rng.randrange(1, 40))}
        want = bpe.train(sorted(counts.items()), rng.choice([8, 20, 60]))
        for top in (1, 3, 1000):
            got, rounds = replayed_merges(counts, len(want.tokens), top)
            assert got == (bpe.train(sorted(counts.items()), len(want.tokens)).tokens, want.merges[: len(got[1])])
            saved += len(got[1]) - rounds
    assert saved > 500


@pytest.mark.parametrize(("least", "top"), [(1, 4), (2, 512)])
def test_learning_over_tables_equals_the_driver_loop(spark, least, top):
    rng = random.Random(least)
    rows = [(" ".join("".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7))) + rng.choice(["", "!", "!!"]) for _ in range(4)),) for _ in range(150)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "name string").repartition(5)
    want = bpe.learn(df, vocab_size=40, least=least)
    got = bpe_tables.learn_tables(df, vocab_size=40, least=least, top=top)
    assert (got.tokens, got.merges) == (want.tokens, want.merges)
    assert bpe_tables.learn_tables(df.limit(0)).tokens == ("<unk>",)
    for most in (3, 10_000):
        assert bpe_tables.learn(df, vocab_size=40, least=least, most_words=most) == want


def events(spark, path, rows):
    df = spark.createDataFrame(rows, "id int, ts string, lat double, lon double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def test_a_stream_goes_on_after_a_failure_and_leaves_late_rows_out(spark, tmp_path, monkeypatch):
    cities = spark.createDataFrame([("s", "Null Island"), ("u", "North")], "geohash string, city_name string")
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    at = lambda i, minute, lat=1.0: (i, f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00", lat, 1.0)
    schema = events(spark, source, [at(0, 0), at(1, 1), at(2, 1, 50.0), at(3, 2, -80.0)])
    run = lambda: enrich.run_counts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), cities, "ts", out, state)
    seen = lambda: {(r["window_start"].strftime("%H:%M"), r["city_name"]): r["events"] for r in enrich.latest_counts(spark, out).collect()}
    run()
    assert seen() == {("00:00", "Null Island"): 2, ("00:00", "North"): 1}
    events(spark, source, [at(4, 3), at(5, 40)])
    writes = []
    real = enrich.city_counts

    def fails_after_writing(*args, **kwargs):  # the batch is written, then its driver dies before the mark
        from pyspark.sql.streaming.readwriter import DataStreamWriter

        each = DataStreamWriter.foreachBatch
        monkeypatch.setattr(DataStreamWriter, "foreachBatch", lambda self, f: each(self, lambda b, n: (f(b, n), writes.append(n), 1 / 0)))
        return real(*args, **kwargs)

    with monkeypatch.context() as m:
        m.setattr(enrich, "city_counts", fails_after_writing)
        with pytest.raises(Exception, match="division"):
            run()
        monkeypatch.undo()
    run()
    assert writes and seen() == {("00:00", "Null Island"): 3, ("00:00", "North"): 1, ("00:40", "Null Island"): 1}
    run()  # nothing new
    events(spark, source, [at(6, 4), at(7, 41)])  # the first is over ten minutes late by now
    run()
    assert seen() == {("00:00", "Null Island"): 3, ("00:00", "North"): 1, ("00:40", "Null Island"): 2}
