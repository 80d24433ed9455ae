"""Operators against plain restatements of their rules."""

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from atlasframe.operators import bpe, columns, keys, normalize, search, verify


def shortest_keys(hashes):
    """Step by step: whoever is alone at a precision gets its prefix."""
    out, pending = {}, dict(hashes)
    for p in range(1, 13):
        cells = {}
        for i, h in pending.items():
            cells.setdefault(h[:p], []).append(i)
        for cell, ids in cells.items():
            if len(ids) == 1:
                out[ids[0]] = (cell, p)
                del pending[ids[0]]
    return out | {i: (f"{h}_{i}", 12) for i, h in pending.items()}


@pytest.mark.parametrize("letters", ["ab", "0123456789"])
def test_shortest_unique_keys(spark, letters):
    rng = random.Random(3)
    hashes = {i: "".join(rng.choice(letters) for _ in range(12)) for i in range(400)}
    hashes |= {400: hashes[0], 401: hashes[0]}
    df = spark.createDataFrame(list(hashes.items()), "id long, gh string")
    want = shortest_keys(hashes)
    for form in (keys.shortest_unique_keys, keys.shortest_unique_keys_sorted):
        found = {r["id"]: (r["key"], r["precision"]) for r in form(df.repartition(7), "gh", "id").collect()}
        assert found == want
    plain = sorted(k for k, _ in want.values() if "_" not in k)
    assert not any(b.startswith(a) for a, b in zip(plain, plain[1:]))


def test_keys_edge_cases(spark):
    empty = spark.createDataFrame([], "id long, gh string")
    assert keys.shortest_unique_keys(empty, "gh", "id").count() == 0
    one = spark.createDataFrame([(1, "u4pruydqqvj8"), (2, None)], "id long, gh string")
    assert [(r["id"], r["key"]) for r in keys.shortest_unique_keys(one, "gh", "id").collect()] == [(1, "u")]


def replayed(rows, known):
    """The loop that first-wins stands for."""
    seen, out = set(), {}
    for i, place, _, iso in sorted(rows, key=lambda r: (-r[2], r[0])):
        if place in seen:
            out[i] = "duplicate"
        elif iso in known:
            seen.add(place)
            out[i] = "inserted"
        else:
            out[i] = "skipped"
    return out


@pytest.mark.parametrize("seed", range(3))
def test_first_wins(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(30), rng.randrange(1, 20), rng.choice("abcx")) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, place int, population int, iso string")
    done = normalize.first_wins(df, [F.col("place")], [-F.col("population"), F.col("id")], F.col("iso") != "x")
    assert {r["id"]: r["outcome"] for r in done.collect()} == replayed(rows, set("abc"))


def test_front_and_delta_coding_round_trip(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 13))) for _ in range(300)})
    df = spark.createDataFrame([(w, i * 7 % 1000) for i, w in enumerate(words)], "w string, v long")
    placed = columns.positions(df, ["w"])
    assert [r["w"] for r in placed.orderBy("pos").collect()] == words
    for block in (None, 64):
        coded = columns.front_encode(placed, "w", block)
        back = columns.front_decode(coded.select("pos", "shared", "suffix"), block=block)
        assert [r["value"] for r in back.orderBy("pos").collect()] == words
        steps = columns.delta_encode(placed, "v", block)
        assert [r["value"] for r in columns.delta_decode(steps, block=block).orderBy("pos").collect()] == [i * 7 % 1000 for i in range(len(words))]
    for part in (7, 50):  # parts change nothing
        coded = columns.front_encode(placed, "w", part=part)
        assert sorted(map(tuple, coded.collect())) == sorted(map(tuple, columns.front_encode(placed, "w").collect()))
        assert [r["value"] for r in columns.front_decode(coded.select("pos", "shared", "suffix"), part=part).orderBy("pos").collect()] == words
        steps = columns.delta_encode(placed, "v", part=part)
        assert [r["delta"] for r in steps.orderBy("pos").collect()] == [i * 7 % 1000 - (i - 1) * 7 % 1000 if i else 0 for i in range(len(words))]
        assert [r["value"] for r in columns.delta_decode(steps, part=part).orderBy("pos").collect()] == [i * 7 % 1000 for i in range(len(words))]
    assert columns.unsorted_rows(placed, "w", "pos").first()[0] == 0
    shuffled = words[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(list(enumerate(shuffled)), "at int, w string").repartition(5)
    assert columns.unsorted_rows(df, "w", "at").first()[0] == sum(b < a for a, b in zip(shuffled, shuffled[1:]))
    assert columns.unsorted_rows(df.limit(0), "w", "at").first()[0] == 0


@pytest.mark.parametrize(("words", "ok"), [(["a" * 15, "a" * 15 + "b" * 15], True), (["a" * 16], False), (["a" * 15, "a" * 15 + "b", "a" * 15 + "b" + "c"], False)])
def test_front_limits(spark, words, ok):
    df = spark.createDataFrame(list(enumerate(words)), "pos int, w string")
    rows = columns.front_rows(columns.front_encode(df, "w"))
    if ok:
        assert [bytes(r["data"]) for r in rows.orderBy("pos").collect()] == [b"\x0f" + b"a" * 15, b"\xff" + b"b" * 15]
    else:
        with pytest.raises(Exception, match="too long"):
            rows.collect()


@pytest.mark.parametrize(("values", "ok"), [([32767, -1], True), ([0, 32768], False), ([-32769], False)])
def test_delta_limits(spark, values, ok):
    df = spark.createDataFrame(list(enumerate(values)), "pos int, v long")
    rows = columns.delta_rows(columns.delta_encode(df, "v"))
    if ok:
        assert b"".join(bytes(r["data"]) for r in rows.orderBy("pos").collect()) == b"\xff\x7f\x00\x80"
    else:
        with pytest.raises(Exception, match="too large"):
            rows.collect()


def naive_bpe(counts, size):
    tokens = ["<unk>", *sorted({c for w, _ in counts for c in w})]
    words = [[tokens.index(c) for c in w] for w, _ in counts]
    while len(tokens) < size:
        pairs = {}
        for w, (_, n) in zip(words, counts):
            for p in zip(w, w[1:]):
                pairs[p] = pairs.get(p, 0) + n
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        text = tokens[best[0]] + tokens[best[1]]
        if text not in tokens:
            tokens.append(text)
        new = tokens.index(text)
        for w in words:
            i = 0
            while i + 1 < len(w):
                if (w[i], w[i + 1]) == best:
                    w[i : i + 2] = [new]
                i += 1
    return tokens, words


@pytest.mark.parametrize("seed", range(3))
def test_bpe_matches_recounting(seed):
    rng = random.Random(seed)
    counts = [("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))), rng.randrange(1, 5)) for _ in range(60)]
    vocabulary = bpe.train(counts, 60)
    tokens, words = naive_bpe(counts, 60)
    assert list(vocabulary.tokens) == tokens
    assert [vocabulary.encode_word(w) for w, _ in counts] == words
    assert vocabulary.encode_word("a?b") == vocabulary.encode_word("ab")  # unseen characters are dropped


def test_bpe_matches_public_library():
    tokenizers = pytest.importorskip("tokenizers")
    rng = random.Random(9)
    names = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    library = tokenizers.Tokenizer(tokenizers.models.BPE())
    library.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    library.train_from_iterator(names, tokenizers.trainers.BpeTrainer(special_tokens=["<unk>"], vocab_size=120, show_progress=False))
    counts = {}
    for n in names:
        counts[n] = counts.get(n, 0) + 1
    vocabulary = bpe.train(sorted(counts.items()), 120)
    assert {t: k for k, t in enumerate(vocabulary.tokens)} == library.get_vocab()
    assert all(vocabulary.encode_word(n) == library.encode(n).ids for n in names)


def test_learning_is_bounded(spark):
    df = spark.createDataFrame([("aa bb",), ("aa cc",)], "name string")
    with pytest.raises(ValueError, match="raise least"):
        bpe.learn(df, most_words=2)
    assert bpe.learn(df, least=2, most_words=2).tokens == ("<unk>", "a", "aa")


def test_learned_vocabulary_of_a_corpus_matches_public_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    rng = random.Random(4)
    names = [" ".join("".join(rng.choice("abcdeéñ-'") for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    library = tokenizers.Tokenizer(tokenizers.models.BPE())
    library.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    library.train_from_iterator(names, tokenizers.trainers.BpeTrainer(special_tokens=["<unk>"], vocab_size=150, show_progress=False))
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string").repartition(4)
    vocabulary = bpe.learn(df, vocab_size=150)
    assert {t: k for k, t in enumerate(vocabulary.tokens)} == library.get_vocab()
    got = {r["id"]: r["ids"] for r in df.select("id", bpe.encode(vocabulary, F.col("name")).alias("ids")).collect()}
    assert all(got[i] == library.encode(n).ids for i, n in enumerate(names))


def test_tokenized_table(spark):
    df = spark.createDataFrame([(1, "New York"), (2, "Yorkshire")], "id int, city_name string")
    vocabulary = bpe.learn(df, "city_name", 40)
    out = bpe.tokenize_table(df, vocabulary, keep_original=True, packing="csv")
    assert out.columns == ["id", "city_name", "city_name_tokens"]
    assert bpe.tokenize_table(df, vocabulary).columns == ["id", "city_name_tokens"]
    ids = bpe.encode(vocabulary, F.col("city_name"))
    texts = [r[0] for r in df.select(bpe.decode(ids, bpe.vocabulary_table(spark, vocabulary))).collect()]
    assert texts == ["NewYork", "Yorkshire"]


def test_prefix_join_and_locate(spark):
    cities = spark.createDataFrame([("u1a",), ("u1b",), ("s",)], "geohash string")
    probes = spark.createDataFrame([("u1",), ("",), ("x",), ("u1a",)], "p string")
    got = sorted((r["p"], r["geohash"]) for r in keys.prefix_join(probes, "p", cities, "geohash").collect())
    assert got == sorted((p, c) for p in ("u1", "", "x", "u1a") for c in ("u1a", "u1b", "s") if c.startswith(p))
    long = spark.createDataFrame([("u4pruydqqvj8_123456789012345678",), (None,)], "geohash string")
    probes = spark.createDataFrame([("u4pruydqqvj8_1234567890123456",)], "p string")
    assert keys.prefix_join(probes, "p", long, "geohash").count() == 1
    points = spark.createDataFrame([(1, "u1aaaa"), (2, "zzz"), (3, "s12"), (4, None)], "id int, gh string")
    assert {r["id"]: r["geohash"] for r in keys.locate(points, "gh", cities, "geohash").collect()} == {1: "u1a", 2: None, 3: "s", 4: None}


def test_search(spark):
    df = spark.createDataFrame([(1, "New York, X"), (2, "York"), (3, "Newport")], "id int, name string")
    index = search.postings(df, "id", "name")
    hits = lambda q: sorted(r["id"] for r in search.match(index, q, "id").collect())
    assert hits("york") == [1, 2] and hits("new*") == [1, 3] and hits("york new") == [1] and hits("") == [] and hits("yo* n*") == [1]
    assert [r["id"] for r in search.name_prefix(df, "name", "New", 1).collect()] == [1] and search.name_prefix(df, "name", "New", -1).count() == 0


def test_mismatches(spark):
    a = spark.createDataFrame([(0, "x", None), (1, "y", 1), (2, "z", 2)], "pos int, s string, n int")
    b = spark.createDataFrame([(0, "x", None), (1, "q", 1), (3, "w", 2)], "pos int, s string, n int")
    assert verify.mismatches(a, b, "pos", ["s", "n"]).first().asDict() == {"missing": 1, "extra": 1, "s_differs": 1, "n_differs": 0}
    assert verify.same_rows(a, a) and not verify.same_rows(a, b)


def test_rows_are_spread_before_their_prefixes_are_made(spark, monkeypatch):
    """A file is one task; keys and prefix joins deal its rows to more, whatever they are."""
    rows = [(i, "".join("bcd"[(i * 7919 >> 2 * k) % 3] for k in range(12))) for i in range(300)] + [(900, None)]
    df = spark.createDataFrame(rows, "id long, gh string").coalesce(1)
    want = sorted(map(tuple, keys.shortest_unique_keys(df, "gh", "id").collect()))
    probes = spark.createDataFrame([("",), ("b",), (None,), (want[5][2],)], "p string")
    cities = spark.createDataFrame(want, "id long, gh string, key string, precision int")
    met = sorted(map(tuple, keys.prefix_join(probes, "p", cities, "key").collect()))
    monkeypatch.setattr(keys, "SPREAD", 10)
    spread = keys.shortest_unique_keys(df, "gh", "id")
    assert sorted(map(tuple, spread.collect())) == want and "RepartitionByExpression [_id" in spread._jdf.queryExecution().toString()
    assert sorted(map(tuple, keys.prefix_join(probes, "p", cities, "key").collect())) == met


def test_key_counts_are_dealt_whatever_the_number_of_partitions(spark, monkeypatch):
    """A task's share of the prefixes, of their counts and of the rows they lead to doesn't grow with the table; a cell that all rows share is added up before it is dealt."""
    rows = [(i, "s" * 6 + "".join("bcd"[(i * 7919 >> 2 * k) % 3] for k in range(6))) for i in range(400)] + [(900, None), (None, "sz"), (901, "")]
    df = spark.createDataFrame(rows, "id long, gh string").coalesce(1)
    want = sorted(map(str, keys.shortest_unique_keys(df, "gh", "id").collect()))
    monkeypatch.setattr(keys, "SPREAD", 10)
    spread = keys.shortest_unique_keys(df, "gh", "id")
    plan = spread._jdf.queryExecution().toString()
    assert sorted(map(str, spread.collect())) == want
    assert all(f"RepartitionByExpression [{c}#" in plan for c in ("_deal", "_prefix", "_id")) and plan.count(", 41") >= 3


def test_learning_takes_little_memory_a_word(monkeypatch):
    """Half of what lists of ids and sets of words a pair take; the driver learns from up to MOST_WORDS of them."""
    monkeypatch.setattr(bpe, "CELLS", 1 << 14, raising=False)
    counts = [(f"{k:09d}", 1) for k in range(20_000)]
    tracemalloc.start()
    try:
        bpe.train(counts, 60)
        assert tracemalloc.get_traced_memory()[1] < 400 * len(counts)
    finally:
        tracemalloc.stop()


def test_words_are_fetched_whole(spark):
    words = [("aa", 3), ("", 5), ("b" * 300, 1), ("é漢😀", 2)] + [(f"{k:09d}", 1) for k in range(3000)]
    found, n = bpe.fetched(spark.createDataFrame(words, "word string, n long").repartition(3))
    assert sorted(zip(found.to_pylist(), n.tolist(), strict=True)) == sorted(w for w in words if w[0])
    assert bpe.train_words(found, n, 50) == bpe.train(words, 50)
    none, n = bpe.fetched(spark.createDataFrame([], "word string, n long"))
    assert len(none) == 0 and bpe.train_words(none, n) == bpe.train([])


@pytest.mark.parametrize("seed", range(3))
def test_overlapping_pairs_and_long_words(seed):
    rng = random.Random(seed)
    counts = [(rng.choice("ab") * rng.randrange(1, 80) + rng.choice(["", "ab", "ba"]), rng.randrange(1, 5)) for _ in range(30)]
    vocabulary = bpe.train(counts, 40)
    tokens, words = naive_bpe(counts, 40)
    assert list(vocabulary.tokens) == tokens
    assert [vocabulary.encode_word(w) for w, _ in counts] == words


def test_encoding_needs_neither_pandas_nor_workers_for_tables(spark):
    """Workers that load pandas, and others that only hand a list over, took half of an executor's Python."""
    vocabulary = bpe.train([("new", 2), ("york", 1)], 20)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for made in (bpe.vocabulary_table(spark, vocabulary), bpe.merges_table(spark, vocabulary)):
        assert "LocalTableScan" in plan(made)
    rows = spark.createDataFrame([(1, "new york!"), (2, None), (3, "")], "id int, name string")
    encoded = rows.select("id", bpe.encode(vocabulary, F.col("name")).alias("ids"))
    assert f", {PythonEvalType.SQL_SCALAR_ARROW_UDF}" in plan(encoded)
    assert {r["id"]: r["ids"] for r in encoded.collect()} == {1: vocabulary.encode_word("new") + vocabulary.encode_word("york"), 2: None, 3: []}
