"""Token counts against the public library, periodic runs and whitening against brute force."""

import hashlib
import os
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from atlasframe.llm import periodic, queries, tokencount, whitening

SF = "/root/testdata/sf0.001"


def odd_texts(seed, n):
    rng = random.Random(seed)
    out = ["", "<|endoftext|>", "a<|endoftext|>b <|startoftext|><|endoftext|>x", "it's İSTANBUL ΣΑΣ ﬁ é \x1c\x1d\x85\xa0 a b", "a" * 3000, "ab" * 2000 + "!" * 999, "\x00\x01   x", "ʼn ß ẞ 1234567 ½ ²", "'s 'S it'S we'LL"]
    out += ["".join(rng.choice("abcdeéÀ 'st!?\n\t01東<|>endoftx_") for _ in range(rng.randrange(120))) for _ in range(n)]
    out += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x800), rng.randrange(0x800, 0xD800), rng.randrange(0x10000, 0x1F000)])) for _ in range(40)) for _ in range(n)]
    return [*out, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_counts_equal_the_library(file):
    path = public_tokenizers.path(file)
    texts = odd_texts(5, 300)
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    counter = tokencount.TokenCounter(path)
    assert counter.counts(texts) == want
    assert counter.counts(texts[::-1]) == want[::-1]  # from memory
    assert not any(len(w) > tokencount.SHORT for w in (*counter.words, *counter.stretches))


def test_token_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokencount, "MEMORY", 20)
    path = public_tokenizers.path("word_bpe_49k.json")
    counter, library = tokencount.TokenCounter(path), Tokenizer.from_file(path)
    for k in range(20):
        texts = [f"word{k} other{k * i} <|endoftext|>" for i in range(9)]
        assert counter.counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
        assert len(counter.words) <= 20 and len(counter.stretches) <= 20


def merged_one_by_one(word, merges):
    ranks = {p: r for r, p in enumerate(merges)}
    parts = list(word)
    while True:
        found = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]
        if not found:
            return len(parts)
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges_that_use_a_symbol_before_it_is_made():
    merges = [("b", "c"), ("abc", "a"), ("a", "bc"), ("a", "a"), ("aa", "a"), ("c", "a")]
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys([*"abc", *(a + b for a, b in merges)]))}
    merger = tokencount.PairMerges(vocabulary, merges)
    assert not merger.together.all()
    rng = random.Random(2)
    words = ["", "abcabc", *("".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(400))]
    assert merger.count(words).tolist() == [merged_one_by_one(w, merges) for w in words]


def test_token_counts_of_odd_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, None), (2, ""), (3, "hello " * 50_000)], "doc_id long, text string").withColumns({"n_tokens": F.lit("clash"), "lang": F.lit(None)})
    rows = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokencount.count_tokens(df, path).collect())
    assert rows == [(0, 0, 0, False), (1, 1, 1, False), (1, 1, 1, False), (2, 0, 0, False), (3, 300_000, 50_000, True)]
    assert tokencount.count_tokens(df.limit(0), path).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_token_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    library = Tokenizer.from_file(queries.tokenizer_path())
    rows = queries.op11_token_counts(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 2048)


def naive_runs(w, least=6, times=4):
    n, out = len(w), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            k = i
            while k + p < n and w[k] == w[k + p]:
                k += 1
            if k > i and k + p - i >= max(least, times * p):
                out.setdefault((i, k + p - i), p)
            i = k + 1
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("seed", "pairs", "times"), [(1, 1 << 20, 4), (2, 1, 4), (3, 40, 3), (4, 1 << 20, 2)])
def test_runs_against_all_periods(monkeypatch, seed, pairs, times):
    monkeypatch.setattr(periodic, "PAIRS", pairs)
    rng = random.Random(seed)
    for _ in range(15 if pairs == 1 else 60):
        docs = []
        for _ in range(rng.randrange(1, 10)):
            letters = [b"a", b"b", b"c"][: rng.choice([1, 2, 3])]
            doc = [rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 6, 7, 30, 150]))]
            if doc and rng.random() < 0.5:
                unit, at = [rng.choice([b"a", b"b", b"d"]) for _ in range(rng.randrange(1, 9))], rng.randrange(len(doc))
                doc[at:at] = unit * rng.randrange(2, 8) + unit[: rng.randrange(len(unit))]
            docs.append(doc)
        assert periodic.find_runs(docs, 6, times) == [naive_runs(d, 6, times) for d in docs]


def test_long_runs():
    rng = random.Random(8)
    unit = [b"%d" % rng.randrange(40) for _ in range(9_000)]
    assert periodic.find_runs([unit * 5 + unit[:7], [b"a"] * 20_000]) == [[(0, 45_007, 9_000)], [(0, 20_000, 1)]]


def test_collapse_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b a b a b a b c"), (1, "a b a b a b a b c"), (None, None), (2, " \n\t"), (3, "x " * 7), (4, "é  é  é  é  é  é ")], "doc_id long, text string").withColumns({"runs": F.lit(1), "n_words": F.lit("")})
    rows = sorted((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.collapse_runs(df).collect())
    assert rows == [(0, 0, [], ""), (1, 9, [(0, 8, 2)], "a b c"), (1, 9, [(0, 8, 2)], "a b c"), (2, 0, [], ""), (3, 7, [(0, 7, 1)], "x"), (4, 6, [(0, 6, 1)], "é ")]
    assert periodic.collapse_runs(df.limit(0)).count() == 0


def brute_runs_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = naive_runs(words)
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{size},{p}\n" for s, size, p in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_runs_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op12_periodic_runs(spark, SF).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert sorted(map(tuple, rows)) == sorted(brute_runs_row(*d) for d in docs if len((d[1] or "").split()) < 20_000)
    assert sum(r["n_runs"] > 0 for r in rows) > 5


def test_repeating_documents_odd_rows(spark):
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0]
    rng = random.Random(4)
    docs = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40)))) for k in ids] + [(ids[0], None), (ids[1], " \n"), (None, "a a a a a a a")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in queries.repeating_documents(df).collect())
    assert len(got) == len(docs) and (-1, "a a a a a a a") in got
    for k, text in got:
        assert k < 0 or text == "" or len(text.split()) > 0 or text.isspace()
    found = {(r["doc_id"], r["text"]) for r in queries.repeating_documents(df).collect()}
    for k, text in docs:
        words = (text or "").split()
        if k is not None and words:
            g = zlib.crc32(str(k).encode()) // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            assert (k, " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(len(words)))) in found


def brute_whitening(vectors, k=16, scale=64, shift=1_000_000):
    x = np.floor(scale * np.asarray(vectors, dtype=np.float64)).astype(np.int64) + shift
    fit = np.unique(x, axis=0)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = fit - np.array(sums) / n
    v = centred.T @ centred / n
    values, columns = np.linalg.eigh(v)
    order = np.argsort(-values)[:k]
    deviations = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return n, deviations, (x - np.array(sums) / n) @ columns[:, order] / np.sqrt(values[order]), values[order] / np.trace(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_whitening_query(spark):
    given = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    n, deviations, white, shares = brute_whitening(list(given.values()))
    rows = queries.op13_embedding_whitening(spark, SF).collect()
    assert len(rows) == len(given) * 16 and {r["n"] for r in rows} == {n}
    at = {v: i for i, v in enumerate(given)}
    got = np.zeros((len(given), 16))
    for r in rows:
        got[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviations[at[r["vec_id"]]] and abs(r["explained"] / shares[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9
    signs = np.sign((got * white).sum(axis=0))
    assert np.allclose(got * signs, white, atol=1e-6)


@pytest.mark.parametrize("dims", [3, 40, 150])
def test_tiles_against_one_product(spark, dims, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(dims)
    x = np.round(rng.normal(size=(300, dims)) @ rng.normal(size=(dims, dims)) * 10).astype(int)
    vectors = spark.createDataFrame([(i, dims, [int(c) for c in v]) for i, v in enumerate(x)], "id long, dims int, x array<bigint>").repartition(4)
    sums = whitening._sums(vectors)
    assert sums == {dims: (300, tuple(int(s) for s in x.sum(axis=0)))}
    want = np.cov(x.T, bias=True)
    assert np.allclose(whitening.tiled_covariance(vectors, sums)[dims], want, rtol=1e-10, atol=1e-8)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(1)
    good = [(i, [rng.random(), rng.random() * 3, 0.5]) for i in range(40)]
    rows = [*good, good[0], (None, good[1][1]), (90, None), (91, [0.1, None, 0.2]), (92, [nan, 0.0, 0.0]), (93, [0.0, inf, 0.0]), (94, []), (95, [1.0]), (96, [1.0, 2.0]), (97, [1e30, -1e30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "dims": F.lit("d")})
    vectors = whitening.integer_vectors(df)
    fits = whitening.fit(vectors)
    found = whitening.whiten(vectors, fits).collect()
    assert sorted(r["id"] for r in found if r["id"] is not None) == sorted([*range(40), 0, 95, 96, 97]) and len(found) == 45
    by_id = {}
    for r in found:
        by_id.setdefault(r["id"], []).append(r)
    assert by_id[0][0] == by_id[0][1] and by_id[1][0]["whitened"] == by_id[None][0]["whitened"]
    assert by_id[2][0]["whitened"][2] is None and by_id[2][0]["n"] == 40 and by_id[2][0]["identity_error"] < 1e-9
    assert by_id[95][0]["whitened"] == [None] and by_id[95][0]["explained"] == [None] and by_id[95][0]["deviation"] == 0
    assert by_id[97][0]["deviation"] is None and by_id[96][0]["n"] == 2
    n, deviations, white, _ = brute_whitening([v[:2] for _, v in good], 2)
    assert n == 40 and [by_id[i][0]["deviation"] for i in range(40)] == deviations
    got = np.array([by_id[i][0]["whitened"][:2] for i in range(40)])
    assert np.allclose(np.abs(got), np.abs(white), atol=1e-9)
    empty = whitening.integer_vectors(df.limit(0))
    assert whitening.whiten(empty, whitening.fit(empty)).count() == 0
