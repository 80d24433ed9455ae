"""Packing, sharding, mixing, top-k, near-duplicates and the pipeline against brute force."""

import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasframe import scratch
from atlasframe.llm import common, graph, mixing, neardup, packing, sharding, simhash, topk
from atlasframe.llm.queries import tokenizer_path

WEIRD = ["", None, "Hello,  World's end!", "ﬁ İstanbul ΣΑΣ", "á café", "<|endoftext|> x", "don't we'll", "\x1c\x85  ", "12 345", "word,' ''s", "日本語 テキスト", "x" * 300, "tab\tand\r\nlines", "é" * 80]


def test_token_pieces_match_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(1)
    texts = WEIRD + [" ".join(rng.choice(["The", "Thonti,", "été", "x.", "--", "naïve"]) for _ in range(rng.randrange(1, 90))) for _ in range(30)]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, piece int").repartition(3)
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in packing.token_pieces(df, tokenizer_path(), 16, with_ids=True).collect()}
    want = {}
    for i, t in enumerate(texts):
        ids = np.asarray([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes()
        for k, at in enumerate(range(0, len(ids), 64)):
            want[i, k] = (at // 4, len(ids[at : at + 64]) // 4, zlib.crc32(ids[at : at + 64]), ids[at : at + 64])
    assert got == want


def fewest(items, capacity):
    """The least number of bins, by trying all."""
    best = [len(items)]

    def put(rest, bins):
        if len(bins) >= best[0]:
            return
        if not rest:
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + rest[0] <= capacity and bins[k] not in bins[:k]:
                put(rest[1:], bins[:k] + [bins[k] + rest[0]] + bins[k + 1 :])
        put(rest[1:], bins + [rest[0]])

    put(sorted(items, reverse=True), [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_reduction_keeps_the_optimum(seed):
    rng = random.Random(seed)
    items = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 11))]
    histogram = {s: items.count(s) for s in items}
    stock = packing._Stock(histogram)
    fixed = packing.reduce_instance(stock, 20)
    rest = [s for s, n in stock.count.items() for _ in range(n)]
    assert sorted(rest + [s for p, n in fixed for s in p * n]) == sorted(items)
    assert sum(n for _, n in fixed) + (fewest(rest, 20) if rest else 0) == fewest(items, 20)
    plan = packing.plan_packing(histogram, 20)
    assert all(sum(p) <= 20 for p, _ in plan) and sorted(s for p, n in plan for s in p * n) == sorted(items)


def test_packing_places_everything(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("ab" for _ in range(rng.choice([0, 1, 3, 9, 30, 50])))) for i in range(400)] + [(5, "ab ab")] * 3 + [(None, None)]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path(), 32).collect()
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 32
    assert len(by) <= 1.02 * sum(r["length"] for r in out) / 32 + 1
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


@pytest.mark.parametrize(("rows", "hot"), [(300, 120), (10, 0), (0, 0)])
def test_sharding(spark, rows, hot):
    rng = random.Random(rows)
    docs = [(i, "hot" if i < hot else rng.choice([None, "", f"t{rng.randrange(60)}", f"only {i}"])) for i in range(rows)]
    out = sharding.shard(spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, shard string"), 24).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(rows))
    counts = [sum(r["shard"] == s for r in out) for s in range(24)]
    assert max(counts) - min(counts) <= 1
    for s in range(24):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(counts[s]))
    texts = {i: t or "" for i, t in docs}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in out)
    groups = {}
    for r in out:
        groups.setdefault(texts[r["doc_id"]], []).append(r["shard"])
    linked = [g for g in groups.values() if len(g) > 1]
    if rows >= 24 * 4:  # far more neighbours meet than by chance
        together = sum(sum(a == b for a, b in combinations(g, 2)) for g in linked if len(g) < 12)
        assert together >= 0.7 * sum(len(g) * (len(g) - 1) // 2 for g in linked if len(g) < 12)


def test_sharding_cuts_no_more_than_plain_propagation(spark):
    """Cut links against label propagation row by row under the same quotas."""
    rng = random.Random(6)
    texts = [f"g{g}" for g in range(50) for _ in range(rng.choice([2, 2, 3, 3, 4, 6, 9, 14]))]
    rng.shuffle(texts)
    shards, n = 6, len(texts)
    quota = [n // shards + (j < n % shards) for j in range(shards)]
    label = [i % shards for i in range(n)]
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t, []).append(i)
    for _ in range(6):
        for i in range(n):
            near = [sum(label[j] == s for j in groups[texts[i]] if j != i) for s in range(shards)]
            for s in sorted(range(shards), key=lambda s: -near[s]):
                if near[s] <= near[label[i]]:
                    break
                if sum(x == s for x in label) < quota[s]:
                    label[i] = s
                    break
    cut = lambda of: sum(of[a] != of[b] for g in groups.values() for a, b in combinations(g, 2))
    out = {r["doc_id"]: r["shard"] for r in sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards).collect()}
    assert sorted(sum(x == s for x in out.values()) for s in range(shards)) == sorted(quota)
    assert cut(out) <= cut(label)
    odd = spark.createDataFrame([(None, "a"), (None, "a"), (1, "a"), (1, "a"), (2, "b" * 200_000), (3, None)], "doc_id long, text string")
    placed = sharding.shard(odd, 3).collect()
    assert sorted(r["shard"] for r in placed) == [0, 0, 1, 1, 2, 2] and {r["size"] for r in placed if r["doc_id"] == 2} == {200_008}


def filled(sizes, weights, share=1.5, repeats=2):
    """Targets by resharing the excess until none is above its cap."""
    target, fixed = {}, set()
    while True:
        left = share * sum(sizes.values()) - sum(repeats * sizes[s] for s in fixed)
        w = sum(weights[s] for s in sizes if s not in fixed)
        target = {s: repeats * sizes[s] if s in fixed else left * weights[s] / w for s in sizes}
        above = {s for s in sizes if s not in fixed and target[s] >= repeats * sizes[s]}
        if not above:
            return target
        fixed |= above


def test_mixing(spark):
    rng = random.Random(7)
    sources = ["a", "b", "zz", "é", None]
    docs = [(i, " ".join("w" * rng.randrange(0, 40)), rng.choice(sources)) for i in range(500)] + [(7, "w w", "a")] * 2 + [(None, None, "b"), (901, "", "b")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, size int").repartition(6)
    rows = mixing.mix(df).collect()
    sizes = {s: sum(len((t or "").split()) for _, t, x in docs if x == s) for s in sources}
    want = filled(sizes, dict(zip(sources, (5, 2, 1, 5, 2))))
    assert len(rows) == len(docs)
    for s in sources:
        own = [r for r in rows if r["source"] == s]
        assert all(r["_mix_total"] == sizes[s] and abs(r["_mix_target"] - want[s]) < 1e-6 and r["_mix_times"] <= 2 for r in own)
        assert abs(sum(r["_mix_size"] * r["_mix_times"] for r in own) - want[s]) <= 40
        assert all(len(r["_mix_positions"]) == r["_mix_times"] and sorted(r["_mix_positions"]) == r["_mix_positions"] for r in own)
    assert mixing.mix(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, "w " * 300_000, "a", 7), (2, "w", "a", 7), (3, "\u00a0", None, 7)], "doc_id long, text string, source string, _mix_size int")
    assert {r["doc_id"]: r["_mix_size"] for r in mixing.mix(odd).collect()} == {1: 300_000, 2: 1, 3: 1}
    trained = mixing.mixed_rows(df)
    assert trained.columns == df.columns and trained.count() == sum(r["_mix_times"] for r in rows)


@pytest.mark.parametrize("rank", range(3))
def test_positions_invert_the_schedule(spark, rank):
    knots = mixing.SCHEDULES[rank]
    df = spark.range(101).select((F.col("id") / 100).alias("u"))
    for r in df.select("u", mixing._position(F.col("u"), F.lit(rank), mixing.SCHEDULES).alias("t")).collect():
        grid = np.linspace(0, r["t"], 20001)
        rate = np.interp(grid, [k[0] for k in knots], [k[1] for k in knots])
        whole = np.interp(np.linspace(0, 1, 20001), [k[0] for k in knots], [k[1] for k in knots])
        assert abs(np.trapezoid(rate, grid) / np.trapezoid(whole, np.linspace(0, 1, 20001)) - r["u"]) < 1e-6


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(400)]
    rows += [(500 + i, rows[3][1]) for i in range(60)] + [(20, rows[0][1])]
    odd = [(960, [1e20] * 8), (961, [3e7] + [0.0] * 7), (900, None), (901, [1.0, None] * 4), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (None, rows[0][1]), (920, [1.0] * 3), (921, [2.0] * 3)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], "vec_id long, embedding array<float>, rank int").repartition(5)
    vectors = topk.impact_vectors(df)
    asked = vectors.where("id % 20 = 0")
    got = {}
    for r in topk.top_k(vectors, asked, 20, block_rows=150).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    q = lambda v: [int(np.floor(64 * np.float64(np.float32(x)))) for x in v]
    ints = [(i, q(v)) for i, v in rows] + [(960, q(odd[0][1])), (961, q(odd[1][1])), (920, [64] * 3), (921, [128] * 3)]
    for i, v in ints:
        if i % 20 or i == 20:  # 20 is asked with two vectors
            continue
        scored = ((-sum(a * b for a, b in zip(v, w)), j) for j, w in ints if j != i and len(w) == len(v))
        best = sorted(x for x in scored if -(2**63) < x[0] <= 2**63)[:20]  # what fits a long
        assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert topk.top_k(vectors.limit(0), asked.limit(0)).count() == 0


def test_top_k_loses_no_pair_that_fits_a_long(spark):
    rows = [(20, [1.0, 0.0]), (1, [3e8, 0.0]), (2, [0.5, 0.0]), (3, [1e17, 0.0]), (4, [1e30, 0.0]), (5, [-1e15, 3e38]), (40, [0.0, 1.0]), (60, [1e16, 1e16])]
    vectors = topk.impact_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in topk.top_k(vectors, vectors.where("id % 20 = 0"), 20).collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows}
    for q in (20, 40, 60):
        scored = [(j, sum(a * b for a, b in zip(whole[q], v))) for j, v in whole.items() if j != q]
        assert sorted(got.get(q, [])) == sorted((j, s) for j, s in scored if -(2**63) <= s < 2**63)
    assert (1, 64 * 64 * 3 * 10**8) in got[20] and len(got[20]) == 4


def test_top_k_index_is_exact():
    rng = np.random.default_rng(1)
    for n, dims, top in ((2000, 16, 30), (500, 1, 3), (300, 64, 2**22), (900, 3, 2**30), (3000, 20, 2), (1, 4, 9), (400, 5, 2**25)):
        v = rng.integers(-top, top, (n, dims))
        index = topk.ImpactIndex(np.arange(n) * 3, v.astype(float))
        asked = np.arange(0, n, 7)
        for i, (ids, scores) in zip(asked.tolist(), index.search(asked * 3, v[asked].astype(float), 7), strict=True):
            s = v @ v[i]
            order = [j for j in np.lexsort((np.arange(n), -s)) if j != i][:7]
            assert ids.tolist() == [3 * j for j in order] and scores.tolist() == [s[j] for j in order]


def test_segments_are_processed_by_falling_impact(monkeypatch):
    rng = np.random.default_rng(4)
    v = np.floor(rng.standard_t(2, (4000, 6)) * 20)
    index = topk.ImpactIndex(np.arange(4000), v)
    for q in v[:50]:
        index.processed = 0
        found = index.possible(q[None], np.array([20]))[0]
        scores = v @ q
        assert scores.max() in scores[found] and set(np.flatnonzero(scores > np.sort(scores)[-21])) <= set(found.tolist())
        impacts = np.sort(np.abs(v * q), axis=None)[::-1]
        levels = [x * impacts[0] for x in topk.LEVELS]
        assert index.processed in {int((impacts >= x).sum()) for x in levels}
    index.processed = 0
    index.possible(v[:50], np.full(50, 20))
    assert index.processed < 50 * 4000 * 6 * 0.95  # it stops on proof before the end


def test_queries_pass_by_the_index_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.integers(-5, 6, 4)]) for i in range(700)]
    vectors = topk.impact_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), scale=1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(vectors, vectors, 5, block_rows=90).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    m = np.array([v for _, v in rows])
    for i in range(700):
        s = m @ m[i]
        order = [j for j in np.lexsort((np.arange(700), -s)) if j != i][:5]
        assert [found[i, r + 1] for r in range(5)] == [(j, s[j]) for j in order]


def slow_fingerprint(text, k=3):
    import re

    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(spark):
    rng = random.Random(11)
    words = [f"Wörd{i}" for i in range(300)]
    docs = []
    for i in range(120):
        base = [rng.choice(words) for _ in range(rng.randrange(0, 120))]
        docs.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            near = base[:]
            if near:
                near[rng.randrange(len(near))] = "changed"
            docs.append(" \t".join(near))
    rows = list(enumerate(docs)) + [(5000, None), (5001, " \n"), (None, docs[4]), (3, docs[3])]
    df = spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(6)
    out = simhash.near_duplicates(df, shard_points=16).collect()
    fp = {(i, t): slow_fingerprint(t) for i, t in rows}
    parent = list(range(len(rows)))
    find = lambda a: a if parent[a] == a else find(parent[a])
    keys = [fp[r] for r in rows]
    for a, b in combinations(range(len(rows)), 2):
        if bin(keys[a] ^ keys[b]).count("1") <= 2:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = sorted((str(i), f"{keys[k]:016x}", least[find(k)]) for k, (i, _) in enumerate(rows))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in out) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    clash = df.withColumns({"_n": F.lit(1), "key": F.lit(2), "node": F.lit(3)})
    kept = [r["doc_id"] for r in simhash.keep_one(clash, radius=2).collect()]
    assert sorted(kept, key=str) == sorted(least.values(), key=str) or sorted(i for i in kept if i is not None) == sorted(set(least.values()))
    two = spark.createDataFrame([(1, "a b c d e"), (1, "v w x y z"), (None, "l m n"), (None, "l m n"), (None, "a b c d e")], "doc_id long, text string")
    assert sorted(map(str, simhash.keep_one(two, radius=2).collect())) == sorted(map(str, two.distinct().where("doc_id is not null or text = 'l m n'").collect()))


def test_pipeline_near_dedup_by_jaccard(spark):
    import corpus_pipeline

    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(1, 150))]
        docs.append(base)
        for _ in range(rng.randrange(4)):
            near = base[:]
            for _ in range(rng.randrange(1, 4)):
                near[rng.randrange(len(near))] = "changed"
            docs.append(near)
    hot = [rng.choice(words) for _ in range(120)]
    for i in range(40):  # a group whose members are linked by its middle only
        docs.insert(0, [*hot[: 3 * i], f"x{i}", *hot[3 * i + 1 :]])
    docs += [hot, ["Two", "words"], ["two", "words"], []]
    rng.shuffle(docs)
    shingles = [{tuple(x.lower() for x in d[i : i + 5]) for i in range(max(1, len(d) - 4))} if d else set() for d in docs]
    parent = list(range(len(docs)))
    find = lambda a: a if parent[a] == a else find(parent[a])
    for a, b in combinations(range(len(docs)), 2):
        if shingles[a] == shingles[b] or 10 * len(shingles[a] & shingles[b]) >= 8 * len(shingles[a] | shingles[b]):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    want = sorted({find(i) for i in range(len(docs))})
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)] + [(3, " ".join(docs[3])), (None, " ".join(docs[7])), (None, "only " * 9), (None, "only " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for out in (corpus_pipeline.drop_near_duplicates(spark, df, ""), neardup.keep_one(df, block=4, block_shingles=300)):
        got = [r["doc_id"] for r in out.collect()]
        assert got.count(None) == 1 and sorted(i for i in got if i is not None) == want
    assert len(want) < len(docs) - 60
    assert neardup.keep_one(df.limit(0)).count() == 0


def test_near_dedup_compares_what_no_hub_has_met(spark):
    """Families whose members share fingerprints with many but are close to few: all links by brute force."""
    rng = random.Random(8)
    docs = []
    for f in range(3):
        base = [f"f{f}w{i}" for i in range(90)]
        for _ in range(70):
            near = base[:]
            for at in rng.sample(range(18), rng.randrange(1, 5)):
                near[5 * at] = f"y{rng.randrange(6)}"
            docs.append(near)
    sets = [{tuple(d[i : i + 5]) for i in range(len(d) - 4)} for d in docs]
    parent = list(range(len(docs)))
    find = lambda a: a if parent[a] == a else find(parent[a])
    for a, b in combinations(range(len(docs)), 2):
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    want = sorted({find(i) for i in range(len(docs))})
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").repartition(4)
    assert 10 < len(want) < 190
    for block in (512, 8):
        assert sorted(r["doc_id"] for r in neardup.keep_one(df, block=block).collect()) == want


def test_near_dedup_takes_candidates_from_simhash_trees(spark):
    """With no MinHash fingerprint shared, fingerprints through the trees alone lead to the links; pairs that are near but not similar don't."""
    rng = random.Random(9)
    bases = [[f"d{d}w{i}" for i in range(400)] for d in range(40)]
    docs = bases + [[*b[:200], f"new{d}", *b[201:]] for d, b in enumerate(bases)] + [["one"], ["two"]]
    rng.shuffle(docs)
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").repartition(4)
    marked = neardup._marked(df, 5, "doc_id", "text").withColumn("bands", F.array("node"))
    near = lambda fps: simhash.links(fps, 3, least=8)
    fps = [neardup.fingerprint(neardup.shingles(" ".join(d))) for d in docs]
    sets = [set(neardup.shingles(" ".join(d)).tolist()) for d in docs]
    close = [(i, j) for i, j in combinations(range(len(docs)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3]
    want = [(i, j) for i, j in close if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    roots, nodes = neardup.similar_roots(df, marked, 80, 5, "doc_id", "text", near=near)
    got = {frozenset(r["ids"]) for r in nodes.join(roots, "node").groupBy("root").agg(F.collect_set("first.id").alias("ids")).collect()}
    assert len(want) > 10 and got == {frozenset(p) for p in want}
    alone, _ = neardup.similar_roots(df, marked, 80, 5, "doc_id", "text")
    assert alone.count() == 0
    wide = lambda fps: simhash.links(fps, 40, least=8)
    roots, nodes = neardup.similar_roots(df, marked, 80, 5, "doc_id", "text", near=wide)
    joined = {frozenset(r["ids"]) for r in nodes.join(roots, "node").groupBy("root").agg(F.collect_set("first.id").alias("ids")).collect()}
    assert all(len(g) == 2 for g in joined)


def test_tree_routes_every_link():
    rng = np.random.default_rng(2)
    points = np.unique(rng.integers(0, 2**63, 600, dtype=np.uint64))
    near = points[:300] ^ (np.uint64(1) << rng.integers(0, 63, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 300, dtype=np.uint64))
    points = np.unique(np.concatenate([points, near]))
    tree = simhash.fit_tree(points[::3], 20)
    members, homes = {}, {}
    for shard, idx, home in simhash._routes(tree, points, 2):
        members.setdefault(shard, set()).update(idx.tolist())
        for i in idx.tolist() if home else ():
            assert i not in homes
            homes[i] = shard
    assert len(homes) == len(points) and len(members) > 8
    a, b = np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2, 1))
    assert len(a) >= 290
    assert all(j in members[homes[i]] or i in members[homes[j]] for i, j in zip(a.tolist(), b.tolist()))


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (7, 7)]
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}


def test_scratch_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.shared_dir(Session())


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), i, rng.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    out = common.running(df, ["g"], [("-p", F.floor(F.col("v") / 2))], [F.col("i")], F.col("v"), "before").collect()
    order = sorted(out, key=lambda r: (r["g"], -(r["v"] // 2), r["i"]))
    total = {}
    for r in order:
        assert r["before"] == total.get(r["g"], 0)
        total[r["g"]] = r["before"] + r["v"]


def test_pipeline(spark):
    """Every stage against plain Python, each on what the stage before it kept."""
    import hashlib
    import math

    from tokenizers import Tokenizer

    import corpus_pipeline
    from atlasframe.llm import langid

    from .test_text_operators import naive_dedup

    rng = random.Random(21)
    words = {k: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(60)] for k, letters in (("en", "abcdefghi"), ("fr", "éàçlmnopq"))}
    say = lambda k, n: "\n".join(" ".join(rng.choice(words[k]) for _ in range(rng.randrange(5, 14))) for _ in range(n))
    rows = [(i, say(k, rng.randrange(1, 25)), k if i % 5 else None, rng.choice("abc")) for i, k in enumerate(["en", "fr"] * 60)]
    shared = say("en", 9)
    rows += [(200 + i, f"{say('en', 6)}\n{shared}\n{say('en', 3)}", "en", "a") for i in range(4)]
    rows += [(300 + i, rows[i][1].replace(rows[i][1].split()[0], "changed", 1), "en", "b") for i in range(0, 40, 2)]
    rows += [(400, "Привет мир", None, "a"), (401, "123 !!", None, "a"), (402, None, "en", "c"), (403, "", "en", "c"), (404, rows[3][1], "fr", None), (None, say("fr", 12), "fr", "b"), (404, rows[3][1], "fr", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema).repartition(5)
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        seen.append(common.written(stage(spark, seen[-1], "")))
        assert k == 4 or seen[-1].columns == docs.columns
    bag = lambda df: sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()), key=str)

    learned = langid.learn(docs.where("doc_id is null or crc32(cast(doc_id as string)) % 3 != 1"))
    parsed = [(*r, learned.predict(r[1])) for r in rows]
    want = [(i, t, lang or p[0], source) for i, t, lang, source, p in parsed if p[2]]
    assert bag(seen[1]) == sorted(want, key=str) and {400, 401, 402, 403} & {r[0] for r in want} == set()

    once = list(dict.fromkeys(want))  # a repeated row is a later repeat of the first, and long enough here
    lines = naive_dedup([(r[0], r[1]) for r in once], 50)
    left = [(i, lines[i], lang, source) for i, _, lang, source in once]
    left = [r for r in left if r[1].strip() or not dict((x[0], x[1]) for x in once)[r[0]].strip()]
    assert bag(seen[2]) == sorted(left, key=str) and len(left) < len(once)
    assert all(r["n_chars"] == len(r["text"]) for r in seen[2].collect())

    tokens = [(r[1] or "").lower().split() for r in left]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in tokens]
    parent = list(range(len(left)))
    find = lambda a: a if parent[a] == a else find(parent[a])
    order = sorted(range(len(left)), key=lambda k: (left[k][0] is None, left[k][0] or 0))
    place = {k: n for n, k in enumerate(order)}
    for a, b in combinations(range(len(left)), 2):
        if sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)), key=place.get)
            parent[y] = x
    kept = [left[k] for k in range(len(left)) if find(k) == k]
    assert bag(seen[3]) == sorted(kept, key=str) and len(kept) < len(left)

    sources = sorted({r[3] for r in kept}, key=lambda s: (s is None, s))
    size = lambda t: len((t or "").split())
    sizes = {s: sum(size(r[1]) for r in kept if r[3] == s) for s in sources}
    target = filled(sizes, dict(zip(sources, (5, 2, 1) * 2)))
    mixed = []
    for s in sources:
        at = 0
        for r in sorted((r for r in kept if r[3] == s), key=lambda r: hashlib.md5(str(r[0] if r[0] is not None else "").encode()).hexdigest()):
            n = size(r[1])
            passes = math.floor((target[s] - at - n / 2) / sizes[s]) + 1 if n else 0
            mixed += [r] * max(0, min(2, passes))
            at += n
    assert bag(seen[4]) == sorted(mixed, key=str) and len(mixed) > len(kept)

    library = Tokenizer.from_file(tokenizer_path())
    pieces = []
    for r in mixed:
        total = len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1
        pieces += [(r[0], at, min(2048, total - at)) for at in range(0, total, 2048)]
    packed = seen[5].collect()
    assert sorted(((r["doc_id"], r["start"], r["length"]) for r in packed), key=str) == sorted(pieces, key=str)
    filled_to = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled_to.get(r["sequence_id"], 0)
        filled_to[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled_to.values()) <= 2048 and len(filled_to) <= -(-sum(filled_to.values()) // 2048) + 1


def test_pipeline_on_nothing(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, ""))
    assert docs.count() == 0 and "sequence_id" in docs.columns
