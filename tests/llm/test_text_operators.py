"""Line dedup, language ID, license scans, chat formatting and media against brute force."""

import hashlib
import json
import math
import os
import random
import struct
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from atlasframe.llm import chat, langid, licenses, linededup, media

DOCS = "doc_id long, text string, n_lines int, other string"


def naive_dedup(docs, min_words):
    """Every window of every document, in order, against all before it."""
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    seen, gone = set(), {}
    for key, (doc, text) in enumerate(order):
        lines = [(i, x.strip(" \t\r\x0b\x0c")) for i, x in enumerate((text or "").split("\n"))]
        lines = [x for x in lines if x[1]]
        size = lambda a, b: sum(len(x[1].split()) for x in lines[a : b + 1])
        found = set()
        for p in range(len(lines)):
            ends = [e for e in range(p, len(lines)) if size(p, e) >= min_words]
            starts = [s for s in range(p + 1) if size(s, p) >= min_words]
            found |= {(p, ends[0])} if ends else set()
            found |= {(starts[-1], p)} if starts else set()
        for a, b in sorted(found):
            content = tuple(x[1] for x in lines[a : b + 1])
            if content in seen:
                gone.setdefault(key, set()).update(range(lines[a][0], lines[b][0] + 1))
            seen.add(content)
    return {doc: None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone.get(key, ())) for key, (doc, text) in enumerate(order)}


@pytest.mark.parametrize("seed", range(2))
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 7))) for _ in range(12)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 25)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "\n\n"), (63, docs[0][1]), (64, docs[0][1] + "\n" + docs[1][1]), (None, docs[1][1])]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], DOCS).repartition(5)
    out = linededup.dedup_lines(df, 8)
    assert out.columns == ["doc_id", "text", "other", "n_lines", "removed_lines"]
    assert {r["doc_id"]: r["text"] for r in out.collect()} == naive_dedup(docs, 8)


def test_line_dedup_repeated_and_empty(spark):
    line = "one two three four five six"
    df = spark.createDataFrame([(1, line), (1, line), (2, line), (None, f"\n{line}\nx"), (None, f"\n{line}\nx")], "doc_id long, text string")
    found = sorted(((r["doc_id"] is None, r["doc_id"], r["text"]) for r in linededup.dedup_lines(df, 5).collect()), key=str)
    assert found == [(False, 1, ""), (False, 1, line), (False, 2, ""), (True, None, ""), (True, None, "\nx")]
    assert linededup.dedup_lines(df, 7).where("removed_lines > 0").select("doc_id", "text").collect() == [(None, "")]
    assert linededup.dedup_lines(df.limit(0), 5).count() == 0


def test_line_dedup_matches_are_whole(spark):
    rng = random.Random(9)
    say = lambda n: [" ".join(rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(4)) for _ in range(n)]
    shared, other = say(30), say(12)
    docs = [(1, [*say(5), *shared, *say(3)]), (2, [*say(2), *shared[3:25], "", *other, *say(9)]), (3, [*other, *say(4), *shared[20:], *shared[:4]])]
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in docs], "doc_id long, text string")
    rid = {bytes(r["rid"]): r["doc_id"] for r in df.select("doc_id", linededup.row_identity("doc_id", "text").alias("rid")).collect()}
    found = sorted((rid[bytes(r["rid"])], r["first"], r["last"], r["source_id"], r["source_begin"]) for r in linededup.matches(df, 12).collect())
    assert found == [(2, 2, 23, 1, 8), (3, 0, 11, 2, 24), (3, 16, 25, 1, 25), (3, 26, 29, 1, 5)]


def test_line_dedup_long_text(spark):
    lines = [f"line {i % 5000} of a long text" for i in range(20_000)]
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    out = linededup.dedup_lines(df, 50).first()
    assert out["text"] == "\n".join(lines[:5000]) and out["removed_lines"] == 15_000


def naive_phrases(sample, text):
    n, at = 0, 0
    while at < len(text):
        length = max((k for k in range(1, len(text) - at + 1) if text[at : at + k] in sample), default=1)
        n, at = n + 1, at + length
    return n


def test_suffix_automaton_parses_greedily():
    rng = random.Random(2)
    for _ in range(30):
        sample = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 80)))
        automaton = langid.SuffixAutomaton(sample)
        for _ in range(20):
            text = "".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 30)))
            assert automaton.parse(text) == (naive_phrases(sample, text), sum(c not in sample for c in text))


def test_language_id(spark):
    rng = random.Random(4)
    kinds = {"aa": ["ba", "bo", "mi"], "zz": ["xu", "qi", "zoz"]}
    say = lambda k, n: " ".join("".join(rng.choice(kinds[k]) for _ in range(3)) for _ in range(n))
    rows = [(i, say(k, 30), k) for i, k in enumerate(["aa", "zz"] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.learn(df)
    odd = [(1, say("aa", 20), "x"), (2, say("zz", 1), "x"), (3, None, "x"), (4, "", "x"), (5, "12 34 ²!", "x"), (6, "q" * 5000, "x")]
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(spark.createDataFrame(odd, "doc_id long, text string, score string"), learned).collect()}
    assert [out[i][0] for i in (1, 2, 3, 4, 5, 6)] == ["aa", "zz", "und", "und", "und", "zz"] and all(0 <= s <= 1 for _, s in out.values())
    nothing = langid.learn(df.where("lang is null"))
    assert [r["lang_pred"] for r in langid.identify(df.limit(1), nothing).collect()] == ["und"]
    assert langid.identify(df.limit(0), learned).count() == 0


def test_language_id_by_brute_force(spark):
    """``learn`` and ``identify`` against plain Python: samples, whole parses, ties and scores."""
    rng = random.Random(12)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 7)))
    say = lambda letters, n: " ".join(word(letters) for _ in range(n)) + rng.choice(["", "!", " 12"])
    kinds = {"b": "abcé", "a": "bcdx", "c": "xyzñ"}
    rows = [(i, say(kinds[k], 9), k) for i, k in enumerate("abc" * 5)] + [(90, None, "a"), (91, "zzz", None), (92, "", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learned = langid.learn(df, chars=70)
    spaced = lambda t: " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
    whole = {k: {spaced(t).strip() for _, t, x in rows if x == k and t} for k in "abc"}
    for k, sample in learned.samples.items():
        texts = sorted(whole[k], key=lambda t: sample.find(t) if t in sample else 10**6)
        assert len(sample) == 70 and sample == " ".join(texts)[:70] or all(w in " ".join(texts).split() for w in sample.split()[:-1])
    held = {k: f" {s} " for k, s in learned.samples.items()}
    tied = langid.Languages({"q": ["ab ab"], "p": ["ab ab"]})
    assert tied.predict("ab") == ("p", 0.0, True)
    assert not tied.predict("uvw xyz")[2] and tied.predict("b" * 50)[2] and tied.predict("ba")[2] and not tied.predict("1")[2]
    odd = [say("abcdxyzé", rng.randrange(1, 12)) for _ in range(40)] + ["abcé" * 300, "Éa B", "q"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)] * 2, "doc_id long, text string")
    for r in langid.identify(df, learned).collect():
        bits = sorted((naive_phrases(s, spaced(r["text"])) * math.log2(len(s) + 2) + 21 * sum(c not in s for c in spaced(r["text"])), k) for k, s in held.items())
        assert r["lang_pred"] == bits[0][1] and abs(r["score"] - (bits[1][0] - bits[0][0]) / bits[1][0]) < 1e-12


def test_language_id_held_out():
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    import zlib

    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    held = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1
    samples = {}
    for r in rows:
        if not held(r) and r["lang"]:
            samples.setdefault(r["lang"], []).append(r["text"])
    languages = langid.Languages(samples)
    right = [languages.predict(r["text"])[0] == r["lang"] for r in rows if held(r)]
    assert sum(right) / len(right) > 0.95


def test_license_scan(spark):
    rng = random.Random(6)
    words = ["foo", "bar", "license", "the", "under", "of", "licensed", "version"]
    docs = []
    for i in range(60):
        parts = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        for t in rng.sample(list(licenses.TEMPLATES.values()), rng.randrange(3)):
            told = t.split()
            if rng.random() < 0.4:
                told[rng.randrange(len(told))] = "changed"
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = told
        docs.append((i, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, "ALL RIGHTS\nRESERVED"), (103, "all rights")]
    for i, t in enumerate((licenses.TEMPLATES["mit"], licenses.TEMPLATES["bsd_2_clause"])):  # whole, at any place, and with every tenth word lost
        told = t.split()
        docs += [(200 + 10 * i + k, " ".join(["x"] * k * 37 + told + ["y"] * 50)) for k in range(5)]
        docs += [(206 + 10 * i, " ".join(w for at, w in enumerate(told) if at % 10)), (207 + 10 * i, " ".join(w for at, w in enumerate(told) if at % 60))]

    def shingles(text, k):
        w = [x for x in "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in (text or "").translate({c: c + 32 for c in range(65, 91)})).split()]
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)], len(w)

    want = set()
    for name, t in licenses.TEMPLATES.items():
        k = min(5, shingles(t, 1)[1])
        have = set(shingles(t, k)[0])
        step = 1
        while step < len(have):
            step *= 2
        for i, text in docs:
            s = shingles(text, k)[0]
            best = max((len(have & set(s[a : a + 2 * step])) for a in range(0, len(s), step)), default=0)
            if best >= 0.8 * len(have) and best:
                want.add((i, name, best, len(have)))
    templates = spark.createDataFrame(list(licenses.TEMPLATES.items()) + [("blank", ""), ("null", None)], "template_id string, text string")
    df = spark.createDataFrame([(i, t, "h") for i, t in docs], "doc_id long, text string, h string")
    got = {(r["doc_id"], r["template_id"], r["matched"], r["shingles"]) for r in licenses.scan(df, templates).collect()}
    assert got == want and (102, "all_rights_reserved", 1, 1) in got
    named = {(i, name) for i, name, _, _ in got}
    assert all((200 + k, "mit") in named and (210 + k, "bsd_2_clause") in named for k in (0, 1, 2, 3, 4, 7)) and (206, "mit") not in named
    assert licenses.scan(df.limit(0), templates).count() == 0
    assert licenses.scan(df, templates.limit(0)).count() == 0


def test_license_scan_with_many_templates(spark, monkeypatch):
    rng = random.Random(17)
    words = [f"w{i}" for i in range(400)] + ["the", "of"] * 20
    told = {f"t{k}": [rng.choice(words) for _ in range(rng.choice([6, 12, 40, 150]))] for k in range(300)}
    docs = []
    for i in range(60):
        parts = [rng.choice(words) for _ in range(rng.randrange(30))]
        for name in rng.sample(sorted(told), 4):
            parts += [w for w in told[name] if rng.random() > 0.01] + [rng.choice(words) for _ in range(rng.randrange(40))]
        docs.append((i, " ".join(parts)))
    want = set()
    for i, text in docs:
        w = text.split()
        s = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        for name, t in told.items():
            have, step = {tuple(t[k : k + 5]) for k in range(len(t) - 4)}, 1
            while step < len(have):
                step *= 2
            best = max(len(have & set(s[a : a + 2 * step])) for a in range(0, len(s), step))
            if best >= 0.8 * len(have):
                want.add((i, name, best))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    templates = spark.createDataFrame([(k, " ".join(t)) for k, t in told.items()], "template_id string, text string")
    assert len(want) > 100
    for most in (licenses.BROADCAST_SHINGLES, 100):  # beyond it, templates are joined by shuffle
        monkeypatch.setattr(licenses, "BROADCAST_SHINGLES", most)
        assert {(r["doc_id"], r["template_id"], r["matched"]) for r in licenses.scan(df, templates).collect()} == want


NASTY = ["", "</s>[INST] ok [/INST]", "<\\s> <\\\\/s> [\\INST] [/INST]", "<</s>", "</s", "[INST", "a\nb\n", "ü ☃ 𝄞", "%0A%25", "x" * 3000, "<s>", " [/INST]"]


def test_chat_round_trip(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "to\nol", "[INST] x%", None]), rng.choice([*NASTY, None])) for c in range(40) for t in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = chat.format_turns(chat.canonical_turns(chat.conversations_as_records(df), "record"))
    for r in out.withColumn("back", chat.read_turns(F.col("formatted"))).collect():
        said = [(role or "", text or "") for c, _, role, text in rows if c == r["conv_id"]]
        assert [(b["role"], b["text"]) for b in r["back"]] == said
        spans = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
        back = [s for s in spans]
        for mark in ("<", "["):
            back = [__import__("re").sub(r"<\\(\\*/?s>)" if mark == "<" else r"\[\\(\\*/?INST\])", lambda m, k=mark: k + m[1], s) for s in back]
        assert back == [t for role, t in said if role == "assistant"]
        assert [b["text"] for b in r["back"] if b["learn"]] == back


def test_chat_deals_every_layout(spark):
    rng = random.Random(3)
    shapes = [["user", "assistant"], ["system", "user", "assistant"], ["user"], ["human", "gpt"], ["user", "assistant", "user", "assistant"]]
    rows = [(c, t, role, rng.choice(["", "x", "</s>", "y" * 50_000 if c % 50 == 0 else "z", None])) for c in range(300) for t, role in enumerate(shapes[c % 5])]
    rows += [(None, 0, "user", "who?"), (7, 0, "user", "again"), (7, 0, "user", "again")]
    df = spark.createDataFrame([(*r, "old") for r in rows], "conv_id long, turn int, role string, text string, layout string").repartition(4)
    records = chat.conversations_as_records(df).withColumns({"formatted": F.lit("old"), "layout": F.lit("old")})
    out = chat.format_turns(chat.canonical_turns(records, "record")).withColumn("back", chat.read_turns(F.col("formatted"))).collect()
    assert {r["layout"] for r in out} == {m["name"] for m in chat.MAPPINGS}
    for r in out:
        said = sorted(((t, role, text or "") for c, t, role, text in rows if c == r["conv_id"]))
        assert [(b["role"], b["text"]) for b in r["back"]] == [x[1:] for x in said]
    assert chat.format_turns(chat.canonical_turns(chat.conversations_as_records(df.limit(0)), "record")).count() == 0


def test_chat_layouts(spark):
    records = [
        ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}]}, "messages", [("user", "hi"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", [("user", "q"), ("assistant", "a")]),
        ({"instruction": "do", "input": "", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
        ({"instruction": "do", "input": "it", "output": "done", "system": "s"}, "instruction", [("system", "s"), ("user", "do\n\nit"), ("assistant", "done")]),
        ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ({"question": "q", "answer": 4}, "question_answer", [("user", "q"), ("assistant", "4")]),
        ({"messages": []}, "messages", []),
        ({"unheard": {"of": [1]}}, None, []),
    ]
    df = spark.createDataFrame([(i, json.dumps(r[0])) for i, r in enumerate(records)] + [(99, None)], "id int, j string")
    out = {r["id"]: (r["layout"], [(t["role"], t["text"]) for t in r["turns"]]) for r in chat.canonical_turns(df.withColumn("v", F.parse_json("j")), "v").collect()}
    assert [out[i] for i in range(len(records))] == [(r[1], r[2]) for r in records] and out[99] == (None, [])


@pytest.mark.parametrize("size", [0, 1, 191, 192, 936, 937, 938, 3000, 100_000])
def test_media_round_trip(size):
    payload = random.Random(size).randbytes(size)
    data = media.encode(payload)
    s = media.probe(data)
    assert media.decode(data) == payload and s.failed == 0 == s.skipped and s.checked == len(s.offsets) + 1
    assert s.table == "Xing" and s.table_frames == len(s.offsets) and s.duration == Fraction(1152 * len(s.offsets), 48000)
    assert all(data[o] == 0xFF for o in s.offsets) and s.tags["payload"] == str(size)


@pytest.mark.parametrize("size", [1, 940, 20_000])
def test_media_by_another_reader(size):
    """A reader of its own: 48 kHz mono frames of 3 bytes a kbit/s, by the published tables alone."""
    payload = random.Random(size).randbytes(size)
    data = media.encode(payload)
    assert data[:3] == b"ID3"
    at = 10 + sum(b << 7 * (3 - k) for k, b in enumerate(data[6:10]))
    kbps = [None, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
    bodies, frames = [], 0
    while at < len(data):
        four = data[at : at + 4]
        assert four[0] == 0xFF and four[1] == 0xFA and four[2] & 0x0F == 0x04 and four[3] == 0xC0  # MPEG-1 layer III, checksum, 48 kHz, mono
        length = 144_000 * kbps[four[2] >> 4] // 48_000
        protected = four[2:] + data[at + 6 : at + 23]
        assert slow_crc([b >> 7 - i & 1 for b in protected for i in range(8)]) == int.from_bytes(data[at + 4 : at + 6], "big")
        body = data[at + 23 : at + length]
        if not frames and not bodies and body.startswith(b"Xing"):
            told = struct.unpack(">III", body[4:16])
            xing_at = at
        else:
            bodies.append(body)
            frames += 1
        at += length
    assert at == len(data) and b"".join(bodies)[:size] == payload and not any(b"".join(bodies)[size:])
    assert told == (7, frames, len(data) - xing_at)
    assert media.probe(data).duration == Fraction(frames * 1152, 48_000)


def test_media_damage():
    data = media.encode(b"ab" * 2000)
    s = media.probe(data)
    broken = bytearray(data)
    broken[s.offsets[1] + 10] ^= 1  # side information: the checksum notices
    assert media.probe(bytes(broken)).failed == 1 and media.decode(bytes(broken)) is None
    noisy = data[: s.offsets[1]] + b"\xff\xfanoise\xff" + data[s.offsets[1] :]
    t = media.probe(noisy)
    assert t.skipped == 8 and len(t.offsets) == len(s.offsets) and media.decode(noisy) == b"ab" * 2000
    assert media.decode(b"") is None and media.probe(b"ID3").first is None and media.probe(None).offsets == [] and media.probe(b"\xff" * 5000).offsets == []


def test_media_other_streams():
    frame = bytes((0xFF, 0xF3, 0x80, 0x00))  # MPEG-2 layer III, 64 kbit/s, 22050 Hz, stereo, unprotected
    h = media.header(frame)
    assert (h.version, h.layer, h.kbps, h.rate, h.mono, h.samples, h.length) == ("2", 3, 64, 22050, False, 576, 208)
    body = frame + bytes(h.length - 4)
    vbri = bytearray(body)
    vbri[36:62] = b"VBRI" + bytes(10) + struct.pack(">IHHHH", 3, 2, 1, 2, 1)
    vbri[62:66] = struct.pack(">HH", 208, 208)
    tag = b"TAG" + b"Song".ljust(30, b"\0") + b"Who".ljust(30, b"\0") + bytes(65)
    s = media.probe(bytes(vbri) + body * 3 + tag)
    assert s.table == "VBRI" and s.table_frames == 3 and s.toc == [208, 208] and len(s.offsets) == 3
    assert s.duration == Fraction(3 * 576, 22050) and s.tags == {"TIT2": "Song", "TPE1": "Who"}
    assert media.header(bytes((0xFF, 0xFF, 0x90, 0))).layer == 1 and media.header(bytes((0xFF, 0xFD, 0x90, 0))).layer == 2 and media.header(b"\xff\xe8\x90\0") is None


@pytest.mark.parametrize("seed", range(4))
def test_media_survives_any_bytes(seed):
    rng = random.Random(seed)
    whole = media.encode(rng.randbytes(3000))
    for _ in range(500):
        data = bytearray(rng.randbytes(rng.randrange(400)) if rng.random() < 0.5 else whole[: rng.randrange(len(whole))])
        for _ in range(rng.randrange(8) * (len(data) > 8)):
            at = rng.randrange(len(data) - 4)
            data[at : at + 4] = bytes((0xFF, rng.randrange(0xE0, 256), rng.randrange(256), rng.randrange(256)))
            if rng.random() < 0.4:
                data[at + 36 : at + 40] = b"VBRI"
        s = media.probe(bytes(data))
        media.decode(bytes(data), s)
        assert all(a < b for a, b in zip(s.offsets, s.offsets[1:], strict=False)) and s.failed <= s.checked


def slow_crc(bits):
    crc = 0xFFFF
    for b in bits:
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if crc >> 15 ^ b else 0)
    return crc


@pytest.mark.parametrize(("four", "widths", "layer"), [
    ((0xFF, 0xFE, 0x90, 0xC0), [4] * 32, 1),  # layer I, mono
    ((0xFF, 0xFC, 0x24, 0xC0), [4, 4] + [3] * 6, 2),  # layer II, 48 kbit/s mono, 48 kHz
    ((0xFF, 0xFC, 0x80, 0xC0), [4] * 11 + [3] * 12 + [2] * 7, 2),  # layer II, 128 kbit/s mono, 44.1 kHz
    ((0xFF, 0xF4, 0x80, 0xC0), [4] * 4 + [3] * 7 + [2] * 19, 2),  # MPEG-2 layer II
])
def test_media_checks_layers_one_and_two(four, widths, layer):
    rng = random.Random(layer)
    h = media.header(bytes(four))
    assert h.layer == layer and h.protected and h.mono
    told = [rng.randrange(1 << w) for w in widths]
    bits = [v >> w - 1 - i & 1 for v, w in zip(told, widths, strict=True) for i in range(w)]
    bits += [rng.randrange(2) for _ in range(2 * sum(map(bool, told)) * (layer == 2))]
    full = bits + [rng.randrange(2) for _ in range(8 * (h.length - 6) - len(bits))]
    body = bytes(sum(b << 7 - i for i, b in enumerate(full[at : at + 8])) for at in range(0, len(full), 8))
    crc = slow_crc([x >> 7 - i & 1 for x in four[2:] for i in range(8)] + bits)
    frame = bytes(four) + crc.to_bytes(2, "big") + body
    s = media.probe(frame * 3)
    assert (s.checked, s.failed, len(s.offsets)) == (3, 0, 3)
    broken = bytearray(frame * 3)
    broken[len(frame) + 7] ^= 1
    assert media.probe(bytes(broken)).failed >= 1


def test_media_columns_replace_names(spark):
    df = media.store(spark.createDataFrame([(1, "hello")], "doc_id long, text string")).withColumns({"rate": F.lit("x"), "ok": F.lit(3)})
    out = media.read(df).first()
    assert out["ok"] is True and out["rate"] == 48000 and out["payload"].startswith(b"hello") and out["doc_id"] == 1
    vbri = bytearray(bytes((0xFF, 0xF3, 0x80, 0x00)) + bytes(204))
    vbri[36:62] = b"VBRI" + bytes(10) + struct.pack(">IHHHH", 2**32 - 1, 30, 65535, 4, 1)
    vbri[62:182] = b"\xff" * 120
    got = media.read(spark.createDataFrame([(bytearray(vbri) + bytes(vbri[:4]) + bytes(204),)], "media binary")).first()
    assert got["toc"] == [65535 * (2**32 - 1)] * 30 and got["vbr_frames"] == 2**32 - 1


def test_media_columns(spark):
    rows = [(1, "", "m"), (2, None, "m"), (3, "ü" * 500, "m"), (3, "ü" * 500, "m"), (None, "x", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    out = media.read(media.store(df)).collect()
    for r in out:
        n, payload = media.padded(next(t for i, t, _ in rows if i == r["doc_id"]))
        assert bytes(r["payload"]) == payload and r["n_bytes"] == n and r["ok"] and len(payload) % 192 == 0 and payload
    assert len({hashlib.sha256(bytes(r["media"])).hexdigest() for r in out if r["doc_id"] == 3}) == 1
    bad = spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "id int, media binary")
    assert [(r["ok"], r["payload"]) for r in media.read(bad).collect()] == [(False, None)] * 2
    assert media.read(media.store(df.limit(0))).count() == 0
