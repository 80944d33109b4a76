"""Each operator against a brute-force version on small fixtures with the awkward cases."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from vetlake.llm import graph, license_join, mixing, packing, posting_lists, quality_llr, sharding, simhash_bk, suffix_dedup, token_attribution, toxicity_kn

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string"
RND = random.Random(5)
WORDS = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("an", "el", "ir", "os", "um", "é", "ei")]


def prose(n: int, rnd: random.Random = RND) -> str:
    out = []
    for i in range(n):
        out.append(rnd.choice(WORDS) + rnd.choice(["", "", "", "", ", ", ".\n", " "]).rstrip(" "))
    return " ".join(out)


def awkward_rows() -> list[tuple]:
    passage = prose(60)
    base = [prose(RND.randint(3, 120)) for _ in range(40)]
    texts = [*base, base[0], base[0], base[1] + " zz", "qq " + passage + " " + base[2], base[3] + " " + passage, None, "", " \n ", "a", "ab " * 300, passage[10:], prose(3000)]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, base[5], None, None, None, None, None), (None, None, None, None, None, None, None), (7, base[6], "en", "s1", None, None, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    out = [(i, 1 if i % 4 else 0, 1 if i % 9 == 0 else 0) for i in ids if i % 3]
    return spark.createDataFrame([*out, (None, 1, 1), (8, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")


def bag(rows) -> Counter:
    return Counter(tuple(r) for r in rows)


# ---- token counts


def test_token_counts(docs, rows):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sizes = token_attribution.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)

    def want(text, rule):
        text = text or ""
        starts = [0, *[i + 1 for i, c in enumerate(text) if c == "\n" or c == " " and i and text[i - 1] in ".!?"]]
        section = [sum(s <= i for s in starts) - 1 for i in range(len(text))]
        owner = [i for i, c in enumerate(text) for _ in c.encode()]
        raw, at, n, crossing = text.encode(), 0, [0.0] * len(starts), [0] * len(starts)
        for size in sizes.token_bytes(np.array(t.encode(text, add_special_tokens=False).ids, np.int64)).tolist():
            own = [section[owner[k]] for k in range(at, at + size) if raw[k] & 0xC0 != 0x80] or [section[owner[at]]]
            at += size
            if rule == "majority":
                n[max(sorted(set(own)), key=own.count)] += 1
            elif rule == "start":
                n[own[0]] += 1
            else:
                for s in own:
                    n[s] += 1 / len(own)
            if len(set(own)) > 1:
                for s in set(own):
                    crossing[s] += 1
        ends = [*starts[1:], len(text)]
        return [(k, starts[k], ends[k] - starts[k], round(n[k], 6), crossing[k]) for k in range(len(starts))]

    small = [r for r in rows if len(r[1] or "") < 2000]
    for rule in token_attribution.RULES:
        got = token_attribution.count_tokens(docs.where("coalesce(length(text), 0) < 2000"), rule).collect()
        assert bag((r[0], r[1], r[2], r[3], round(r[4], 6), r[5]) for r in got) == bag((d[0], *x) for d in small for x in want(d[1], rule))


@pytest.mark.parametrize("rule", token_attribution.RULES)
def test_token_counts_empty_and_long(spark, nothing, rule):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    assert token_attribution.count_tokens(nothing, rule).count() == 0
    long = prose(40_000) + "\n" + "x" * 50_000 + " é" * 20_000
    got = token_attribution.count_tokens(spark.createDataFrame([(1, long), (2, "")], "doc_id long, text string"), rule).where("doc_id = 1").collect()
    assert sum(r["n_tokens"] for r in got) == pytest.approx(len(t.encode(long, add_special_tokens=False).ids))


def test_token_spans_cross_sections():
    first, last = np.array([0, 3, 5]), np.array([2, 4, 9])
    starts = np.array([0, 4, 6, 8])
    assert token_attribution.attribute(first, last, starts)[0].tolist() == [2, 0, 1, 0]
    assert token_attribution.attribute(first, last, starts, "start")[0].tolist() == [2, 1, 0, 0]
    assert token_attribution.attribute(first, last, starts, "split")[0].tolist() == pytest.approx([1.5, 0.7, 0.4, 0.4])


def test_long_blank_runs_keep_their_tokens():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    e = token_attribution.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for text in ("a" + " " * 3000 + "b", "\n" * 2500, "x" + "\t" * 2100 + " y " + " " * 2200):
        assert e.ids(text).tolist() == t.encode(text, add_special_tokens=False).ids
    assert len(e.ids(" " * 400_000 + "end")) > 0


# ---- license scans


def test_license_scan(spark, docs, rows):
    notices = [*license_join.NOTICES, ("own", "ban bel bir")]
    extra = ["Licensed under the Apache License, Version 2.0. apache license", "GNU General-Public License! the MIT license cc by", "apache licence cc\nBY", "released under THE mit  license", "all of the rights were reserved", "x " * 50 + "this work is licensed under the gnu general public license version 3"]
    data = [*rows, *[(100 + i, t, None, None, None, None, None) for i, t in enumerate(extra)]]

    def told(words, first, stride, notice):
        own = [None, *notice.split(), None]
        for w in {x for x in own if x in license_join.TELLING}:
            near = {(own[i - 1], own[i + 1]) for i, x in enumerate(own) if x == w}
            places = [i for i in range(first, min(len(words), first + 2 * stride)) if words[i] == w]
            if not any((i and words[i - 1] == b and b) or (i + 1 < len(words) and words[i + 1] == a and a) for i in places for b, a in near):
                return False
        return True

    def want(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = [(i, label) for p, label in license_join.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        blocks = []
        for label, n in notices:
            stride = next(32 << k for k in range(20) if len(n.split()) <= 32 << k)
            for k in range(0, len(words), stride):
                share = Fraction(len(set(n.split()) & set(words[k : k + 2 * stride])), len(set(n.split())))
                if share >= Fraction(4, 5) and told(words, k, stride, n):
                    blocks.append((k, label, share))
        own = {x[1] for x in places}
        score = 1.0 if places else float(max((b[2] for b in blocks), default=0))
        return (len(words), len(places), min((p[0] for p in places), default=None), max((p[0] for p in places), default=None), ",".join(sorted(own)), ",".join(sorted(own | {b[1] for b in blocks})), round(score, 9), len(blocks))

    extra += [text.upper() for _, text in license_join.NOTICES] + [text.replace(" the ", " ") + " mit sa nc apache" for _, text in license_join.NOTICES]
    extra += ["word " * 40 + license_join.NOTICES[-1][1] + " word" * 300 + license_join.NOTICES[-3][1]]
    data = [*rows, *[(100 + i, t, None, None, None, None, None) for i, t in enumerate(extra)]]
    got = license_join.scan_licenses(spark.createDataFrame(data, SCHEMA), notices).collect()
    assert bag((*r[:7], round(r[7], 9), len(r[8])) for r in got) == bag((d[0], *want(d[1])) for d in data)


def test_license_scan_empty_and_long(spark, nothing):
    assert license_join.scan_licenses(nothing).collect() == []
    long = "word " * 400_000 + "Licensed under CC BY-NC 4.0."
    r = license_join.scan_licenses(spark.createDataFrame([(1, long, None, None, None, None, None)], SCHEMA)).first()
    assert (r["n_words"], r["first_word"], r["labels"]) == (400_007, 400_002, "cc-by,cc-by-nc")


def test_notices_of_the_given_documents(spark):
    """One label of its own kind for every notice in the wording of the documents, in any company of words."""
    notices = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc", "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache",
    }
    data = [(i, f"sa mit {before} {text} nd sa apache", None, None, None, None, None) for i, (text, before) in enumerate((t, b) for t in notices for b in ("", "a b " * 20))]
    got = {r["doc_id"]: r["labels"] for r in license_join.scan_licenses(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {i: label for i, label in enumerate(x for x in notices.values() for _ in range(2))}


def test_license_scan_whole_texts(spark):
    """A template longer than a stride is met wherever it stands, also when it has lost some words."""
    body = " ".join(f"clause{i}" for i in range(150))
    data = [(i, "x " * before + body.replace("clause7 ", ""), None, None, None, None, None) for i, before in enumerate((0, 1, 31, 200, 255, 511))]
    data.append((9, " ".join(body.split()[:100]), None, None, None, None, None))
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in license_join.scan_licenses(spark.createDataFrame(data, SCHEMA), [*license_join.NOTICES, ("whole", body)]).collect()}
    assert got == {i: ("whole", round(149 / 150, 9)) for i in range(6)} | {9: ("", 0.0)}


def test_license_scan_siblings(spark):
    header = "this {} is free software you can redistribute it and or modify it under the terms of the gnu {} public license as published by the free software foundation"
    cases = [
        ("licensed under cc by 4 0", {"cc-by"}), ("licensed under cc by sa 4 0", {"cc-by", "cc-by-sa"}), ("licensed under cc by nc 4 0", {"cc-by", "cc-by-nc"}),
        ("released under the apache license", {"apache"}), ("released under the bsd license", set()), ("released under the mit license", {"mit"}),
        (header.format("program", "general"), {"gpl"}), (header.format("library", "lesser general"), {"lgpl"}), ("licensed under the mozilla public license version 2 0", set()),
    ]
    data = [(i, text, None, None, None, None, None) for i, (text, _) in enumerate(cases)]
    got = {r["doc_id"]: set(r["labels"].split(",")) - {""} for r in license_join.scan_licenses(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {i: labels for i, (_, labels) in enumerate(cases)}


# ---- mixing


def fill(sizes, weights):
    """Targets by repeated resharing."""
    target, free, total = {k: 0.0 for k in sizes}, set(sizes), float(sum(sizes.values()))
    while free:
        level = total / sum(weights[k] for k in free)
        full = {k for k in free if 3 * sizes[k] <= level * weights[k] + 1e-12}
        if not full:
            return target | {k: level * weights[k] for k in free}
        for k in full:
            target[k] = 3.0 * sizes[k]
            total -= target[k]
        free -= full
    return target


def test_mixing(docs, rows, nothing):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    got = mixing.mix_plan(docs).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in rows if r[0] is not None and r[0] != 7 and r[0] != 4}
    for g in got:
        if g["doc_id"] in by_id:
            r = by_id[g["doc_id"]]
            rate = target[r[3]] / sizes[r[3]]
            assert (g["size"], g["source_size"]) == (size(r[1]), sizes[r[3]])
            assert g["target"] == pytest.approx(target[r[3]])
            assert math.floor(rate) * g["size"] <= g["taken"] <= min(3, math.floor(rate) + 1) * g["size"]
    assert bag(got) == bag(mixing.mix_plan(docs.repartition(5)).collect())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(g["copies"] for g in got)
    assert mixing.mix_plan(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_mixing_comes_near_its_targets(spark):
    big = spark.range(4000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 37 AS int)) AS text", "concat('s', case when id % 3 = 0 then 0 else id % 11 end) AS source")
    got = mixing.mix_plan(big).join(big.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()
    assert all(abs(r["t"] - r["w"]) <= 0.12 * r["w"] + 40 for r in got)


# ---- suffix-array dedup


def brute_removed(texts, width=200):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(c for c, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), sum(1 for i in range(len(r)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest(), gone))
    return out


def test_suffix_dedup(spark, docs, rows, nothing):
    got = suffix_dedup.measure(docs).collect()
    assert bag(got) == bag((r[0], *w[:4]) for r, w in zip(rows, brute_removed([r[1] for r in rows])))
    assert suffix_dedup.measure(nothing).count() == 0 and suffix_dedup.cut_documents(nothing).count() == 0


def test_suffix_dedup_overfull_anchor(spark):
    # one passage in many contexts: its edge anchors exceed a small limit and are dealt window by window
    passage = prose(80)
    texts = [prose(12) + " " + passage + " " + prose(12) for _ in range(40)] + ["ab" * 400, "xyz" * 300 + passage]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = brute_removed(texts)
    keys = docs.select("doc_id", *suffix_dedup.text_key(F.col("text")))
    got = {r["doc_id"]: suffix_dedup._merged(r["spans"]) for r in keys.join(suffix_dedup.repeated_spans(docs, limit=3000), ["k1", "k2"], "left").collect()}
    for i, w in enumerate(whole):
        gone = bytearray(w[0])
        for a, b in got[i]:
            gone[a:b] = b"\1" * (b - a)
        assert gone == w[4]


@pytest.mark.parametrize("limit", [suffix_dedup.BLOCK, 2500])
def test_suffix_dedup_many_copies(spark, limit):
    # copies of one text are most of the table, and others share a passage with it, with or without room in a block
    passage = prose(70)
    hot = prose(30) + " " + passage + " " + prose(30)
    texts = [hot] * 120 + [prose(15) + " " + passage + " " + prose(15) for _ in range(25)] + [prose(40), None, "", "short", "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    whole = brute_removed(texts)
    keys = docs.select("doc_id", *suffix_dedup.text_key(F.coalesce("text", F.lit(""))))
    got = {r["doc_id"]: suffix_dedup._merged(r["spans"]) for r in keys.join(suffix_dedup.repeated_spans(docs, limit), ["k1", "k2"], "left").collect()}
    for i, w in enumerate(whole):
        gone = bytearray(w[0])
        for a, b in got[i]:
            gone[a:b] = b"\1" * (b - a)
        assert gone == w[4], i
    assert got[0] == [(0, len(hot.encode()))]


def test_cut_documents_keeps_characters_whole(spark):
    tail = "é" * 150
    rows = [(1, "xéa" + tail, "k", 3), (2, "yèa" + tail, "k", 3), (3, None, "n", None)]
    out = {r["doc_id"]: r for r in suffix_dedup.cut_documents(spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars long")).collect()}
    assert (out[1]["text"], out[2]["text"], out[3]["text"]) == ("xé", "yè", None)
    assert (out[1]["n_chars"], out[3]["n_chars"], out[1]["spans"]) == (2, None, "k")


def test_cut_documents_longer_than_a_batch(spark):
    shared = "".join(random.Random(3).choices("abcdefgh ", k=400))
    rows = [(i, chr(65 + i % 26) * (1 + i % 7) + (shared if i % 3 == 0 else "") + f"{i}") for i in range(1300)]
    out = {r["doc_id"]: r["text"] for r in suffix_dedup.cut_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    gone = [x[4] for x in brute_removed([t for _, t in rows])]
    assert out == {i: "".join(c for c, g in zip(t, gone[i]) if not g) for i, t in rows}


def test_block_search_memory():
    import tracemalloc

    parts = [bytes(random.Random(i).choices(b"abcdefgh ", k=300)) for i in range(3000)]
    tracemalloc.start()
    suffix_dedup.repeated_windows(parts, [1] * len(parts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * 301 * len(parts)  # 79 bytes a byte with 64-bit places


def test_keys_do_not_fill_a_block_twice(spark, monkeypatch):
    # two keys, each near the limit, are two blocks; a key is never in two
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3000)
    sizes = []
    monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda parts, weights: (sizes.append(sum(map(len, parts)) + len(parts)), *[np.zeros(0, int)] * 3)[1:])
    captured = {}

    class Dealt:
        repartition = sortWithinPartitions = lambda self, *a: self

        def mapInArrow(self, f, schema):
            captured["f"] = f

    suffix_dedup._searched(Dealt(), 3000)
    rows = [(key, key, n, 1, bytes([97 + n]) * 250) for key in range(6) for n in range(11)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["key", "anchor", "seg", "weight", "part"])
    told = [x for b in captured["f"](iter([batch])) for x in b.to_pylist()]
    assert not told and sizes == [11 * 251] * 6


@pytest.mark.parametrize("seed", range(4))
def test_interval_expansion(seed):
    rnd = random.Random(seed)
    for _ in range(40):
        width = rnd.choice([4, 5, 9])
        parts = list({bytes(rnd.choice(b"aab") if rnd.random() < 0.9 else rnd.choice(b"cd") for _ in range(rnd.randint(0, 60))) for _ in range(rnd.randint(1, 8))})
        weights = [rnd.choice([1, 1, 2]) for _ in parts]
        seen = Counter()
        for p, w in zip(parts, weights):
            for i in range(len(p) - width + 1):
                seen[p[i : i + width]] += w
        want = {(k, i) for k, p in enumerate(parts) for i in range(len(p) - width + 1) if seen[p[i : i + width]] >= 2}
        assert {(int(k), i) for k, a, b in zip(*suffix_dedup.repeated_windows(parts, weights, width)) for i in range(a, b + 1)} == want


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abcdefgh ", bytes(range(250))])
def test_interval_expansion_beyond_the_first_key(letters):
    rnd = random.Random(len(letters))
    for width in (1, 2, 30, 64, 100):
        base = bytes(rnd.choices(letters, k=300))
        cuts = [sorted(rnd.choices(range(301), k=2)) for _ in range(14)]
        parts = list({base[a:b] + bytes(rnd.choices(letters, k=rnd.randint(0, 20))) for a, b in cuts} | {b"", base[:90] * 2})
        weights = [rnd.choice([1, 1, 2]) for _ in parts]
        seen = Counter()
        for p, w in zip(parts, weights):
            for i in range(len(p) - width + 1):
                seen[p[i : i + width]] += w
        want = {(k, i) for k, p in enumerate(parts) for i in range(len(p) - width + 1) if seen[p[i : i + width]] >= 2}
        assert {(int(k), i) for k, a, b in zip(*suffix_dedup.repeated_windows(parts, weights, width)) for i in range(a, b + 1)} == want


def test_block_search_time():
    # told in sorts of as many places, which take this machine's speed out: some 13 when all suffixes were sorted each round
    def took(f, *x):
        t = time.process_time()
        f(*x)
        return time.process_time() - t

    rnd = random.Random(7)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rnd.choices(words, k=45)).encode() for _ in range(3500)]
    parts = list({t[:300] for t in texts} | {t[20:240] + b"." for t in texts[::5]})
    places = np.random.default_rng(1).integers(0, 1 << 62, sum(map(len, parts)) + len(parts))
    assert min(took(suffix_dedup.repeated_windows, parts, [1] * len(parts)) for _ in range(3)) < 9 * min(took(np.argsort, places) for _ in range(3))


# ---- sharding


@pytest.mark.parametrize("bits", [3, 15])
def test_sharding(docs, rows, nothing, bits):
    limit = 4000

    def place(r):
        inner = hashlib.md5((r[1] or "").encode()).hexdigest()
        return f"{int(hashlib.md5(f'{"" if r[0] is None else r[0]}|{inner}'.encode()).hexdigest()[:15], 16):060b}"

    sums = Counter()
    for r in rows:
        for d in range(61):
            sums[place(r)[:d]] += len((r[1] or "").encode())
    want = []
    for r in rows:
        d = next(d for d in range(61) if sums[place(r)[:d]] <= limit or d == 60)
        want.append((r[0], len((r[1] or "").encode()), place(r)[:d], sums[place(r)[:d]], sums[place(r)[:d]] > limit))
    got = sharding.assign_shards(docs, limit, bits).collect()
    assert bag((r["doc_id"], r["n_bytes"], r["shard"], r["shard_bytes"], r["overfull"]) for r in got) == bag(want)
    assert sharding.assign_shards(nothing, limit, bits).count() == 0


def test_written_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), 4000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("__shard").distinct().count() > 3


# ---- quality rules


def brute_quality(rows, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    out = []
    for r in rows:
        t, w = r[1] or "", words(r[1])
        seen, cover = Counter(zip(w, w[1:], w[2:])), set()
        for i, g in enumerate(zip(w, w[1:], w[2:])):
            if seen[g] > 1:
                cover |= {i, i + 1, i + 2}
        lines = [x for x in t.split("\n") if words(x)]
        out.append((r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)))
    return out


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def brute_scores(rows, trusted):
    def features(text):
        h = [signed(xxh64_intdigest(w.encode(), 42)) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        # xxhash64(a, b) hashes b with the hash of a as seed
        pair = lambda a, b: signed(xxh64_intdigest((b & (1 << 64) - 1).to_bytes(8, "little"), xxh64_intdigest((a & (1 << 64) - 1).to_bytes(8, "little"), 42)))
        return [x & quality_llr.BUCKETS - 1 for x in [*h, *map(pair, h, h[1:])]]

    raw, target = Counter(), Counter()
    for r in rows:
        f = features(r[1])
        raw.update(f)
        if trusted.get(r[0]) == 1:
            target.update(f)
    n_raw, n_target = sum(raw.values()) + quality_llr.BUCKETS, sum(target.values())
    weight = lambda b: math.log((target[b] / n_target / ((raw[b] + 1) / n_raw) + 1) / 2) if n_target else 0.0
    return [sum(map(weight, f)) / len(f) if (f := features(r[1])) else 0.0 for r in rows]


def test_quality(docs, rows, labels, nothing):
    got = quality_llr.score_quality(docs, labels).collect()
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    want = brute_quality(rows, labels)
    trusted = {r["__id"]: r["__part"] for r in quality_llr.trusted_sample(labels).collect()}
    assert 8 not in trusted and None not in trusted
    scores = brute_scores(rows, trusted)
    assert bag((*[r[c] for c in names], round(r["score"], 8)) for r in got) == bag((*w, round(s, 8)) for w, s in zip(want, scores))
    cut = quality_llr.THRESHOLD
    held = sorted(s for r, w, s in zip(rows, want, scores) if trusted.get(r[0]) == 0 and w[1] >= 50)
    if held:
        cut = min(cut, float(np.percentile(held, 0.5)) - quality_llr.MARGIN)
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= cut) for r in got if abs(r["score"] - cut) > 1e-9)
    kept = quality_llr.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality_llr.score_quality(nothing, labels).count() == 0
    unlabelled = quality_llr.score_quality(docs, labels.limit(0)).collect()
    assert all(r["score"] == 0 and r["kept"] != r["base_failed"] for r in unlabelled)


def test_quality_takes_every_trusted_row(spark):
    labels = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert quality_llr.trusted_sample(labels).count() == 30_000


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_quality_counts_do_not_depend_on_the_join(spark, docs, rows, labels, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        short = docs.withColumn("doc_id", F.col("doc_id").cast("int"))  # ids of another type than the labels'
        got = quality_llr.score_quality(short, labels).collect()
        trusted = {r["__id"]: r["__part"] for r in quality_llr.trusted_sample(labels).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert bag((r["doc_id"], round(r["score"], 8)) for r in got) == bag((r[0], round(s, 8)) for r, s in zip(rows, brute_scores(rows, trusted)))


def test_quality_percentile(spark):
    rng = np.random.default_rng(4)
    for x in ([0.5], [1.0, 1.0, 2.0], rng.normal(size=3000).tolist(), [*[0.25] * 900, *rng.exponential(1e-9, 400).tolist(), 1e6]):
        df = spark.createDataFrame([(v,) for v in x], "s double").repartition(3)
        for share in (0.005, 0.3, 0.5, 0.9):
            assert abs(quality_llr._percentile(df, share) - np.percentile(x, 100 * share)) < 1e-9 * max(1, abs(np.percentile(x, 100 * share)))
    assert quality_llr._percentile(spark.createDataFrame([], "s double"), 0.5) is None


# ---- nearest neighbours


def test_nearest_equals_brute_force_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 6)).round(2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900 + i, x[3].tolist()) for i in range(60)]
    odd = [(2000, None), (2001, [0.0] * 6), (2002, [1.0, None] + [0.0] * 4), (2003, [float("nan")] + [1.0] * 5), (2004, [float("inf")] + [1.0] * 5), (2005, [1.0, 2.0]), (None, [1.0] * 6), (2006, [])]
    df = spark.createDataFrame([*rows, *odd, rows[5]], "vec_id long, embedding array<double>")
    got = posting_lists.nearest(df, F.col("vec_id") % 20 == 0).collect()
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    hit, n = 0, 0
    for q in ids[ids % 20 == 0].tolist():
        s = (m * m[q]).sum(axis=1)
        s[q] = -np.inf
        order = np.lexsort((ids, -s))[:20]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in mine] == list(range(1, 21))
        assert all(r[2] == pytest.approx(s[r[1]], abs=1e-12) and r[1] != q for r in mine)
        assert mine == sorted(mine, key=lambda r: (-r[2], r[1]))
        hit += len({r[1] for r in mine} & set(ids[order].tolist()))
        n += 20
    assert hit / n >= 0.9
    assert len(got) == n
    few = posting_lists.nearest(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4]
    assert posting_lists.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_embeddings(spark, sf):
    e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = sorted((r["vec_id"], r["embedding"]) for r in e.collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    want = set()
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        want |= {(int(ids[q]), int(ids[j])) for j in np.lexsort((ids, -s))[:20]}
    got = {(r["query_id"], r["vec_id"]) for r in posting_lists.nearest(e, F.col("vec_id") % 20 == 0).collect()}
    print(sf, "recall", len(got & want) / len(want))
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_popular_lists_are_dealt_in_blocks(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(300, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = bag(posting_lists.nearest(df, F.col("vec_id") % 20 == 0).collect())
    monkeypatch.setattr(posting_lists, "BLOCK_ROWS", 5)
    assert bag(posting_lists.nearest(df, F.col("vec_id") % 20 == 0).collect()) == want


# ---- toxicity


def toxic_docs(spark, n=400):
    rnd = random.Random(3)
    rows, marks = [], []
    for i in range(n):
        toxic = rnd.random() < 0.3
        words = [rnd.choice(WORDS) for _ in range(rnd.randint(20, 80))]
        if toxic:
            for _ in range(1 + len(words) // 20):
                words.insert(rnd.randrange(len(words)), rnd.choice(["grozzle", "vrakk" + rnd.choice("abcdef")]))
        rows.append((i, " ".join(words), "x", "clash"))
        marks.append((i, 1, int(toxic)))
    rows += [(None, "ban bel", None, None), (n, None, None, None), (n + 1, "", None, None), rows[3]]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic string, ratio string"), spark.createDataFrame([*marks, (None, 1, 1)], "doc_id long, quality int, toxic int"), rows, {m[0]: m[2] for m in marks}


def brute_ratios(rows, marks, order):
    words = Counter()
    for r in rows:
        if r[0] in marks and zlib.crc32(str(r[0]).encode()) % 5:
            for w in (r[1] or "").lower().split():
                words[marks[r[0]], w] += 1
    grams = [Counter(), Counter()]
    spell = lambda w: [(s[max(0, i - order) : i]) for s in [f"\x02{w}\x03"] for i in range(2, len(s) + 1)]
    for (c, w), n in words.items():
        for g in spell(w):
            grams[c][g] += n
    every = grams[0] + grams[1]
    count = Counter(every)
    longer = {(g[-n:], g[-n - 1 :]) for g in every for n in range(1, order) if len(g) > n}
    for g, _ in longer:
        count[g] += 1
    total, types = Counter(), Counter()
    for g, c in count.items():
        total[g[:-1]] += c
        types[g[:-1]] += 1
    letters = sum(len(g) == 1 for g in count) + 1

    def pooled(g):
        less = pooled(g[1:]) if len(g) > 1 else 1 / letters
        return (max(count[g] - 0.75, 0) + 0.75 * types[g[:-1]] * less) / total[g[:-1]]

    all_, off = [Counter(), Counter()], [Counter(), Counter()]
    for c in (0, 1):
        for g, n in grams[c].items():
            all_[c][g[:-1]] += n
            off[c][g[:-1]] += min(n, toxicity_kn.CLASS_DISCOUNT)
    share = lambda c, h: off[c][h] / all_[c][h] if all_[c][h] else 1.0

    def ratio(g):
        h = g[:-1]
        if g in every:
            p = [(max(grams[c][g] - toxicity_kn.CLASS_DISCOUNT, 0) / all_[c][h] if all_[c][h] else 0) + share(c, h) * pooled(g) for c in (0, 1)]
            return math.log(p[1] / p[0])
        return math.log(share(1, h) / share(0, h))

    def word(w):
        return math.log1p(toxicity_kn.SHARE * math.expm1(min(50.0, sum(map(ratio, spell(w))))))

    return [sum(map(word, w)) / len(w) if (w := (r[1] or "").lower().split()) else 0.0 for r in rows]


def test_toxicity(spark):
    docs, labels, rows, marks = toxic_docs(spark)
    model = toxicity_kn.train(docs, labels)
    want = bag((r[0], round(x, 7)) for r, x in zip(rows, brute_ratios(rows, marks, toxicity_kn.ORDER)))
    for limit in (toxicity_kn.MODEL_ROWS, 0):  # the model sent to the tasks, and joined as a table
        assert bag((r["doc_id"], round(r["ratio"], 7)) for r in toxicity_kn.ratios(docs, model, model_rows=limit).collect()) == want
    got = toxicity_kn.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    held = [(r["predicted"], marks[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in marks]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(p == y for p, y in held) / len(held) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_toxicity_without_labels(spark, docs, labels, nothing):
    got = toxicity_kn.score_toxicity(docs, labels.limit(0)).collect()
    assert {r["predicted"] for r in got} == {0} and {r["ratio"] for r in got} == {0.0}
    assert toxicity_kn.score_toxicity(nothing, labels).count() == 0


# ---- SimHash near-dedup


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 3 else [" ".join(words)] * bool(words)
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(keys, near):
    up = list(range(len(keys)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if near(keys[i], keys[j]):
                up[root(i)] = root(j)
    return [root(i) for i in range(len(keys))]


def test_simhash(docs, rows, nothing):
    fps = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for r, k in zip(rows, roots):
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    want = [(r[0], f"{f:016x}", least.get(k)) for r, f, k in zip(rows, fps, roots)]
    assert bag(simhash_bk.components(docs).collect()) == bag(want)
    kept = simhash_bk.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(least.values())
    assert simhash_bk.components(nothing).count() == 0 and simhash_bk.keep_one(nothing).count() == 0


def test_one_nameless_document_stays(spark):
    rows = [(None, "a b c d e f", "x"), (None, "a b c d e f", "y"), (None, "other words here now again", "z"), (3, "Third text is this one here", "w")]
    kept = simhash_bk.keep_one(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert sorted(r["text"][0] for r in kept) == ["T", "a", "o"]


def test_groups_of_one_name_keep_a_row_each(spark):
    """An id that stands on unrelated texts names both components."""
    one, other = "a b c d e f", "other words here now again"
    rows = [(1, one, "x"), (1, one, "y"), (4, one, "x"), (1, other, "x"), (5, other, "x"), (6, other, "y"), (3, "Third text is this one here", "w")]
    kept = simhash_bk.keep_one(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert sorted((r["doc_id"], r["text"][0]) for r in kept) == [(1, "a"), (1, "o"), (3, "T")]


@pytest.mark.parametrize("limit", [3, 4096])
def test_links_survive_full_shards(spark, limit):
    rnd = random.Random(9)
    centre = rnd.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 6))) for _ in range(60)} | {rnd.getrandbits(64) for _ in range(60)}
    values = sorted(values)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    links = simhash_bk.near_links(frame, limit=limit)
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 4 for r in links.collect())
    got = {r["node"]: r["root"] for r in graph.connected_components(links).collect()}
    groups = {}
    for v, k in zip(values, brute_components(values, lambda a, b: (a ^ b).bit_count() <= 4)):
        groups.setdefault(k, set()).add(v - (1 << 64) if v >> 63 else v)
    for members in groups.values():
        assert len({got.get(v, v) for v in members}) == 1 and (len(members) == 1 or got[min(members)] == min(members))


def test_components_of_a_long_path(spark):
    path = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    assert {r["root"] for r in graph.connected_components(path).collect()} == {0}
    assert graph.connected_components(path.limit(0)).count() == 0


# ---- packing


def test_packing(docs, rows, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    odd = ["<|endoftext|> Hi <|STARTOFTEXT|>", "don't, WON'T!! é, É. ½... 日本,", "x" * 500, "é ́a"]
    extra = docs.sparkSession.createDataFrame([(500 + i, x) for i, x in enumerate(odd)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    want = []
    for d, text in [*[(r[0], r[1]) for r in rows], *[(500 + i, x) for i, x in enumerate(odd)]]:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(d, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    got = packing.pack_documents(both, with_ids=True)
    out = got.collect()
    assert bag((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == bag(want)
    fill_ = {}
    for r in sorted(out, key=lambda r: r["offset"]):
        assert fill_.get(r["sequence_id"], 0) == r["offset"]
        fill_[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill_.values()) <= 2048 and len(fill_) <= math.ceil(sum(fill_.values()) / 2048) + 1
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(got).collect()}
    for r in out:
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert packing.pack_documents(nothing).count() == 0


def test_letters_go_to_their_merges(tmp_path):
    from tokenizers import Tokenizer

    from vetlake.llm import word_tokens

    path = packing.default_tokenizer()
    t, ids = Tokenizer.from_file(path), word_tokens.ChunkIds(path)
    latin = [chr(c) for c in range(0xC0, 0x100)]
    rnd = random.Random(6)
    words = ["".join(rnd.choices([*"abcdefghijklmnopqrstuvwxyzABCXYZ", *latin], k=rnd.randint(1, 16))) for _ in range(2000)]
    words += [a + b for a in ["e", "é", "É", "s"] for b in ["", "́", "'s", "ª", "µ", "·", "×", "÷", "х", "日", "1", "."]] + latin + ["x" * 3000]
    assert all(ids._encode(w.encode()) == np.array(t.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words)
    # other rules, or a token that may stand inside words: as the file says
    spec = json.loads(t.to_str())
    for change in ({"normalizer": None}, {"added_tokens": [{**spec["added_tokens"][0], "content": "ab"}]}):
        (other := tmp_path / "other.json").write_text(json.dumps(spec | change))
        u, odd = Tokenizer.from_file(str(other)), word_tokens.ChunkIds(str(other))
        assert all(odd._encode(w) == np.array(u.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes() for w in (b"cabby", b"ABBA", b"word"))


def test_letters_pass_the_rules_by(monkeypatch):
    from vetlake.llm import word_tokens

    whole = []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def encode(self, chunk, **x):
            whole.append(chunk)
            return self.inner.encode(chunk, **x)

    ids = word_tokens.ChunkIds(packing.default_tokenizer())
    monkeypatch.setattr(ids, "_tokenizer", Counted(ids._tokenizer))
    ids.text("Every word of this sentence goes, école, Éclair; but not 日本 nor 42")
    assert set(whole) == {",", ";", "日本", "42"}


def test_chunks_are_given_back(spark):
    docs = spark.createDataFrame([(i, prose(50)) for i in range(40)], "doc_id long, text string").repartition(4)
    assert packing.pieces(docs).count() >= 40

    def kept(batches):
        from vetlake.llm import word_tokens

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, word_tokens._BY_PATH.values()))], pa.int64())], names=["n"])

    assert {r["n"] for r in docs.mapInArrow(kept, "n long").collect()} == {0}


def test_bounded_bins():
    rnd = random.Random(4)
    for most in (1, 3, 50):
        bins, open_, size = packing.OpenBins(64, most), {}, {}
        for _ in range(3000):
            n = rnd.randint(1, 64)
            number, offset = bins.place(n)
            fits = [f for f in open_.values() if f >= n]
            if fits:
                assert open_[number] == min(fits)
                open_[number] -= n
            else:
                assert offset == 0
                if len(open_) == most and n < 64:
                    del open_[min(open_, key=open_.get)]
                open_[number] = 64 - n
            assert size.get(number, 0) == offset
            size[number] = offset + n
            open_ = {k: f for k, f in open_.items() if f}
            assert bins.n <= most
            if sorted(open_.values()) != sorted(s for s in range(65) for _ in bins.at[s]):
                raise AssertionError("open sequences differ")
            # ties: follow the numbers that the bins hold
            open_ = {k: s for s in range(65) for k in bins.at[s]}
