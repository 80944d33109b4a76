"""Backtracking encoder, ns-bound clustering and target resampling against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vetlake.llm import bpe_backtrack, centroid_ns, target_resample

SCHEMA = "doc_id long, text string, ids string, n_tokens string, weight string, rank string, key string, place string"
RND = random.Random(17)
PIECES = ["the", "naïve", "Straße", "ΣΑΣ", "don't", "we'LL", "12345", "!!??...", "ein", "Ærø", "日本語", "é", "H̱", "T̈x", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>!", "a<|endoftext|>b", "</w>", "　", "\x85", "​", "İI", "ﬁn", "👍🏽", "x" * 40, "ababab" * 9, "où", "ÿß", "÷", "façon,", "straße", "é÷é"]


def texts() -> list[str | None]:
    made = ["".join(RND.choice(PIECES) + RND.choice([" ", "\n", "\t", "", "  "]) for _ in range(RND.randint(0, 60))) for _ in range(150)]
    letters = ["".join(RND.choice("aeinorstéя") for _ in range(RND.randint(1, 50))) for _ in range(150)]
    return [*made, *letters, None, "", " ", " \n\t", "a", "<|endoftext|>", "th" * 60_000, "z" * 70_000, "word " * 30_000, made[0], made[0]]


def rows_of(some) -> list[tuple]:
    out = [(i, t, "clash", "clash", "clash", "clash", "clash", "clash") for i, t in enumerate(some)]
    return [*out, out[3], out[3], (None, "no id here", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


# ---- encoding and decoding


def test_ids_and_texts_are_the_librarys(spark, library):
    rows = rows_of(texts())
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = bpe_backtrack.decode(bpe_backtrack.encode(docs)).collect()
    assert sorted(map(str, bpe_backtrack.round_trip(docs).collect())) == sorted(map(str, got))
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    key = lambda t: (t[0] is None, t[0] or 0, t[2])
    assert sorted(((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in got), key=key) == sorted(want, key=key)


def test_every_token_encodes_to_itself_and_merges_are_exact():
    m = bpe_backtrack.encoder(bpe_backtrack.default_tokenizer()).merges
    assert all(m.encode(s) == [n] for n, s in enumerate(m.spelled))
    single = {s: n for n, s in enumerate(m.spelled) if len(s) == 1}

    def by_rank(symbols: str) -> list[int]:
        now = [single[c] for c in symbols]
        while found := [(m.joined[p], i) for i, p in enumerate(zip(now, now[1:])) if p in m.joined]:
            n, i = min(found)
            now[i : i + 2] = [n]
        return now

    for _ in range(1500):
        word = "".join(RND.choice("aabbeinorstth") for _ in range(RND.randint(1, 30)))
        assert m.encode(m.symbols(word)) == by_rank(m.symbols(word)), word
    for _ in range(1500):  # the table of pairs says what merging two tokens together says
        a, b = RND.randrange(len(m.size)), RND.randrange(len(m.size))
        if any(ord(c) >= bpe_backtrack._LAST for c in m.spelled[a]):
            continue
        assert m.compatible(a, b) == (by_rank(m.spelled[a] + m.spelled[b]) == [a, b])


def test_merge_tables_out_of_order_are_refused():
    with pytest.raises(ValueError):
        bpe_backtrack.Merges({"vocab": {"a": 0, "b": 1, "ab": 2, "abb": 3}, "merges": ["ab b", "a b"]})
    m = bpe_backtrack.Merges({"vocab": {"a": 0, "b": 1, "ab": 2, "abb": 3}, "merges": ["a b", "ab b"]})
    assert [m.spelled[n] for n in m.encode("aabbab")] == ["a", "abb", "ab"]
    with pytest.raises(ValueError):
        m.encode("ac")


def test_decode_skips_unknown_ids_and_nulls(spark, library):
    ids = np.array([320, 4_000_000_000, 49407, 49408, 512], "<u4").tobytes()
    df = spark.createDataFrame([(1, bytearray(ids)), (2, None), (3, bytearray())], "doc_id long, ids binary")
    got = {r["doc_id"]: r["decoded"] for r in bpe_backtrack.decode(df).collect()}
    assert got == {1: library.decode([320, 49407, 512], skip_special_tokens=False), 2: "", 3: ""}


def test_id_rows_and_empty_table(spark, library):
    docs = spark.createDataFrame([(5, "some words here"), (6, None)], "doc_id long, text string")
    rows = sorted((r["position"], r["id"]) for r in bpe_backtrack.id_list(bpe_backtrack.encode(docs)).collect())
    assert [i for _, i in rows] == library.encode("some words here", add_special_tokens=False).ids
    none = spark.createDataFrame([], SCHEMA)
    assert bpe_backtrack.decode(bpe_backtrack.encode(none)).collect() == []


# ---- clustering


def vectors(n: int, dim: int, spread: float) -> list[list[float]]:
    middles = [[RND.uniform(-1, 1) for _ in range(dim)] for _ in range(7)]
    return [[m + RND.gauss(0, spread) for m in RND.choice(middles)] for _ in range(n)]


@pytest.mark.parametrize("dim, k, rounds, spread", [(64, 16, 3, 0.05), (64, 16, 3, 0.6), (4, 5, 9, 0.3), (2, 3, 12, 0.02), (64, 16, 0, 0.2)])
def test_clusters_equal_plain_rounds(spark, dim, k, rounds, spread):
    made = vectors(400, dim, spread)
    rows = [(i * 3, v, "clash", 1) for i, v in enumerate(made)]
    rows += [rows[0]] * 150  # a hot vector, same id
    rows += [(7 + i, list(made[1]), None, None) for i in range(60)]  # ties between ids
    rows += [(None, made[2], None, None), (None, made[3], None, None)]
    bad = [(901, None, "", 0), (902, made[0][:-1], "", 0), (903, [*made[0], 1.0], "", 0), (904, [None, *made[0][1:]], "", 0), (905, [float("nan"), *made[0][1:]], "", 0), (906, [float("-inf"), *made[0][1:]], "", 0), (907, [], "", 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, cluster string, inertia int").repartition(3)
    got = centroid_ns.clusters(df, k=k, rounds=rounds, dim=dim).collect()
    want = centroid_ns.plain_clusters([(r[0], [math.floor(64 * x) for x in r[1]]) for r in rows], k, rounds)
    order = lambda t: (t[0] is None, t[0] or 0, *t[1:])
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=order) == sorted(want["assigned"], key=order)
    for r in got:
        assert r["centroid"] == ",".join(map(str, want["centroids"][r["cluster"]]))
        assert r["cluster_inertia"] == sum(d for _, c, d in want["assigned"] if c == r["cluster"])
        assert r["inertia"] == sum(d for _, _, d in want["assigned"])
    if spread < 0.1 and rounds:
        assert sum(r["evaluated"] for r in got) < 0.5 * k * len(got)  # the bounds save most distances


def test_bound_uses_the_total_displacement():
    # a centroid that left and came back has moved by nothing in total; its bound is as tight as at first
    here, away, other = [0, 0], [50, 0], [100, 0]
    v = np.array([[1, 0]], np.int64)
    h = np.array([[here, other], [here, away], [here, other]], np.int64)
    d, t, own, _ = centroid_ns.assign(v, None, None, None, h[:1])
    d2, t2, own2, done = centroid_ns.assign(v, d, t, own, h)
    assert done.tolist() == [0] and own2.tolist() == [0] and t2.tolist() == [[0, 0]] and d2.tolist() == d.tolist()


def test_few_vectors_empty_table_and_range(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroid_ns.clusters(spark.createDataFrame([], schema)).collect() == []
    assert centroid_ns.clusters(spark.createDataFrame([(1, None)], schema)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "evaluated"]
    few = centroid_ns.clusters(spark.createDataFrame([(1, [0.5, -0.5]), (2, [0.5, -0.5]), (3, [2.0, 1.0])], schema), dim=2).collect()
    assert sorted((r["vec_id"], r["distance"]) for r in few) == [(1, 0), (2, 0), (3, 0)] and len({r["cluster"] for r in few}) == 2
    with pytest.raises(Exception, match="vector component beyond"):
        centroid_ns.clusters(spark.createDataFrame([(1, [3e7, 0.0])], schema), dim=2).collect()


# ---- resampling


def plain_resample(rows, bench, percent=10, least=20, buckets=10_000, grams=(1, 1)):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def found(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(grams[0], grams[1] + 1) for i in range(len(words) - n + 1)]

    of = [found(t) for _, t in rows]
    raw, target = [0] * buckets, [0] * buckets
    for _, f in of:
        for b in f:
            raw[b] += 1
    for t in bench:
        for b in found(t)[1]:
            target[b] += 1
    gain = [math.floor(1000 * math.log((t + 1) * (sum(raw) + buckets) / ((s + 1) * (sum(target) + buckets)))) for s, t in zip(raw, target)]
    out = []
    for (i, _), (n, f) in zip(rows, of):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append((i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2]))
    drawn = able[: percent * len(able) // 100]
    want = [(i, f, w, s, k + 1) for k, (i, _, f, w, s) in enumerate(drawn)]
    rest = able[len(drawn) :] + [x for x in out if x[1] < least]
    return want, [(i, f, w, s, None) for i, _, f, w, s in rest]


def prose(n):
    return " ".join(RND.choice(["Alpha", "beta,", "GAMMA", "delta42", "é", "Ωmega", "zeta—eta", "日本", "x", "y", "q.r"]) for _ in range(n))


@pytest.mark.parametrize("percent, grams, buckets", [(10, (1, 1), 10_000), (37, (1, 2), 500), (100, (1, 1), 50), (0, (1, 1), 50), (50, (2, 3), 10_000)])
def test_resample_equals_plain_version(spark, percent, grams, buckets):
    made = [(i, prose(RND.randint(0, 80))) for i in range(300)]
    made += [made[5]] * 200 + [made[9]] * 30  # repeated rows, across the cutoff at some percentage
    made += [(None, prose(50)), (None, None), (400, None), (401, ""), (402, " .,;"), (403, "WORD " * 20_000), (-4, prose(40)), (2**62, prose(40))]
    bench = [prose(30) for _ in range(5)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "c", "c", "c", "c", "c", "c") for i, t in made], SCHEMA).repartition(4)
    target = spark.createDataFrame([(t,) for t in bench], "text string")
    got = target_resample.resample(docs, target, percent, 20, buckets, grams)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want, rest = plain_resample(made, bench, percent, 20, buckets, grams)
    rows = [tuple(r) for r in got.collect()]
    assert sorted((r for r in rows if r[4] is not None), key=lambda r: r[4]) == want
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    assert sorted((r for r in rows if r[4] is None), key=key) == sorted(rest, key=key)


def test_bisection_meets_every_cutoff(spark):
    values = [RND.choice([-9, -3, 0, 0, 0, 4, 70, 10**12, -(10**15)]) for _ in range(120)]
    df = spark.createDataFrame([(v,) for v in values], "v long").cache()
    for need in (1, 2, 60, 119, 120):
        assert target_resample._bisect(df, "v", need, min(values), max(values), True) == sorted(values, reverse=True)[need - 1]
        assert target_resample._bisect(df, "v", need, min(values), max(values), False) == sorted(values)[need - 1]


def test_all_scores_tied_fall_to_smaller_ids(spark):
    df = spark.createDataFrame([(i, 30, 30, 0, 5) for i in range(100)], "doc_id long, n_words long, n_features long, weight long, score long").repartition(4)
    drawn, rest = target_resample.draw(df, 25)
    assert [(r["doc_id"], r["rank"]) for r in target_resample.ranked(drawn).orderBy("rank").collect()] == [(i, i + 1) for i in range(25)] and rest.count() == 75


def test_resample_empty_tables(spark):
    none, nothing = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert target_resample.resample(none, nothing).collect() == []
    some = spark.createDataFrame([(1, prose(40)), (2, "short")], "doc_id long, text string")
    assert [r["rank"] for r in target_resample.resample(some, nothing, 100).orderBy("doc_id").collect()] == [1, None]
    assert some.select(F.lit(1)).count() == 2
