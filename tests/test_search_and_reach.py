"""Inverted-file search against brute force; reachability by pointer doubling against a plain walk."""

from __future__ import annotations

import random
from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vetlake.operators import cells, flow, similarity
from vetlake.operators.reach import reach

RND = random.Random(3)


def brute(rows, queries, k):
    out = {}
    for qi, q in queries:
        scored = []
        for vi, v in rows:
            if vi == qi:
                continue
            if len(q) != len(v):
                c = -1.0
            else:
                a, b = np.array(q, float), np.array(v, float)
                n = np.linalg.norm(a) * np.linalg.norm(b)
                c = float(a @ b / n) if n else 0.0
            scored.append((-round(c, 9) + 0.0, vi))
        out |= {(qi, r + 1): vi for r, (_, vi) in enumerate(sorted(scored)[:k])}
    return out


def test_search_through_cells_is_exact(spark, monkeypatch):
    monkeypatch.setattr(cells, "VECTOR_BLOCK", 60)
    monkeypatch.setattr(cells, "QUERY_BLOCK", 7)
    middles = [[RND.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [m + RND.gauss(0, 0.2) for m in middles[i % 5 if i % 3 else 0]]) for i in range(400)]
    rows += [(1000 + i, list(rows[0][1])) for i in range(90)]  # a hot vector
    rows += [(2000, [0.0] * 6), (2001, [1.0, 2.0]), (2002, [0.0] * 6)]
    v = spark.createDataFrame([*rows, (None, rows[0][1]), (3000, None)], "vec_id long, embedding array<double>").repartition(3)
    asked = [r for r in rows if r[0] % 50 == 0]
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in similarity.similar_vectors(v, v.where("vec_id % 50 = 0"), 7).collect()}
    assert got == brute(rows, asked, 7)
    few = similarity.similar_vectors(v.where("vec_id < 3"), v.where("vec_id < 3"), 7)
    assert few.count() == 6
    assert similarity.similar_vectors(v.limit(0), v).collect() == []


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_nearest_cells(spark, sf):
    """The approximate search finds at least 0.9 of the five nearest of the given embeddings."""
    e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding")
    asked = e.where("vec_id % 50 = 0")
    full = similarity.similar_vectors(e, asked).cache()
    rows = [(r["vec_id"], r["embedding"]) for r in e.collect()]
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in full.collect()} == brute(rows, [r for r in rows if r[0] % 50 == 0], 5)
    share = cells.recall(similarity.similar_vectors(e, asked, exact=False), full)
    print(sf, "recall", share)
    assert share >= 0.9


def test_chosen_cells_come_in_bounded_parts():
    rng = np.random.default_rng(5)
    full, middles = np.arange(700), rng.normal(size=(700, 4))
    asked = pd.DataFrame({"query_id": np.arange(1000), "q": list(rng.normal(size=(1000, 4)))})
    held = []
    every = lambda apart, some: held.append(apart.size) or np.ones(apart.shape, bool)
    parts = [*cells._chosen(iter([asked, asked.iloc[:0]]), (full, middles), every)]
    assert max(map(len, parts)) <= cells.PAIRS_OUT and max(held) <= cells.PAIRS_HELD
    out = pd.concat(parts)
    assert len(out) == 700_000 and len(out[["query_id", "cell"]].drop_duplicates()) == 700_000
    assert all((asked["q"].iloc[r.query_id] == r.q).all() for r in out.sample(50, random_state=1).itertuples())


def test_cells_follow_the_rows():
    assert [cells.cell_count(n) for n in (0, 1, 500, 1_000_000, 10**12)] == [1, 1, 22, 1000, cells.MOST_CELLS]


def walk(edges, seeds):
    hops = {}
    for key in {s[0] for s in seeds}:
        todo = deque((n, 0) for k, n in seeds if k == key)
        while todo:
            n, h = todo.popleft()
            if (key, n) in hops:
                continue
            hops[key, n] = h
            todo.extend((b, h + 1) for k, a, b in edges if k == key and a == n)
    return hops


def as_frames(spark, edges, seeds):
    return spark.createDataFrame(edges, "k string, src string, dst string"), spark.createDataFrame(seeds, "k string, name string")


def shapes():
    chain = [("c", f"v{i}", f"v{i + 1}") for i in range(60)]
    side = [("c", f"v{i}", f"s{i % 7}") for i in range(0, 60, 3)]  # names that many steps lead to
    circle = [("c", f"o{i}", f"o{(i + 1) % 30}") for i in range(30)] + [("c", "v9", "o0"), ("c", "o17", "v55")]
    lost = [("c", f"x{i}", f"x{(i + 1) % 5}") for i in range(5)] + [("c", "x2", "v30"), ("c", "y0", "v20"), ("c", "y1", "y0")]
    ladder = [("d", f"{a}{i}", f"{b}{i + 1}") for i in range(20) for a in "ab" for b in "ab"]
    diamonds = [e for i in range(25) for e in (("e", f"t{i}", f"p{i}"), ("e", f"t{i}", f"q{i}"), ("e", f"p{i}", f"t{i + 1}"), ("e", f"q{i}", f"t{i + 1}"))]
    return chain + side + circle + lost + ladder + diamonds, [("c", "v0"), ("c", "v40"), ("d", "a0"), ("e", "t0"), ("e", "t0"), ("f", "alone")]


@pytest.mark.parametrize("walked", [0, 4])
def test_reach_equals_a_walk(spark, walked):
    edges, seeds = shapes()
    e, s = as_frames(spark, edges + edges[:9] + [("c", "v3", "v3")], seeds)
    got = {(r["k"], r["name"]): r["hop"] for r in reach(e, s, ("k",), walked).collect()}
    assert got == walk(edges, seeds)


def test_reach_random_graphs(spark):
    edges, seeds = [], []
    for g in range(30):  # many small graphs at once, one key each
        n = RND.randint(2, 25)
        edges += [(f"g{g}", f"n{RND.randrange(n)}", f"n{RND.randrange(n)}") for _ in range(RND.randint(1, 2 * n))]
        seeds += [(f"g{g}", f"n{RND.randrange(n)}") for _ in range(RND.randint(1, 2))]
    e, s = as_frames(spark, edges, seeds)
    for walked in (0, 2):
        got = {(r["k"], r["name"]): r["hop"] for r in reach(e, s, ("k",), walked).collect()}
        assert got == walk(edges, seeds)


def test_long_chain_in_few_rounds(spark):
    n = 10_000
    e = spark.range(n).select(F.lit("k").alias("k"), F.concat(F.lit("v"), F.col("id")).alias("src"), F.concat(F.lit("v"), F.col("id") + 1).alias("dst"))
    trace: list[str] = []
    out = reach(e, spark.createDataFrame([("k", "v0")], "k string, name string"), ("k",), trace=trace)
    wrong = out.where(F.col("hop") != F.substring("name", 2, 10).cast("long")).count()
    assert out.count() == n + 1 and wrong == 0 and len(trace) < 20, trace


def test_hop_limit(spark):
    edges, seeds = shapes()
    e, s = as_frames(spark, edges, seeds)
    got = {(r["k"], r["name"]): r["hop"] for r in flow.propagate(e, s, hops=5, keys=("k",)).collect()}
    assert got == {n: h for n, h in walk(edges, seeds).items() if h <= 5}
