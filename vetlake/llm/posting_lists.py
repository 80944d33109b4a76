"""Approximate nearest neighbours on balanced posting lists.

*Measure.*  The largest inner product.  With one more coordinate, ``sqrt(M^2 - |x|^2)`` for vectors (``M`` the
largest norm) and 0 for queries, it is the smallest distance, which is what the lists are built on.

*Lists.*  Centroids are fitted on a bounded sample (smallest hash first; ``SAMPLE_ROWS``, or ``SAMPLE_PER_LIST`` rows for
each list if that is more), one per ``LIST_ROWS`` rows and at most ``MAX_LISTS`` of them: k-means, then clusters with over twice the mean are split in two.  Every vector goes to its nearest
list and to further ones within ``1 + BOUNDARY`` times that distance, at most ``COPIES`` in all (its own lists, not
its partners).  Equal vectors are one entry with their ``TOP + 1`` smallest ids; no more of them can be
among the nearest.

*Search.*  The centroids form a graph, each linked with its nearest ones both ways, searched best first in
the tasks that read the queries.  A query takes all lists within a ratio of its nearest centroid's
distance; the ratio is the smallest that reaches ``RECALL`` for up to ``HELD_OUT`` rows of the sample that the centroids
were not fitted on.  It also takes more until they
hold enough entries for ``TOP`` results.  Queries and entries meet by list, both dealt in blocks of
bounded size, so that a popular list is many tasks.  The nearest ``FIRST_LISTS`` lists come first; from the
others only entries return that score no less than the last of the best found there, so what is returned
for a query does not grow with the number of lists.  Scores are exact, in double precision.

*Bounds.*  The broadcast holds at most ``MAX_LISTS`` centroids and ``LINKS`` links each.  Task memory is a block of
``BLOCK_ROWS`` entries and one of ``BLOCK_ROWS`` queries.

Defined cases.  Vectors null, zero or with null or non-finite components take no part, neither do those
whose length is not the most frequent one (of several, the largest).  Null ``vec_id``: no part.  A repeated
row is one candidate; different vectors under one id are candidates each, and a query never meets its
own id; a query id with several vectors is searched for each, the best score of a candidate counts.
Fewer candidates than ``TOP``: all.  Empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vetlake.session import stage_table

TOP = 20
SAMPLE_ROWS = 20_000
SAMPLE_PER_LIST = 8
HELD_OUT = 300
LIST_ROWS = 256
MAX_LISTS = 1 << 14
BOUNDARY = 0.05
COPIES = 8
LINKS = 16
RECALL = 0.97
BLOCK_ROWS = 8192
QUERIES_PER_TASK = 512
FIRST_LISTS = 4
SEED = 7


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0.0))


def _lift(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the coordinate that turns inner products into distances."""
    return np.column_stack([x, np.sqrt(np.maximum(longest * longest - (x * x).sum(1), 0.0))])


def _some(c: np.ndarray) -> int:
    """Rows at a time, so that their distances to all centroids stay within some 32 MB."""
    return max(64, min(4096, (1 << 22) // len(c)))


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)].copy()
    for _ in range(rounds):
        step = _some(c)
        near = np.concatenate([np.argmin(_distances(x[i : i + step], c), axis=1) for i in range(0, len(x), step)])
        size = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    # clusters of over twice the mean become two, beside each other
    crowded = np.flatnonzero(size > 2 * len(x) / len(c))
    for k in crowded[: MAX_LISTS - len(c)]:
        mine = x[near == k]
        axis = mine[np.argmax(_distances(mine, c[k : k + 1])[:, 0])] - c[k]
        side = (mine - c[k]) @ axis > 0
        if side.any() and not side.all():
            c[k] = mine[~side].mean(0)
            c = np.vstack([c, mine[side].mean(0)])
    return c


class CentroidGraph:
    """Centroids linked with their nearest ones, both ways; ``near`` searches best first."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        self.square = (centroids * centroids).sum(1)
        links: list[set[int]] = [set() for _ in centroids]
        for at in range(0, len(centroids), 1024):
            d = _distances(centroids[at : at + 1024], centroids)
            for i, row in enumerate(np.argsort(d, axis=1)[:, : LINKS + 1]):
                for j in row.tolist():
                    if j != at + i:
                        links[at + i].add(j)
                        links[j].add(at + i)
        self.links = [np.array(sorted(x), np.int64) for x in links]
        self.entries = np.unique(np.linspace(0, len(centroids) - 1, min(16, len(centroids))).astype(np.int64))

    def _d(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(q @ q - 2 * self.c[at] @ q + self.square[at], 0.0))

    def near(self, q: np.ndarray, ratio: float, least: int, sizes: np.ndarray) -> list[int]:
        """Centroids within ``ratio`` times the nearest one's distance, then more until their lists hold ``least`` entries.

        Nodes come in order of distance from the frontier; the search goes on a little beyond the ratio,
        since the way to a near centroid may lead over a farther one.
        """
        seen = set(self.entries.tolist())
        frontier = [(d, i) for d, i in zip(self._d(q, self.entries).tolist(), self.entries.tolist())]
        heapq.heapify(frontier)
        out: list[tuple[float, int]] = []
        best, held, beyond = np.inf, 0, 0
        while frontier:
            d, i = heapq.heappop(frontier)
            best = min(best, d)
            out.append((d, i))
            held += int(sizes[i])
            beyond = beyond + 1 if d > ratio * best else 0
            if beyond > 2 * LINKS and held >= 2 * least:
                break
            fresh = [j for j in self.links[i].tolist() if j not in seen]
            if fresh:
                seen.update(fresh)
                for dj, j in zip(self._d(q, np.array(fresh)).tolist(), fresh):
                    heapq.heappush(frontier, (dj, j))
            elif not frontier and len(seen) < len(self.c):  # another part of the graph
                j = next(j for j in range(len(self.c)) if j not in seen)
                seen.add(j)
                heapq.heappush(frontier, (float(self._d(q, np.array([j]))[0]), j))
        out.sort()
        picked, held = [], 0
        for d, i in out:
            if d > ratio * out[0][0] and held >= least:
                break
            picked.append(i)
            held += int(sizes[i])
        return picked


def _lists_of(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and lists of the entries of vectors with distances ``d`` to the centroids."""
    k = min(COPIES, d.shape[1])
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    own = np.take_along_axis(d, near, 1)
    rows, at = np.nonzero(own <= (1 + BOUNDARY) * own.min(axis=1, keepdims=True))
    return rows, near[rows, at]


def _ratio(x: np.ndarray, lifted: np.ndarray, c: np.ndarray, top: int, ask: np.ndarray) -> float:
    """The smallest distance ratio with which the rows ``ask`` of the sample find ``RECALL`` of their neighbours in it."""
    score = x[ask] @ x.T
    score[np.arange(len(ask)), ask] = -np.inf
    best = np.argsort(-score, axis=1)[:, : min(top, len(x) - 1)]
    wanted, at = np.unique(best, return_inverse=True)
    at, step = at.reshape(best.shape), _some(c)
    lists: list[list[int]] = [[] for _ in wanted]
    for i in range(0, len(wanted), step):
        for r, k in zip(*(m.tolist() for m in _lists_of(_distances(lifted[wanted[i : i + step]], c)))):
            lists[i + r].append(k)
    need = []
    for i, a in enumerate(ask):
        d = _distances(np.append(x[a], 0.0)[None], c)[0]
        # a neighbour is found as soon as the nearest of its lists is taken
        need += [d[lists[j]].min() / d.min() for j in at[i]]
    return float(np.quantile(need, RECALL)) * (1 + 1e-9) if need else 1.0


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct ``vec_id, v`` that take part."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & sound)
    rows = rows.select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))  # -0 is 0
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (common["d"] if common else 0)).distinct()


def _norm2(v: str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)


def nearest(vectors: DataFrame, is_query: Column, top: int = TOP) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``vectors`` with ``is_query`` (a condition on ``vec_id``) its ``top`` nearest others."""
    spark = vectors.sparkSession
    rows = stage_table(usable(vectors).select("*", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2")), "ann-rows")
    first = Window.partitionBy("k1", "k2").orderBy("vec_id")
    kept = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= top + 1)
    classes = stage_table(kept.groupBy("k1", "k2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-classes")
    facts = classes.agg(F.count("*").alias("n"), F.max(_norm2("v")).alias("m")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not facts["n"]:
        return spark.createDataFrame([], schema)
    longest = float(np.sqrt(facts["m"]))
    lists = min(MAX_LISTS, -(-facts["n"] // LIST_ROWS))
    sample = np.array([r["v"] for r in classes.orderBy("k1", "k2").limit(max(SAMPLE_ROWS, SAMPLE_PER_LIST * lists)).select("v").collect()])
    lifted = _lift(sample, longest)
    held = np.zeros(len(sample), bool)
    held[np.random.default_rng(SEED).choice(len(sample), min(HELD_OUT, len(sample) // 3), replace=False)] = True
    centroids = balanced_centroids(lifted[~held], lists)
    ratio = _ratio(sample, lifted, centroids, top, np.flatnonzero(held))
    graph = CentroidGraph(centroids)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("v").to_pylist())
            step = _some(centroids)
            for i in range(0, len(x), step):
                r, k = _lists_of(_distances(_lift(x[i : i + step], longest), centroids))
                yield pa.RecordBatch.from_arrays([pa.array(k), *[batch.column(c).take(pa.array(r + i)) for c in ("k1", "k2", "first", "v")]], names=["list", "k1", "k2", "first", "v"])

    entries = classes.select("k1", "k2", F.element_at("ids", 1).alias("first"), "v").mapInArrow(spread, "list long, k1 long, k2 long, first long, v array<double>")
    entries = stage_table(entries, "ann-entries")
    counted = {r["list"]: r["count"] for r in entries.groupBy("list").count().collect()}  # at most MAX_LISTS rows
    sizes = np.array([counted.get(k, 0) for k in range(len(centroids))], np.int64)
    sent = spark.sparkContext.broadcast((graph, sizes))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, sizes = sent.value
        for batch in batches:
            found = [graph.near(np.append(q, 0.0), ratio, COPIES * (top + 1), sizes) for q in np.array(batch.column("q").to_pylist())]
            owner = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            place = pa.array([n for x in found for n in range(len(x))], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([k for x in found for k in x], pa.int64()), place, *[batch.column(c).take(owner) for c in ("q1", "q2", "q")]], names=["list", "place", "q1", "q2", "q"])

    asked = rows.where(is_query)
    queries = asked.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("v").alias("q")).dropDuplicates(["q1", "q2"])
    # dealt to tasks of their own: the search costs far more than the bytes of a query tell
    dealt = queries.repartition(max(1, -(-asked.count() // QUERIES_PER_TASK)), "q1", "q2")
    taken = stage_table(dealt.mapInArrow(look, "list long, place int, q1 long, q2 long, q array<double>"), "ann-taken")
    asks = {r["list"]: r["count"] for r in taken.groupBy("list").count().collect()}  # at most MAX_LISTS rows

    def blocks(many: dict[int, int]) -> Column:
        """How many blocks a list has: 1 but for the popular ones."""
        over = {k: -(-n // BLOCK_ROWS) for k, n in many.items() if n > BLOCK_ROWS}
        if not over:
            return F.lit(1)
        return F.coalesce(F.get(F.lit([over.get(k, 1) for k in range(len(centroids))]), F.col("list").cast("int")), F.lit(1))

    def every(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    e, t = blocks(counted), blocks(asks)
    right = entries.select("list", "k1", "k2", "first", "v", F.pmod(F.xxhash64("k2", "k1"), e).cast("int").alias("eb"), every(t).alias("tb"))
    by = ["list", "tb", "eb"]

    def search(some: DataFrame) -> DataFrame:
        left = some.select("list", "q1", "q2", "q", "bound", F.pmod(F.xxhash64("q2", "q1"), t).cast("int").alias("tb"), every(e).alias("eb"))
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(partial(_best, top=top + 1), "q1 long, q2 long, k1 long, k2 long, first long, score double")

    def ranked(pairs: DataFrame) -> DataFrame:
        """Each pair once, ``n`` by score and smallest id."""
        once = pairs.groupBy("q1", "q2", "k1", "k2").agg(F.min("first").alias("first"), F.max("score").alias("score"))
        return once.withColumn("n", F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "first")))

    near = stage_table(search(taken.where(F.col("place") < FIRST_LISTS).withColumn("bound", F.lit(float("-inf")))), "ann-near")
    bounds = stage_table(ranked(near).where(F.col("n") == top + 1).select("q1", "q2", F.col("score").alias("bound")), "ann-bounds")
    rest = taken.where(F.col("place") >= FIRST_LISTS).join(bounds, ["q1", "q2"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    # one class more than asked for: one may hold only the query itself
    named = ranked(near.unionByName(search(rest))).where(F.col("n") <= top + 1).join(classes.select("k1", "k2", "ids"), ["k1", "k2"])
    hits = asked.select(F.col("vec_id").alias("query_id"), F.col("k1").alias("q1"), F.col("k2").alias("q2")).join(named.select("q1", "q2", "ids", "score"), ["q1", "q2"])
    hits = hits.select("query_id", F.explode("ids").alias("vec_id"), "score").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _best(queries: pd.DataFrame, entries: pd.DataFrame, top: int) -> pd.DataFrame:
    """Of a block of entries the ``top`` best, and all that tie with the last, for each query of a block; none below its bound."""
    names = ["q1", "q2", "k1", "k2", "first", "score"]
    if queries.empty or entries.empty:
        return pd.DataFrame({c: [] for c in names}).astype({c: "int64" for c in names[:-1]} | {"score": "float64"})
    q, v = np.array(queries["q"].tolist()), np.array(entries["v"].tolist())
    out: list[pd.DataFrame] = []
    for at in range(0, len(q), 256):
        rough = q[at : at + 256] @ v.T
        k = min(top, len(v))
        last = np.partition(rough, len(v) - k, axis=1)[:, len(v) - k]
        last = np.maximum(last, queries["bound"].to_numpy()[at : at + 256])
        i, j = np.nonzero(rough >= (last - 1e-9 * np.abs(last) - 1e-300)[:, None])
        exact = (q[at + i] * v[j]).sum(axis=1)  # the same sum wherever a pair meets
        out.append(pd.DataFrame({"q1": queries["q1"].to_numpy()[at + i], "q2": queries["q2"].to_numpy()[at + i], "k1": entries["k1"].to_numpy()[j], "k2": entries["k2"].to_numpy()[j], "first": entries["first"].to_numpy()[j], "score": exact}))
    return pd.concat(out, ignore_index=True)
