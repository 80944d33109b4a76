"""Centroid clustering with ns-bounds on integer vectors.

Every vector remembers its exact squared distance to each centroid as it was when last evaluated, and in
which round that was.  The history of all centroids is kept (rounds x k vectors).  A centroid that has
moved from its place of round t to its present place, by a displacement of norm p, cannot be nearer than
the remembered distance less p: the bound is loosened by the norm of the *total* displacement since the
evaluation, not by the sum of the moves of each round, and is tighter by the triangle inequality.

A round needs no distance for a vector whose own bound from above stays under all others from below.
Where it does not, the own distance is evaluated exactly; centroids whose bound still is not above it are
evaluated exactly too, and the nearest wins, ties to the smaller number.  The bounds leave room for
rounding, so the result is that of comparing everything, in integers.

A vector and its state are one row of a staged table; a round reads one and writes the next, with no
shuffle but the k sums of the update, which combine in the tasks first, so a cluster that holds most
vectors is no hot task.  The driver and the tasks hold k x rounds centroids and nothing that grows.

Defined cases.  Vectors that are null, of another length, or with a null or non-finite component take no
part.  A component beyond 2^20 in size is an error: its squared distance would not fit the result.  Null
``vec_id``: takes part; as a start it hashes like an empty id.  Repeated rows: each is assigned; equal
ids are ordered by their components when starts are chosen.  Fewer vectors than ``k``: as many
centroids.  Empty table: no rows.  Texts and other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetlake.session import drop_table, stage_table

DIM = 64
K = 16
ROUNDS = 3
SCALE = 64
LARGEST = 1 << 20  # of a component
SEED = "1"


def integer_vectors(embeddings: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``vec_id, v`` of the vectors that take part: ``floor(scale * x)`` of each component."""
    x = F.col("embedding")
    fits = (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = F.transform(x, lambda c: F.when(F.abs(c) <= LARGEST, F.floor(F.lit(float(scale)) * c.cast("double"))).otherwise(F.raise_error(F.lit(f"vector component beyond {LARGEST}"))).cast("int"))
    return embeddings.where(x.isNotNull() & fits).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def starts(vectors: DataFrame, k: int = K, seed: str = SEED) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of their id: k rows, ranked in the tasks first."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of row pairs, in 64-bit integers."""
    apart = vectors - centroids
    return np.einsum("ij,ij->i", apart, apart)


def _all_squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.stack([squared(vectors, c[None, :]) for c in centroids], axis=1)


def assign(v: np.ndarray, d: np.ndarray | None, t: np.ndarray | None, own: np.ndarray | None, history: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """State after the round whose centroids are ``history[-1]``: distances, their rounds, clusters, evaluations.

    ``d[i, j]`` is the squared distance of vector i to ``history[t[i, j], j]``.
    """
    now, (rounds, k, _) = history[-1], history.shape
    n = len(v)
    if d is None:
        d = _all_squared(v, now)
        return d, np.zeros((n, k), np.int8), d.argmin(1).astype(np.int32), np.full(n, k, np.int32)
    moved = np.sqrt(((history - now[None]).astype(np.float64) ** 2).sum(2))  # norm of the total displacement, by round and centroid
    d, t, rows, ids = d.copy(), t.copy(), np.arange(n), np.arange(k)
    far = np.sqrt(d.astype(np.float64))
    loose = moved[t, ids[None, :]]
    room = 1e-9 * (1 + far + loose)
    below = far - loose - room
    above = far[rows, own] + loose[rows, own] + room[rows, own]
    other = ids[None, :] != own[:, None]
    open_ = np.flatnonzero(((below <= above[:, None]) & other).any(1))
    done = np.zeros(n, np.int32)
    if len(open_):
        at = own[open_]
        d[open_, at], t[open_, at] = squared(v[open_], now[at]), rounds - 1
        exact = np.sqrt(d[open_, at].astype(np.float64))
        i, j = np.nonzero((below[open_] <= (exact * (1 + 1e-9) + 1e-9)[:, None]) & other[open_])
        d[open_[i], j], t[open_[i], j] = squared(v[open_[i]], now[j]), rounds - 1
        done[open_] = 1 + np.bincount(i, minlength=len(open_))
        # only distances of this round compete; the others are known to be larger
        own = own.copy()
        own[open_] = np.where(t[open_] == rounds - 1, d[open_], np.iinfo(np.int64).max).argmin(1)
    return d, t, own, done


def _matrix(column: pa.Array, n: int, kind: str) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(n, -1)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(matrix.ravel(), kind))


_STATE = "vec_id long, v array<int>, d array<long>, t array<tinyint>, cluster int, evaluated int"
_LAST = "vec_id long, cluster int, distance long, evaluated int"


def _round(state: DataFrame, history: np.ndarray, last: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vetlake.llm.centroid_ns import assign

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = _matrix(batch.column("v"), n, "i8")
            if len(history) == 1:
                d, t, own, done = assign(v, None, None, None, history)
            else:
                d, t, own, done = assign(v, _matrix(batch.column("d"), n, "i8"), _matrix(batch.column("t"), n, "i1"), batch.column("cluster").to_numpy().astype(np.int32), history)
            if last:
                distance = squared(v, history[-1][own])
                arrays = [batch.column("vec_id"), pa.array(own, pa.int32()), pa.array(distance, pa.int64()), pa.array(done + (t[np.arange(n), own] != len(history) - 1), pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "cluster", "distance", "evaluated"])
            else:
                arrays = [batch.column("vec_id"), batch.column("v"), _lists(d, pa.int64()), _lists(t, pa.int8()), pa.array(own, pa.int32()), pa.array(done, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "v", "d", "t", "cluster", "evaluated"])

    return state.mapInArrow(run, _LAST if last else _STATE)


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each cluster; empty clusters stay.  One row per cluster comes back."""
    k, dim = centroids.shape
    sums = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(dim)]
    out = centroids.copy()
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dim)]
    return out


def cluster(vectors: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance, evaluated`` of ``vectors(vec_id, v)`` (staged) and the final centroids.

    ``evaluated`` counts the exact distances that the last assignment needed.
    """
    history, state = first[None], vectors
    for _ in range(rounds):
        after = stage_table(_round(state, history, False), "cluster-state")
        if state is not vectors:
            drop_table(state)
        state = after
        history = np.concatenate([history, _moved(state, history[-1])[None]])
    out = stage_table(_round(state, history, True), "clusters")
    if state is not vectors:
        drop_table(state)
    return out, history[-1]


def clusters(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """Per vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid, evaluated``."""
    vectors = integer_vectors(embeddings, dim, scale)
    first = starts(vectors, k, seed)
    if not len(first):
        empty = vectors.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")])
        return empty.select("*", F.col("vec_id").cast("string").alias("centroid"), F.lit(0).alias("evaluated")).where(F.lit(False))
    found, last = cluster(vectors, first, rounds)
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    of: Column = F.col("cluster")
    names = [",".join(map(str, c.tolist())) for c in last]
    return found.select(
        "vec_id", "cluster", "distance",
        F.element_at(F.array(*[F.lit(sums.get(j, 0)).cast("long") for j in range(len(last))]), of + 1).alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        F.element_at(F.array(*[F.lit(x) for x in names]), of + 1).alias("centroid"),
        "evaluated",
    )


def plain_clusters(rows: list[tuple[int | None, list[int]]], k: int = K, rounds: int = ROUNDS, seed: str = SEED) -> dict:
    """The same by comparing everything, for tests: vec_id -> (cluster, distance), and the centroids."""
    order = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in rows)
    centroids = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups: dict[int, list] = {}
        for _, v in rows:
            groups.setdefault(near(v)[1], []).append(v)
        for j, members in groups.items():
            centroids[j] = [sum(c) // len(members) for c in zip(*members)]
    return {"assigned": [(i, near(v)[1], near(v)[0]) for i, v in rows], "centroids": centroids}


def _sql(k: int, rounds: int, dim: int, scale: int, seed: str) -> str:
    """DuckDB: one long table of components, and per round the distances to all centroids."""
    parts = [
        "src AS (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings)",
        f"kept AS (SELECT r, vec_id, list_transform(e, lambda x: CAST(floor({scale}.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM src WHERE len(e) = {dim} AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS INTEGER) AS j, v FROM kept QUALIFY j < {k})",
    ]
    for n in range(rounds + 1):
        parts.append(
            f"a{n} AS (SELECT r, min_by(j, (d, j)) AS j, min(d) AS d FROM (SELECT r, j, list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept x, c{n} c) GROUP BY r)"
        )
        if n < rounds:
            parts.append(
                f"m{n} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (SELECT a.j, i, CAST(sum(v[i]) AS HUGEINT) AS s, count(*) AS n FROM a{n} a JOIN kept USING (r), range(1, {dim + 1}) t(i) GROUP BY a.j, i) GROUP BY j)"
            )
            parts.append(f"c{n + 1} AS (SELECT c.j, coalesce(CAST(m.v AS BIGINT[]), c.v) AS v FROM c{n} c LEFT JOIN m{n} m USING (j))")
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, a.j AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN kept USING (r) JOIN c{rounds} c ON c.j = a.j"
    )


CLUSTER_SQL = _sql(K, ROUNDS, DIM, SCALE, SEED)
