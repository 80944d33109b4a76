"""Inverted-file search: vectors in coarse cells, the nearest cells of a query probed, the rest excluded or left out.

Cells are centroids of unit vectors; their number follows the number of rows (about its square root).
Every vector lies in the cell of its nearest centroid, and a cell knows its radius.  A query first probes its
``probes`` nearest cells.  The exact search then probes every further cell that could still hold a better
neighbour: by the triangle inequality no vector of a cell is nearer to the query than the centroid is,
less the radius, so a cell beyond the k-th best found so far is left out without loss.  The
approximate search stops after the first step, with as many cells as ``tuned_probes`` measures to be enough; ``recall`` says
what it found.

Work is dealt by cell.  A cell meets its queries as products of matrices, a block of queries with a
block of vectors in one task, so a cell that holds a third of all rows is many tasks and no pair
is a row: a query leaves ``k`` ids and scores per block.  These are ranked; vectors are never joined to pairs.

The driver holds the centroids, radii and sizes: at most ``MOST_CELLS`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import norm
from ..session import stage_table

MOST_CELLS = 1 << 14
# Rows of the sample that moves the centroids, per cell; rows of a block of queries and of vectors.
SAMPLE_PER_CELL = 48
QUERY_BLOCK = 4096
VECTOR_BLOCK = 8192
# Distances of queries to centroids that a task holds, and rows of a query's vector with a cell that it gives out at a time.
PAIRS_HELD = 1 << 18
PAIRS_OUT = 4096
ROUNDS = 2
# Scores are compared to nine places; cells are left out only beyond that.
PLACES = 9
MARGIN = 4e-9


@dataclass
class CellIndex:
    """``rows``: vec_id, u (unit vector), cell, apart (distance to the centroid); the rest is one row per cell."""

    rows: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    size: np.ndarray


def cell_count(n_rows: int) -> int:
    """About the square root of the rows, so that a cell and the list of cells grow alike."""
    return int(max(1, min(MOST_CELLS, round(n_rows**0.5))))


def unit_rows(vectors: DataFrame, dim: int) -> DataFrame:
    """``vec_id, u`` of the vectors of length ``dim`` that are not zero."""
    e = F.col("embedding").cast("array<double>")
    sized = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") == dim)).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"), norm(e).alias("n"))
    return sized.where("n > 0").select("vec_id", F.transform("e", lambda x: x / F.col("n")).alias("u"))


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), dim)


def _nearest(u: np.ndarray, centroids: np.ndarray, some: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row and the distance to it."""
    at, apart = np.empty(len(u), np.int64), np.empty(len(u))
    half = (centroids * centroids).sum(1) / 2
    for i in range(0, len(u), some):
        part = u[i : i + some]
        at[i : i + some] = (half[None] - part @ centroids.T).argmin(1)
        apart[i : i + some] = np.sqrt(((part - centroids[at[i : i + some]]) ** 2).sum(1))
    return at, apart


def in_cells(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``rows(vec_id, u)`` with cell and distance to its centroid."""
    dim = centroids.shape[1]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                at, apart = _nearest(_matrix(p["u"], dim), centroids)
                yield p.assign(cell=at.astype("int32"), apart=apart)

    return rows.mapInPandas(run, "vec_id long, u array<double>, cell int, apart double")


def fit(rows: DataFrame, n_rows: int, cells: int | None = None) -> np.ndarray:
    """Centroids: a sample's vectors with the smallest id hashes, moved to the mean of their cell ``ROUNDS`` times.

    The sample is the rows whose id hash is below a bound, ``SAMPLE_PER_CELL`` per cell on average; the means are Spark
    aggregates, so only one row per cell reaches the driver.
    """
    k = min(cells or cell_count(n_rows), n_rows)
    keyed = rows.withColumn("h", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)))
    share = min(1.0, SAMPLE_PER_CELL * k / max(1, n_rows))
    sample = stage_table(keyed.where(F.col("h") < F.lit(int(share * (1 << 30)) + 1)).drop("h"), "cell-sample")
    first = sample.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id", "u").limit(k).select("u").collect()
    centroids = np.unique(np.array([r["u"] for r in first], float), axis=0)
    for _ in range(ROUNDS):
        dim = centroids.shape[1]
        moved = in_cells(sample, centroids).groupBy("cell").agg(*[F.avg(F.col("u")[i]).alias(f"m{i}") for i in range(dim)]).collect()
        for r in moved:
            centroids[r["cell"]] = [r[f"m{i}"] for i in range(dim)]
    return centroids


def build(vectors: DataFrame, dim: int, cells: int | None = None) -> CellIndex | None:
    """Index of all vectors of length ``dim`` that are not zero; None if there are none."""
    rows = unit_rows(vectors, dim)
    n = rows.count()
    if not n:
        return None
    centroids = fit(rows, n, cells)
    placed = stage_table(in_cells(rows, centroids), "cells")
    radius, size = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in placed.groupBy("cell").agg(F.max("apart").alias("r"), F.count("*").alias("n")).collect():
        radius[r["cell"]], size[r["cell"]] = r["r"], r["n"]
    return CellIndex(placed, centroids, radius, size)


def _best(queries: pd.DataFrame, vectors: pd.DataFrame, k: int, dim: int) -> pd.DataFrame:
    """The ``k`` best of a block of vectors for each query of a block: ids and scores, ties to the smaller id."""
    out = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})]
    if len(queries) and len(vectors):
        vectors = vectors.sort_values("vec_id", kind="stable")
        ids, v = vectors["vec_id"].to_numpy(), _matrix(vectors["u"], dim)
        for i in range(0, len(queries), 256):
            own = queries["query_id"].to_numpy()[i : i + 256]
            score = np.round(_matrix(queries["q"].iloc[i : i + 256], dim) @ v.T, PLACES) + 0.0
            score[own[:, None] == ids[None]] = -np.inf
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            got = pd.DataFrame({"query_id": np.repeat(own, best.shape[1]), "vec_id": ids[best].ravel(), "cosine": np.take_along_axis(score, best, 1).ravel()})
            out.append(got[got["cosine"] > -np.inf])
    return pd.concat(out, ignore_index=True)


def _probe(index: CellIndex, probes: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, cosine``: per probed cell and block the ``k`` best for each query of ``probes(query_id, q, cell)``."""
    asked = np.zeros(len(index.size), np.int64)
    for r in probes.groupBy("cell").count().collect():  # one row per cell
        asked[r["cell"]] = r["count"]
    per_cell = lambda counts, block: F.element_at(F.lit([int(max(1, -(-c // block))) for c in counts]), F.col("cell") + 1)
    vb, qb = per_cell(index.size, VECTOR_BLOCK), per_cell(asked, QUERY_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    left = probes.select("query_id", "q", "cell", dealt("query_id", qb).alias("qb"), every(vb).alias("vb"))
    right = index.rows.where(F.element_at(F.lit([bool(a) for a in asked]), F.col("cell") + 1)).select("vec_id", "u", "cell", dealt("vec_id", vb).alias("vb"), every(qb).alias("qb"))
    run = partial(_best, k=k, dim=index.centroids.shape[1])
    return left.groupBy("cell", "qb", "vb").cogroup(right.groupBy("cell", "qb", "vb")).applyInPandas(lambda q, v: run(q, v), "query_id long, vec_id long, cosine double")


def _top(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _chosen(parts: Iterator[pd.DataFrame], index_rows: tuple[np.ndarray, np.ndarray], pick) -> Iterator[pd.DataFrame]:
    """Rows of ``_cells_of`` for frames of queries: at most ``PAIRS_HELD`` distances and ``PAIRS_OUT`` rows at a time, however many cells there are."""
    full, centroids = index_rows
    square = (centroids**2).sum(1)[None]
    step = max(1, min(512, PAIRS_HELD // max(1, len(full))))
    for p in parts:
        for i in range(0, len(p), step):
            some = p.iloc[i : i + step]
            q = _matrix(some["q"], centroids.shape[1])
            row, col = np.nonzero(pick(np.sqrt(np.maximum(1 + square - 2 * q @ centroids.T, 0)), some))
            ids, vectors = some["query_id"].to_numpy(), some["q"].to_numpy()
            for j in range(0, len(row), PAIRS_OUT):
                at = row[j : j + PAIRS_OUT]
                yield pd.DataFrame({"query_id": ids[at], "q": vectors[at], "cell": full[col[j : j + PAIRS_OUT]].astype("int32")})


def _cells_of(queries: DataFrame, index: CellIndex, pick) -> DataFrame:
    """``query_id, q, cell`` for the cells that ``pick(distances to all centroids, frame of queries)`` names."""
    full = np.flatnonzero(index.size)
    rows = full, index.centroids[full]
    return queries.mapInPandas(lambda parts: _chosen(parts, rows, pick), "query_id long, q array<double>, cell int")


def _first(apart: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest cells of each row."""
    most = min(probes, apart.shape[1])
    chosen = np.zeros(apart.shape, bool)
    np.put_along_axis(chosen, np.argsort(apart, axis=1, kind="stable")[:, :most], True, axis=1)
    return chosen


def search(index: CellIndex, queries: DataFrame, k: int, probes: int = 4, exact: bool = True) -> DataFrame:
    """``query_id, vec_id, cosine, rank``: the ``k`` nearest others of ``queries(query_id, q)``, unit vectors.

    ``exact``: after the nearest cells, all cells that the bound does not exclude.
    """
    q = stage_table(queries.select("query_id", "q"), "cell-queries")
    found = _top(_probe(index, _cells_of(q, index, lambda apart, _: _first(apart, probes)), k), k)
    if not exact:
        return found
    found = stage_table(found.drop("rank"), "cell-found")
    worst = found.groupBy("query_id").agg(F.min("cosine").alias("worst"), F.count("*").alias("n")).where(F.col("n") >= k)
    radius = index.radius[np.flatnonzero(index.size)]

    def more(apart: np.ndarray, some: pd.DataFrame) -> np.ndarray:
        nearest = np.maximum(apart - radius[None] - 1e-9, 0)
        best = 1 - nearest * nearest / 2  # the largest cosine a vector of the cell can have
        return (best >= some["worst"].to_numpy(float)[:, None] - MARGIN) & ~_first(apart, probes)

    open_ = q.join(worst.drop("n"), "query_id", "left").select("query_id", "q", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
    rest = stage_table(_cells_of(open_, index, more), "cell-probes")
    return _top(found.unionByName(_probe(index, rest, k)), k)


def tuned_probes(index: CellIndex, k: int, want: float = 0.95, sample: int = 200) -> int:
    """Cells to probe so that a share of ``want`` of the ``k`` nearest is found, measured on ``sample`` vectors.

    The sample's exact neighbours are found, and each neighbour's cell has a place among the cells by distance
    from the query; so many places are taken that the share is met.  At most ``sample * k`` rows reach the driver.
    """
    some = index.rows.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id").limit(sample).select(F.col("vec_id").alias("query_id"), F.col("u").alias("q"))
    some = stage_table(some, "cell-tuning")
    near = search(index, some, k).select("query_id", "vec_id").join(index.rows.select("vec_id", "cell"), "vec_id").join(some, "query_id")
    rows = near.select("q", "cell").collect()
    if not rows:
        return 1
    full = np.flatnonzero(index.size)
    place = []
    for r in rows:
        apart = ((index.centroids[full] - np.array(r["q"])) ** 2).sum(1)
        place.append(int((apart < apart[np.searchsorted(full, r["cell"])]).sum()) + 1)
    return sorted(place)[min(len(place) - 1, int(np.ceil(want * len(place))) - 1)]


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours (``query_id, vec_id``) that were found."""
    wanted = exact.select("query_id", "vec_id")
    n = wanted.count()
    return wanted.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count() / n if n else 1.0
