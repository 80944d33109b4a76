"""Nearest neighbours over embedding columns."""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ws_trim
from ..functions.vectors import norm
from . import cells
from .scan import analysis_text


def unit(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Vectors scaled to length 1 (zero vectors stay zero)."""
    n = norm(F.col(col))
    return df.withColumn(col, F.when(n > 0, F.transform(F.col(col).cast("array<double>"), lambda x: x / n)).otherwise(F.col(col).cast("array<double>")))


def centroids(df: DataFrame, key: str = "label", col: str = "embedding") -> DataFrame:
    """Mean vector per key; positions are combined map-side, never a whole group in one task."""
    parts = df.select(key, F.posexplode(F.col(col)).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


# Rows of a block of queries and of a block of vectors: what one task holds at a time.
QUERY_BLOCK = 4096
VECTOR_BLOCK = 8192


def _best_of_block(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best of a block of vectors for each query of a block, by cosine to nine places and id."""
    out = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})]
    if queries.empty or vectors.empty:
        return out[0]
    vectors = vectors.sort_values("vec_id", kind="stable")
    ids = vectors["vec_id"].to_numpy()
    sized = lambda col: {n: np.flatnonzero(col.map(len) == n) for n in col.map(len).unique()}
    by_size = {n: (at, np.array(vectors["embedding"].iloc[at].tolist(), float).reshape(len(at), n)) for n, at in sized(vectors["embedding"]).items()}
    for n, rows in sized(queries["embedding"]).items():
        for some in np.array_split(rows, -(-len(rows) // 256)):
            q = np.array(queries["embedding"].iloc[some].tolist(), float).reshape(len(some), n)
            score = np.full((len(some), len(ids)), -1.0)  # other lengths, as in ``cosine``
            if n in by_size:
                at, v = by_size[n]
                size = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))[None]
                score[:, at] = np.divide(q @ v.T, size, out=np.zeros(size.shape), where=size != 0)
            score = np.round(score, 9) + 0.0
            own = queries["vec_id"].to_numpy()[some]
            score[own[:, None] == ids[None]] = -np.inf
            # rows are in order of id, so a stable sort breaks ties by the smallest
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            got = pd.DataFrame({"query_id": np.repeat(own, best.shape[1]), "vec_id": ids[best].ravel(), "cosine": np.take_along_axis(score, best, 1).ravel()})
            out.append(got[got["cosine"] > -np.inf])
    return pd.concat(out, ignore_index=True)


def _exact(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, cosine``: the ``k`` best of every block of vectors for every query.

    Each block of queries meets each block of vectors in one task as a product of matrices, so no pair is a row:
    a query leaves ``k`` rows per block.
    """
    usable = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    v, q = usable(vectors), usable(queries)
    n_v, n_q = max(1, -(-v.count() // VECTOR_BLOCK)), max(1, -(-q.count() // QUERY_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select("vec_id", "embedding", block(n_q).alias("qb"), every(n_v).alias("vb"))
    right = v.select("vec_id", "embedding", block(n_v).alias("vb"), every(n_q).alias("qb"))
    return left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(partial(_best_of_block, k=k), "query_id long, vec_id long, cosine double")


def similar_vectors(vectors: DataFrame, queries: DataFrame, k: int = 5, exact: bool = True, want: float = 0.95, n_cells: int | None = None) -> DataFrame:
    """The ``k`` most similar others of each query vector, by cosine to nine places and smallest id.

    ``vectors`` and ``queries``: vec_id, embedding.  Vectors of the table's usual length are searched through
    coarse cells (see ``cells``): the nearest, then all that the bound does not exclude, so nothing is missed.
    ``exact=False`` stops after as many of the nearest cells as give a recall of ``want`` on a sample.  Zero vectors
    and other lengths, which have no place in a cell, are compared block by block.
    """
    v, q = (df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null") for df in (vectors, queries))
    usual = v.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if usual is None:
        return v.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("cosine"), F.lit(1).alias("rank")).where(F.lit(False))
    dim = usual["dim"]
    length = norm(F.col("embedding"))
    odd = (F.size("embedding") != dim) | ~((length > 0) & (length < float("inf")))
    parts = []
    if not v.where(odd).isEmpty():
        parts.append(_exact(v.where(odd), q.where(~odd), k))
    if not q.where(odd).isEmpty():
        parts.append(_exact(v, q.where(odd), k))
    index = cells.build(v.where(~odd), dim, n_cells)
    if index is not None:
        asked = cells.unit_rows(q.where(~odd), dim).withColumnsRenamed({"vec_id": "query_id", "u": "q"})
        probes = 4 if exact else cells.tuned_probes(index, k, want)
        parts.append(cells.search(index, asked, k, probes, exact).drop("rank"))
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def code_summary(files: DataFrame) -> DataFrame:
    """Embedding input text per file: function names, imports, comments over 10 bytes, literals of 6..49 bytes."""
    text = analysis_text(files)
    lines = F.split(text, "\n", -1)
    funcs = F.transform(F.filter(lines, lambda l: l.startswith("func ")), lambda l: F.regexp_extract(l, r"^func\s+(\S+)", 1))
    imports = F.flatten(F.transform(F.filter(lines, lambda l: l.startswith("import ")), lambda l: F.regexp_extract_all(l, F.lit(r'(?<=\s)"+([^"\s]*)"*(?=\s|$)'), F.lit(1))))
    comments = F.transform(F.filter(lines, lambda l: ws_trim(l).startswith("//")), lambda l: ws_trim(F.when(l.startswith("//"), F.substring(l, 3, 1 << 30)).otherwise(l)))
    literals = F.transform(F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*"'), F.lit(0)), lambda s: F.regexp_replace(s, '^"+|"+$', ""))
    parts = F.concat(
        F.filter(funcs, lambda x: x != ""), imports, F.filter(comments, lambda c: F.octet_length(c) > 10),
        F.filter(literals, lambda s: (F.octet_length(s) > 5) & (F.octet_length(s) < 50)))
    return files.select("skill_id", "path", F.array_join(parts, " ").alias("summary"))


