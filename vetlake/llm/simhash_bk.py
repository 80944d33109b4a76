"""Near duplicates by SimHash, found with sharded BK-trees.

Fingerprints of equal value are one node.  A fingerprint goes to one shard for each pair of equal blocks
it may share with a near one: of six blocks at most four hold a differing bit, so two fingerprints
within ``RADIUS`` bits agree in two blocks and meet in that shard.  A shard's distinct fingerprints form
a BK-tree, children keyed by their Hamming distance to the parent; a search follows only the edges
within the radius of the distance at hand.  Links become a spanning forest per shard (one link for each
union, never all pairs), and components are joined across shards by star steps.

A broadcast of trees over all fingerprints has no size bound, so a shard's tree is built where the
shuffle on the block key brings the shard's rows together.  Shards of more than ``SHARD_LIMIT``
fingerprints are not built: their members are dealt again with more and smaller blocks, the last time
by 12 of 16 blocks, where a shard cannot hold more than ``2 ** 16`` different fingerprints.  Every link
is found at one of these levels.

Defined cases.  Null or empty text, or one without words: fingerprint 0, linked like any other.  Null
``doc_id``: has a fingerprint and belongs to a component, but never names it; a component without any id
has ``component_id`` null.  Repeated rows: each is returned.  Empty table: empty result.
``components`` ignores further columns; ``keep_one`` keeps all columns whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vetlake.session import stage_table

from .common import ROW, pack_row, unpack_row, whole_text
from .graph import connected_components

SHINGLE = 4
SEED = 42
RADIUS = 4
SHARD_LIMIT = 4096
#: (blocks, blocks that two fingerprints within RADIUS bits surely share)
LEVELS = ((6, 2), (8, 4), (16, 12))
_STEP = 1 << 16


def fingerprint_of(text: str) -> int:
    """The fingerprint of one text, unsigned."""
    from xxhash import xxh64_digest

    words = text.encode().lower().split()  # ASCII case and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(words)) - 1
    first, last = starts[: len(words) - k].tolist(), ends[k:].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), _STEP):
        digests = b"".join([xxh64_digest(line[a:b], SEED) for a, b in zip(first[at : at + _STEP], last[at : at + _STEP])])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(first)).tobytes(), "big")


def _fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint_of(x) for x in text], np.uint64).view(np.int64))


def fingerprint(text: Column) -> Column:
    """The fingerprint as a signed 64-bit number."""
    return F.pandas_udf(_fingerprints, T.LongType())(text)


class BKTree:
    """Distinct integers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def search(self, value: int, radius: int) -> list[int]:
        """Indices of the values within ``radius`` bits."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)
        return found

    def insert(self, value: int) -> int:
        new = len(self.values)
        if new:
            at = 0
            while (edge := (self.values[at] ^ value).bit_count()) in self.children[at]:
                at = self.children[at][edge]
            self.children[at][edge] = new
        self.values.append(value)
        self.children.append({})
        return new


def shard_links(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among distinct unsigned ``values``."""
    tree, up = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, value in enumerate(values):
        for j in tree.search(value, radius):
            if (r := root(j)) != root(i):
                up[r] = root(i)
                yield value, values[j]
        tree.insert(value)


def _masks(blocks: int, same: int) -> list[int]:
    """For each choice of ``same`` of ``blocks`` blocks, the bits in them, as signed 64-bit numbers."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [(m ^ (1 << 63)) - (1 << 63) for m in map(sum, combinations(block, same))]


def _in_shards(nodes: DataFrame, blocks: int, same: int, radius: int, limit: int | None) -> DataFrame:
    """Links ``a, b`` within the shards of ``nodes(fp)``; rows with ``b`` null are members of shards over the limit."""
    masks = _masks(blocks, same)
    keys = F.explode(F.transform(F.lit(masks).cast("array<long>"), lambda m, k: F.struct(k.alias("k"), F.col("fp").bitwiseAND(m).alias("v")))).alias("key")
    dealt = nodes.select("fp", keys).select("fp", "key.k", "key.v")
    dealt = dealt.repartition("k", "v").sortWithinPartitions("k", "v", "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard, over = None, [], False
        a, b = [], []

        def close() -> None:
            if over:
                a.extend(shard)
                b.extend([None] * len(shard))
            elif len(shard) > 1:
                for x, y in shard_links(shard, radius):
                    a.append(x)
                    b.append(y)

        def flush() -> pa.RecordBatch:
            signed = [pa.array([None if x is None else (x ^ (1 << 63)) - (1 << 63) for x in side], pa.int64()) for side in (a, b)]
            a.clear()
            b.clear()
            return pa.RecordBatch.from_arrays(signed, names=["a", "b"])

        for batch in batches:
            k, v, fp = (batch.column(n).to_numpy() for n in ("k", "v", "fp"))
            cuts = np.flatnonzero((k[1:] != k[:-1]) | (v[1:] != v[:-1])) + 1 if len(k) else []
            numbers = fp.view(np.uint64).tolist()
            for at, to in zip([0, *cuts], [*cuts, len(k)]):
                if to == at:
                    continue
                if (k[at], v[at]) != key:
                    close()
                    key, shard, over = (k[at], v[at]), [], False
                shard += numbers[at:to]
                if limit and len(shard) > limit:
                    over = True
                    close()
                    shard = []
            yield flush()
        close()
        yield flush()

    return dealt.mapInArrow(search, "a long, b long")


def near_links(nodes: DataFrame, radius: int = RADIUS, limit: int = SHARD_LIMIT) -> DataFrame:
    """Links ``a, b`` that connect whatever distinct fingerprints ``nodes(fp)`` lie within ``radius`` (at most 4) bits."""
    if not 0 <= radius <= RADIUS:
        raise ValueError("the blocks are laid out for at most 4 differing bits")
    links = None
    for level, (blocks, same) in enumerate(LEVELS):
        last = level == len(LEVELS) - 1
        found = stage_table(_in_shards(nodes, blocks, same, radius, None if last else limit), "simhash-links")
        here = found.where("b is not null")
        links = here if links is None else links.unionByName(here)
        over = found.where("b is null")
        if last or over.isEmpty():
            return links
        nodes = over.select(F.col("a").alias("fp")).distinct()


def _grouped(docs: DataFrame) -> DataFrame:
    """``doc_id, k1, fp, root, component_id`` for every row of ``docs``; ``k1`` is a hash of the text."""
    rows = stage_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("k1"), fingerprint(whole_text()).alias("fp")), "simhash-rows")
    nodes = stage_table(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = connected_components(near_links(nodes.select("fp")))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = stage_table(named, "simhash-roots")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(least, "root").select(F.col("fp").alias("__fp"), "root", "component_id")
    return rows.join(classes, rows["fp"] == F.col("__fp")).select("doc_id", "k1", "fp", "root", "component_id")


def components(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``."""
    return _grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` per component, the one that names it, with all its columns.

    Of rows of the component that repeat that id one stays, as does one row of a component without any id; components
    that bear the same id keep a row each.  The rows
    to drop (id and text hash) are written first: the join that leaves them out is planned from their known size, and
    the texts are shuffled only when that list is too long to broadcast.
    """
    groups = stage_table(_grouped(docs), "simhash-groups")
    dropped = stage_table(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__id"), F.col("k1").alias("__k1")).distinct(), "simhash-dropped")
    named = groups.where("doc_id = component_id")
    again = named.groupBy("root", "doc_id").count().where("count > 1").select("root", F.col("doc_id").alias("__again"))
    twice = stage_table(named.join(again, (named["root"] == again["root"]) & (F.col("doc_id") == F.col("__again")), "left_semi").select(F.col("doc_id").alias("__id"), F.col("k1").alias("__k1"), "root").distinct(), "simhash-twice")
    key = F.col("doc_id").cast("long") == F.col("__id")
    rows = docs.select(pack_row(docs), "doc_id", "text")
    key = key & (F.xxhash64(whole_text()) == F.col("__k1"))
    kept = rows.where("doc_id is not null").join(dropped, key, "left_anti")

    def one(df: DataFrame, *by: str) -> DataFrame:
        first = Window.partitionBy(*by).orderBy(F.xxhash64(ROW), F.to_json(ROW))
        return df.withColumn("__n", F.row_number().over(first)).where("__n = 1")

    if not twice.isEmpty():
        kept = kept.join(twice, key, "left_anti").select(ROW).unionByName(one(kept.join(twice, key), "root", "doc_id").select(ROW))
    nameless = stage_table(groups.where("component_id is null").select(F.col("fp").alias("__fp"), "root").distinct(), "simhash-nameless")
    if not nameless.isEmpty():
        lost = rows.where("doc_id is null").withColumn("fp", fingerprint(whole_text())).join(nameless, F.col("fp") == F.col("__fp"))
        kept = kept.select(ROW).unionByName(one(lost, "root").select(ROW))
    return unpack_row(kept)
