"""Sharding by extendible hashing.

A document's place is a 60-bit hash.  The directory starts as one bucket; a bucket whose bytes
exceed the limit is split on the next hash bit, and only such buckets are.  A shard is therefore the
shortest hash prefix under which the documents fit, named by its bits (the single bucket by "").

The directory is grown ``BITS_PER_ROUND`` bits at a time: one count of bytes per prefix over the
documents that are still in oversized buckets, at most ``2 ** BITS_PER_ROUND`` rows for each of these,
from which the levels between follow by summing.  Documents (id and size, without their text) meet the
directory in a join on the prefix; a hot source or key is no hot prefix, because the hash covers id
and text.

Defined cases.  Null text: 0 bytes.  Null ``doc_id``: the text alone places it.  Rows that agree in id
and text share all bits, and a single document over the limit cannot be split either: once no bit
separates a bucket's rows its bucket stays oversized and is marked ``overfull``.  Empty table: no
shards.  Other columns are ignored by ``assign_shards`` and kept by ``write_shards``.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetlake.session import stage_table

from .common import ROW, pack_row, whole_text

SHARD_BYTES = 64 << 20
HASH_BITS = 60
BITS_PER_ROUND = 15


def place(doc_id: Column, text: Column) -> Column:
    """The document's 60 hash bits as a string of 0 and 1."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(text)))
    return F.lpad(F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 2), HASH_BITS, "0")


def directory(placed: DataFrame, limit: int, bits_per_round: int = BITS_PER_ROUND) -> DataFrame:
    """Shards of ``placed(place, n_bytes)``: ``shard, shard_bytes, shard_docs, overfull``.

    ``open_at`` are the prefixes at the depth reached so far whose buckets are over the limit.
    """
    found, depth, rest = None, 0, placed
    while True:
        step = min(bits_per_round, HASH_BITS - depth)
        last = depth + step >= HASH_BITS
        leaves = rest.groupBy(F.substring("place", 1, depth + step).alias("p")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        levels = leaves.select("b", "n", F.explode(F.sequence(F.lit(depth), F.lit(depth + step))).alias("d"), "p")
        sums = levels.groupBy("d", F.expr("substring(p, 1, d)").alias("shard")).agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        sums = stage_table(sums, "shard-levels")
        # a bucket is in the directory if it fits (or cannot be split) and the bucket it was split from does not
        fits = (F.col("shard_bytes") <= limit) | (F.col("d") == HASH_BITS)
        over = sums.where(~fits).select((F.col("d") + 1).alias("d"), F.col("shard").alias("up"))
        kept = sums.where(fits)
        inner = kept.join(over, (kept["d"] == over["d"]) & (F.expr("substring(shard, 1, length(shard) - 1)") == over["up"]), "left_semi")
        top = kept.where(F.col("d") == 0)
        now = (top.unionByName(inner) if depth == 0 else inner).select("shard", "shard_bytes", "shard_docs")
        found = now if found is None else found.unionByName(now)
        if last:
            break
        open_at = stage_table(sums.where((F.col("d") == depth + step) & ~fits).select(F.col("shard").alias("p")), "shard-open")
        if open_at.isEmpty():
            break
        depth += step
        rest = rest.join(open_at, F.substring("place", 1, depth) == F.col("p"), "left_semi")
    return stage_table(found.withColumn("overfull", F.col("shard_bytes") > limit), "shard-directory")


def _assigned(rows: DataFrame, limit: int, bits_per_round: int = BITS_PER_ROUND) -> DataFrame:
    """``rows`` (with ``place, n_bytes``) with their shard, by equality on each depth that occurs."""
    shards = directory(rows.select("place", "n_bytes"), limit, bits_per_round)
    depths = [r["d"] for r in shards.select(F.length("shard").alias("d")).distinct().orderBy("d").collect()]  # at most HASH_BITS + 1 numbers
    marked = rows.select("*", F.explode(F.array(*[F.lit(d) for d in depths]) if depths else F.array().cast("array<int>")).alias("d"))
    return marked.withColumn("shard", F.expr("substring(place, 1, d)")).join(shards, "shard").drop("d", "place")


def assign_shards(docs: DataFrame, limit: int = SHARD_BYTES, bits_per_round: int = BITS_PER_ROUND) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, shard, shard_bytes, shard_docs, overfull``."""
    rows = docs.select("doc_id", F.octet_length(whole_text()).cast("long").alias("n_bytes"), place(F.col("doc_id"), whole_text()).alias("place"))
    rows = stage_table(rows, "shard-places")  # the texts are read once
    return _assigned(rows, limit, bits_per_round).select("doc_id", "n_bytes", "shard", "shard_bytes", "shard_docs", "overfull")


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """Write one folder ``shard=<bits>`` per shard, in one pass over the documents."""
    rows = docs.select(pack_row(docs), F.octet_length(whole_text()).cast("long").alias("n_bytes"), place(F.col("doc_id"), whole_text()).alias("place"))
    out = _assigned(rows, limit).select(f"{ROW}.*", F.concat(F.lit("s"), "shard").alias("__shard"))
    out.repartition("__shard").write.partitionBy("__shard").parquet(path)


SHARD_SQL = f"""
WITH x AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents),
h AS (SELECT doc_id, n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(text)), 1, 15))::BIGINT AS v FROM x),
p AS (SELECT doc_id, n_bytes, lpad(bin(v), {HASH_BITS}, '0') AS place FROM h),
l AS (SELECT d, substr(place, 1, d::INT) AS shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM p, range(0, {HASH_BITS + 1}) r(d) GROUP BY ALL),
f AS (SELECT p.doc_id, p.n_bytes, p.place, min(l.d) AS d FROM p JOIN l ON l.shard = substr(p.place, 1, l.d::INT) AND (l.shard_bytes <= {SHARD_BYTES} OR l.d = {HASH_BITS}) GROUP BY ALL)
SELECT f.doc_id, f.n_bytes, l.shard, l.shard_bytes, l.shard_docs, l.shard_bytes > {SHARD_BYTES} AS overfull
FROM f JOIN l ON l.d = f.d AND l.shard = substr(f.place, 1, f.d::INT)
"""
