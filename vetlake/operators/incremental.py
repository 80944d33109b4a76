"""Incremental re-scan: changed files, snapshot trimming, result reuse."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ws_trim
from ..session import shared_dir

SNAPSHOT_LIMIT = 2000
CACHE_TTL_SECS = 24 * 3600


def fingerprints(files: DataFrame) -> DataFrame:
    """skill_id, rel_path, language, sha256, size of the current files."""
    return files.select("skill_id", ws_trim(F.col("path")).alias("rel_path"), ws_trim(F.coalesce("language", F.lit(""))).alias("language"), "sha256", F.col("n_bytes").alias("size"))


def compare_files(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Current fingerprints with ``status`` hit or miss; language, hash and size must agree (mtime is not compared)."""
    s = snapshot.select("skill_id", "rel_path", F.col("language").alias("s_lang"), F.col("sha256").alias("s_sha"), F.col("size").alias("s_size"))
    same = (F.col("language") == F.col("s_lang")) & (F.col("sha256") == F.col("s_sha")) & (F.col("size") == F.col("s_size"))
    return current.join(s, ["skill_id", "rel_path"], "left").withColumn("status", F.when(F.coalesce(same, F.lit(False)), F.lit("hit")).otherwise(F.lit("miss"))).drop("s_lang", "s_sha", "s_size")


def bucketed(fingerprints_: DataFrame, name: str, buckets: int = 64) -> DataFrame:
    """Fingerprints written as a table in the shared folder, dealt and sorted by file in ``buckets`` parts.

    Two such tables with the same number of buckets are compared without a shuffle: write the snapshot
    once a day like this, and the comparison of each run moves no row.
    """
    spark = fingerprints_.sparkSession
    keys = ["skill_id", "rel_path"]
    path = f"{shared_dir(spark)}/bucketed-{name}-{uuid.uuid4().hex}"
    # one file per bucket, so that its order can be used
    dealt = fingerprints_.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).mode("overwrite").saveAsTable(name)
    return spark.table(name)


def changed_files(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Files that must be scanned again."""
    return compare_files(current, snapshot).where("status = 'miss'").drop("status")


def scan_stats(compared: DataFrame) -> DataFrame:
    """Candidates, hits, misses and hit rate per skill."""
    return compared.groupBy("skill_id").agg(F.count("*").alias("candidate"), F.count_if(F.col("status") == "hit").alias("hit"), F.count_if(F.col("status") == "miss").alias("miss")).withColumn(
        "hit_rate", F.when(F.col("candidate") > 0, F.col("hit") * 100.0 / F.col("candidate")).otherwise(0.0))


def evict_snapshot(snapshot: DataFrame, n: int = SNAPSHOT_LIMIT, order: str = "seq") -> DataFrame:
    """Keep the ``n`` most recently ordered distinct paths (the snapshot's size limit).

    Planned as TakeOrdered: every task keeps its best ``n``, no global sort and no single-task window.
    """
    latest = snapshot.where(ws_trim(F.col("rel_path")) != "").groupBy("skill_id", "rel_path").agg(F.max_by(F.struct(*[c for c in snapshot.columns if c not in ("skill_id", "rel_path")]), order).alias("m"))
    return latest.select("skill_id", "rel_path", "m.*").orderBy(F.desc(order), "skill_id", "rel_path").limit(n)


def content_key(files: DataFrame, skills: DataFrame, deps: DataFrame) -> DataFrame:
    """Cache key per skill from five hashes: name, description, permissions, files, dependencies.

    File and dependency sets are folded by an order-free combination of row hashes, so a skill with
    very many files needs no sorted list in one task.  All 256 bits of a row's hash enter the fold,
    as four sums of 64 bits each.
    """
    part = lambda h, i: F.sum(F.conv(F.substring(h, 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)")).cast("string")
    fold = lambda h: F.concat_ws("-", *[part(h, i) for i in range(4)], F.count("*").cast("string"))
    f = files.select("skill_id", F.sha2(F.concat_ws("\x1f", "path", "sha256"), 256).alias("h")).groupBy("skill_id").agg(fold(F.col("h")).alias("k_files"))
    d = deps.select("skill_id", F.sha2(F.concat_ws("\x1f", "name", "version"), 256).alias("h")).groupBy("skill_id").agg(fold(F.col("h")).alias("k_deps"))
    j = skills.join(f, "skill_id", "left").join(d, "skill_id", "left")
    grants = F.array_join(F.transform(F.sort_array(F.coalesce("permissions", F.array().cast("array<string>"))), lambda p: F.concat(F.length(p).cast("string"), F.lit(":"), p)), ",")
    hashed = [F.sha2(c, 256) for c in (F.coalesce("name", F.lit("")), F.coalesce("description", F.lit("")), grants, F.coalesce("k_files", F.lit("")), F.coalesce("k_deps", F.lit("")))]
    return j.select("skill_id", F.concat_ws(":", *hashed).alias("cache_key"))


def content_cache(requests: DataFrame, results: DataFrame, now: int) -> DataFrame:
    """Reusable results by key that have not expired (``results``: cache_key, expire_at, ...)."""
    return requests.join(results.where(F.col("expire_at") > now), "cache_key", "left").withColumn("cached", F.col("expire_at").isNotNull())
