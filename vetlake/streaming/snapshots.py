"""Snapshots of arriving files that a replayed batch leaves as they are.

Every micro-batch writes the fingerprints of its files to ``batch=<id>``, replacing that folder whole.  A
batch that runs again after a failure, with the same id and the same rows, therefore leaves one version of
each row.  The current state of a file is its row of the highest batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import language_of

SCHEMA = "skill_id string, rel_path string, language string, sha256 string, size long, arrived timestamp"


def batch_writer(root: str) -> Callable[[DataFrame, int], None]:
    """The function that writes one micro-batch of ``skill_id, path, content, arrived``."""

    def write(arrivals: DataFrame, batch_id: int) -> None:
        marked = arrivals.withColumn("language", language_of(F.col("path")))
        sized = marked.select("skill_id", F.col("path").alias("rel_path"), F.coalesce("language", F.lit("")).alias("language"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"), "arrived")
        # one row per file of a batch: the latest to arrive
        last = sized.groupBy("skill_id", "rel_path").agg(F.max(F.struct("arrived", "sha256", "language", "size")).alias("m"))
        last.select("skill_id", "rel_path", "m.language", "m.sha256", "m.size", "m.arrived").write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return write


def start(arrivals: DataFrame, root: str, checkpoint: str):
    """Follow a stream of arrivals into snapshots below ``root``."""
    return arrivals.writeStream.foreachBatch(batch_writer(root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_batches(spark: SparkSession, root: str) -> DataFrame:
    """All rows written so far with their batch."""
    return spark.read.schema(f"{SCHEMA}, batch long").parquet(root)


def latest(batches: DataFrame) -> DataFrame:
    """The current fingerprint of every file, as ``incremental.compare_files`` takes it, with its batch."""
    rest = [c for c in batches.columns if c not in ("skill_id", "rel_path", "batch")]
    newest = batches.groupBy("skill_id", "rel_path").agg(F.max(F.struct("batch", *rest)).alias("m"))
    return newest.select("skill_id", "rel_path", *[F.col(f"m.{c}").alias(c) for c in rest], "m.batch")
