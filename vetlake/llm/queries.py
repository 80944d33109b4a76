"""Registered queries of the operators, with SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_backtrack, centroid_ns, license_join, mixing, packing, posting_lists, quality_llr, sharding, simhash_bk, suffix_dedup, target_resample, token_attribution, toxicity_kn
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every sentence of every document."""
    return token_attribution.count_tokens(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    found = license_join.scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("n_blocks", F.size("blocks").cast("long")).drop("blocks")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies and taken words of every document in the mix."""
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed bytes and the hash of the rest of every document."""
    return suffix_dedup.measure(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, score and verdict of every document."""
    return quality_llr.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest others of every vector whose id is divisible by 20."""
    return posting_lists.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity_kn.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_bk.components(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document and their places."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the text they decode to, as hashes."""
    found = bpe_backtrack.round_trip(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector, exact distances and the final centroids."""
    found = centroid_ns.clusters(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.col("centroid").cast("binary"), 256).alias("centroid_sha256"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document in a sample towards the benchmark."""
    return target_resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_license_scan, op3_mixing, op4_suffix_dedup, op5_sharding, op6_quality, op7_nearest, op8_toxicity, op9_simhash, op10_packing, op11_bpe, op12_clusters, op13_resample)}
ORACLES: dict[str, str] = {"op2_license_scan": license_join.LICENSE_SQL, "op3_mixing": mixing.MIX_SQL, "op5_sharding": sharding.SHARD_SQL, "op12_clusters": centroid_ns.CLUSTER_SQL, "op13_resample": target_resample.RESAMPLE_SQL}
