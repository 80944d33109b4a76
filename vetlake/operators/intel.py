"""Reputation of network targets: local rules, indicator feeds, merge and score adjustment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, ws_trim
from .behavior import line_targets

# Local reputation rules, thresholds and weights.
POLICY_TARGETS = ["clob.polymarket.com", "polymarket.com", "0x2791bca1f2de4661ed88a30c99a7a9449aa84174", "usdc"]
PASTE_HOSTS = ["pastebin", "anonfiles", "transfer.sh"]
LOOPBACK = ["0.0.0.0", "127.0.0.1", "localhost", "::1"]
CODE_HOST, RAW_HOST = "github.com", "raw.githubusercontent.com"
DOWNLOAD_SUFFIXES = [".zip", ".tar.gz", ".tgz"]
RANK = {"malicious": 6, "high-risk": 6, "suspicious": 5, "policy": 4, "unknown": 3, "internal": 2, "trusted": 1, "benign": 1}
THREAT = ["malicious", "high-risk", "suspicious"]
FEED_CONFIDENCE = {"feed1": 0.9, "feed2": 0.85}
FEED_MISS_CONFIDENCE, MISSING_CONFIDENCE = 0.6, 0.4
MALICIOUS_MIN_CONFIDENCE = 0.85
ADJUST_MIN, ADJUST_MAX = -30.0, 10.0


def url_host(target: Column) -> Column:
    """Host with port, lower-cased; empty when the target is not an absolute URL."""
    return F.lower(F.regexp_extract(target, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def url_path(target: Column) -> Column:
    """Lower-cased path without repeated or trailing slashes; ``/`` for none."""
    p = F.regexp_replace(F.regexp_extract(target, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+", "/")
    p = F.regexp_replace(p, "(.)/$", "$1")
    return F.lower(F.when(p == "", F.lit("/")).otherwise(p))


def local_reputation(targets: DataFrame) -> DataFrame:
    """Ordered local rules: adds ``reputation`` and ``confidence`` to rows with a ``target``."""
    t, host, path = F.lower("target"), url_host(F.col("target")), url_path(F.col("target"))
    parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    landing = (F.size(parts) <= 2) | F.get(parts, F.lit(2)).isin("tree", "blob")
    download = path.contains("/releases/download/") | any_of(path.endswith(s) for s in DOWNLOAD_SUFFIXES)
    rule = lambda rep, conf: F.struct(F.lit(rep).alias("reputation"), F.lit(conf).alias("confidence"))
    r = (
        F.when(any_of(t.contains(x) for x in POLICY_TARGETS), rule("policy", 0.9))
        .when(any_of(t.contains(x) for x in PASTE_HOSTS), rule("suspicious", 0.8))
        .when(any_of(t.contains(x) for x in LOOPBACK), rule("internal", 0.9))
        .when(host == RAW_HOST, rule("suspicious", 0.8))
        .when((host == CODE_HOST) & download, rule("suspicious", 0.78))
        .when((host == CODE_HOST) & landing, rule("trusted", 0.6))
        .when(host == CODE_HOST, rule("unknown", 0.55))
        .when(t.contains("http://"), rule("benign", 0.6))
        .otherwise(rule("unknown", 0.5))
    )
    return targets.withColumn("_r", r).withColumns({"reputation": F.col("_r.reputation"), "confidence": F.col("_r.confidence")}).drop("_r")


def feed_reputation(targets: DataFrame, feed: DataFrame, name: str) -> DataFrame:
    """Indicator match -> suspicious with the feed's confidence, otherwise unknown.

    Plain equi join: the optimizer broadcasts the feed when its statistics allow and
    shuffles it otherwise.
    """
    ind = feed.select(F.col("indicator").alias("target")).distinct().withColumn("_hit", F.lit(True))
    return targets.join(ind, "target", "left").select(
        "target",
        F.when(F.col("_hit"), F.lit("suspicious")).otherwise(F.lit("unknown")).alias("reputation"),
        F.when(F.col("_hit"), F.lit(FEED_CONFIDENCE[name])).otherwise(F.lit(FEED_MISS_CONFIDENCE)).alias("confidence"),
    )


def reputation_rank(rep: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(ws_trim(rep))), F.lit(0))


def _clamped(conf: Column) -> Column:
    return F.greatest(F.least(conf, F.lit(1.0)), F.lit(0.0))


def merge_reputations(providers: list[DataFrame]) -> DataFrame:
    """Best reputation per target by (rank, clamped confidence); the first provider wins ties.

    One union and one ``max`` of a struct: partial aggregation, no window.
    """
    out = None
    for i, p in enumerate(providers):
        part = p.select(ws_trim(F.col("target")).alias("target"), "reputation", _clamped(F.col("confidence")).alias("confidence"), F.lit(-i).alias("_order"))
        out = part if out is None else out.unionByName(part)
    best = F.max(F.struct(reputation_rank(F.col("reputation")), "confidence", "_order", "reputation"))
    return out.where("target <> ''").groupBy("target").agg(best.alias("m")).select("target", F.col("m.reputation").alias("reputation"), F.col("m.confidence").alias("confidence"))


def semantics(rep: Column) -> Column:
    r = F.lower(ws_trim(rep))
    return (F.when(r.isin(THREAT), F.lit("threat")).when(r == "policy", F.lit("policy")).when(r == "internal", F.lit("internal"))
            .when(r.isin("trusted", "benign"), F.lit("benign")).otherwise(F.lit("unknown")))


def score_adjustment(rep: Column, conf: Column) -> Column:
    c, r = _clamped(conf), F.lower(ws_trim(rep))
    return (F.when(r.isin("malicious", "high-risk"), c * -10).when(r == "suspicious", c * -8).when(r == "policy", c * -3)
            .when(r == "unknown", F.lit(-1.0)).when(r.isin("trusted", "internal", "benign"), c * 2).otherwise(F.lit(0.0)))


def ti_adjustment(targets: DataFrame, reputations: DataFrame, owner: str = "skill_id") -> DataFrame:
    """Clamped score adjustment and malicious flag per owner; targets without a row count as unknown.

    ``targets``: owner, target (distinct pairs).
    """
    j = targets.select(owner, "target").distinct().join(reputations, "target", "left")
    rep = F.coalesce("reputation", F.lit("unknown"))
    conf = F.coalesce("confidence", F.lit(MISSING_CONFIDENCE))
    total = F.sum(score_adjustment(rep, conf))
    return j.groupBy(owner).agg(
        F.count("*").alias("n_targets"),
        F.greatest(F.least(total, F.lit(ADJUST_MAX)), F.lit(ADJUST_MIN)).alias("adjustment"),
        F.bool_or(F.lower(ws_trim(rep)).isin(THREAT) & (conf >= MALICIOUS_MIN_CONFIDENCE)).alias("malicious"),
        F.bool_or(F.lower(ws_trim(rep)).isin(THREAT)).alias("suspicious"),
    )


def finding_reputation(findings: DataFrame, reputations: DataFrame, key: str = "finding_id") -> DataFrame:
    """Reputation of the first target (in text order) that a finding's evidence names.

    Targets are extracted from the evidence and equi-joined; a ``contains`` join of findings
    with targets would be a nested loop.  ``findings``: key, evidence (text).
    """
    hits = findings.select(key, F.explode(F.array_distinct(F.transform(line_targets(F.col("evidence")), F.lower))).alias("_t"))
    reps = reputations.select(F.lower(ws_trim(F.col("target"))).alias("_t"), "reputation")
    return hits.join(reps, "_t").groupBy(key).agg(F.min_by("reputation", "_t").alias("reputation"))
