"""Scores and risk levels as Column expressions and small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_severity
from ..functions.vectors import cosine


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(c, F.lit(float(hi))), F.lit(float(lo)))


# Risk score cut-offs.
CRITICAL, HIGH, MEDIUM = 8.5, 7.0, 4.0


def trust_score(df: DataFrame) -> DataFrame:
    """Weighted trust with exploitability and impact; inputs base, p1, ics, ti, veto."""
    trust = F.when(F.col("veto"), F.lit(0.0)).otherwise(
        clamp((F.col("base") - F.col("p1")) * 0.6 + F.col("ics") * 0.3 + (100 + F.col("ti")) * 0.1, 0, 100))
    exploit = clamp(2.0 + F.when(F.col("veto"), 4.0).otherwise(0.0) + clamp(F.col("p1") / 20.0, 0, 2.5) + clamp(F.col("ics") / 100.0 * 1.5, 0, 1.5), 0, 10)
    impact = clamp(1.5 + clamp((100 - F.col("base")) / 20.0, 0, 3.0) + F.when(F.col("ti") < 0, clamp(-F.col("ti") / 20.0, 0, 2.0)).otherwise(0.0), 0, 10)
    out = df.withColumns({"trust": trust, "exploitability": exploit, "impact": impact})
    out = out.withColumn("risk_score", clamp(F.col("exploitability") * 0.6 + F.col("impact") * 0.4, 0, 10))
    r = F.col("risk_score")
    level = (F.when(F.col("veto"), F.lit("high")).when(r >= CRITICAL, F.lit("critical")).when(r >= HIGH, F.lit("high"))
             .when(r >= MEDIUM, F.lit("medium")).otherwise(F.lit("low")))
    return out.withColumn("risk_level", level).withColumn("admission", admission(F.col("risk_level")))


def admission(level: Column) -> Column:
    return F.when(level.isin("critical", "high"), F.lit("Block")).when(level == "medium", F.lit("Review")).otherwise(F.lit("Pass"))


def risk_by_counts(df: DataFrame) -> DataFrame:
    """Risk from high, medium, low counts and veto; a veto without high findings sets high = 1 after the score."""
    h, m, l = F.col("high"), F.col("medium"), F.col("low")
    out = df.withColumns({
        "exploitability": clamp(h * 3.0 + m * 1.2 + 1.0, 0, 10),
        "impact": clamp(h * 2.5 + m * 1.0 + l * 0.2 + 1.0, 0, 10),
    })
    out = out.withColumn("risk_score", clamp(F.col("exploitability") * 0.6 + F.col("impact") * 0.4, 0, 10))
    out = out.withColumn("high", F.when(F.col("veto") & (h == 0), F.lit(1)).otherwise(h))
    level = (F.when(F.col("risk_score") >= CRITICAL, F.lit("critical")).when(F.col("high") > 0, F.lit("high"))
             .when(m > 0, F.lit("medium")).otherwise(F.lit("low")))
    return out.withColumn("risk_level", level).withColumn("admission", admission(F.col("risk_level")))


def count_risks(findings: DataFrame, key: str = "skill_id") -> DataFrame:
    """High / medium / low counts per key; both spellings, anything else is low."""
    s = normalize_severity(F.col("severity"))
    return findings.groupBy(key).agg(F.count_if(s == "high").alias("high"), F.count_if(s == "medium").alias("medium"),
                                     F.count_if(~s.isin("high", "medium")).alias("low"))


def calibrated_counts(df: DataFrame) -> DataFrame:
    """Raise counts by intent differences, suspicious reputation, moderate behaviour and vetoes.

    Inputs: high, medium, low, n_diffs, high_risk_diff, suspicious, moderate, malicious, veto, evasion.
    """
    up = lambda c: c.cast("int")
    high_diff = F.col("high_risk_diff")
    return df.withColumns({
        "high": F.col("high") + up(high_diff) + up(F.col("malicious") | F.col("veto") | F.col("evasion")),
        "medium": F.col("medium") + up(~high_diff & (F.col("n_diffs") > 0)) + up(F.col("suspicious")) + up(F.col("moderate")),
    })


def aggregate_risk(findings: DataFrame, key: str = "skill_id") -> DataFrame:
    """Blocked -> high, else the highest severity (``findings``: key, severity, blocked)."""
    return findings.groupBy(key).agg(
        F.bool_or("blocked").alias("blocked"), F.bool_or(F.col("severity") == "high").alias("h"), F.bool_or(F.col("severity") == "medium").alias("m"),
    ).select(key, "blocked", F.when(F.col("blocked") | F.col("h"), F.lit("high")).when(F.col("m"), F.lit("medium")).otherwise(F.lit("low")).alias("risk_level"))


# Similarity bounds.
SIMILARITY_LOW, SIMILARITY_HIGH = 0.5, 0.75


def semantic_band(sim: Column, low: float = SIMILARITY_LOW, high: float = SIMILARITY_HIGH) -> Column:
    return F.when(sim < low, F.lit("fail")).when(sim < high, F.lit("half")).otherwise(F.lit("full"))


def semantic_alignment(pairs: DataFrame, low: float = SIMILARITY_LOW, high: float = SIMILARITY_HIGH, weight: float = 1.0) -> DataFrame:
    """Description vector against code vector -> band and weighted score (``pairs``: a, b arrays)."""
    out = pairs.withColumn("similarity", cosine(F.col("a"), F.col("b")))
    out = out.withColumn("band", semantic_band(F.col("similarity"), low, high))
    return out.withColumn("score", F.when(F.col("band") == "fail", 0.0).when(F.col("band") == "half", weight / 2).otherwise(weight)).drop("a", "b")


def item_scores(evaluated: DataFrame) -> DataFrame:
    """Rule -> score map per skill (``evaluated``: skill_id, rule_id, score); bounded by the rule list."""
    entries = F.array_sort(F.collect_list(F.struct("rule_id", "score")))
    return evaluated.groupBy("skill_id").agg(F.map_from_entries(entries).alias("item_scores"))


def unchecked_rules(rule_ids: list[str], evaluated: DataFrame, skills: DataFrame) -> DataFrame:
    """Catalogue rules not evaluated per skill; the id list is unrolled as a literal array."""
    grid = skills.select("skill_id", F.explode(F.array(*[F.lit(r) for r in rule_ids])).alias("rule_id"))
    return grid.join(evaluated.select("skill_id", "rule_id").distinct(), ["skill_id", "rule_id"], "left_anti")
