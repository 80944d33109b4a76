"""Shared intermediate tables of the multi-step queries.

The text is scanned twice in all (rule packs, behaviour).  Hits are a small fraction of it and
are written once to the checkpoint folder; every later step reads them instead of scanning again.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import behavior as B
from ..operators import findings as FD
from ..operators import packs as P
from ..operators import review as R
from ..operators import scan, sets
from ..session import cut_lineage
from . import corpus as C

OBSERVED = ["network_targets", "file_targets", "exec_targets", "collection", "download", "outbound", "execute", "credential"]


def observed_of(facts: DataFrame) -> DataFrame:
    """Behaviour flags per skill."""
    return facts.groupBy("skill_id").agg(*[F.bool_or(F.col("category") == c).alias(c) for c in OBSERVED])


class Stage:
    """Lazily built tables over the seeded corpus; each is computed at most once."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.files, self.skills = C.seeded_files(spark, sf_dir), C.seeded_skills(spark, sf_dir)

    @cached_property
    def findings(self) -> DataFrame:
        return cut_lineage(FD.as_findings(scan.scan_packs(self.files, list(P.LINE_PACKS.values()))))

    @cached_property
    def facts(self) -> DataFrame:
        return cut_lineage(B.behavior_facts(self.files))

    @cached_property
    def points(self) -> DataFrame:
        return B.points_of(self.facts)

    @cached_property
    def signals(self) -> DataFrame:
        return B.signals_of(self.facts)

    @cached_property
    def segments(self) -> DataFrame:
        return cut_lineage(B.segments(self.points))

    @cached_property
    def observed(self) -> DataFrame:
        return observed_of(self.facts)

    @cached_property
    def diffs(self) -> DataFrame:
        return sets.intent_diffs(self.skills, self.observed)

    @cached_property
    def counts(self) -> DataFrame:
        return B.behavior_counts(self.segments)

    @cached_property
    def groups(self) -> DataFrame:
        return cut_lineage(FD.group_findings(self.findings))

    @cached_property
    def skill_flags(self) -> DataFrame:
        n = self.diffs.groupBy("skill_id").agg(F.count("*").alias("n_diffs"))
        ev = self.signals.select("skill_id").distinct().withColumn("evasion", F.lit(True))
        ti = self.observed.select("skill_id", F.col("network_targets").alias("has_ti"))
        out = self.skills.select("skill_id").join(ti, "skill_id", "left").join(n, "skill_id", "left").join(ev, "skill_id", "left")
        return out.fillna({"has_ti": False, "n_diffs": 0, "evasion": False})

    @cached_property
    def confident(self) -> DataFrame:
        support = FD.behavior_support(B.correlated(self.segments), B.sequence_alerts(self.segments))
        return FD.finding_confidence(FD.with_support(self.groups, support, self.skill_flags))

    @cached_property
    def assessed(self) -> DataFrame:
        return cut_lineage(R.assess(self.confident))

    @cached_property
    def analyses(self) -> DataFrame:
        """Stand-in for model analyses: one row per finding, graded by its count and category."""
        sev = F.when(F.col("n") > 3, F.array(F.lit("High"))).when(F.col("n") > 1, F.array(F.lit("medium"))).otherwise(F.array().cast("array<string>"))
        return self.groups.select("skill_id", "finding_id", sev.alias("risk_severities"), F.when(F.col("category") == "static", F.lit("none")).otherwise(F.lit("unclear")).alias("intent_risk_level"),
                                  (F.col("n") * 30 + 40).alias("intent_consistency"))

    @cached_property
    def consensus(self) -> DataFrame:
        return R.verdict_consensus(R.union_verdicts(R.external_verdicts(self.analyses), R.deterministic_verdict(self.assessed)))

    @cached_property
    def reviewed(self) -> DataFrame:
        return R.reviewed(self.assessed, self.consensus)
