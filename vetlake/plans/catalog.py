"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import q_behavior, q_findings, q_registry, q_rules, q_scan  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity counts per source over credential, TLS and network-target evidence."""
    return QUERIES["scan_all_packs"](spark, sf_dir)
