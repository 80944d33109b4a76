from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from vetlake.session import build_session  # noqa: E402
from vetlake.sources.artifacts import artifacts_from_table  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    from pyspark.sql import functions as F

    def make(rows):
        """rows: (skill, path, content)"""
        df = spark.createDataFrame(rows, "skill string, p string, c string")
        return artifacts_from_table(df, F.col("skill"), F.col("p"), F.col("c"))

    return make


@pytest.fixture(scope="session")
def make_skills(spark):
    def make(rows):
        """rows: (skill, name, description, permissions)"""
        return spark.createDataFrame(rows, "skill_id string, name string, description string, permissions array<string>")

    return make
