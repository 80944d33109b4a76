from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vetlake.operators import packs as P
from vetlake.operators import rules
from vetlake.operators.detectors import Detectors
from vetlake.sources.artifacts import read_artifacts


def test_enable_and_disable(make_files):
    known = Detectors()
    known.register_rule_pack("own", lambda f: f.select("skill_id", "path", F.lit(1).alias("line_no"), F.lit("OWN").alias("rule_id"), F.lit("low").alias("severity"), F.lit("any").alias("label")))
    with pytest.raises(ValueError):
        known.register_rule_pack("own", P.HARDCODED_CREDENTIALS)
    with pytest.raises(ValueError):
        known.names(enabled=["nobody"])
    key = next(iter(P.LINE_PACKS))
    assert known.names([key, "own"], [key]) == ["own"]
    files = make_files([("s", "a.py", "x = 1"), ("t", "b.py", "y")])
    assert sorted((r["skill_id"], r["pack"]) for r in known.run(files, ["own"]).collect()) == [("s", "own"), ("t", "own")]
    assert known.run(files, ["own"], ["own"]) is None


def test_too_many_rules_are_an_error():
    import json

    item = {"name": "n", "severity": "high", "patterns": ["x"]}
    assert len(rules.parse_custom_rules(json.dumps([item] * rules.MAX_CUSTOM_RULES))) == rules.MAX_CUSTOM_RULES
    for bad in ([item] * (rules.MAX_CUSTOM_RULES + 1), [item | {"patterns": ["x"] * (rules.MAX_CUSTOM_PATTERNS + 1)}], [item | {"patterns": ["[[:odd:]]"]}]):
        with pytest.raises(ValueError):
            rules.parse_custom_rules(json.dumps(bad))


def test_root_name_further_down(spark, tmp_path):
    root = tmp_path / "data"
    (root / "a" / "data").mkdir(parents=True)
    (root / "a" / "data" / "f.py").write_text("x = 1")
    rows = [(r["skill_id"], r["path"]) for r in read_artifacts(spark, str(root)).collect()]
    assert rows == [("a", "data/f.py")]
