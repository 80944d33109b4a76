"""Groups of any length: keys of selections, behaviour counts from segments, tables staged on the way."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import functions as F

from vetlake.operators import behavior as B
from vetlake.operators import combination as CB
from vetlake.operators import packs as P
from vetlake.session import shared_dir, stage_result, stage_table


def test_selection_keys_equal_the_expression(spark):
    rows = [(i % 4, f" m{i * 7 % 61}") for i in range(3000)] + [(9, None), (9, "  "), (8, ""), (8, "b"), (8, "a "), (None, "x"), (None, "x"), (None, "é")]
    df = spark.createDataFrame(rows, "owner long, member string").repartition(5)
    want = {}
    for o, m in rows:
        want.setdefault(o, set()).add((m or "").strip())
    want = {o: hashlib.sha1(",".join(sorted(ms - {""})).encode()).hexdigest() for o, ms in want.items()}
    got = CB.selection_keys(df, "owner", "member").collect()
    assert len(got) == len(want) and {r["owner"]: r["key"] for r in got} == want
    one = df.groupBy("owner").agg(F.collect_list("member").alias("ids")).select("owner", CB.selection_key(F.col("ids")).alias("key"))
    assert {r["owner"]: r["key"] for r in one.collect()} == want
    assert CB.selection_keys(df.where("false"), "owner", "member").count() == 0


def test_behavior_counts_come_from_segments(spark):
    cats = P.BEHAVIOR_CATEGORIES
    rows = [(f"s{i % 5}", f"f{i % 11}", (i * 37) % 900, cats[(i * i + i // 7) % len(cats)]) for i in range(1500)]
    points = spark.createDataFrame(rows, "skill_id string, path string, line_no long, category string")
    segs = B.segments(points, bucket=64)
    warnings = spark.createDataFrame([("s0", "w"), ("s0", "w"), ("s0", "v"), ("s9", "w")], "skill_id string, warning string")
    got = {r["skill_id"]: r.asDict() for r in B.behavior_counts(segs, warnings).collect()}
    alerts = B.sequence_alerts(segs).collect()
    chains = B.correlated(segs).groupBy("skill_id").count().collect()
    for s in ("s0", "s1", "s2", "s3", "s4"):
        assert {c: got[s][c] for c in cats} == {c: sum(1 for r in rows if r[0] == s and r[3] == c) for c in cats}
        assert got[s]["alerts"] == sum(r["skill_id"] == s for r in alerts)
        assert got[s]["veto_alerts"] == sum(r["skill_id"] == s and r["alert"] in B.VETO_ALERTS for r in alerts)
        assert got[s]["chains"] == sum(r["count"] for r in chains if r["skill_id"] == s)
    assert got["s0"]["warnings"] == 2 and got["s1"]["warnings"] == 0 and got["s9"]["warnings"] == 1 and got["s9"]["execute"] == 0
    plain = B.behavior_counts(segs).where("skill_id = 's1'").first().asDict()
    assert plain == {**got["s1"], "warnings": 0} and plain.keys() == {"skill_id", *B.RISK_INPUTS}
    assert B.behavior_counts(segs.where("false")).count() == 0


def test_stage_result_leaves_one_table(spark):
    folder = f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}".removeprefix("file:")
    held = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before = held()

    def build():
        first = stage_table(spark.range(10), "first")
        return stage_result(spark, lambda: stage_table(first.where("id > 2"), "inner").where("id > 4"), "nested").where("id > 6")

    out = stage_result(spark, build, "kept")
    assert [r["id"] for r in out.orderBy("id").collect()] == [7, 8, 9]
    assert [n.rpartition("-")[0] for n in held() - before] == ["kept"]
