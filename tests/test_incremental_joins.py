"""Comparison of bucketed tables without a shuffle, and as-of reuse against a plain search."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vetlake.functions.literals import guarded_match, required_literals
from vetlake.functions.text import matches_any
from vetlake.operators import asof, packs
from vetlake.operators import incremental as INC

RND = random.Random(41)


def test_bucketed_comparison_moves_no_row(spark):
    rows = [(f"s{i % 7}", f"f{i}", "go", f"h{i}", i) for i in range(500)]
    schema = "skill_id string, rel_path string, language string, sha256 string, size long"
    now, then = spark.createDataFrame(rows, schema), spark.createDataFrame([(*r[:3], r[3] if i % 5 else "old", r[4]) for i, r in enumerate(rows) if i % 11], schema)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = INC.changed_files(INC.bucketed(now, "t_now", 8), INC.bucketed(then, "t_then", 8))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, INC.changed_files(now, then).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("t_now", "t_then"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_asof_equals_a_search(spark, width):
    keys = ["hot"] * 6 + ["a", "b", "only requests"]
    rq = [(i, RND.choice(keys), RND.randrange(300), f"q{i}") for i in range(400)] + [(900, None, 5, "x"), (901, "hot", None, "x")]
    rs = [(RND.choice([k for k in keys if k != "only requests"]), RND.randrange(300), RND.randrange(9), RND.choice([None, "u", "v"])) for _ in range(120)] + [(None, 1, 1, "n"), ("hot", None, 1, "n")]
    requests = spark.createDataFrame(rq, "id long, k string, at long, note string").repartition(3)
    results = spark.createDataFrame(rs, "k string, at long, grade long, note string")
    got = {r["id"]: None if r["result"] is None else (r["result"]["at"], r["result"]["grade"], r["result"]["note"]) for r in asof.asof(requests, results, "k", "at", width).collect()}
    order = lambda t: (t[0], t[1], t[2] is not None, t[2] or "")
    want = {i: max(((a, g, n) for key, a, g, n in rs if key == k and k is not None and a is not None and at is not None and a <= at), key=order, default=None) for i, k, at, _ in rq}
    assert got == want


def test_reuse_is_judged_at_the_time_of_the_request(spark):
    requests = spark.createDataFrame([("k", 10, 1), ("k", 19, 2), ("k", 20, 3), ("k", 9, 4)], "cache_key string, at long, id long")
    results = spark.createDataFrame([("k", 10, "r")], "cache_key string, at long, level string")
    got = {r["id"]: r["cached"] for r in asof.reusable(requests, results, 10).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}
    assert [r["cached"] for r in asof.reusable(requests, results.limit(0), 10).collect()] == [False] * 4


def test_word_guard_gives_the_same_hits(spark):
    pats = [rx for p in packs.LINE_PACKS.values() for rx, _ in p.patterns] + [r"^x$", r"(?i)\bab\b"]
    assert all(required_literals(p) for p in pats if "password" in p)
    lines = ["password = 'abc'", "API_KEY: \"x\"", "pwd:='q'", "Private-Key='k'", "open('../x')", "x", "AB", "xab", "", "usdc", "ERC20", "eval(json.loads(q))", "logger.info(token)", "verify=False", "http://a", "nothing here"]
    df = spark.createDataFrame([(a + RND.choice(["", " ", b]),) for a in lines for b in lines], "line string")
    assert df.where(guarded_match(F.col("line"), pats)).count() == df.where(matches_any(F.col("line"), pats)).count() > 50
    both = df.select(guarded_match(F.col("line"), pats).alias("a"), matches_any(F.col("line"), pats).alias("b"))
    assert both.where("a <> b").count() == 0


def test_number_of_blocks_does_not_follow_the_texts():
    from vetlake.operators import signatures

    assert [signatures.block_count(n) for n in (0, 100, 800)] == [8, 8, 50]
    assert signatures.block_count(3_000_000) < 1000


def test_signatures_leave_out_blocks_but_no_hit(spark):
    from vetlake.operators import scan, signatures

    words = ["alpha", "beta", "gamma", "delta", "tok", "open", "password", "ünïcode"]
    rows = [(f"s{i // 40}", f"f{i:03d}", " ".join(RND.choice(words) for _ in range(30)) + ("\nTOKEN = 'x'" if i in (17, 350) else "")) for i in range(400)] + [("s0", "empty", ""), ("s1", "null", None), ("s2", "ab", "ab")]
    files = spark.createDataFrame(rows, "skill_id string, path string, content string").repartition(3)
    signed = signatures.sign(files, 40)

    hits = lambda df, rx: sorted(map(tuple, scan.explode_lines(df).where(F.col("line").rlike(rx)).collect()))
    kept = signatures.may_hold(signed, [r"(?i)token\s*="])
    assert hits(kept, r"(?i)token\s*=") == hits(files, r"(?i)token\s*=") and len(hits(kept, r"(?i)token\s*=")) == 2
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [block" in plan
    paths = {r["f"] for r in kept.select(F.input_file_name().alias("f")).distinct().collect()}
    assert 1 <= len(paths) <= 8 < len(signed.texts.inputFiles())
    assert hits(signatures.may_hold(signed, [r"a.z", r"token"]), "beta$") == hits(files, "beta$")  # no words: every block
    assert signatures.may_hold(signed, ["zzzzzz"]).count() == 0
