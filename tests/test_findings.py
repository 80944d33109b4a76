import pytest
from pyspark.sql import functions as F

from vetlake.operators import admission as A
from vetlake.operators import combination as CB
from vetlake.operators import findings as FD
from vetlake.operators import review as R
from vetlake.operators import scoring as S


@pytest.mark.parametrize("row,level,adm", [((95.0, 0.0, 95.0, 0.0, False), "low", "Pass"), ((10.0, 30.0, 20.0, -50.0, False), "medium", "Review"), ((90.0, 0.0, 90.0, 0.0, True), "high", "Block")])
def test_trust_score(spark, row, level, adm):
    r = S.trust_score(spark.createDataFrame([row], "base double, p1 double, ics double, ti double, veto boolean")).first()
    assert (r["risk_level"], r["admission"]) == (level, adm)


@pytest.mark.parametrize("row,want", [
    ((0, 0, 1, 0, False, False, False, False, False, False), (0, 0, 1)), ((0, 0, 1, 0, False, True, False, False, False, False), (0, 1, 1)),
    ((0, 1, 0, 0, False, False, True, True, False, True), (1, 2, 0)), ((0, 0, 0, 2, True, False, False, False, False, False), (1, 0, 0)), ((0, 0, 0, 1, False, False, False, False, False, False), (0, 1, 0)),
])
def test_calibrated_counts(spark, row, want):
    r = S.calibrated_counts(spark.createDataFrame([row], "high int, medium int, low int, n_diffs int, high_risk_diff boolean, suspicious boolean, moderate boolean, malicious boolean, veto boolean, evasion boolean")).first()
    assert (r["high"], r["medium"], r["low"]) == want


def test_risk_by_counts_veto(spark):
    r = S.risk_by_counts(spark.createDataFrame([(0, 0, 0, True)], "high int, medium int, low int, veto boolean")).first()
    assert r["high"] == 1 and r["risk_level"] == "high" and abs(r["risk_score"] - 1.0) < 1e-9


ASSESSED = ("skill_id string, finding_id string, rule_id string, severity string, title string, description string, source string, category string, n int, evidence array<string>, "
            "has_chain boolean, has_alert boolean, high_signal boolean, threat_alert boolean, has_ti boolean, n_diffs int, evasion boolean")


def finding(spark, rows):
    return R.assess(FD.finding_confidence(spark.createDataFrame(rows, ASSESSED)))


def row(fid, sev, cat, ev, n=1, chain=False, alert=False, sig=False):
    return ("s", fid, "V7-021", sev, "t", "d", "engine", cat, n, ev, chain, alert, sig, False, False, 0, False)


def test_review_rules(spark):
    a = finding(spark, [
        row("doc", "medium", "static", ["docs/readme.md:1 example"]), row("strong", "high", "execution", ["run.py:3 exec"], 2, True, True, True),
        row("weak", "medium", "static", []), row("local", "high", "static", ["a.py:1 http://127.0.0.1"]), row("plain", "high", "static", ["a.py:2 foo"]),
    ])
    v = {r["finding_id"]: (r["verdict"], r["confidence"], len(r["missing"])) for r in R.deterministic_verdict(a).collect()}
    assert v["doc"][0] == "likely_false_positive" and v["local"][0] == "likely_false_positive"
    assert v["strong"][:2] == ("confirmed", "medium_high")
    assert v["weak"][0] == "needs_manual_review" and v["weak"][2] == 2
    assert v["plain"] == ("needs_manual_review", "medium", 1)
    cons = R.verdict_consensus(R.deterministic_verdict(a).withColumn("seq", F.lit(0)))
    rev = R.reviewed(a, cons)
    assert {r["finding_id"]: r["tier"] for r in rev.collect()} == {"doc": "weak", "strong": "strong", "weak": "weak", "local": "moderate", "plain": "moderate"}
    c = R.reviewed_counts(rev).first()
    assert (c["high"], c["medium"], c["low"]) == (1, 1, 3)
    fb = sorted((r["rule_id"], r["token"]) for r in R.learn_feedback(rev).collect())
    assert fb == [("V7-021", "127.0.0.1"), ("V7-021", "docs/"), ("V7-021", "readme.md")]


def test_consensus_conflict(spark):
    v = spark.createDataFrame([("s", "f", 0, "confirmed", "high", "llm-x", ["m1"]), ("s", "f", 1, "likely_false_positive", "medium", "deterministic-y", ["m2"]), ("s", "g", 0, "odd", "low", "", []), ("s", "g", 1, "needs_manual_review", "low", "", [])],
                              "skill_id string, finding_id string, seq int, verdict string, confidence string, reviewer string, missing array<string>")
    got = {r["finding_id"]: r for r in R.verdict_consensus(v).collect()}
    assert (got["f"]["verdict"], got["f"]["confidence"], got["f"]["reviewer"], got["f"]["missing"]) == ("needs_manual_review", "low", "deterministic-y+llm-x", ["m1", "m2"])
    assert got["g"]["verdict"] == "odd"


def test_group_findings_order_and_license_merge(spark):
    lic = FD.LICENSE_TITLE
    rows = [("s", "e", "V7-005", "high", lic, "d", "b.py", 2, 2, "x"), ("s", "e", "V7-001", "high", lic, "d", "a.py", 1, 1, "y"), ("s", "e", "V7-020", "medium", "q", "d", "a.py", 5, 5, "z")]
    df = spark.createDataFrame(rows, "skill_id string, source string, rule_id string, severity string, title string, description string, path string, line_start int, line_end int, code_snippet string")
    got = [(r["finding_id"], r["rule_id"], r["n"]) for r in FD.group_findings(df).orderBy("finding_id").collect()]
    assert got == [("SF-001", "V7-001", 2), ("SF-002", "V7-020", 1)]


def test_verdict_looks_at_all_evidence(spark):
    rows = [("s", "e", "V7-021", "high", "q", "d", "docs/a.md", i, i, "x") for i in range(6)] + [("s", "e", "V7-021", "high", "q", "d", "src/m.py", i, i, "x") for i in range(500)]
    df = spark.createDataFrame(rows, "skill_id string, source string, rule_id string, severity string, title string, description string, path string, line_start int, line_end int, code_snippet string")
    g = FD.group_findings(df).first()
    assert g["n"] == 506 and len(g["evidence"]) == 6 and not g["seen"]["docs"] and g["seen"]["tokens"] == ["docs/"]
    only = FD.group_findings(df.where("path = 'docs/a.md'")).first()
    assert only["seen"]["docs"]


def profile(sid, net=False, wr=False, ex=False, sens=False, ev=()):
    return (sid, net, False, wr, ex, sens, False, False, False, False, False, [], list(ev))


PROFILE = "skill_id string, network_access boolean, file_read boolean, file_write boolean, command_exec boolean, sensitive_data_access boolean, external_fetch boolean, data_collection boolean, persistence boolean, privilege_use boolean, tool_invocation boolean, tags array<string>, evidence array<string>"


@pytest.mark.parametrize("profiles,want", [
    ([profile("a", net=True, ev=["note only"]), profile("b", ex=True, ev=["misc only"])], []),
    ([profile("a", net=True, ev=["http://x"]), profile("b", ex=True, ev=["unrelated"])], []),
    ([profile("a", wr=True, ex=True, ev=["drop payload", "exec it"]), profile("b", net=True, ev=["http://x"])], ["remote-command-chain", "write-exec-chain"]),
    ([profile("a", net=True, sens=True, ev=["http://x", "token read"]), profile("b", ex=True, ev=["exec shell"])], ["full-attack-chain"]),
    ([profile("a", net=True, sens=True, wr=True, ex=True, ev=["http://x", "token", "exec", "write"]), profile("b", ev=[])], ["full-attack-chain", "write-exec-chain"]),
])
def test_chains(spark, profiles, want):
    p = spark.createDataFrame(profiles, PROFILE)
    sel = p.select(F.lit("sel").alias("selection_id"), "skill_id")
    got = [r["chain_id"] for r in CB.fold_chains(CB.infer_chains(CB.selected_profiles(sel, p))).collect()]
    assert got == want


def test_merge_profiles_is_associative_and_key_order_free(spark):
    p = spark.createDataFrame([profile("a", net=True, ev=["x"]), profile("b", ex=True, ev=["x", "y"]), profile("c", wr=True)], PROFILE)
    sel = lambda ids: p.where(F.col("skill_id").isin(ids)).select(F.lit("s").alias("selection_id"), "skill_id")
    whole = CB.merge_profiles(CB.selected_profiles(sel(["a", "b", "c"]), p)).first()
    assert whole["tags"] == ["network_access", "file_write", "command_exec"] and whole["n_evidence"] == 2
    k = lambda ids: spark.range(1).select(CB.selection_key(F.array(*[F.lit(i) for i in ids]))).first()[0]
    assert k(["b", "a", "a"]) == k(["a", "b"]) == k([" a ", "b", ""])


def test_pairwise_counts_match_listing(spark):
    rows = [profile(f"s{i:02d}", net=i % 2 == 0, ex=i % 3 == 0, wr=i % 5 == 0, sens=i % 7 == 0) for i in range(40)]
    p = spark.createDataFrame(rows, PROFILE)
    flags = {r["skill_id"]: r.asDict() for r in p.collect()}
    for r in CB.pairwise_summary(p).collect():
        a, b = r["pair"].split("+")
        ids = sorted(flags)
        want = sum(1 for i, x in enumerate(ids) for y in ids[i + 1:] if (flags[x][a] and flags[y][b]) or (flags[x][b] and flags[y][a]))
        assert r["n_pairs"] == want


def test_visibility(spark):
    rep = spark.createDataFrame([("1", "ann", "t1"), ("2", "bob", "t1"), ("3", "cat", "")], "report_id string, username string, team string")
    users = spark.createDataFrame([("ann", "t1", "user"), ("cat", "", "user"), ("root", "", "admin")], "username string, team string, role string")
    see = lambda who: sorted((r["report_id"], r["can_delete"]) for r in A.visible_reports(rep, users, who).collect())
    assert see("ann") == [("1", True), ("2", False)] and see("cat") == [("3", True)]
    assert see("root") == [("1", True), ("2", True), ("3", True)] and see("bob") == [("2", False)]


def test_skill_records(spark):
    reg = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "skill_id string, name string")
    rec = spark.createDataFrame([("a", "r1", 5), ("a", "r2", 9), ("a", "r3", 9), ("b", "r4", None), ("x", "r5", 1)], "skill_id string, record_id string, created_at long")
    got = sorted((tuple(r[c] for c in ("skill_id", "record_id", "name", "n_records", "is_last")) for r in A.skill_records(reg, rec).collect()), key=str)
    assert got == [("a", "r1", "A", 3, False), ("a", "r2", "A", 3, True), ("a", "r3", "A", 3, True), ("b", "r4", "B", 1, None), ("c", None, "C", 0, None)]
    empty = A.skill_records(reg, rec.limit(0)).collect()
    assert sorted((r["skill_id"], r["n_records"], r["record_id"]) for r in empty) == [("a", 0, None), ("b", 0, None), ("c", 0, None)]
