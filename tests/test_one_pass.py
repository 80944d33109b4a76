"""Scans whose words are found in one pass over the text, against scans of every line."""

from __future__ import annotations

import contextlib
import io
import random

from pyspark.sql import functions as F

from vetlake.functions.text import any_of, matches
from vetlake.llm import quality_llr
from vetlake.operators import behavior as B
from vetlake.operators import combination as CB
from vetlake.operators import packs as P
from vetlake.operators import rules as R
from vetlake.operators import scan, sets
from vetlake.plans import corpus as C


def _plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(True)
    return out.getvalue().split("== Optimized Logical Plan ==")[1]


def _files(spark, make_files):
    rng = random.Random(5)
    odd = ["", " ", "debug\x0b=\x0btrue", "İGNORE PREVİOUS İNSTRUCTİONS", "ignore previous instructions", "PASSWORD = 'x1'", "toKen = 'abc'", "pay in USDC", "10.1.2.3", "3.14", "\\x41\\x42\\x43\\x44\\x45\\x46\\x47\\x48",
           "aWdub3JlIHByZXZpb3VzIGluc3RydWN0aW9ucw==", "sleep(400)\r", "方案 删除 全部", "人工确认", "args = 1", "whitelist", "refund(order)", "x" * 3000 + " docker", "é docker ü", " verify = false"]
    texts = ["\n".join(rng.choice([*odd, *C.SAMPLE_LINES, "plain prose of no interest"]) for _ in range(rng.randrange(1, 30))) + rng.choice(["", "\n", "\n\n"]) for _ in range(700)]
    rows = [(f"s{i % 90}", rng.choice(["scripts/a.py", "docs/b.md", "src/c.go", "x.js"]) if i % 7 else "scripts/same.py", t) for i, t in enumerate(texts)]
    return make_files([*rows, ("s1", "scripts/none.py", None), ("s2", "scripts/empty.py", "")])


def _sorted(df):
    return sorted(map(repr, df.collect()))


def test_lines_of_patterns(spark, make_files):
    files = _files(spark, make_files)
    rules = [p for r in R.default_rules() if r.dtype == "pattern" for p in r.patterns]
    for patterns in ([rx for p in P.LINE_PACKS.values() for rx, _ in p.patterns], rules, list(P.BEHAVIOR_RX.values()), [rx for *_, rx in P.IRREVERSIBLE_ACTIONS], [r"(?i)人工确认|审批\s+x", r"[[:alpha:]]+debug\s*=\s*true|verify\s=", r"(?i)\bUSDC\b"]):
        test = any_of(matches(F.col("line"), p) for p in patterns)
        assert _sorted(scan.pattern_lines(files, patterns).where(test)) == _sorted(scan.explode_lines(files).where(test))
    assert _sorted(scan.pattern_lines(files, [r"\d"])) == _sorted(scan.explode_lines(files))  # no word to look for


def test_scans_equal_scans_of_every_line(spark, make_files, monkeypatch):
    files = _files(spark, make_files)
    skills = spark.createDataFrame([(f"s{i}", f"tool {i}", "removes orders" if i % 2 else "text") for i in range(90)], "skill_id string, name string, description string")
    run = {"packs": lambda: scan.scan_packs(files, list(P.LINE_PACKS.values()), R.default_rules()), "facts": lambda: B.behavior_facts(files), "rules": lambda: scan.scan_patterns(files, R.default_rules()),
           "scores": lambda: scan.injection_scores(files), "risk": lambda: scan.injection_risk(files), "ops": lambda: sets.irreversible_ops(files, skills)}
    frames = {k: f() for k, f in run.items()}
    got = {k: _sorted(df) for k, df in frames.items()}
    assert all(got.values())
    # the text goes through one search for all words, not through a split and a search per word
    assert all("MapInArrow" in _plan(df) for df in frames.values())
    every = lambda f, patterns, text=None, keep=None, shapes=(): scan.explode_lines(f, text, keep)
    for module in (scan, B, sets):
        monkeypatch.setattr(module, "pattern_lines", every)
    monkeypatch.setattr(scan, "pattern_texts", lambda f, patterns, text=None, keep=None, shapes=(): f.select("skill_id", "path", F.col("content").alias("text")))
    for k, f in run.items():
        assert got[k] == _sorted(f()), k


def test_decoded_text_is_decoded_once(spark, tmp_path):
    from vetlake.operators.flow import CHARCODE_RX
    from vetlake.plans.q_scan import scan_decoded_text

    spark.createDataFrame([(i, "one\ntwo", "en", "s", 7) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    plan = _plan(scan_decoded_text(spark, str(tmp_path))).split("== Physical Plan ==")[0]
    # once for the documents and once for the manifests
    assert 0 < plan.count(CHARCODE_RX) <= 2


def test_cited_items_are_lowered_once(spark):
    rows = [("a", " Token to http://x "), ("a", "COMMAND run"), ("b", "nothing"), ("b", "exec CURL download")]
    df = CB.cited_items(spark.createDataFrame(rows, "skill_id string, e string"))
    assert _plan(df).split("== Physical Plan ==")[0].count("lower(") == 1
    low = {e: e.strip().lower() for _, e in rows}
    want = sorted((s, e, r) for s, e in rows for r, (caps, *_) in CB.CHAIN_RULES.items() if any(w.lower() in low[e] for c in caps for w in CB.EVIDENCE_WORDS[c]))
    assert sorted((r["skill_id"], r["e"], r["chain_id"]) for r in df.collect()) == want and want


def test_quality_shuffles_no_held_out_text_and_joins_alike_at_every_size(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 37}" for j in range(60))) for i in range(60)], "doc_id long, text string")
    trusted = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)], "__id long, __part int")
    staged = []
    real = quality_llr.stage_table
    try:
        quality_llr.stage_table = lambda df, name: (staged.append((name, _plan(df))), real(df, name))[1]
        weights = quality_llr.fit(docs, trusted)
        quality_llr.threshold(docs, trusted, weights)
    finally:
        quality_llr.stage_table = real
    plans = dict(staged)
    assert all("SortMergeJoin" in plans[n] and "BroadcastHashJoin" not in plans[n] for n in ("quality-counts", "quality-held"))
    below = plans["quality-held"].split("== Physical Plan ==")[0].split("Join LeftSemi")[1].split("\n", 2)[1]
    assert "text" not in below
