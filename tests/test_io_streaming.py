import datetime as dt
import json

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vetlake.operators import flow
from vetlake.operators import incremental as INC
from vetlake.operators import packs as P
from vetlake.operators import similarity
from vetlake.sources import artifacts, registry, rules, sinks
from vetlake.streaming import jobs


def test_read_artifacts(spark, tmp_path):
    root = tmp_path / "in"
    for rel, text in {"s1/SKILL.md": "# s", "s1/README.md": "r", "s1/notes.md": "n", "s1/scripts/run.py": "print(1)", "s1/web/package.json": '{"dependencies":{"axios":"^1.6.0"}}',
                      "s2/go.mod": "module m\n\nrequire example.com/a v1.2.0\n", "s2/bin.exe": "x"}.items():
        f = root / rel
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    files = artifacts.read_artifacts(spark, str(root))
    got = {(r["skill_id"], r["path"]): r["language"] for r in files.collect()}
    assert got == {("s1", "SKILL.md"): "markdown", ("s1", "README.md"): "markdown", ("s1", "scripts/run.py"): "python", ("s1", "web/package.json"): "json", ("s2", "go.mod"): "gomod"}
    deps = sorted(tuple(r) for r in artifacts.extract_dependencies(files).collect())
    assert deps == [("s1", "axios", "^1.6.0"), ("s2", "example.com/a", "v1.2.0")]


def test_read_rules(tmp_path):
    p = tmp_path / "r.json"
    p.write_text(json.dumps({"rules": [{"id": "A", "name": "a", "severity": "高风险", "detection": {"type": "pattern", "patterns": ["x"]}, "on_fail": {"action": "block", "reason": "r"}}, {"id": "B", "name": "b", "layer": "P1"}],
                             "items": [{"id": "V7-001", "name": "n"}]}))
    got = rules.read_rules(str(p))
    assert [(r.rule_id, r.severity, r.layer) for r in got] == [("A", "high", "P0"), ("B", "medium", "P1")]
    assert rules.read_matrix(str(p)) == [("V7-001", "n", "", "", "")]


def test_registry_and_sinks(spark, tmp_path):
    p = tmp_path / "reg"
    p.mkdir()
    (p / "a.json").write_text(json.dumps([{"skill_id": " s1 ", "report_id": "r1", "risk_tags": [" a", "a", ""], "admission_status": ""}, {"skill_id": "s2", "report_id": "r2"}]))
    reg = registry.read_registry(spark, str(p), multiline=True)
    rows = {r["skill_id"]: r for r in reg.collect()}
    assert rows["s1"]["admission_status"] == "pending" and rows["s1"]["risk_tags"] == ["a"] and rows["s2"]["review_decision"] == "review"
    new = spark.createDataFrame([("s1", "r9", 1), ("s3", "r2", 2), ("s4", "r4", 3), ("s4", "r5", 4), ("s5", "r4", 5)], "skill_id string, report_id string, seq int")
    assert [tuple(r) for r in sinks.insert_registry(new, reg).collect()] == [("s4", "r4", 3)]
    chain = spark.createDataFrame([("s2", "q1", 0), ("s7", "q1", 1), ("s7", "q2", 2), ("s8", "q2", 3), ("s8", "q3", 4)], "skill_id string, report_id string, seq int")
    assert sorted(tuple(r) for r in sinks.insert_registry(chain, reg.where("skill_id = 's1'")).collect()) == [("s2", "q1", 0), ("s7", "q2", 2), ("s8", "q3", 4)]
    twice = spark.createDataFrame([("s1", "one", 1), ("s1", "two", 2)], "skill_id string, name string, at int")
    assert [r["name"] for r in sinks.update_registry(twice, reg.where("skill_id = 's1'"), order="at").collect()] == ["two"]
    assert [r["name"] for r in sinks.save_profile(twice, twice.limit(0), order="at").collect()] == ["two"]
    old = spark.createDataFrame([("k", "run1", 10, 10)], "selection_key string, run_id string, created_at int, updated_at int")
    up = spark.createDataFrame([("k", "run2", 20, 20), ("", "x", 1, 1), ("n", "run3", 5, 5)], "selection_key string, run_id string, created_at int, updated_at int")
    assert sorted(tuple(r) for r in sinks.upsert_runs(up, old).collect()) == [("k", "run2", 10, 20), ("n", "run3", 5, 5)]
    out = str(tmp_path / "f")
    sinks.write_findings(spark.createDataFrame([("s", "high"), ("s", "low")], "skill_id string, severity string"), out)
    sinks.append_rows(spark.createDataFrame([("s", "low")], "skill_id string, severity string"), out + "2")
    assert spark.read.parquet(out).count() == 2


def test_snapshot(spark):
    cur = spark.createDataFrame([("s", "a", "go", "h1", 1), ("s", "b", "go", "h2", 1), ("s", "c", "go", "h3", 1)], "skill_id string, rel_path string, language string, sha256 string, size int")
    snap = spark.createDataFrame([("s", "a", "go", "h1", 1), ("s", "b", "go", "OLD", 1)], "skill_id string, rel_path string, language string, sha256 string, size int")
    assert sorted(r["rel_path"] for r in INC.changed_files(cur, snap).collect()) == ["b", "c"]
    s = INC.scan_stats(INC.compare_files(cur, snap)).first()
    assert (s["candidate"], s["hit"], s["miss"]) == (3, 1, 2)
    ordered = spark.createDataFrame([("s", "a", 1), ("s", "b", 2), ("s", "a", 3)], "skill_id string, rel_path string, seq int")
    assert [r["rel_path"] for r in INC.evict_snapshot(ordered, 1).collect()] == ["a"]


def test_code_summary(make_files):
    f = make_files([("s", "a.go", 'import "net/http"\nfunc Run(x int) {\n// starts the worker now\n// short\ns := "hello world"\nt := "abc"')])
    assert similarity.code_summary(f).first()["summary"] == "Run(x net/http starts the worker now net/http hello world"


def test_propagate_stops_at_hops(spark):
    e = spark.createDataFrame([("s", "p", f"v{i}", f"v{i + 1}", "alias") for i in range(8)], "skill_id string, path string, src string, dst string, kind string")
    seeds = spark.createDataFrame([("s", "p", "v0")], "skill_id string, path string, name string")
    got = {r["name"]: r["hop"] for r in flow.propagate(e, seeds, hops=4).collect()}
    assert got == {f"v{i}": i for i in range(5)}
    assert {r["name"]: r["hop"] for r in flow.propagate(e, seeds).collect()} == {f"v{i}": i for i in range(9)}


def test_stream_scan_equals_batch(spark, tmp_path):
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    t = dt.datetime(2024, 1, 1)
    rows = [("s", "a.py", 'password = "one-two"', t), ("s", "a.py", 'password = "one-two"', t), ("s", "b.py", "x\ntoken = 'abc'", t)]
    spark.createDataFrame(rows, jobs.ARRIVAL_SCHEMA).write.parquet(src)
    q = jobs.start_append(jobs.scan_arrivals(jobs.read_arrivals(spark, src), [P.HARDCODED_CREDENTIALS]), dst, str(tmp_path / "ck"))
    q.awaitTermination(120)
    cols = ["skill_id", "path", "line_no", "label"]
    got = sorted(tuple(r) for r in spark.read.parquet(dst).select(*cols).collect())
    want = sorted(tuple(r) for r in jobs.scan_arrivals(spark.read.parquet(src), [P.HARDCODED_CREDENTIALS]).select(*cols).collect())
    assert got == want and len(got) == 2


def test_stream_sessions_equal_batch(spark, tmp_path):
    src, dst = str(tmp_path / "ev"), str(tmp_path / "out")
    t0 = dt.datetime(2024, 1, 1)
    mins = [(1, 0, "view"), (1, 30, "purchase"), (1, 900, "purchase"), (1, 910, "view"), (2, 5, "view"), (2, 6, "view"), (3, 6000, "view")]
    rows = [(u, t0 + dt.timedelta(minutes=m), k) for u, m, k in mins]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp, event_type string")
    df.where("ts < '2024-01-02'").coalesce(1).write.parquet(src)
    df.where("ts >= '2024-01-02'").coalesce(1).write.mode("append").parquet(src)
    pairs = {"view then purchase": ("view", "purchase")}
    stream = spark.readStream.schema("user_id int, ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(src)
    q = jobs.start_append(jobs.session_alerts(stream, pairs, "2 hours"), dst, str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = sorted((r["user_id"], r["n_events"], r["alert"]) for r in spark.read.schema("user_id int, session_start timestamp, session_end timestamp, n_events long, alert string").parquet(dst).collect())
    want = sorted((r["user_id"], r["n_events"], r["alert"]) for r in jobs.session_alerts(df, pairs, "2 hours").collect())
    assert got == want == [(1, 2, "view then purchase")]


def test_registered_queries_have_parsing_oracles():
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in entry.oracle_sql().items():
        con.execute("EXPLAIN " + sql)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_context_plan_shares_one_exchange(spark):
    """The hits of a context rule are shuffled once and reused by both branches; nothing is a nested loop."""
    from vetlake.operators import context
    from vetlake.plans import corpus

    plan = context.scan_context(corpus.document_files(spark, "/root/testdata/sf0.001"), P.SSRF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert F is not None
