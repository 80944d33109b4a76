"""Keyed tables on Parquet, file trees, keyed sessions and replayed batches."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from vetlake.operators import behavior
from vetlake.sources import file_tree
from vetlake.sources.artifacts import read_artifacts
from vetlake.sources.merge_table import MergeTable
from vetlake.streaming import keyed_sessions as KS
from vetlake.streaming import snapshots

RND = random.Random(11)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_rewrites_only_touched_buckets(spark, tmp_path):
    old = [(f"k{i}", i, 10 * i, None if i % 3 else [f"t{i}"]) for i in range(300)]
    schema = "key string, at long, created long, tags array<string>"
    t = MergeTable(spark, str(tmp_path / "t"), ["key"], 8).create(spark.createDataFrame(old, schema))
    before = {f: os.path.getmtime(f.removeprefix("file://").removeprefix("file:")) for f in t.files()}
    assert rows_of(t.read()) == sorted(old, key=lambda r: r[0])
    ups = [("k5", 900, 1, ["new"]), ("k5", 901, 2, None), ("fresh", 7, 3, [])]
    version = t.merge(spark.createDataFrame(ups, schema), matched={"created": F.col("old.created")}, order="at")
    want = {r[0]: r for r in old} | {"k5": ("k5", 901, 50, None), "fresh": ("fresh", 7, 3, [])}
    assert version == 2 and rows_of(t.read()) == sorted(want.values(), key=lambda r: r[0])
    after = t.files()
    kept = [f for f in after if f in before]
    assert 6 <= len({f.split("key_bucket=")[1].split("/")[0] for f in kept}) < 8 and len(after) - len(kept) <= 2
    assert all(os.path.getmtime(f.removeprefix("file://").removeprefix("file:")) == before[f] for f in kept)
    assert rows_of(t.read(1)) == sorted(old, key=lambda r: r[0])  # the version before is still whole


def test_merge_modes_and_conflicts(spark, tmp_path):
    schema = "a long, b string, v string"
    t = MergeTable(spark, str(tmp_path / "t"), ["a", "b"], 4).create(spark.createDataFrame([(1, "x", "old"), (2, "x", "old")], schema))
    t.merge(spark.createDataFrame([(1, "x", "new"), (9, "x", "new")], schema), insert=False)
    assert rows_of(t.read()) == [(1, "x", "new"), (2, "x", "old")]
    t.merge(spark.createDataFrame([(1, "x", "newer"), (9, "x", "newer")], schema), update=False)
    assert rows_of(t.read()) == [(1, "x", "new"), (2, "x", "old"), (9, "x", "newer")]
    t.merge(spark.createDataFrame([], schema))
    assert t.version() == 4 and t.read().count() == 3
    with pytest.raises(Exception, match="key column b is null"):
        t.merge(spark.createDataFrame([(1, None, "z")], schema))
    assert t.read().count() == 3  # a failed merge is not seen
    spec = t._spec(4)
    t._publish(5, spec)
    with pytest.raises(Exception):  # noqa: B017
        t._publish(5, spec)  # the later of two merges from one version
    with pytest.raises(ValueError):
        t.create(t.read())
    empty = MergeTable(spark, str(tmp_path / "e"), ["a"], 4).create(spark.createDataFrame([], schema))
    assert empty.read().collect() == [] and empty.merge(spark.createDataFrame([(1, "x", "v")], schema)) == 2 and empty.read().count() == 1


def test_tree_reads_kept_files_only(spark, tmp_path):
    files = {f"s{i % 3}/src/deep/f{i}.py": f"x = {i}\n" * i for i in range(40)} | {"s0/SKILL.md": "# s", "s0/notes.md": "n", "s1/a.bin": "b", "s1/go.mod": "module m", "s2/PACKAGE.JSON": "{}", "s2/README.MD": "r", "top.py": "no skill"}
    for rel, text in files.items():
        f = tmp_path / rel
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    (tmp_path / "s1" / "latin.py").write_bytes(b"caf\xe9")
    (tmp_path / "s1" / "a.bin").chmod(0)
    got = file_tree.read_tree(spark, str(tmp_path), bytes_per_partition=1 << 20)
    assert got.rdd.getNumPartitions() > 5
    kept = {(r["skill_id"], r["path"]): r["content"] for r in got.collect()}
    assert kept["s1", "latin.py"] == "caf�" and kept["s2", "src/deep/f2.py"] == "x = 2\n" * 2 and ("s1", "a.bin") not in kept and ("s0", "notes.md") not in kept
    assert {"SKILL.md", "go.mod", "PACKAGE.JSON", "README.MD"} <= {p for _, p in kept}
    (tmp_path / "s1" / "a.bin").chmod(0o644)
    plain = {(r["skill_id"], r["path"]) for r in read_artifacts(spark, str(tmp_path)).collect()}
    # the other reader leaves empty files out and takes files above any folder
    assert {k for k, text in kept.items() if text} == {k for k in plain if k[0] != "top.py"}
    assert file_tree.read_tree(spark, str(tmp_path / "s0" / "src")).count() == 14


def test_files_are_dealt_by_size():
    groups = file_tree.planned([(100, ("big",)), *[(1, (f"s{i}",)) for i in range(50)]], 10 * file_tree.OPEN_COST)
    assert sum(map(len, groups)) == 51 and max(map(len, groups)) <= 10
    assert file_tree.planned([], 10) == []


def events(spark, n):
    t0 = dt.datetime(2024, 1, 1)
    at = sorted(RND.randrange(40 * 86400) for _ in range(n))
    kinds = ["view", "click", "purchase"]
    rows = [(1 if RND.random() < 0.5 else RND.randrange(2, 30), t0 + dt.timedelta(seconds=s), RND.choice(kinds)) for s in at]
    return rows, spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string")


def whole(df):
    return sorted((r["user"], r["range_start"], r["range_end"], r["n_categories"], r["total"], tuple(sorted((k, tuple(v)) for k, v in r["cats"].items()))) for r in df.collect())


def by_segments(df, gap):
    points = df.select(F.col("user_id").cast("string").alias("key"), F.unix_seconds("ts").alias("pos"), F.col("event_type").alias("category"))
    return whole(behavior.segments(points, gap, ("key",), "pos").withColumnRenamed("key", "user"))


@pytest.mark.parametrize("gap, width", [(1800, 7200), (600, 600), (7200, 86400)])
def test_stitched_sessions_equal_segments(spark, gap, width):
    _, df = events(spark, 3000)  # one user holds half of the events
    got = KS.stitched(KS.local_sessions(df, gap, width), gap, width).withColumnRenamed("key", "user")
    assert whole(got) == by_segments(df, gap)


def test_session_stream_equals_segments(spark, tmp_path):
    gap, width = 1800, 14400
    rows, df = events(spark, 1500)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):  # several batches; the last event only moves the watermark on
        spark.createDataFrame(rows[500 * k : 500 * k + 500], df.schema).coalesce(1).write.mode("append").parquet(src)
    late = dt.datetime(2025, 1, 1)
    for day in (0, 1):
        spark.createDataFrame([(99, late + dt.timedelta(days=day), "view")], df.schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = KS.stream_local_sessions(stream, gap, width).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = KS.read_sessions(spark, out, gap, width).where("key <> '99'").withColumnRenamed("key", "user")
    assert whole(got) == by_segments(df, gap)


def test_replayed_batch_leaves_one_version(spark, tmp_path):
    root = str(tmp_path / "snap")
    schema = "skill_id string, path string, content string, arrived timestamp"
    t = dt.datetime(2024, 1, 1)
    first = spark.createDataFrame([("s", "a.py", "one", t), ("s", "b.py", "two", t)], schema)
    second = spark.createDataFrame([("s", "a.py", "three", t), ("s", "c.py", "four", t)], schema)
    write = snapshots.batch_writer(root)
    write(first, 0)
    write(second, 1)
    write(second, 1)  # the batch is replayed after a failure
    stored = snapshots.read_batches(spark, root)
    assert stored.count() == 4
    latest = {r["rel_path"]: (r["batch"], r["size"]) for r in snapshots.latest(stored).collect()}
    assert latest == {"a.py": (1, 5), "b.py": (0, 3), "c.py": (1, 4)}


def test_snapshot_stream_and_restart(spark, tmp_path):
    src, root, ck = (str(tmp_path / n) for n in ("in", "snap", "ck"))
    schema = "skill_id string, path string, content string, arrived timestamp"
    t = dt.datetime(2024, 1, 1)
    for k in range(2):
        spark.createDataFrame([("s", f"f{k}.py", "x" * k, t), ("s", "same.py", f"v{k}", t)], schema).coalesce(1).write.mode("append").parquet(src)
        snapshots.start(spark.readStream.schema(schema).parquet(src), root, ck).awaitTermination(120)
    rows = snapshots.read_batches(spark, root)
    assert rows.count() == 4 and snapshots.latest(rows).where("rel_path = 'same.py'").first()["batch"] == 1
