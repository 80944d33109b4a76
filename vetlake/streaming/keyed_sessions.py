"""Gap sessions of keyed event streams, with hot keys dealt to many tasks.

The state is kept per key *and* bucket of event time, so one user's events are as many groups as they span
buckets, in any number of tasks.  A group holds its local sessions (at most ``width / gap`` + 1, each with
count, first and last per category) and one event-time timer at the end of its bucket.  When the watermark
passes that end, nothing can be added any more: the timer emits the local sessions and clears the state.

A local session further than ``gap`` from both borders of its bucket is complete.  Only those near a
border can continue in the bucket next door; ``stitched`` joins them, from at most two rows per key and
bucket, whatever the number of events.  It works on the table that the stream appends to (for the
buckets written so far) and on batch input, and gives what clustering all events at once gives.

Late events, beyond the watermark, are dropped.  Null keys, times or categories take no part.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LOCAL = "bucket long, seg_start long, seg_end long, cats map<string,struct<n:long,first:long,last:long>>"


def _points(events: DataFrame, key: str, ts: str, category: str, width: int) -> DataFrame:
    """``key, bucket, pos (seconds), category`` and the event time."""
    pos = F.unix_seconds(F.col(ts))
    usable = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(category).isNotNull())
    return usable.select(F.col(key).cast("string").alias("key"), F.floor(pos / width).cast("long").alias("bucket"), pos.alias("pos"), F.col(category).cast("string").alias("category"), F.col(ts).alias("ts"))


class BucketSessions(StatefulProcessor):
    """Local sessions of one (key, bucket): added to as events come, emitted when the bucket is over."""

    def __init__(self, gap: int, width: int):
        self.gap, self.width = gap, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getValueState("sessions", "json string")

    def _load(self) -> list[list]:
        return json.loads(self.sessions.get()[0]) if self.sessions.exists() else []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._load()
        if not known:
            self.handle.registerTimer((int(key[1]) + 1) * self.width * 1000)
        # [start, end, {category: [n, first, last]}], in order of start
        for part in rows:
            counted = part.groupby(["pos", "category"]).size()
            known += [[int(p), int(p), {c: [int(n), int(p), int(p)]}] for (p, c), n in counted.items()]
            known = merged(known, self.gap)
        self.sessions.update((json.dumps(known),))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = [(str(key[0]), int(key[1]), a, b, {c: tuple(v) for c, v in cats.items()}) for a, b, cats in self._load()]
        self.sessions.clear()
        yield pd.DataFrame(rows, columns=["key", "bucket", "seg_start", "seg_end", "cats"]).assign(cats=lambda d: [{c: {"n": v[0], "first": v[1], "last": v[2]} for c, v in x.items()} for x in d["cats"]])

    def close(self) -> None:
        pass


def merged(sessions: list[list], gap: int) -> list[list]:
    """Sessions not more than ``gap`` apart made one, in order of start."""
    out: list[list] = []
    for start, end, cats in sorted(sessions, key=lambda s: (s[0], s[1])):
        if out and start - out[-1][1] <= gap:
            last = out[-1]
            last[1] = max(last[1], end)
            for c, (n, first, at) in cats.items():
                have = last[2].get(c)
                last[2][c] = [n, first, at] if have is None else [have[0] + n, min(have[1], first), max(have[2], at)]
        else:
            out.append([start, end, {c: list(v) for c, v in cats.items()}])
    return out


def stream_local_sessions(events: DataFrame, gap: int, width: int | None = None, key: str = "user_id", ts: str = "ts", category: str = "event_type", watermark: str = "1 hour") -> DataFrame:
    """Append-only local sessions of a stream: ``key, bucket, seg_start, seg_end, cats``."""
    wide = width or gap * 8
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)  # timers need it
    points = _points(events, key, ts, category, wide).withWatermark("ts", watermark)
    return points.groupBy("key", "bucket").transformWithStateInPandas(BucketSessions(gap, wide), f"key string, {_LOCAL}", "Append", "EventTime")


def local_sessions(events: DataFrame, gap: int, width: int | None = None, key: str = "user_id", ts: str = "ts", category: str = "event_type") -> DataFrame:
    """The batch twin, as aggregates and windows inside buckets."""
    points = _points(events, key, ts, category, width or gap * 8).groupBy("key", "bucket", "pos", "category").agg(F.count("*").alias("n"))
    inside = Window.partitionBy("key", "bucket").orderBy("pos")
    before = F.max("pos").over(inside.rangeBetween(Window.unboundedPreceding, -1))
    marked = points.withColumn("new", F.when(before.isNull() | (F.col("pos") - before > gap), F.col("pos")))
    placed = marked.withColumn("seg_start", F.max("new").over(inside.rangeBetween(Window.unboundedPreceding, 0)))
    per = placed.groupBy("key", "bucket", "seg_start", "category").agg(F.sum("n").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    return per.groupBy("key", "bucket", "seg_start").agg(F.max("last").alias("seg_end"), F.map_from_entries(F.collect_list(F.struct("category", F.struct("n", "first", "last")))).alias("cats")).select("key", "bucket", "seg_start", "seg_end", "cats")


def _rows(df: DataFrame, start: Column) -> DataFrame:
    """``key, range_start`` with one row per category."""
    return df.select("key", start.alias("range_start"), F.explode("cats").alias("category", "v")).select("key", "range_start", "category", "v.*")


def stitched(local: DataFrame, gap: int, width: int | None = None) -> DataFrame:
    """Whole sessions: ``key, range_start, range_end, n_categories, total, cats``."""
    wide = width or gap * 8
    low, high = F.col("bucket") * wide, (F.col("bucket") + 1) * wide - 1
    near = (F.col("seg_start") - low < gap) | (high - F.col("seg_end") < gap)
    inner, border = local.where(~near), local.where(near)
    w = Window.partitionBy("key").orderBy("seg_start")  # at most two rows per bucket
    before = F.max("seg_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = border.withColumn("new", F.when(before.isNull() | (F.col("seg_start") - before > gap), F.col("seg_start")))
    joined = opened.withColumn("range_start", F.max("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = _rows(inner, F.col("seg_start")).unionByName(_rows(joined, F.col("range_start")))
    per = rows.groupBy("key", "range_start", "category").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    return per.groupBy("key", "range_start").agg(
        F.max("last").alias("range_end"), F.count("*").alias("n_categories"), F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("category", F.struct("n", "first", "last")))).alias("cats")
    )


def read_sessions(spark: SparkSession, path: str, gap: int, width: int | None = None) -> DataFrame:
    """Whole sessions of the buckets that a stream has written to ``path`` so far."""
    return stitched(spark.read.schema(f"key string, {_LOCAL}").parquet(path), gap, width)
