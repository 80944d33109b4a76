"""Structured Streaming forms of the scan, session alerts and login counts.

Each job has a batch twin built from the same expressions, used for backfills and tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packs import Pack
from ..operators.scan import scan_packs
from ..sources.artifacts import _finish

ARRIVAL_SCHEMA = "skill_id string, path string, content string, arrived timestamp"


def read_arrivals(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int = 1000) -> DataFrame:
    """Artifacts arriving as files; bounded per trigger so a backlog is worked off in steps."""
    return spark.readStream.schema(ARRIVAL_SCHEMA).option("maxFilesPerTrigger", max_files).format(fmt).load(path)


def scan_arrivals(arrivals: DataFrame, packs: list[Pack], watermark: str = "1 hour") -> DataFrame:
    """Scan each distinct content once per watermark period; append-only findings.

    State is one hash per recent file, dropped with the watermark.
    """
    keyed = arrivals.withColumn("sha256", F.sha2("content", 256))
    fresh = keyed.withWatermark("arrived", watermark).dropDuplicatesWithinWatermark(["skill_id", "path", "sha256"]) if arrivals.isStreaming else keyed.dropDuplicates(["skill_id", "path", "sha256"])
    files = _finish(fresh.withColumn("language", F.lit(None).cast("string")))
    return scan_packs(files, packs)


def session_alerts(events: DataFrame, pairs: dict[str, tuple[str, str]], gap: str = "6 hours", key: str = "user_id", ts: str = "ts", category: str = "event_type",
                   watermark: str | None = None) -> DataFrame:
    """Sessions whose first A precedes the last B, one row per (key, session, alert).

    The whole test is a conditional min / max inside the session aggregate: state per open
    session is a handful of timestamps, whatever the number of events.  Late rows beyond the
    watermark are dropped; append mode emits a session once it can no longer grow.
    """
    src = events.withWatermark(ts, watermark or gap) if events.isStreaming else events
    cats = sorted({c for p in pairs.values() for c in p})
    at = {c: F.when(F.col(category) == c, F.col(ts)) for c in cats}
    agg = [F.count("*").alias("n_events"), *[F.min(at[c]).alias(f"first_{c}") for c in cats], *[F.max(at[c]).alias(f"last_{c}") for c in cats]]
    s = src.groupBy(F.session_window(ts, gap), F.col(key)).agg(*agg)
    cells = F.array_compact(F.array(*[F.when(F.col(f"first_{a}") < F.col(f"last_{b}"), F.lit(n)) for n, (a, b) in pairs.items()]))
    # the window end is the last event plus the gap
    return s.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n_events", F.explode(cells).alias("alert"))


def login_counts(logins: DataFrame, width: str = "1 day", slide: str | None = None, watermark: str = "1 day", ts: str = "ts") -> DataFrame:
    """Tumbling (or sliding) success and failure counts."""
    src = logins.withWatermark(ts, watermark) if logins.isStreaming else logins
    return src.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), "result").agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "result", "n")


def start_append(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", trigger: dict | None = None):
    """Append sink with an explicit checkpoint location (exactly-once file output)."""
    w = df.writeStream.outputMode("append").format(fmt).option("path", path).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()
