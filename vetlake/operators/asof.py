"""As-of joins: for every request the latest result of its key at or before its own time.

Requests and results become one table, and a window carries the last result forward.  A key that holds a third
of all rows is not one task: windows run inside (key, time bucket), and what a bucket inherits comes
from one row per key and bucket.  Nothing is compared pair by pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(requests: DataFrame, results: DataFrame, key: str, at: str, width: int) -> DataFrame:
    """``requests`` with ``result``, a struct of the latest result's columns (null if there is none).

    ``key`` and ``at`` (a whole number, such as seconds) are columns of both.  A result at the very time of a
    request counts; of several at one time the largest by its other columns does.  ``width`` is the length
    of a time bucket.  Requests without key or time get no result; such results are none.
    """
    rest = [c for c in results.columns if c not in (key, at)]
    usable = results.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    latest = usable.groupBy(key, at).agg(F.max(F.struct(*rest) if rest else F.struct(F.lit(1).alias("one"))).alias("_r"))
    bucket = F.floor(F.col(at) / width).cast("long")
    value = F.struct(F.col(at).alias(at), *[F.col(f"_r.{c}").alias(c) for c in rest])
    given = latest.select(key, at, bucket.alias("_b"), value.alias("_v"), F.lit(0).alias("_k"), F.lit(None).cast(requests.schema).alias("_row"))
    asked = requests.select(key, at, bucket.alias("_b"), F.lit(None).cast(given.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_k"), F.struct(*requests.columns).alias("_row"))
    inside = Window.partitionBy(key, "_b").orderBy(at, "_k").rowsBetween(Window.unboundedPreceding, 0)
    local = given.unionByName(asked).withColumn("_last", F.last("_v", ignorenulls=True).over(inside)).where("_k = 1")
    # what a bucket inherits: the last result of the nearest bucket before it that has one
    ends = given.groupBy(key, "_b").agg(F.max_by("_v", at).alias("_end"))
    some = ends.unionByName(asked.select(key, "_b").distinct().withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType))).groupBy(key, "_b").agg(F.max("_end").alias("_end"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    carried = some.select(key, "_b", F.last("_end", ignorenulls=True).over(before).alias("_carry")).where("_carry is not null")
    joined = local.join(carried, [key, "_b"], "left")
    return joined.select("_row.*", F.coalesce("_last", "_carry").alias("result"))


def reusable(requests: DataFrame, results: DataFrame, ttl: int, key: str = "cache_key", at: str = "at", width: int | None = None) -> DataFrame:
    """Requests with the result they can reuse: the latest one, unless it is ``ttl`` or more older than the request itself."""
    found = asof(requests, results, key, at, width or ttl * 8)
    fresh = F.col("result").isNotNull() & (F.col(at) - F.col(f"result.{at}") < ttl)
    return found.withColumn("cached", F.coalesce(fresh, F.lit(False)))
