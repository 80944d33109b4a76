"""Keyed tables on Parquet that merges rewrite only in part.

A row lies in the bucket that the hash of its key names.  A merge reads and writes only the buckets that
its updates touch, as a new folder with one part per bucket; files of other buckets stay as they are.  A small
version file says which folder holds each bucket; it is written last, and readers follow it, so they see either the
table before a merge or after it, and can read any earlier version.  A merge that fails leaves a folder nobody
reads.  Two merges that start from the same version cannot both end: the later one finds the version file
and fails.

Keys are unique, so buckets are of even size whatever the data; their number is chosen when the table is
made.  The driver holds one number per bucket.

Defined cases.  Rows whose key has a null are no rows of a keyed table: an error.  Several updates of one
key: the largest by ``order`` counts, then by the other columns.  No updates: a new version with the same files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FORMAT = "%08d.json"
_BUCKET = "key_bucket"


class MergeTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    # --- version files -------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version, 0 before the first."""
        p, fs = self._fs(f"{self.path}/_versions")
        return max([int(f.getPath().getName()[:8]) for f in fs.listStatus(p) if f.getPath().getName().endswith(".json")], default=0) if fs.exists(p) else 0

    def _spec(self, version: int) -> dict:
        p, fs = self._fs(f"{self.path}/_versions/{_FORMAT % version}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(b & 255 for b in stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, version: int, spec: dict) -> None:
        p, fs = self._fs(f"{self.path}/_versions/{_FORMAT % version}")
        stream = fs.create(p, False)  # fails if another merge was first
        try:
            stream.write(bytearray(json.dumps(spec).encode()))
        finally:
            stream.close()

    # --- reading ---------------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, spec: dict, only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{v}/{_BUCKET}={b}" for b, v in sorted((int(b), v) for b, v in spec["current"].items()) if only is None or b in only]
        schema = T.StructType.fromJson(spec["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the newest by default."""
        return self._read(self._spec(version or self.version()))

    def files(self, version: int | None = None) -> list[str]:
        return sorted(self.read(version).inputFiles())

    # --- writing ---------------------------------------------------------------------------------

    def _write(self, rows: DataFrame) -> dict[int, str]:
        """Write rows to a folder of their own; bucket -> folder for the buckets that have rows."""
        null = F.coalesce(*[F.when(F.col(c).isNull(), F.raise_error(F.lit(f"key column {c} is null")).cast("int")) for c in self.keys], F.lit(0))
        folder = uuid.uuid4().hex
        rows.withColumn(_BUCKET, self._bucket() + null).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        p, fs = self._fs(f"{self.path}/{folder}")
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return {int(n.split("=")[1]): folder for n in names if n.startswith(_BUCKET)}

    def create(self, rows: DataFrame) -> MergeTable:
        """The first version; one row per key."""
        if self.version():
            raise ValueError(f"{self.path} is a table already")
        self._publish(1, {"schema": json.loads(rows.schema.json()), "current": self._write(rows)})
        return self

    def merge(self, updates: DataFrame, matched: dict[str, Column] | None = None, insert: bool = True, update: bool = True, order: str | None = None) -> int:
        """Merge ``updates`` by key; the new version's number.

        A key that is there already takes the columns of its update; ``matched`` gives other values for
        some columns, as expressions over ``old.<column>`` and ``new.<column>``.  ``insert=False`` ignores new
        keys, ``update=False`` known ones.
        """
        start = self.version()
        spec = self._spec(start)
        columns = [f["name"] for f in spec["schema"]["fields"]]
        values = [c for c in columns if c not in self.keys]
        rank = F.struct(*([order] if order else []), *[c for c in values if c != order])
        latest = updates.groupBy(*self.keys).agg(F.max(rank).alias("m")).select(*self.keys, F.struct(*[F.col(f"m.{c}").alias(c) for c in values]).alias("new"))
        touched = {r["b"] for r in latest.select(self._bucket().alias("b")).distinct().collect()}  # at most ``buckets`` rows
        old = self._read(spec, touched).select(*self.keys, F.struct(*values).alias("old"))
        both = old.join(latest, self.keys, "full")
        value = lambda c: (
            F.when(F.col("new").isNull(), F.col(f"old.{c}")).when(F.col("old").isNull(), F.col(f"new.{c}")).otherwise(((matched or {}).get(c, F.col(f"new.{c}"))) if update else F.col(f"old.{c}"))
        )
        kept = both if insert else both.where(F.col("old").isNotNull())
        written = self._write(kept.select(*[F.col(c) if c in self.keys else value(c).alias(c) for c in columns]))
        current = {b: v for b, v in spec["current"].items() if int(b) not in touched} | written
        self._publish(start + 1, {"schema": spec["schema"], "current": current})
        return start + 1
