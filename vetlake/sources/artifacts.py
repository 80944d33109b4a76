"""File sources: directory trees and text tables -> the ``files`` table.

``files``: skill_id, path, language, content, n_bytes, sha256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import base_name, language_of
from ..functions.text import ws_trim

FILE_COLS = ["skill_id", "path", "language", "content", "n_bytes", "sha256"]


def _finish(df: DataFrame) -> DataFrame:
    return df.select(
        "skill_id", "path", "language", "content",
        F.octet_length("content").cast("long").alias("n_bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


def read_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """Walk ``root/<skill_id>/...`` and keep the recognised source files.

    The extension test runs on the path before content is decoded, so dropped files
    never become strings.  The skill is the first folder below ``root``, wherever that name occurs
    again further down.  Files over 2 GB are an error of the reader, never left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # the reader gives qualified paths: the root qualified the same way is their prefix
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/") + "/"
    rel = F.when(F.startswith("path", F.lit(top)), F.substring("path", len(top) + 1, 1 << 30)).otherwise(F.substring_index("path", root.rstrip("/") + "/", -1))
    df = raw.select(
        F.split_part(rel, F.lit("/"), F.lit(1)).alias("skill_id"),
        F.regexp_replace(rel, "^[^/]+/", "").alias("path"),
        F.col("content").cast("string").alias("content"),
    ).withColumn("language", language_of(F.col("path")))
    return _finish(df.where(F.col("language").isNotNull()))


def artifacts_from_table(df: DataFrame, skill: Column, path: Column, content: Column, keep_all: bool = True) -> DataFrame:
    """Any text table becomes ``files``; ``keep_all=False`` applies the reader's extension filter."""
    out = df.select(skill.cast("string").alias("skill_id"), path.alias("path"), content.alias("content"))
    out = out.withColumn("language", language_of(F.col("path")))
    return _finish(out if keep_all else out.where(F.col("language").isNotNull()))


def extract_dependencies(files: DataFrame) -> DataFrame:
    """go.mod requirements and package.json dependencies -> distinct (skill_id, name, version)."""
    base = F.lower(base_name(F.col("path")))
    # single-line "require x v1" or lines inside "require ( ... )"
    block = F.array_join(F.regexp_extract_all("content", F.lit(r"(?m)^\s*require\s*\(([^)]*)\)"), F.lit(1)), "\n")
    single = F.array_join(F.regexp_extract_all("content", F.lit(r"(?m)^\s*require\s+([^(\s][^\n]*)"), F.lit(1)), "\n")
    req_lines = F.split(F.concat_ws("\n", block, single), "\n")
    go = (
        files.where(base == "go.mod")
        .select("skill_id", F.explode(req_lines).alias("req"))
        .select("skill_id", ws_trim(F.regexp_replace("req", r"//.*$", "")).alias("req"))
        .where(F.col("req").rlike(r"^\S+\s+v\S+$"))
        .select("skill_id", F.regexp_extract("req", r"^(\S+)", 1).alias("name"), F.regexp_extract("req", r"\s(\S+)$", 1).alias("version"))
    )
    npm = (
        files.where(base == "package.json")
        .select("skill_id", F.explode(F.from_json("content", "dependencies map<string,string>")["dependencies"]).alias("name", "version"))
    )
    return go.unionByName(npm).dropDuplicates(["skill_id", "name", "version"])
