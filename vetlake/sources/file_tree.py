"""Directory trees as a partitioned data source that opens kept files only.

``spark.read.format("artifact_tree").load(root)`` lists names and sizes, drops what no reader of source
files keeps, and deals the rest to partitions of about ``bytesPerPartition``, so a folder of many small
files is few tasks and one of large files many.  A task opens the files of its partition one after the
other; a dropped file is never opened.

Columns: skill_id (first folder below the root), path, content, n_bytes.  Any file system that pyarrow can
open by address works; folders on a cluster must be visible to all machines.  Bytes that are no UTF-8 are
replaced.  A file that vanished since it was listed is an error, not a missing row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import DECLARATION_NAMES, LANGUAGE_BY_EXT, language_of
from .artifacts import _finish

BYTES_PER_PARTITION = 64 << 20
# What opening a file costs, in bytes read meanwhile.
OPEN_COST = 256 << 10
BATCH_BYTES = 16 << 20
# Endings and whole names that can have a language; of markdown only declarations.
ENDINGS = [e for e in LANGUAGE_BY_EXT if e != ".md"]
NAMES = ["go.mod", "package.json", *DECLARATION_NAMES]


@dataclass
class FileGroup(InputPartition):
    files: list[tuple[str, str, str]]  # skill, path below it, whole path


def _file_system(root: str):
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def planned(files: list[tuple[int, tuple]], most: int) -> list[list[tuple]]:
    """Files in groups of at most ``most`` bytes (or one file), the largest first, each into the emptiest group."""
    import heapq

    weighed = sorted(((size + OPEN_COST, f) for size, f in files), reverse=True)
    n = max(1, -(-sum(w for w, _ in weighed) // most))
    heap, groups = [(0, g) for g in range(n)], [[] for _ in range(n)]
    for weight, f in weighed:
        filled, g = heapq.heappop(heap)
        groups[g].append(f)
        heapq.heappush(heap, (filled + weight, g))
    return [g for g in groups if g]


class TreeReader(DataSourceReader):
    def __init__(self, root: str, kept: list[str], names: list[str], most: int):
        self.root, self.kept, self.names, self.most = root, tuple(kept), set(names), most

    def _keeps(self, path: str) -> bool:
        base = path.rsplit("/", 1)[-1].lower()
        return base in self.names or base.endswith(self.kept)

    def partitions(self) -> list[FileGroup]:
        from pyarrow import fs

        system, top = _file_system(self.root)
        top = top.rstrip("/")
        found = []
        for info in system.get_file_info(fs.FileSelector(top, recursive=True)):
            rel = info.path[len(top) + 1 :]
            if info.type == fs.FileType.File and "/" in rel and self._keeps(rel):
                skill, path = rel.split("/", 1)
                found.append((info.size, (skill, path, info.path)))
        return [FileGroup(g) for g in planned(found, self.most)] or [FileGroup([])]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(self.root)
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            skill, path, text, size = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(skill, pa.string()), pa.array(path, pa.string()), pa.array(text, pa.string()), pa.array(size, pa.int64())], names=["skill_id", "path", "content", "n_bytes"])

        for skill, path, whole in partition.files:
            with system.open_input_stream(whole) as stream:
                raw = stream.read()
            rows.append((skill, path, raw.decode("utf-8", "replace"), len(raw)))
            held += len(raw)
            if held >= BATCH_BYTES:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class ArtifactTree(DataSource):
    """Options: ``path``, ``endings`` and ``names`` (comma lists, lower case), ``bytesPerPartition``."""

    @classmethod
    def name(cls) -> str:
        return "artifact_tree"

    def schema(self) -> str:
        return "skill_id string, path string, content string, n_bytes long"

    def reader(self, schema) -> TreeReader:
        split = lambda o: [x for x in self.options.get(o, "").split(",") if x]
        return TreeReader(self.options["path"], split("endings"), split("names"), int(self.options.get("bytesPerPartition", BYTES_PER_PARTITION)))


def read_tree(spark: SparkSession, root: str, bytes_per_partition: int = BYTES_PER_PARTITION) -> DataFrame:
    """``files`` of the tree below ``root``; the language test decides, endings and names only save opening files."""
    spark.dataSource.register(ArtifactTree)
    raw = spark.read.format("artifact_tree").options(endings=",".join(ENDINGS), names=",".join(NAMES), bytesPerPartition=bytes_per_partition).load(root)
    files = raw.select("skill_id", "path", "content").withColumn("language", language_of(F.col("path")))
    return _finish(files.where(F.col("language").isNotNull()))


def write_tree(files: DataFrame, root: str) -> int:
    """Write ``files(skill_id, path, content)`` as a tree, each file by the task that has its row; the number written.

    A task that runs again writes the same files again.
    """

    def run(parts):
        import pandas as pd

        system, top = _file_system(root)
        for p in parts:
            for skill, path, content in zip(p["skill_id"], p["path"], p["content"]):
                whole = f"{top.rstrip('/')}/{skill}/{path}"
                system.create_dir(whole.rpartition("/")[0], recursive=True)
                with system.open_output_stream(whole) as out:
                    out.write((content or "").encode())
            yield pd.DataFrame({"n": [len(p)]})

    return files.select("skill_id", "path", "content").mapInPandas(run, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0
