"""Best-fit packing of token sequences, online and in bounded space.

Documents are encoded where they are read and cut into pieces of at most ``CAPACITY`` tokens.  The
pieces (ids and lengths, no text) are staged, dealt by hash to ``ceil(tokens / TOKENS_PER_TASK)`` tasks,
so that the number of tasks follows the tokens and each has the same mixture of lengths, and packed
there as they come: a piece goes to the open sequence with the least free space that holds it; if none
does, a new one is opened, and with ``OPEN_BINS`` open the fullest closes first.  The free spaces of
the open sequences are a bitset, so each placement is a few integer operations.

A task keeps ``OPEN_BINS`` sequences and one batch in memory.  Its rows arrive in a fixed order, so a
task that runs again gives the same sequences.

Defined cases.  Null or empty text: one piece, the end mark.  Null ``doc_id``: packed, id null.
Repeated rows: each is packed.  A longer text only gives more pieces.  Empty table: no rows.
Other columns are ignored by ``pieces``; ``pack`` carries all columns of its input but needs ``length``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetlake.session import stage_table

from .common import whole_text

CAPACITY = 2048
END_ID = 0
OPEN_BINS = 512
TOKENS_PER_TASK = 1 << 26

_PIECES = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, on request, the ids."""
    path = tokenizer or default_tokenizer()
    width = 4 * capacity
    end = END_ID.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vetlake.llm.word_tokens import chunk_ids

        with chunk_ids(path) as ids:
            for batch in batches:
                yield cut(ids, batch)

    def cut(ids, batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], [], []]
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            whole = ids.text(text.as_py()) + end
            for k, at in enumerate(range(0, len(whole), width)):
                part = whole[at : at + width]
                for column, value in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None)):
                    column.append(value)
        arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *[pa.array(x, pa.int64()) for x in out[2:5]]]
        names = _PIECES.names
        if with_ids:
            arrays.append(pa.array([np.frombuffer(x, "<u4").astype("i4") for x in out[5]], pa.list_(pa.int32())))
            names = [*names, "ids"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    schema = T.StructType([*_PIECES.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(encode, schema)


class OpenBins:
    """Open sequences by free space; ``place`` gives (sequence number, offset)."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.n, self.next = capacity, most, 0, 0
        self.free = 0  # bit f: some open sequence has f tokens of space left
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, space: int) -> int:
        got = self.at[space].pop()
        if not self.at[space]:
            self.free &= ~(1 << space)
        self.n -= 1
        return got

    def place(self, length: int) -> tuple[int, int]:
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.capacity, self.next
            self.next += 1
            if self.n >= self.most and length < self.capacity:
                self._take((self.free & -self.free).bit_length() - 1)
        left = space - length
        if left:
            self.at[left].append(number)
            self.free |= 1 << left
            self.n += 1
        return number, self.capacity - space


def pack(rows: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, tokens_per_task: int = TOKENS_PER_TASK) -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset``; ``length`` says how many tokens a row has (1 to ``capacity``)."""
    rows = stage_table(rows, "pack-pieces")
    tasks = max(1, -(-(rows.agg(F.sum("length").alias("n")).first()["n"] or 0) // tokens_per_task))
    keys = [c for c in rows.columns if c != "ids"]
    dealt = rows.withColumn("__h", F.xxhash64(*keys)).repartition(tasks, "__h").sortWithinPartitions("__h", *keys).drop("__h")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 33
        for batch in batches:
            got = [bins.place(n) for n in batch.column("length").to_pylist()]
            numbers, offsets = pa.array([first + x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, numbers, offsets], names=[*batch.schema.names, "sequence_id", "offset"])

    return dealt.mapInArrow(fill, T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed token sequences themselves; ``packed`` carries ``ids``.  A sequence has at most ``CAPACITY`` tokens."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """``pieces`` of ``docs``, packed."""
    return pack(pieces(docs, tokenizer, with_ids=with_ids))
