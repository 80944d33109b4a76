"""Trigram signatures: a text table kept with what its texts can contain, tested before texts are read.

Texts lie in blocks.  A block's signature is the set of hashed three-byte pieces of its texts in lower case, as a
bitmap, kept in a small table of its own.  A pattern that cannot match without some word cannot match a
block whose bitmap lacks one of the word's pieces, so the scan first reads bitmaps, then only the blocks
that are left: they are partitions of the text table, and partitions without a candidate are not opened.

Texts that belong together (one source, one kind of file) should share blocks: pass ``near``.  Rare words then
lie in few blocks.  The test only ever lets too much through; hits are those of a scan of everything.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.literals import required_literals
from ..session import shared_dir

BITS = 1 << 15
BLOCKS_HELD = 2000
# Blocks that a small table is cut into, and texts of a block of a large one.
FEW_BLOCKS = 64
BLOCK_ROWS = 4096
# Words shorter than this have no piece; their patterns read every block.
PIECE = 3


@dataclass
class SignedTexts:
    """``texts``: the files, partitioned by block; ``bits``: block and one bit that is set in it."""

    path: str
    texts: DataFrame
    bits: DataFrame


def block_count(n_rows: int) -> int:
    """Blocks for so many texts: small ones while there are few texts, then up to ``BLOCK_ROWS`` texts each.

    Every block is a folder, a task when written and a part of the listing, so their number must not follow the texts'.
    """
    return max(8, min(n_rows // 16, FEW_BLOCKS + n_rows // BLOCK_ROWS))


def piece_bits(text: bytes) -> np.ndarray:
    """Distinct bits of the pieces of a text, whose ASCII letters count as small."""
    codes = np.frombuffer(text.lower(), np.uint8).astype(np.uint64)
    if len(codes) < PIECE:
        return np.zeros(0, np.int64)
    pieces = codes[:-2] << np.uint64(16) | codes[1:-1] << np.uint64(8) | codes[2:]
    return np.unique(pieces * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)


def _bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block and bit that is set in texts of the task; a task holds at most ``BLOCKS_HELD`` bitmaps."""
    held: dict[int, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        rows = [(b, np.flatnonzero(m)) for b, m in held.items()]
        blocks = np.concatenate([np.full(len(at), b, np.int32) for b, at in rows] or [np.zeros(0, np.int32)])
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(np.concatenate([at for _, at in rows] or [np.zeros(0)]).astype(np.int32))], names=["block", "bit"])

    for batch in batches:
        for block, text in zip(batch.column("block").to_pylist(), batch.column("content")):
            if block not in held:
                if len(held) >= BLOCKS_HELD:
                    yield out()
                    held.clear()
                held[block] = np.zeros(BITS, bool)
            held[block][piece_bits((text.as_py() or "").encode())] = True
    yield out()


def sign(files: DataFrame, n_blocks: int, near: list[str] | None = None) -> SignedTexts:
    """Write ``files`` (with ``content``) in blocks, and the bits of each block.

    A bit is one row; bits of a block are combined in the tasks, so at most ``BITS`` rows per block and task move.
    """
    spark = files.sparkSession
    path = f"{shared_dir(spark)}/signed-{uuid.uuid4().hex}"
    order = near or ["skill_id"]
    files.repartitionByRange(n_blocks, *order, "path").withColumn("block", F.spark_partition_id()).write.partitionBy("block").parquet(f"{path}/texts")
    texts = spark.read.parquet(f"{path}/texts")
    texts.select("block", "content").mapInArrow(_bits_of, "block int, bit int").distinct().write.parquet(f"{path}/bits")
    return SignedTexts(path, texts, spark.read.schema("block int, bit int").parquet(f"{path}/bits"))


def candidate_blocks(signed: SignedTexts, patterns: list[str]) -> DataFrame | None:
    """Blocks that can hold a match; None where a pattern has no words to test, so that all can."""
    words: set[str] = set()
    for p in patterns:
        need = required_literals(p)
        if need is None or any(len(w) < PIECE or not w.isascii() for w in need):
            return None
        words |= need
    spark = signed.bits.sparkSession
    # at most as many rows as the patterns' words have letters
    wanted = spark.createDataFrame([(w, b) for w in sorted(words) for b in piece_bits(w.encode()).tolist()], "word string, bit int")
    sizes = wanted.groupBy("word").agg(F.count("*").alias("size"))
    met = signed.bits.join(F.broadcast(wanted), "bit").groupBy("block", "word").agg(F.count("*").alias("n"))
    return met.join(F.broadcast(sizes), "word").where("n = size").select("block").distinct()


def may_hold(signed: SignedTexts, patterns: list[str]) -> DataFrame:
    """Files of the blocks that can hold a match; other blocks' texts are not read."""
    blocks = candidate_blocks(signed, patterns)
    if blocks is None:
        return signed.texts.drop("block")
    # the blocks' number is known and each is one short row: their ids prune the partitions when the plan is made
    ids = [r["block"] for r in blocks.collect()]
    return signed.texts.where(F.col("block").isin(ids)).drop("block") if ids else signed.texts.where(F.lit(False)).drop("block")
