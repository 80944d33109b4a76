"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes the documents that its predecessor kept, reread from Parquet, and its decisions
take effect: rejected documents are gone, one document of each near-duplicate group stays, repeated
passages are cut out of the texts, documents appear as often as the mix takes them.  The last stage
returns the packed pieces; all others return the columns of ``documents``, whatever else is among them.

What a stage staged on the way, and what it was given, is deleted once its own result is written.

Defined cases.  Null and empty texts fail the quality rules and are gone after the first stage.  A row without
``doc_id`` is treated like any other up to packing, whose pieces then have a null ``doc_id``.  Of equal rows one
stays at most, as of any group of near copies.  A text that is cut to nothing stays as an empty document, is mixed
at its source's rate and packed as its end id.  Long texts are worked on whole.  No documents: no pieces, same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vetlake.llm import mixing, packing, quality_llr, simhash_bk, suffix_dedup
from vetlake.llm.common import table
from vetlake.session import drop_table, stage_result


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_llr.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash_bk.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand elsewhere too; a text may become empty."""
    return suffix_dedup.cut_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights ask."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeats),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = given = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        kept = stage_result(spark, lambda: stage(spark, docs, sf_dir), f"pipeline-{k}")  # noqa: B023  called at once
        if docs is not given:
            drop_table(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
