"""The pipeline: each stage on all that the one before kept."""

from __future__ import annotations

import os
import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from vetlake.llm import mixing, packing, quality_llr, simhash_bk, suffix_dedup
from vetlake.session import shared_dir

from .test_llm_operators import WORDS


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    prose = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    shared = prose(90)
    texts = [prose(rnd.randint(60, 200)) for _ in range(60)]
    texts += [texts[0], texts[1] + " x", texts[2] + " " + shared, texts[3] + " " + shared, "short", None, "", "!! ** " * 80]
    rows = [(i, t, "en", f"s{i % 4}", len(t or ""), "more") for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([*rows, rows[5], (None, texts[6], None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long, size string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, len(texts), 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{folder}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, folder)
        assert docs.columns == columns, name
        got = Counter((r["doc_id"], r["text"]) for r in docs.collect())
        if stage is corpus_pipeline.quality:
            want = Counter(r["doc_id"] for r in quality_llr.score_quality(before, labels).where("kept").collect())
            assert Counter(r[0] for r in got.elements()) == want
        elif stage is corpus_pipeline.near_duplicates:
            want = {r["component_id"] for r in simhash_bk.components(before).collect()}
            assert {r[0] for r in got} == want and max(got.values()) == 1
        elif stage is corpus_pipeline.repeats:
            removed = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.measure(before).collect()}
            size = {r["doc_id"]: len(r["text"].encode()) for r in before.collect()}
            assert sum(removed.values()) > 0
            assert all(size[i] - removed[i] <= len(t.encode()) <= size[i] - removed[i] + 8 for i, t in got)
        elif stage is corpus_pipeline.mix:
            want = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(before).collect() if r["copies"]}
            assert Counter(r[0] for r in got.elements()) == want
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.where("piece = 0").count() == docs.count()


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert set(packing._PIECES.names) < set(rows.columns)
    fill = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert fill.where("n <> end OR n > 2048").count() == 0 and fill.count() > 0


def test_run_leaves_one_document_table(spark, folder):
    staged = f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}".removeprefix("file:")
    names = lambda: set(os.listdir(staged)) if os.path.isdir(staged) else set()
    before = names()
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert [n for n in names() - before if n.startswith("pipeline")] == [n for n in names() - before if n.startswith("pipeline-3")]
    assert not any(n.startswith(("simhash", "repeat")) for n in names() - before)


@pytest.mark.parametrize("texts", [[], [None, "", " \n"], ["too short"]])
def test_run_without_good_documents(spark, folder, tmp_path, texts):
    full = spark.read.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, t, "en", "s", 0, "more") for i, t in enumerate(texts)], full.schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert rows.count() == 0 and set(packing._PIECES.names) < set(rows.columns)
