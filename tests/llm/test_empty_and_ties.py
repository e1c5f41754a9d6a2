"""Empty tables through the secret scan and the whole pipeline, the threshold itself, and a shingle that very many texts share."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture
def empty(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def test_empty_tables(spark, empty):
    from tidemark.llm import queries as q

    for name in ("op5_secret_scan", "op11_drift_clusters", "op12_filter_audit", "op13_source_mix"):
        assert getattr(q, name)(spark, empty).count() == 0
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_a_score_at_the_threshold_stays(spark, tmp_path, monkeypatch):
    """A document whose score is the threshold itself is kept, and predicted 1."""
    from tidemark.llm import quality_ftrl, queries

    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(quality_ftrl, "score", lambda d, w, name="score": d.withColumn(name, F.when(F.col("doc_id") == 1, 0.3).otherwise(0.2999999)))
    assert [r.doc_id for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()] == [1]
    assert {r.doc_id: r.predicted for r in queries.op2_quality(spark, str(tmp_path)).collect()} == {1: 1, 2: 0}


def test_texts_of_one_template(spark):
    """Fifteen hundred texts that share a rare passage: only those at the similarity are linked."""
    from tidemark.llm.simhash_dedup import near_duplicates

    rng = np.random.default_rng(6)
    passage = " ".join(f"shared{i}" for i in range(30))
    own = lambda n: " ".join(rng.choice([f"w{i}" for i in range(3000)], n))
    rows = [(i, f"{passage} {own(40)}") for i in range(1500)]
    rows += [(2000 + i, rows[i][1] + " tail") for i in range(0, 1500, 100)]  # near copies of some
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == {i: i for i in range(1500)} | {2000 + i: i for i in range(0, 1500, 100)}
