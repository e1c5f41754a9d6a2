"""The corpus pipeline: documents in; rejected, repeated, leaked and secret text out; tokens at the end.

Each stage takes what its predecessor kept, as a written table, and works on all of it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import blob_ledger, decontaminate, quality_ftrl, simhash_dedup, trie_bpe
from tidemark.llm.storage import discard, materialize, new_path, unused

#: Documents whose probability of good quality is below this go.
LEAST_QUALITY = 0.3


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text; that of a null text stays as it is."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels outside the held-out fifth; drops what scores below LEAST_QUALITY."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    weights = quality_ftrl.train(docs, labels.select("doc_id", F.col("quality").alias("label")))
    score = unused(docs, "quality_score")
    return quality_ftrl.score(docs, weights, score).where(F.col(score) >= LEAST_QUALITY).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their five-word shingles, the smallest doc_id stays: SimHash anchors first, exact sets decide."""
    return simhash_dedup.keep_first(docs, similarity=0.8, shingle_words=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every span that shares ten words in a row with a benchmark item."""
    return _sized(decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10, action="spans"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts."""
    return _sized(blob_ledger.redact_all(docs, new_path(spark, "ledger")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, text)``: little-endian 32-bit ids, and the text that they decode to."""
    return trie_bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens)]

#: SQL has no FTRL training, SimHash or BPE; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
            discard(before)
    return docs
