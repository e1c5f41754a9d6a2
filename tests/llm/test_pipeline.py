"""The stages of the corpus pipeline on small tables, one after the other, against what they must keep and cut."""

from __future__ import annotations

import os
import struct

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

LEAK = "one benchmark question asks which of these twelve words comes right after the other"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Clean texts 0-59, junk 100-159, near copies of text 0 (200, 201), a leak (202), a secret (203), odd rows from 204."""
    rng = np.random.default_rng(11)
    clean = lambda n: " ".join(rng.choice([f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)], n))
    rows = [(i, clean(80)) for i in range(60)] + [(100 + i, "$$$ ### ".join(rng.choice(["buy", "now", "free"], 40))) for i in range(60)]
    base = rows[0][1]
    rows += [(200, base), (201, base + " extra"), (202, f"{clean(40)} {LEAK} {clean(40)}"), (203, f'{clean(40)} password = "abcdef123456" {clean(40)}'), (204, clean(30000)), (205, None), (206, ""), (0, base)]
    labels = [(i, int(i < 100), 0) for i, _ in rows if i < 200]
    folder = "file://" + str(tmp_path_factory.mktemp("corpus"))
    docs = [(i, t, "en", "hot", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, LEAK)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(rows)


def test_stages_keep_the_columns_of_documents(spark, tables):
    from tidemark.llm.storage import materialize

    folder, texts = tables
    docs = first = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), name)
        assert docs.columns == first.columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert all(r.n_chars == len(r.text or "") for r in kept[name].values())
    assert set(range(60)) <= set(kept["quality"]) and not set(range(100, 160)) & set(kept["quality"])
    gone = set(kept["quality"]) - set(kept["near_dedup"])
    assert {200, 201} <= gone and not gone & (set(range(60)) | {202, 203, 204})
    assert LEAK not in kept["decontamination"][202].text and kept["decontamination"][204].text == texts[204]
    assert "abcdef123456" not in kept["secrets"][203].text and kept["secrets"][5].text == texts[5]


def test_run_returns_tokens_of_what_is_kept(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    folder, texts = tables
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) and set(range(60)) <= set(ids)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows:
        want = t.encode(r.text, add_special_tokens=False).ids
        assert bytes(r.ids) == struct.pack(f"<{len(want)}I", *want) and r.n_tokens == len(want)
    assert os.path.exists(corpus_pipeline.__file__) and {r.text for r in rows if r.doc_id == 7} == {texts[7]}


def test_near_duplicates_meet_by_their_fingerprints_anchors(spark, tables, monkeypatch):
    from tidemark.llm import simhash_dedup

    folder, _ = tables
    seen, links = [], simhash_dedup.fingerprint_links

    def watched(nodes, n_nodes, *more):
        out = links(nodes, n_nodes, *more)
        seen.append((n_nodes, out.count()))
        return out

    monkeypatch.setattr(simhash_dedup, "fingerprint_links", watched)
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 100 OR doc_id > 199")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, folder).collect()}
    assert len(seen) == 1 and seen[0][0] > 60 and seen[0][1] > 0
    assert not {200, 201} & kept and set(range(60)) <= kept


def test_equal_and_near_fingerprints_make_pairs(spark):
    from tidemark.llm.simhash_dedup import fingerprint_pairs

    nodes = spark.createDataFrame([(1, 0), (2, 0), (3, 0b1111), (4, -1), (5, -2)], "node long, fp long")
    assert {(r.a, r.b) for r in fingerprint_pairs(nodes).collect()} == {(2, 1), (3, 1), (5, 4)}
