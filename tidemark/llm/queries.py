"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import simhash_components

    return simhash_components(_table(spark, sf_dir, "documents"), shingle_words=4, threshold=4)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_ftrl import score, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    labels = _table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kdtree_topk import build_index, top_k

    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors.where("vec_id % 50 = 0"), build_index(vectors, scale=256), k=5, scale=256)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import overlap_report

    return overlap_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), n=10)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .blob_ledger import BASE, listed, of_rules, scan
    from .storage import new_path

    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    found = scan(docs, new_path(spark, "ledger")).withColumn("base", of_rules(F.col("findings"), BASE))
    n = [F.size(of_rules(F.col("base"), (r,))).cast("long").alias(f"n_{r.name}") for r in BASE]
    return found.select(F.col("path").alias("doc_id"), *n, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))


def op6_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .template_extract import extract

    return extract(_table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_revisit import archive_round_trip

    return archive_round_trip(_table(spark, sf_dir, "pages"))


def op8_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .debruijn_dedup import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"), k=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .trie_bpe import encode_and_decode

    back = encode_and_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_windows import read_back, windows

    said = F.lit("<|im_end|><|im_start|>assistant ok")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return read_back(windows(rows.unionByName(own)))


def op11_drift_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .drift_clusters import cluster_report

    return cluster_report(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, scale=1024, dim=64, seed=3)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_mix import mix_report

    return mix_report(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP3 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS double)) AS bigint)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT * FROM v WHERE vec_id % 50 = 0)
SELECT query_id, cast(rank AS int) AS rank, vec_id, score FROM (SELECT q.vec_id AS query_id, v.vec_id, cast(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS bigint) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) DESC, v.vec_id) AS rank FROM q JOIN v ON q.vec_id <> v.vec_id) WHERE rank <= 5"""

OP4 = f"""WITH b AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark), d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT s.doc_id, s.n, s.i, g.item_id FROM s JOIN g ON s.n = g.n AND s.gram = g.gram),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS k FROM h) GROUP BY doc_id)
SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id"""

OP7 = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS h FROM pages), d AS (SELECT page_id, octet_length(h) AS n, sha1(h) AS g FROM p),
m AS (SELECT g, max(page_id) AS original FROM d WHERE n >= 1000 GROUP BY g)
SELECT d.page_id, cast(d.n AS bigint) AS payload_bytes, d.g AS payload_digest, CASE WHEN m.original <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN m.original <> d.page_id THEN m.original END AS refers_to FROM d LEFT JOIN m ON d.g = m.g"""

OP8 = """WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
h AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY gram) AS first FROM g) WHERE first < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM h),
k AS (SELECT d.doc_id, len(d.w) AS n, p.p, d.w[p.p] AS word FROM d CROSS JOIN LATERAL (SELECT unnest(range(1, len(d.w) + 1)) AS p) AS p),
r AS (SELECT k.doc_id, string_agg(k.word, ' ' ORDER BY k.p) AS kept, count(*) AS n FROM k LEFT JOIN c ON k.doc_id = c.doc_id AND k.p = c.p WHERE c.p IS NULL GROUP BY k.doc_id)
SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, cast(len(d.w) - coalesce(r.n, 0) AS bigint) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256 FROM d LEFT JOIN r ON d.doc_id = r.doc_id"""



def _op11(k: int = 8, rounds: int = 10, dim: int = 64, seed: int = 3) -> str:
    """Lloyd's rounds as a chain of common table expressions: assign, take floors of means, assign again."""
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x AS double)) AS bigint)) AS e FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT r, unnest(range(1, {dim} + 1)) AS d, unnest(e) AS x FROM v)",
        f"c0 AS MATERIALIZED (SELECT c, unnest(range(1, {dim} + 1)) AS d, unnest(e) AS y FROM (SELECT row_number() OVER (ORDER BY sha256(concat('{seed}:', vec_id)), e) - 1 AS c, e FROM v QUALIFY c < {k}))",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, c, s FROM (SELECT r, c, sum((x - y) * (x - y)) AS s FROM x JOIN c{n} USING (d) GROUP BY r, c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY s, c) = 1)")
        if n < rounds:
            parts.append(f"m{n} AS (SELECT c, d, sum(x) AS s, count(*) AS n FROM a{n} JOIN x USING (r) GROUP BY c, d)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT o.c, o.d, coalesce(cast((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS bigint), o.y) AS y FROM c{n} AS o LEFT JOIN m{n} AS m ON o.c = m.c AND o.d = m.d)")
    last = f"a{rounds}"
    return "WITH " + ",\n".join(parts) + f"""
SELECT v.vec_id, cast(a.c AS int) AS cluster, cast(a.s AS bigint) AS distance, cast(sum(a.s) OVER (PARTITION BY a.c) AS bigint) AS cluster_inertia, cast(sum(a.s) OVER () AS bigint) AS inertia, h.centroid_sha256
FROM {last} AS a JOIN v ON a.r = v.r JOIN (SELECT c, sha256(string_agg(cast(y AS varchar), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c) AS h ON a.c = h.c"""


OP12 = """WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text), 'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)} AS m FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
g AS (SELECT part, [m['A'], m['B'], m['C'], m['D'], m['E']] AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
k AS (SELECT * FROM (VALUES (1), (2), (3), (4), (5)) AS t(k)),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM k AS a, k AS b, k AS c, k AS d, k AS e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT part, o, step, o[step] AS k, n, good, toxic, fails[o[step]] AS own, len(list_filter(o[1:step - 1], lambda q: fails[q])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS many FROM g CROSS JOIN o CROSS JOIN (SELECT k AS step FROM k)),
r AS (SELECT part, o, step, k, sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN own AND many = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM s GROUP BY part, o, step, k)
SELECT part, array_to_string(list_transform(o, lambda q: substr('ABCDE', cast(q AS bigint), 1)), '') AS filter_order, cast(step AS int) AS step, cast(kept AS bigint) AS kept, cast(removed AS bigint) AS removed, cast(redundant AS bigint) AS redundant, cast(unique_fails AS bigint) AS unique_fails, cast(good_lost AS bigint) AS good_lost, cast(toxic_lost AS bigint) AS toxic_lost, cast(sum(removed) OVER (PARTITION BY part, k) AS bigint) AS shapley FROM r"""

OP13 = """WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, substr(sha256(concat_ws(':', cast(doc_id AS varchar), text)), 1, 32) AS key FROM documents),
s AS (SELECT source, sum(size) AS n, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, sum(n) OVER () AS total, row_number() OVER (ORDER BY 3 * n / w, source NULLS LAST) AS place, coalesce(sum(3 * n) OVER (ORDER BY 3 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(w) OVER (ORDER BY 3 * n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others FROM s),
h AS (SELECT coalesce(arg_min(cast(total - below AS double) / others, place) FILTER (WHERE cast(total - below AS double) / others * w <= 3 * n), 0) AS share FROM o),
t AS (SELECT source, n, least(w * share, cast(3 * n AS double)) AS target, cast(round(least(w * share, cast(3 * n AS double))) AS bigint) AS quota FROM s CROSS JOIN h),
p AS (SELECT d.*, t.n, t.target, t.quota, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, cast(size AS bigint) AS size, cast(n AS bigint) AS source_size, target, cast(CASE WHEN size = 0 THEN 0 ELSE quota // n * size + least(greatest(quota % n - start, 0), size) END AS bigint) AS taken FROM p"""


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can state; the others are tested against brute force in tests/llm."""
    return {"op3_kdtree_topk": OP3, "op4_decontaminate": OP4, "op7_warc": OP7, "op8_debruijn": OP8, "op11_drift_clusters": _op11(), "op12_filter_audit": OP12, "op13_source_mix": OP13}
