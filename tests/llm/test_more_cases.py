"""Cases that the operators must take: repeated ids, clashing columns, very long texts, many matches, pages without hints."""

from __future__ import annotations

import collections
import hashlib
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm")


def test_top_k_with_repeated_ids(spark):
    from tidemark.llm.kdtree_topk import build_index, top_k

    rows = [(50, [1.0, None, 0.0]), (50, [1.0, 2.0, 0.0]), (50, [float("inf"), 0.0, 0.0]), (7, [1.0, 1.0, 1.0]), (7, [3.0, 1.0, 1.0]), (8, [1e30, 0.0, 0.0]), (9, [-5.0, 0.5, 0.0]), (None, [9.0, 9.0, 9.0]), (100, [4e6, -1e6, 3.0])]
    v = spark.createDataFrame([(i, x, "n", 1) for i, x in rows], "vec_id long, embedding array<double>, score string, tree int").repartition(3)
    got = sorted(tuple(r) for r in top_k(v.where("vec_id % 50 = 0"), build_index(v), 5).collect())
    m = [(i, np.floor(256 * np.array(x)).astype(object)) for i, x in rows if i is not None and None not in x and np.isfinite(x).all() and i != 8]
    want = []
    for q, x in [(50, m[0][1]), (100, m[-1][1])]:
        near = sorted((-int(sum(int(a) * int(b) for a, b in zip(x, y))), i) for i, y in m if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    assert got == sorted(want)


def test_extra_columns_with_the_names_of_results_stay(spark, tmp_path):
    from tidemark.llm.blob_ledger import redact_all
    from tidemark.llm.decontaminate import decontaminate, find_overlaps
    from tidemark.llm.quality_ftrl import score

    names = ["bench_words", "bench_spans", "bench_items", "found_spans", "found_path", "Found_Blob", "score", "spans", "path"]
    passage = "one two three four five six seven eight nine ten"
    rows = [(1, f'a {passage} b password = "abcdef12"', *names), (2, None, *names), (2, None, *names)]
    d = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    for out in (decontaminate(d, bench), redact_all(d, f"file://{tmp_path}/ledger")):
        assert out.columns == d.columns
        got = sorted(out.collect(), key=lambda r: r.doc_id)
        assert len(got) == 3 and all(r[n] == n for r in got for n in names) and got[1].text is None
    assert decontaminate(d, bench, action="documents").count() == 2
    assert find_overlaps(d, bench).where("bench_words > 3").count() == 1
    assert score(d, np.zeros(1 << 18)).where("score = 0.5").count() == 3


def test_stages_take_clashing_columns(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(5)
    own = lambda: " ".join(f"w{i}" for i in rng.integers(0, 400, 60))
    rows = [(i, own() if i < 40 else "$$$ ### " * 30, "q", "s") for i in range(80)] + [(None, own(), "q", "s"), (None, None, "q", "s")]
    folder = f"file://{tmp_path}"
    schema = "doc_id long, text string, quality_score string, bench_spans string"
    spark.createDataFrame([(i, int(i < 40)) for i in range(80)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "quality_score", "bench_spans"]
    kept = docs.collect()
    assert {r.doc_id for r in kept} >= set(range(40)) and all(r.quality_score == "q" for r in kept) and sum(r.doc_id is None for r in kept) >= 1
    empty = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
BASE = (("assign", ASSIGN, lambda m: len(m[2]) >= 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24))


def base_spans(text):
    found = [(m.start(), k, name, m.end()) for k, (name, p, good) in enumerate(BASE) for m in p.finditer(text or "") if good(m)]
    return ",".join(f"{name}:{s}:{e}" for s, _, name, e in sorted(found))


def cut(text, spans):
    out, at = "", 0
    for s, e in sorted(spans):
        if s >= at:
            out += text[at:s] + "[SECRET]"
        at = max(at, e)
    return out + text[at:]


def test_secrets_of_random_texts(spark, tmp_path):
    from tidemark.llm.blob_ledger import BASE as RULES
    from tidemark.llm.blob_ledger import listed, of_rules, redact, scan

    rng = np.random.default_rng(6)
    bits = ["password", "passwd", "SECRET", "token", "api_key", "ApiKey", '"', "'", " ", ":", "=", "abc", "0f" * 13, "AKIA", "A1B2C3D4E5F6G7H8", "é", "日本", "😀", "xyz.w", "\n", "deadbeef"]
    texts = ["".join(rng.choice(bits, int(rng.integers(1, 60)))) for _ in range(500)] + ["".join(rng.choice(bits, 9000)), "", None, None]
    d = spark.createDataFrame(list(enumerate(texts)), "path long, text string").repartition(4)
    rows = scan(d, f"file://{tmp_path}/a").select("path", listed(of_rules(F.col("findings"), RULES)).alias("f"), "findings").collect()
    assert len(rows) == len(texts) and all(r.f == base_spans(texts[r.path]) for r in rows)
    found = {r.path: [(f.start, f.end) for f in r.findings] for r in rows}
    back = spark.createDataFrame([(i, t, found[i]) for i, t in enumerate(texts) if t], "path long, text string, f array<struct<start:int,end:int>>")
    assert all(r.t == cut(texts[r.path], found[r.path]) for r in back.select("path", redact(F.col("text"), F.col("f")).alias("t")).collect())


def test_a_text_of_very_many_secrets(spark, tmp_path):
    from tidemark.llm.blob_ledger import listed, redact_all, scan

    n = 100_000
    text = " ".join(f"é token={i:08d}" for i in range(n))
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    got = scan(d.withColumnRenamed("doc_id", "path"), f"file://{tmp_path}/b").select(listed(F.col("findings")).alias("f")).first().f
    assert got == base_spans(text)
    assert redact_all(d, f"file://{tmp_path}/c").first().text == " ".join("é [SECRET]" for _ in range(n))
    assert time.time() - began < 90


def plain_page(rng, words, menu, paras):
    """No article, class or role tells what is what."""
    said = lambda n: " ".join(rng.choice(words, n))
    title, body = said(5), [said(int(rng.integers(20, 60))) for _ in range(paras)]
    links = "".join(f"<li><a href='/{i}'>{said(2)}</a></li>" for i in range(menu))
    html = f"<html><body><div><ul>{links}</ul></div><div>{said(4)}</div><div><h1>{title}</h1><div>" + "".join(f"<p>{p}</p>" for p in body)
    return html + f"</div></div><div><p>Imprint of the house</p><p>{said(3)}</p></div></body></html>", "\n\n".join([title, *body])


def test_templates_decide_where_markup_says_nothing(spark):
    from tidemark.llm.template_extract import extract, main_text

    rng = np.random.default_rng(7)
    words = [f"wort{i}" for i in range(300)]
    rows, want = [], {}
    for i in range(150):
        html, text = plain_page(rng, words, int(rng.integers(3, 7)), int(rng.integers(2, 8)))
        rows.append((i, f"http://h{i % 3}.example/{i}", html, "x", 1))
        want[i] = text
    rows += [(0, *rows[0][1:]), (200, "http://h0.example/odd", "<p>another layout", "x", 1), (201, "http://h0.example/deep", "<div>" * 20000 + "deep", "x", 1), (202, "http://h0.example/long", "<p>" + "long " * 300000, "x", 1), (203, "http://h0.example/", None, "x", 1)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string, main string, host int").repartition(5)
    got = collections.defaultdict(list)
    for r in extract(p).collect():
        got[r.page_id].append(r.text)
    assert all(got[i] == [want[i]] * (2 if i == 0 else 1) for i in range(150))
    assert got[200] == ["another layout"] and got[201] == ["deep"] and got[202] == [" ".join(["long"] * 300000)] and got[203] == [""]
    assert sum(main_text(html) == want[i] for i, _, html, *_ in rows if i in want) == 0  # the markup alone finds none of them


def test_classes_are_those_of_equal_occurrence_vectors(spark):
    from tidemark.llm.template_extract import LEAST_TOKENS, SHARE, deduce_classes, page_tokens

    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(50)]
    pages = [(i, "http://one.example/", plain_page(rng, words, 4, int(rng.integers(1, 5)))[0].replace("<li>", "<li><p>")) for i in range(40)]
    pages += [(100 + i, "http://one.example/", pages[0][2]) for i in range(30)]  # copies of one page count once
    vectors = collections.defaultdict(dict)
    for i, _, html in pages[:40]:
        for token, e in page_tokens(html).items():
            vectors[token][i] = e[1]
    classes = collections.defaultdict(set)
    for (token, _), v in vectors.items():
        classes[tuple(sorted(v.items()))].add(token)
    want = {frozenset(t) for v, t in classes.items() if len(t) >= LEAST_TOKENS and len(v) >= SHARE * 40}
    got = deduce_classes(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).where("valid").collect()
    assert {frozenset(t.token for t in r.tokens) for r in got} == want and len(want) >= 2 and {r.host_pages for r in got} == {40}


def test_formulas_and_objects_stay_in_articles():
    from tidemark.llm.template_extract import main_text

    assert main_text("<article><p>so <math><mi>a</mi><mo>=</mo><mi>b</mi></math> holds</p><object>shown</object></article>") == "so a=b holds\n\nshown"


def test_revisits_are_resolved_against_what_is_read(spark, tmp_path):
    from tidemark.llm.warc_revisit import archive_round_trip, files_of, read_archives, resolve, resolve_revisits, write_archives

    big, long = "a" * 1500, "b é" * 400_000
    rows = [(3, "u", big, "x"), (3, "v", big, "x"), (1, "u", big, "x"), (None, "u", big, "x"), (5, "u", long, "x"), (4, "u", long, "x"), (None, "n", "c" * 1200, "x"), (None, "n", "c" * 1200, "x")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(3)
    key = lambda r: tuple(str(x) for x in r)
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    got = sorted((tuple(r) for r in archive_round_trip(p).collect()), key=key)
    size = {big: 1500, long: len(long.encode()), "c" * 1200: 1200}
    want = [(i, size[h], sha(h), "revisit" if (h, i) in ((big, 1), (big, None), (long, 4)) else "response", {big: 3, long: 5}.get(h) if (h, i) in ((big, 1), (big, None), (long, 4)) else None) for i, _, h, _ in rows]
    assert got == sorted(want, key=key)
    path = f"file://{tmp_path}/warc"
    write_archives(resolve(p.where("NOT (page_id <=> 5)").union(spark.createDataFrame([(5, "u", long, "x")], p.schema)), files_of(p)).where("NOT (page_id <=> 5)"), path)
    lost = [r for r in resolve_revisits(read_archives(spark, path)).collect() if r.page_id == 4]
    assert [(r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in lost] == [("revisit", 5, None, None)]


def test_near_duplicates_of_the_given_documents(spark):
    """Against exact similarities of 4,000 documents, with two partitionings."""
    from tidemark.llm.simhash_dedup import near_duplicates

    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000").select("doc_id", "text").cache()
    sets, by_token = {}, collections.defaultdict(list)
    for r in d.collect():
        w = re.findall("[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or ""))
        sets[r.doc_id] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for x in sets[r.doc_id]:
            by_token[x].append(r.doc_id)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = {(b, a) for own in by_token.values() for k, a in enumerate(own) for b in own[k + 1 :]} | {(b, a) for a in sets for b in sets if a < b and not sets[a] and not sets[b]}
    links = 0
    for a, b in pairs:
        if not sets[a] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
            links += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert links > 200
    for parts in (3, 8):
        assert {r.doc_id: r.component_id for r in near_duplicates(d.repartition(parts)).collect()} == {i: find(i) for i in sets}


def brute_repeats(texts):
    first, want = {}, []
    for i, t in texts:
        w = (t or "").split(" ")
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(i, first.get(g, i))
    for i, t in texts:
        w, gone = (t or "").split(" "), set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(want)


def test_a_source_of_very_many_spans(spark):
    from tidemark.llm.debruijn_dedup import remove_repeats

    rng = np.random.default_rng(12)
    source = [f"s{i}" for i in range(200_000)]
    texts = [(1, " ".join(source))]
    for d in range(20):  # 500 passages each of 14 to 30 words, parted by words of their own
        said = []
        for k in range(500):
            at, n = int(rng.integers(0, 199_000)), int(rng.integers(14, 31))
            said += [*source[at : at + n], f"o{d}-{k}"]
        texts.append((2 + d, " ".join(said)))
    got = remove_repeats(spark.createDataFrame(texts, "doc_id long, text string").repartition(6)).collect()
    assert sorted(tuple(r) for r in got) == brute_repeats(texts)


def test_deeper_dealing_finds_the_same_repeats(spark, monkeypatch):
    from tidemark.llm import debruijn_dedup as d

    rng = np.random.default_rng(13)
    words = [f"w{i}" for i in range(40)]
    base = list(rng.choice(words, 300))
    texts = [(i, " ".join([*rng.choice(words, 30), *base[int(rng.integers(0, 200)) :], *rng.choice(words, 10)])) for i in range(60)]
    monkeypatch.setattr(d, "FAN_BITS", 2)
    got = d.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).collect()
    assert sorted(tuple(r) for r in got) == brute_repeats(texts)


def test_edges_that_share_a_hash_lose_no_repeat(spark):
    """With 3 bits of the first hash nearly all edges share it with others; the second one must tell them apart."""
    from tidemark.llm.debruijn_dedup import remove_repeats

    rng = np.random.default_rng(15)
    words = [f"w{i}" for i in range(60)]
    base = list(rng.choice(words, 400))
    texts = [(i, " ".join([*rng.choice(words, 25), *base[int(rng.integers(0, 300)) :], *rng.choice(words, 15)])) for i in range(50)]
    want = brute_repeats(texts)
    assert sum(r[2] for r in want) > 1000
    for bits in (3, 64):
        got = remove_repeats(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), hash_bits=bits).collect()
        assert sorted(tuple(r) for r in got) == want


def test_quality_by_plain_updates(spark):
    """FTRL over dictionaries, one coordinate at a time, against what train and score give."""
    import math

    from tidemark.llm import quality_ftrl as q

    rng = np.random.default_rng(14)
    words = ["sun", "Moon", "tree", "RIVER", "12", "--", "...", "stone", "été", "x_y"]
    texts = [" ".join(rng.choice(words[:6] if i % 3 else words[3:], int(rng.integers(0, 40)))) for i in range(80)] + [None, "", "sun " * 30_000]
    labels = [(i, int(i % 3 == 0)) for i in range(60)] + [(5, 1), (70, None), (500, 1)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(7, texts[7])], "doc_id long, text string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, label int")
    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    seen = sorted((order[i], y, i) for i, y in labels if y is not None and i in order)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(s):
        return 0.0 if abs(z[s]) <= 0.02 else -(z[s] - math.copysign(0.02, z[s])) / ((1.0 + math.sqrt(n[s])) / 0.6 + 0.05)

    def share(text):
        return list(zip(*(x.tolist() for x in q.features(text))))

    def chance(text):
        return 1 / (1 + math.exp(-max(-35, min(35, sum(weight(s) * v for s, v in share(text))))))

    for _ in range(4):
        for _, y, i in seen:
            p, own = chance(texts[i]), share(texts[i])
            for s, w, v in [(s, weight(s), v) for s, v in own]:
                g = (p - y) * v
                z[s] += g - (math.sqrt(n[s] + g * g) - math.sqrt(n[s])) / 0.6 * w
                n[s] += g * g
    got = q.score(docs, q.train(docs, known)).collect()
    assert len(got) == len(texts) + 1 and all(abs(r.score - chance(texts[r.doc_id])) < 1e-5 for r in got)
    assert q.score(docs.limit(0), np.zeros(1 << q.BITS)).count() == 0


def test_quality_on_labels_held_out(spark):
    from tidemark.llm.queries import op2_quality

    sf = "/root/testdata/sf0.1"
    got = op2_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out AND quality IS NOT NULL").select("score", "predicted", "quality").toPandas()
    good, bad = got.score[got.quality == 1].to_numpy(), got.score[got.quality == 0].to_numpy()
    right, auc = float((got.predicted == got.quality).mean()), float((good[:, None] > bad[None, :]).mean())
    print(f"held out: {len(got)} labels, right {right:.4f}, AUC {auc:.4f}")
    assert len(got) > 500 and right > 0.97 and auc > 0.98


def test_bpe_of_empty_tables_and_odd_texts(spark):
    import public_tokenizers
    from tidemark.llm.trie_bpe import decode, encode, encode_and_decode
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert encode_and_decode(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0
    rng = np.random.default_rng(15)
    odd = ["".join(chr(int(c)) for c in rng.choice([9, 10, 32, 39, 65, 97, 115, 233, 0x4E2D, 0x1F600, 0x301, 48], 200)) for _ in range(60)] + ["a" * 100_000, "<|endoftext|> a <|endoftext|>", " \n" * 5000]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(odd)] + [(0, odd[0], 1, "x"), (None, None, 1, "x")], "doc_id long, text string, ids int, n_tokens string")
    t = Tokenizer.from_file(path)
    both = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, bytes(r.ids), r.text) for r in encode_and_decode(d, path).collect())
    assert both == sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, bytes(r.ids), r.text) for r in decode(encode(d, path), path).collect())
    for i, n, ids, text in both:
        want = t.encode(odd[i] if i >= 0 else "", add_special_tokens=False).ids
        assert n == len(want) and np.frombuffer(ids, "<u4").tolist() == want and text == t.decode(want, skip_special_tokens=False)


def test_chat_of_long_turns_and_conversations(spark):
    from tidemark.llm.chat_windows import read_back, windows

    long = "<|im_end|>\\ é" * 100_000
    rows = [(1, 0, "system", "s"), (1, 1, "user", long), (1, 2, "assistant", long)] + [(2, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(5000)]
    d = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "conv_id long, turn long, role string, text string, span string, window int, message string").repartition(4)
    got = {r.conv_id: r for r in read_back(windows(d)).collect()}
    for c in (1, 2):
        own = [r for r in rows if r[0] == c]
        learnt = "".join(t for _, _, role, t in own if role == "assistant")
        assert got[c].n_turns == len(own) and got[c].loss_chars == len(learnt)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, _, a, b in own).encode()).hexdigest() and got[c].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
