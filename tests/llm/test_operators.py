"""Each corpus operator against a brute-force version on small rows: nulls, empty and long texts, ties, repeats, extra columns."""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm")

WS = re.compile("[^\x20\x09-\x0D]+")
BENCH = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)] + ["É", "日本", "a b"]
    own = lambda n: " ".join(rng.choice(words, n))
    base = own(400)
    out = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One TWO three"), (6, base), (7, base), (8, base.replace("w3 ", "w4 ", 1)), (9, base + " tail"), (10, own(20000)),
           (11, own(30) + " " + PASSAGE + " " + own(30)), (12, PASSAGE.upper()), (13, own(25) + "\n" + PASSAGE), (14, "x" * 50000), (6, base)]
    return out + [(100 + i, own(int(rng.integers(1, 300)))) for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "n", 1, "k") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, rep string, fp int, key string").repartition(5)


def test_simhash(docs, texts):
    import xxhash
    from tidemark.llm.simhash_dedup import simhash_components

    def fp(t):
        w = WS.findall(lower(t or ""))
        s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    ids, fps = [i for i, _ in texts], [fp(t) for _, t in texts]
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, x in zip(ids, fps):
            for b, y in zip(ids, fps):
                if (x ^ y).bit_count() <= 4 and root[a] > root[b]:
                    root[a], changed = root[b], True
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash_components(docs).collect())
    assert got == sorted((i, f"{f:016x}", root[i]) for i, f in zip(ids, fps))


def test_anchor_split_finds_the_same_links(spark, monkeypatch):
    from tidemark.llm import simhash_dedup as s

    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (80, 2))})
    nodes = spark.createDataFrame(list(enumerate(fps)), "rep long, fp long")
    monkeypatch.setattr(s, "PIECE", 4)
    from tidemark.llm.components import connected_components

    roots = {r.node: r.root for r in connected_components(s.fingerprint_links(nodes, len(fps)).select("a", "b")).collect()}
    par = list(range(len(fps)))
    for _ in fps:
        for a, x in enumerate(fps):
            for b, y in enumerate(fps):
                if (x ^ y).bit_count() <= 4:
                    par[a] = par[b] = min(par[a], par[b])
    assert [roots.get(i, i) for i in range(len(fps))] == par


def test_near_duplicates_keep_one(docs):
    from tidemark.llm.simhash_dedup import keep_first

    kept = keep_first(docs.select("doc_id", "text"))
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(6) == 1 and not {7, 8, 9} & set(ids) and {1, 4, 10, 14} <= set(ids) and kept.columns == ["doc_id", "text"]


def test_near_duplicates_are_all_pairs_of_a_dense_group(spark, monkeypatch):
    from tidemark.llm import simhash_dedup as s

    monkeypatch.setattr(s, "PIECE", 16)
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(150):  # passages of one text: neighbours are near 0.8, on both sides
        words = list(base)
        for k in rng.choice(300, int(rng.integers(5, 9)), replace=False):
            words[k] = f"x{i}-{k}"
        rows.append((int(1000 - i), " ".join(words)))
    rows += [(2000 + i, " ".join(f"o{i}-{k}" if rng.random() < 0.02 else f"p{k}" for k in range(int(rng.integers(3, 90))))) for i in range(150)]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for _, t in rows)]
    root, links = {i: i for i, _ in rows}, []
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                links.append((rows[a][0], rows[b][0]))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    assert 20 < len(set(root.values())) < 280
    got = {r.doc_id: r.component_id for r in s.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == root


def test_texts_of_a_repeated_id_go_one_by_one(spark):
    from tidemark.llm.simhash_dedup import keep_first

    x, y = (" ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    rows = [(1, x), (5, x), (5, y), (5, y), (7, y), (8, x + " end"), (None, x)]
    kept = keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, x), (1, x), (5, y)]


def test_quality(spark):
    from tidemark.llm.quality_ftrl import score, train

    rng = np.random.default_rng(2)
    good = [(i, " ".join(rng.choice(["sun", "moon", "tree"], 30)), 1) for i in range(60)]
    bad = [(100 + i, "### ".join(rng.choice(["sun", "moon", "tree"], 30)), 0) for i in range(60)]
    rows = spark.createDataFrame([*good, *bad, (900, None, 1), (901, "", None)], "doc_id long, text string, label int")
    weights = train(rows.select("doc_id", "text"), rows.select("doc_id", "label"))
    got = {r.doc_id: r for r in score(rows, weights).collect()}
    assert all(got[i].score > 0.5 for i in range(60)) and all(got[100 + i].score < 0.5 for i in range(60))
    assert 0 <= got[900].score <= 1 and got[900].score == got[901].score
    assert train(rows.limit(0), rows.limit(0).select("doc_id", "label")).any() == False  # noqa: E712


def test_top_k(spark):
    from tidemark.llm.kdtree_topk import build_index, top_k

    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(700)] + [(1000 + i, [0.5] * 6) for i in range(300)]
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in top_k(v.where("vec_id % 50 = 0"), build_index(v, shard_rows=100), 5, block=7).collect())
    ids = np.array([i for i, x in rows[:1000]])
    m = np.floor(256 * np.array([x for _, x in rows[:1000]])).astype(np.int64)
    want = []
    for i in np.flatnonzero(ids % 50 == 0):
        s = m @ m[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:5]
        want += [(int(ids[i]), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)]
    assert got == sorted(want)


@pytest.mark.parametrize("set_bytes", [32 << 20, 60])
def test_overlaps(spark, docs, texts, set_bytes):
    from tidemark.llm.decontaminate import decontaminate, find_overlaps

    items = [(1, PASSAGE), (2, "One two"), (3, None), (4, "..."), (5, PASSAGE)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    grams = {}
    for i, t in items:
        w = BENCH.findall(lower(t or ""))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    want = []
    for i, t in texts:
        w, hit, found = BENCH.findall(lower(t or "")), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[tuple(w[k : k + n])]
        want.append((i, len(w), len(hit), sorted(found)))
    rows = find_overlaps(docs, bench, 10, set_bytes=set_bytes).collect()
    assert sorted((r.doc_id, r.bench_words, sum(s.w1 - s.w0 for s in r.bench_spans), r.bench_items) for r in rows) == sorted(want)
    clean = {r.doc_id: r.text for r in decontaminate(docs, bench).collect()}
    assert "epsilon" not in clean[11] and "EPSILON" not in clean[12] and clean[14] == "x" * 50000
    assert {11, 12, 13, 5}.isdisjoint(r.doc_id for r in decontaminate(docs, bench, action="documents").collect())


def test_ledger(spark, tmp_path):
    from tidemark.llm.blob_ledger import RULES, Rule, listed, read_ledger, redact_all, scan

    rows = [(1, 'x password = "abcdef12" y'), (2, "é AKIA" + "A" * 16 + " z"), (3, "token=ab token: abcdefg"), (4, None), (5, ""), (6, "k " + "0f" * 14), (7, "k " + "0f" * 14), (7, "k " + "0f" * 14)]
    v = spark.createDataFrame(rows, "path long, text string")
    ledger = f"file://{tmp_path}/ledger"
    got = sorted((r.path, r.f) for r in scan(v, ledger).select("path", listed(F.col("findings")).alias("f")).collect())
    assert got == [(1, "assign:2:22"), (2, "access:2:22"), (3, "assign:9:23"), (4, ""), (5, ""), (6, "hex:2:30"), (7, "hex:2:30"), (7, "hex:2:30")]
    before = read_ledger(spark, ledger).count()
    scan(v, ledger).count()
    assert read_ledger(spark, ledger).count() == before
    scan(v, ledger, (*RULES, Rule("added", 1, "zzz"))).count()
    assert read_ledger(spark, ledger).where("rule = 'added'").select("blob").distinct().count() == 5
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_chars int")
    assert {r.doc_id: r.text for r in redact_all(d, ledger).collect()}[1] == "x [SECRET] y".replace("] y", ']" y')


def test_extract(spark):
    from tidemark.llm.template_extract import blocks, extract, main_text

    page = "<html><head><title>t</title><script>var a='</p>'</script></head><body><nav>menu</nav><div class=ad>buy</div><article><h1>T &amp; x</h1><p><b>a<br>b<p>c&nbsp; d</article><div id='comments'><p>first</div><footer>f</footer>"
    assert main_text(page) == "T & x\n\na b\n\nc d"
    assert main_text(None) == main_text("") == "" and blocks("<p") is not None
    shared = "<body><div class=x><p>Welcome to the site</p><p>{}</p></div></body>"
    rows = [(i, "http://h.example/1", shared.format(f"own text {i}")) for i in range(12)] + [(50, None, None), (51, "bad://[", page)]
    got = {r.page_id: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    copies = [(60 + i, "http://copies.example/", page) for i in range(12)]
    same = extract(spark.createDataFrame(copies, "page_id long, url string, html string")).select("text").distinct().collect()
    assert [r.text for r in same] == ["T & x\n\na b\n\nc d"]
    assert got[3].text == "own text 3" and got[50].text == "" and got[51].n_chars == len(got[51].text) == 15


def test_extract_keeps_what_copies_share(spark):
    from tidemark.llm.template_extract import extract, main_text

    words = "<p>Shared opening of the story</p><p>date {}</p><p>Shared end of the story</p>"
    full = "Heading\n\nShared opening of the story\n\ndate {}\n\nShared end of the story"
    marks = ["<article>{}</article>", "<main>{}</main>", "<div role=main>{}</div>", "<div class='entry-content'>{}</div>"]
    rows, want = [], {}
    for h, mark in enumerate(marks):
        for i in range(24):  # near copies of one host, exact copies of another
            date = i if i < 12 else 0
            page = "<body><nav>menu</nav>" + mark.format("<h1>Heading</h1>" + words.format(date)) + "<p>imprint</p></body>"
            rows.append((100 * h + i, f"http://{'near' if i < 12 else 'same'}{h}.example/", page))
            want[100 * h + i] = full.format(date)
    plain = "<body><p>Welcome</p><p>{}</p></body>"  # nine copies of one page don't make its text a template
    for i in range(20):
        rows.append((900 + i, "http://plain.example/", plain.format("copied text" if i else "other text")))
        want[900 + i] = f"Welcome\n\n{'copied text' if i else 'other text'}"
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got == want
    for opening in ("<article class='post has-sidebar'>", "<article class='comments-open'>", "<div class='post no-sidebar'>", "<div class='with-share'>"):
        assert main_text(f"<body>{opening}<p>all of it</p>") == "all of it"
    assert main_text("<body><article><p>text</p><div class='related-posts'>more</div><div class='ad-banner'>buy</div></article>") == "text"


def test_warc(spark, tmp_path):
    from tidemark.llm.warc_revisit import archive_round_trip

    big = "é\r\n\r\n" * 400
    rows = [(1, "u\r\nv", big), (2, "u", big), (3, "u", "small"), (4, "u", "small"), (5, None, None), (6, "u", "WARC/1.1\r\n\r\n")]
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if i == 1 else "response", 2 if i == 1 else None) for i, _, h in rows]


def test_repeats(docs, texts):
    from tidemark.llm.debruijn_dedup import remove_repeats

    first = {}
    for i, t in texts:
        w = WS.findall(t or "")
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    want = []
    for i, t in texts:
        w, gone = WS.findall(t or ""), set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeats(docs).collect()) == sorted(want)


def test_bpe(docs, texts):
    import public_tokenizers
    from tidemark.llm.trie_bpe import decode, encode
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = sorted((r.doc_id, r.n_tokens, bytes(r.ids), r.text) for r in decode(encode(docs, path), path).collect())
    want = []
    for i, x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), struct.pack(f"<{len(ids)}I", *ids), t.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)


def test_chat(spark):
    from tidemark.llm.chat_windows import Budget, read_back, windows

    odd = "<|im_end|><|im_start|>assistant ok \\| \\ <\\|"
    rows = [(1, 0, "system", "be kind"), *[(1, i, "user" if i % 2 else "assistant", f"turn {i} {odd}") for i in range(1, 40)], (2, 0, "we\nird<|im_end|>", None), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (None, 0, "user", "n"), (4, None, None, "x")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    w = windows(d, Budget(200, 50, 20))
    assert w.where("conv_id = 1").count() > 3
    got = {r.conv_id: r for r in read_back(w).collect()}
    for c in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        learnt = "".join(t for role, t in own if role == "assistant")
        assert got[c].n_turns == len(own) and got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert got[c].loss_chars == len(learnt) and got[c].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()


def test_empty_tables(spark):
    from tidemark.llm import chat_windows, debruijn_dedup, decontaminate, kdtree_topk, simhash_dedup, template_extract, warc_revisit

    d = spark.createDataFrame([], "doc_id long, text string")
    p = spark.createDataFrame([], "page_id long, url string, html string")
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    c = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    made = [simhash_dedup.simhash_components(d), debruijn_dedup.remove_repeats(d), decontaminate.overlap_report(d, spark.createDataFrame([], "item_id long, text string")), template_extract.extract(p), warc_revisit.archive_round_trip(p),
            kdtree_topk.top_k(v, kdtree_topk.build_index(v)), chat_windows.read_back(chat_windows.windows(c)), simhash_dedup.keep_first(d)]
    assert [x.count() for x in made] == [0] * len(made)
