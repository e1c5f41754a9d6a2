"""Clusters, the filter audit, the source mix and whole class names, against brute force: nulls, empty texts, ties, repeats, extra columns."""

from __future__ import annotations

import hashlib
import itertools
import math
import re

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")

WS = re.compile("[^\x20\x09-\x0D]+")


def lloyd(rows, k, rounds, scale, dim, seed=3):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted(((i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept))
    cents = [v for _, _, v in named[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for r in range(rounds + 1):
        own = [min(range(len(cents)), key=lambda c: (far(v, cents[c]), c)) for _, v in kept]
        if r < rounds:
            for c in range(len(cents)):
                group = [v for (_, v), o in zip(kept, own) if o == c]
                if group:
                    cents[c] = [sum(x) // len(group) for x in zip(*group)]
    return [(i, o, far(v, cents[o])) for (i, v), o in zip(kept, own)], cents


def test_clusters(spark):
    from tidemark.llm.drift_clusters import cluster, cluster_report

    rng = np.random.default_rng(5)
    middles = rng.normal(0, 0.5, (9, 4))
    rows = [(int(i), (middles[i % 9] + rng.normal(0, 0.12, 4)).tolist()) for i in range(700)]
    rows += [(1000 + i, [0.25, 0.25, 0.25, 0.25]) for i in range(40)] + [(1000, [0.25] * 4), (1, [9.0, 1.0, 1.0, 1.0])]
    rows += [(2000, None), (2001, [1.0]), (2002, [1.0, None, 1.0, 1.0]), (2003, [1.0, float("nan"), 0.0, 0.0]), (2004, [float("inf")] * 4), (2005, []), (None, [0.1, 0.2, 0.3, 0.4])]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string").repartition(5)
    want, cents = lloyd(rows, 6, 7, 1024, 4)
    got, centroids, scanned = cluster(df, k=6, rounds=7, dim=4)
    order = lambda x: sorted(x, key=lambda r: (r[0] is None, r))
    assert order((r.vec_id, r.cluster, r.distance) for r in got.collect()) == order(want)
    assert centroids.tolist() == cents and scanned[0] == len(want) and sum(scanned[2:]) < 0.7 * len(want) * len(scanned[2:])
    report = cluster_report(df, k=6, rounds=7, dim=4).collect()
    assert {r.inertia for r in report} == {sum(d for _, _, d in want)} and len(report) == len(want)
    for r in report:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) and r.centroid_sha256 == hashlib.sha256(",".join(map(str, cents[r.cluster])).encode()).hexdigest()
    few = df.where("vec_id IN (3, 1001)")
    assert sorted((r.vec_id, r.distance) for r in cluster_report(few, k=6, rounds=2, dim=4).collect()) == [(3, 0), (1001, 0)]
    assert cluster_report(df.where("false"), k=6, dim=4).count() == 0
    assert cluster(df.where("vec_id >= 1001 AND vec_id < 1040"), k=3, rounds=3, dim=4)[0].select("cluster").distinct().collect() == [(0,)]  # all alike: ties to 0
    with pytest.raises(Exception, match="beyond"):
        cluster_report(spark.createDataFrame([(1, [1e9] * 4)], "vec_id long, embedding array<double>"), k=2, dim=4)


def test_lower_bounds_hold_and_loosen_less():
    from tidemark.llm.drift_clusters import loosening

    rng = np.random.default_rng(8)
    less = 0
    for _ in range(300):
        dim = int(rng.integers(2, 6))
        old = rng.integers(-500, 500, (4, dim))
        new = old + rng.integers(-60, 60, (4, dim)) * rng.integers(0, 2, (4, 1))
        radius = rng.uniform(0, 300, 4)
        falls = loosening(old, new, radius)
        drift = np.sqrt(((new - old) ** 2).sum(1))
        for i in range(4):
            x = rng.normal(0, 1, (400, dim))
            x = old[i] + x / np.sqrt((x * x).sum(1))[:, None] * radius[i] * rng.uniform(0, 1, (400, 1)) ** 0.2
            others = [j for j in range(4) if j != i]
            before, after = (np.sqrt(((x[:, None] - c[None, others]) ** 2).sum(2)) for c in (old, new))
            assert ((before - after).max() <= falls[i] + 1e-6) and falls[i] <= drift[others].max() * (1 + 1e-9)
            less += falls[i] < 0.8 * drift[others].max()
    assert less > 300


def audited(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, t, s in docs:
        t = t or ""
        w = WS.findall(t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails.append({"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy})
    out = {}
    for part in {s or "" for _, _, s in docs}:
        own = [(i, f) for (i, _, s), f in zip(docs, fails) if (s or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for o in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, k in enumerate(o, 1):
                gone = [x for x in left if x[1][k]]
                lost = [x for x in own if x not in left and x[1][k]] if False else [x for n, x in enumerate(own) if x[1][k] and any(x[1][q] for q in o[: step - 1])]
                left = [x for x in left if not x[1][k]]
                shapley[k] += len(gone)
                out[part, o, step] = [len(left), len(gone), len(lost), sum(f[k] and sum(f.values()) == 1 for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, o, step), v in out.items():
            if p == part:
                v.append(shapley[o[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def test_filter_audit(spark):
    from tidemark.llm.filter_audit import audit

    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(400)] + ["É", "ABC", "#x", "日本"]
    say = lambda n, m: " ".join(rng.choice(words[:m], n))
    docs = [(i, say(int(rng.integers(1, 500)), int(rng.integers(50, 404))), f"s{i % 2}") for i in range(60)]
    docs += [(100, None, None), (101, "", ""), (99, "", "s1"), (None, "", "s0"), (None, docs[3][1], "s1"), (3, docs[3][1], "s1"), (70, docs[3][1], "s0"), (71, docs[3][1], None), (72, "z" * 50000, "s0"), (72, " ".join(["y"] * 200), "s0"), (73, "A" + "b" * 49, "s0")]
    labels = [(i, int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(0, 110, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1), (70, None, 1)]
    d = spark.createDataFrame([(*r, 1, "m") for r in docs], "doc_id long, text string, source string, n int, mask string").repartition(4)
    lab = spark.createDataFrame([(*r, "t") for r in labels], "doc_id long, quality int, toxic int, text string")
    got = sorted(tuple(r) for r in audit(d, lab).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())
    assert got == audited(docs, labels)
    assert audit(d.where("false"), lab).count() == 0
    assert audit(d, lab.where("false")).agg({"good_lost": "max", "toxic_lost": "max"}).first() == (0, 0)
    with pytest.raises(ValueError):
        audit(d, lab, {"E": d["doc_id"] > 1})


def mixed_by_hand(docs, weights=(5, 2, 1)):
    size = [len(WS.findall(t or "")) for _, t, _ in docs]
    names = sorted({s for *_, s in docs if s is not None}, key=lambda s: s.encode()) + [None] * any(s is None for *_, s in docs)
    own = {s: sum(n for n, (*_, x) in zip(size, docs) if x == s) for s in names}
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    held = set()
    while True:
        left = sum(own.values()) - sum(3 * own[s] for s in held)
        free = sum(weight[s] for s in names if s not in held)
        above = {s for s in names if s not in held and weight[s] * left / free > 3 * own[s]} if free else set()
        if not above:
            break
        held |= above
    return size, own, {s: 3.0 * own[s] if s in held else weight[s] * left / free for s in names}


def test_source_mix(spark):
    from tidemark.llm.source_mix import mix_report, mix_spans, mixed, schedule, sized, targets

    rng = np.random.default_rng(4)
    say = lambda n: " ".join(rng.choice([f"w{i}" for i in range(90)], n))
    docs = [(i, say(int(rng.integers(1, 60))), ["a", "b", "É", "z", None][min(i % 9, 4)]) for i in range(300)]
    docs += [(400, None, "a"), (401, " \t", "b"), (402, say(5000), "c"), (403, "", "only empty"), (404, "few words here", "tiny"), (405, None, None), (7, docs[7][1], docs[7][2]), (7, "other text", "a"), (None, say(30), "a"), (None, None, "a")]
    df = spark.createDataFrame([(*r, 1, "k") for r in docs], "doc_id long, text string, source string, sid int, key string").repartition(4)
    size, own, target = mixed_by_hand(docs)
    got = mix_report(df).collect()
    same = lambda rows: sorted(rows, key=str)
    assert same((r.doc_id, r.size, r.source_size) for r in got) == same((i, n, own[s]) for (i, _, s), n in zip(docs, size))
    source = {r.doc_id: s for r in got for i, _, s in docs if i == r.doc_id}
    assert {round(r.target, 6) for r in got} == {round(t, 6) for t in target.values()}
    taken = {}
    for r in df.select("doc_id", "source").distinct().collect():
        source.setdefault(r.doc_id, r.source)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
    by = mix_spans(df).groupBy("source").agg({"n": "sum"}).collect()
    for s, n in by:
        taken[s] = n or 0
        assert abs(taken[s] - target[s]) <= 0.5
    assert taken["tiny"] == 9 and taken["only empty"] == 0
    assert same(map(tuple, mix_report(df.repartition(7)).collect())) == same(map(tuple, got))
    out = mixed(df, block=64).orderBy("slot").collect()
    assert all(len(r.text.split()) == r.n_words <= 64 for r in out) and sum(r.n_words for r in out) == sum(taken.values())
    assert sum(r.n_words < 64 for r in out) <= len(target)  # only a source's last block is cut
    said = {}
    for r in out:
        said.setdefault(r.source, []).extend(r.text.split())
    for s in target:  # a source's slots in a row are its documents, whole, again and again
        every = sorted(w for _, t, x in docs if x == s for w in (t or "").split())
        once = said.get(s, [])[: len(every)]
        assert sorted(once) == every[: len(once)] if len(once) == len(every) else set(once) <= set(every)
    sources = targets(sized(df))
    slots = [r.sid for r in schedule(sources, 16).orderBy("slot").collect()]
    need = {r.sid: math.ceil(r.quota / 16) for r in sources.collect()}
    assert {k: slots.count(k) for k in need} == need
    for at in range(40, len(slots), 40):  # any beginning of the mix is mixed like the whole
        for k in need:
            assert abs(slots[:at].count(k) - at * need[k] / len(slots)) <= 6
    assert mix_report(df.where("false")).count() == 0 and mixed(df.where("false")).count() == 0
    assert [tuple(r)[1:] for r in mix_report(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).collect()] == [(0, 0, 0.0, 0)]


def test_class_names_count_whole(spark):
    from tidemark.llm.template_extract import extract

    body = '<h1>Title {0}</h1><p>first {0} of the text that is long enough</p><div class="share-price"><p>price {0}</p></div><p class="comment-count-note">note {0}</p><div class="related-work">work {0}</div><div class="notice-period">period {0}</div>'
    junk = '<nav>menu</nav><div class="share-buttons">Tweet {0}</div><div class="related-posts"><p>more {0}</p></div><section id="comments"><div class="comment-list"><p>reader {0} says so</p></div></section><div class="ad-slot-2">buy {0}</div><div class="newsletter-signup">sign {0}</div>'
    marked = f'<body><div class="menu">m</div><article class="post has-sidebar">{body}{junk}</article><footer>f</footer></body>'
    plain = f'<body><div class="menu">m</div><div class="wrap">{body}{junk}</div><div class="site-footer">f</div></body>'
    rows = [(i, "http://marked.example/", marked.format(i)) for i in range(20)] + [(100 + i, "http://plain.example/", plain.format(i)) for i in range(20)]
    rows += [(200, "http://single.example/", marked.format(200)), (201, "http://other.example/", plain.format(201)), (3, "http://marked.example/", marked.format(203))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.text) for r in extract(df).collect())
    text = lambda i: f"Title {i}\n\nfirst {i} of the text that is long enough\n\nprice {i}\n\nnote {i}\n\nwork {i}\n\nperiod {i}"
    assert got == sorted([(i, text(i)) for i in range(20)] + [(100 + i, text(i)) for i in range(20)] + [(200, text(200)), (201, text(201)), (3, text(203))])
