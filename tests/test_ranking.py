"""Exact ranks, neighbours across borders, pages by key and the name index, at sizes and ties that the tables do not have."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.operators import ranking as rk
from tidemark.operators import screening as sc


def test_ranges_follow_the_data(spark):
    rows = spark.range(60_000).select(F.exp(3 * F.randn(5)).alias("v"), F.lit("m").alias("metric"))  # lognormal
    sizes = [r["count"] for r in rk.in_parts(rows, "v", ["metric"]).groupBy("part").count().collect()]
    assert len(sizes) == rk.PARTS and max(sizes) < 2 * 60_000 / rk.PARTS
    tied = spark.range(3000).select((F.col("id") % 3).cast("double").alias("v"))
    assert {r["count"] for r in rk.in_parts(tied, "v", []).groupBy("part").count().collect()} == {1000}


def test_positions_are_exact(spark):
    rnd = random.Random(2)
    values = {k: [rnd.lognormvariate(0, 4) * rnd.choice([-1, 1]) for _ in range(n)] + [0.0, 1e300, -1e300] for k, n in (("a", 3000), ("b", 1), ("c", 100))}
    counts = [(k, v, rnd.randrange(1, 5)) for k, own in values.items() for v in own]
    got = {(r.k, r.v): r.start for r in rk.positions(spark.createDataFrame(counts, "k string, v double, n long"), "v", ["k"]).collect()}
    want = {}
    for k in values:
        total = 0
        for _, v, n in sorted(c for c in counts if c[0] == k):
            want[k, v], total = total, total + n
    assert got == want
    assert rk.positions(spark.createDataFrame([], "v double, n long"), "v").count() == 0


def test_neighbours_cross_the_borders_of_blocks(spark):
    rows = [(g, i, i * 10) for g, n in (("x", 57), ("y", 3), ("z", 10)) for i in range(n)]
    for block in (2, 10, 19, 100):
        got = rk.neighbours(spark.createDataFrame(rows, "g string, at long, v long"), "at", ["g"], "v", 3, block=block).collect()
        assert len(got) == len(rows)
        for r in got:
            n = max(i for g, i, _ in rows if g == r.g)
            assert r.v == [10 * i for i in range(max(0, r.at - 3), min(n, r.at + 3) + 1)]


def test_peers_of_one_large_industry(spark):
    n = 100_000
    c = spark.range(n).select(F.col("id").alias("cik"), F.format_string("T%06d", "id").alias("ticker"), F.lit("one").alias("sic_description"), F.when(F.col("id") % 4 > 0, F.pmod(F.xxhash64("id"), F.lit(40_000)).cast("double")).alias("market_cap"))
    own = {r.cik: (r.market_cap or 0.0, r.ticker) for r in c.collect()}
    asked = [0, 1, 4, 77, 5002, 99_999]
    got = sc.peers(c).where(F.col("cik").isin(asked)).collect()
    for k in asked:
        near = sorted((abs(own[k][0] - cap), t, i) for i, (cap, t) in own.items() if i != k)[:8]
        assert sorted((r.rank, r.gap, r.peer, r.peer_cik) for r in got if r.cik == k) == [(i + 1, *x) for i, x in enumerate(near)]


def test_pages_by_key_are_the_pages_of_one_sort(spark):
    rnd = random.Random(1)
    rows = [(i, f"T{i % 40:02d}" if i < 60 else f"U{i}", rnd.choice([None, 1.0, 2.0, 3.5, float(i)])) for i in range(90)]
    snap = spark.createDataFrame(rows, "cik long, ticker string, market_cap double")
    bars = spark.createDataFrame([(f"T{i:02d}", rnd.choice([None, 5.0, 7.0])) for i in range(40)], "ticker string, volume double").withColumn("change_pct", F.col("volume"))
    sectors = snap.select("cik", F.lit("s").alias("sector"), F.lit("s").alias("sector_slug"))
    members = spark.createDataFrame([], "index_slug string, ticker string")
    for sort in ("active", "mcap", "losers"):
        column, desc = sc.SORTS[sort]
        page = lambda after=None, n=11: sc.browse(snap, bars, sectors, members, sort=sort, after=after, per_page=n).collect()
        whole, found, last = page(n=1000), [], None
        while rows_ := page(last):
            found, last = [*found, *rows_], rows_[-1]
        assert [(r.cik, r.ticker) for r in found] == [(r.cik, r.ticker) for r in whole] and len(found) == 90
        known = [r[column] for r in whole if r[column] is not None]
        assert known == sorted(known, reverse=desc) and all(r[column] is None for r in whole[len(known) :])


def test_the_name_index_finds_what_a_scan_finds(spark):
    rows = [(1, "ABC", "Alpha Beta", 5.0), (2, "AB", "abacus", None), (3, "X", "100% Pure_Water", 9.0), (4, None, "Zeta", 1.0), (5, "aBcD", None, 7.0), (6, "Q", "", 3.0), (7, "BCAB", "ab ab", 2.0), (8, "ÉT", "Été SA", 4.0)]
    snap = spark.createDataFrame(rows, "cik long, ticker string, name string, market_cap double")
    index = sc.name_index(snap).cache()
    for term in ("a", "ab", "abc", "abca", "ALPHA", "a b", "%", "_w", "100%", "é", "zz", "bcab", "b", "ab ab"):
        want = sorted(c for c, t, n, _ in rows if term.lower() in (t or "").lower() or term.lower() in (n or "").lower())
        got = sc.search(snap, term, index).collect()
        assert sorted(r.cik for r in got) == want, term
        assert [r.rank for r in got] == sorted(r.rank for r in got)
    assert [r.ticker for r in sc.search(snap, "ab", index).collect()][0] == "AB"
