"""Past views by validity intervals, against the current view of what was filed by then."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fundamentals as fu
from tidemark.operators import history as hi
from tidemark.operators import intervals as iv
from tidemark.operators import snapshot as sn
from tidemark.sources.concepts import concept_map

FACT = "cik long, taxonomy string, concept string, unit string, period_start date, period_end date, filed date, accn string, val double"
REVENUE = ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"]


def day(s):
    return dt.date.fromisoformat(s)


@pytest.fixture(scope="module")
def messy(spark):
    """Restatements, tags that come later, year-to-date figures, a year with two ends, missing quarters, filings of one day."""
    rnd = random.Random(11)
    rows = []
    for cik in range(1, 7):
        for year in (2020, 2021, 2022, 2023, 2024):
            ends = [day(f"{year}-03-31"), day(f"{year}-06-30"), day(f"{year}-09-30"), day(f"{year}-12-31")]
            starts = [day(f"{year}-01-01"), *[e + dt.timedelta(1) for e in ends[:3]]]
            for concept, unit in [*[(c, "USD") for c in REVENUE], ("NetIncomeLoss", "USD"), ("NetCashProvidedByUsedInOperatingActivities", "USD"), ("EarningsPerShareDiluted", "USD/shares"), ("Assets", "USD"), ("Unmapped", "USD")]:
                spans = [(None, e) for e in ends] if concept == "Assets" else [(starts[0], e) for e in ends] if concept.startswith("NetCash") else [*zip(starts[:3], ends), (starts[0], ends[3])]
                if rnd.random() < 0.3:
                    spans.append((starts[0], ends[3] + dt.timedelta(rnd.choice([-3, 2]))))
                if rnd.random() < 0.3 and concept != "Assets":
                    spans.append((starts[3], ends[3]))
                for s, e in spans:
                    if rnd.random() < 0.15:
                        continue
                    for version in range(rnd.choice([1, 1, 1, 2, 3])):
                        filed = e + dt.timedelta(30 + rnd.choice([0, 3, 10]) + 90 * version * rnd.choice([0, 1, 4]))
                        rows.append((cik, "us-gaap", concept, unit, s, e, filed, f"{cik}-{filed}-{rnd.randrange(3)}", float(rnd.randrange(1, 1000))))
    rows = list({(r[0], *r[2:6], r[6], r[7]): r for r in rows}.values())
    return spark.createDataFrame(rows, FACT).repartition(4).cache()


def test_each_vintage_is_the_current_view_of_what_was_filed(spark, messy):
    cm = concept_map(spark)
    days = ["2020-05-15", "2021-03-01", "2022-02-10", "2023-08-20", "2026-12-31"]
    got = hi.fundamentals_asof(messy, cm, spark.createDataFrame([(day(d),) for d in days], "as_of date")).collect()
    for d in days:
        want = fu.fundamentals(messy.where(F.col("filed") <= d), cm).collect()
        own = sorted(tuple(r)[1:] for r in got if r.as_of == day(d))
        assert own == sorted(map(tuple, want)) and (d < "2021" or own)


def test_figures_of_each_vintage(spark, messy):
    cm = concept_map(spark)
    days = ["2021-03-01", "2023-08-20", "2026-12-31"]
    figures = iv.at_vintages(hi.figure_spans(hi.fundamentals_spans(messy, cm)), spark.createDataFrame([(day(d),) for d in days], "as_of date"))
    got = {(r.as_of.isoformat(), r.cik, r.metric, r.kind): round(r.v, 9) for r in figures.collect()}
    want = {}
    for d in days:
        f = fu.fundamentals(messy.where(F.col("filed") <= d), cm)
        for kind, df, c, metrics in (("t", sn.ttm(f), "ttm", sn.TTM_METRICS), ("i", sn.latest_instant(f), "val", sn.INSTANTS), ("g", sn.cagr(f), "cagr", sn.GROWTH)):
            want |= {(d, r.cik, r.metric, kind): round(r[c], 9) for r in df.collect() if r[c] is not None and r.metric in metrics}
    assert got == want and {k[3] for k in want} == {"t", "i", "g"}


def test_intervals_do_not_overlap_and_do_not_depend_on_vintages(spark, messy):
    spans = hi.fundamentals_spans(messy, concept_map(spark)).select("cik", "metric", "period_end", "period_type", "since", "until").collect()
    by: dict = {}
    for r in spans:
        assert r.since < r.until
        by.setdefault(tuple(r)[:4], []).append((r.since, r.until))
    for held in by.values():
        held.sort()
        assert all(a[1] <= b[0] for a, b in zip(held, held[1:]))


def test_prices_as_of_each_tickers_own_days(spark):
    bars = spark.createDataFrame([("A", day("2024-01-02"), 1.0), ("A", day("2024-01-05"), 2.0), ("A", day("2024-01-08"), None), ("B", day("2024-01-03"), 9.0)], "ticker string, date date, close double")
    asked = spark.createDataFrame([("A", day("2024-01-04")), ("A", day("2024-01-04")), ("A", day("2024-01-05")), ("A", day("2024-02-01")), ("A", day("2023-12-31")), ("B", day("2024-01-02")), ("C", day("2024-02-01"))], "ticker string, as_of date")
    got = sorted((r.ticker, r.as_of.isoformat(), r.price, r.price_date.isoformat()) for r in sn.price_asof(bars, asked).collect())
    assert got == [("A", "2024-01-04", 1.0, "2024-01-02"), ("A", "2024-01-05", 2.0, "2024-01-05"), ("A", "2024-02-01", 2.0, "2024-01-05")]
    shared = sn.price_asof(bars, spark.createDataFrame([(day("2024-01-03"),), (day("2024-03-01"),)], "as_of date"))
    assert sorted((r.ticker, r.as_of.isoformat(), r.price) for r in shared.collect()) == [("A", "2024-01-03", 1.0), ("A", "2024-03-01", 2.0), ("B", "2024-01-03", 9.0), ("B", "2024-03-01", 9.0)]
    assert sn.price_asof(bars.where("false"), asked).count() == 0


def test_first_in_force(spark):
    rows = [("k", 1, day("2020-01-05"), day("2020-01-09")), ("k", 2, day("2020-01-01"), day("9999-12-31")), ("k", 3, day("2020-01-01"), day("2020-01-20")), ("l", 7, day("2020-01-01"), day("2020-01-02"))]
    out = iv.first_in_force(spark.createDataFrame(rows, "k string, rank int, since date, until date"), ["k"], ["rank"])
    by_day = {("k", d): [r.rank for r in out.where("k = 'k'").collect() if r.since <= day(d) < r.until] for d in ("2020-01-01", "2020-01-05", "2020-01-08", "2020-01-09", "2020-03-01")}
    assert list(by_day.values()) == [[2], [1], [1], [2], [2]]
    assert [tuple(r) for r in out.where("k = 'l'").collect()] == [rows[3]]
    assert iv.first_in_force(spark.createDataFrame([], "k string, rank int, since date, until date"), ["k"], ["rank"]).count() == 0
