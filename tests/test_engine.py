"""The engine's queries against their SQL on the smallest tables, and cases that the tables do not hold."""

from __future__ import annotations

import datetime as dt

import pytest
from oracle_check import database, differs

from tidemark.operators import fundamentals as fu
from tidemark.operators import history as hi
from tidemark.operators import screening as sc
from tidemark.plans.registry import oracle_sql, queries
from tidemark.sources import filings as fi
from tidemark.sources.concepts import concept_map

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, name):
    assert differs(spark, name, queries()[name], oracle_sql()[name], SF, database(SF)) == ""


def day(s):
    return dt.date.fromisoformat(s) if s else None


def test_split_needs_two_periods(spark):
    def fact(end, filed, val):
        return (1, "us-gaap", "EarningsPerShareDiluted", "USD/shares", day(f"{int(end[:4]) - 1}-12-31"), day(end), day(filed), f"a{filed}", val)

    schema = "cik long, taxonomy string, concept string, unit string, period_start date, period_end date, filed date, accn string, val double"
    rows = [fact("2018-12-30", "2019-02-01", 12.0), fact("2018-12-30", "2020-11-01", 3.0), fact("2019-12-30", "2020-02-01", 13.0), fact("2019-12-30", "2020-11-01", 3.25), fact("2017-12-30", "2018-02-01", 11.5)]
    splits = fu.detect_splits(spark.createDataFrame(rows, schema))
    assert [tuple(r) for r in splits.collect()] == [(1, day("2020-11-01"), 4.0)]
    assert fu.detect_splits(spark.createDataFrame(rows[:2], schema)).count() == 0
    f = {r.period_end.year: r.val for r in fu.fundamentals(spark.createDataFrame(rows, schema), concept_map(spark), splits).collect()}
    assert f[2017] == 2.875 and f[2018] == 3.0


def test_screen_thresholds():
    assert sc.threshold("500m") == 5e8 and sc.threshold("2cr") == 2e7 and sc.threshold(3) == 3.0
    with pytest.raises(ValueError):
        sc.field("drop table")


def test_price_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Date,Open,High,Low,Close,Adjusted_close,Volume\n2024-01-02,1,2,0.5,1.5,1.4,100\n2024-01-03,1,2,0.5,N/A,N/A,100\n2024-01-04,1,2,0.5,1.6,,7\nsome message,,,,,,\n")
    assert sorted((r.date.isoformat(), r.close) for r in fi.read_price_csv(spark, str(tmp_path / "p.csv"), "abc").collect()) == [("2024-01-02", 1.4), ("2024-01-04", 1.6)]


FACT = "cik long, taxonomy string, concept string, unit string, period_start date, period_end date, filed date, accn string, val double"
BAR = "ticker string, date date, open double, high double, low double, close double, volume double"


@pytest.fixture
def refreshed(spark, tmp_path):
    from tidemark.streaming import refresh as rf

    companies = spark.createDataFrame([(i, f"T{i}", f"Name {i}", "S", "X") for i in (1, 2)], "cik long, ticker string, name string, sic_description string, exchange string")
    schema = lambda text: spark.createDataFrame([], text).schema
    for folder in ("bars", "facts", "histories"):
        (tmp_path / folder).mkdir()
    r = rf.Refresh(rf.Store(spark, f"{tmp_path}/store", buckets=8), f"{tmp_path}/bars", schema(BAR), f"{tmp_path}/facts", schema(FACT), companies, concept_map(spark), "2021-06-01", f"{tmp_path}/histories")

    def land(facts=(), bars=()):
        if facts:
            spark.createDataFrame([(c, "us-gaap", "Assets", "USD", None, day("2020-12-31"), day(f), f"{c}-{f}", v) for c, f, v in facts], FACT).coalesce(1).write.mode("append").parquet(r.facts)
        if bars:
            spark.createDataFrame([(t, day(d), c, c, c, c, 10.0) for t, d, c in bars], BAR).coalesce(1).write.mode("append").parquet(r.bars)
        return rf.run(r)

    return r, land


def test_refresh_steps_in_order_and_only_what_changed(refreshed):
    r, land = refreshed
    names = [s["name"] for s in land([(1, "2021-02-01", 5.0), (2, "2021-02-01", 7.0)], [("T1", "2021-01-04", 1.0), ("T2", "2021-01-04", 2.0)])]
    assert names == ["prices", "snapshot", "sentiment", "levels", "filings", "normalise", "snapshot (after filings)"]
    before = dict(r.store._generations("fundamentals"))
    said = land([(1, "2021-04-01", 6.0)], [("T1", "2021-01-05", 3.0)])
    assert all(s["state"] == "ok" for s in said)
    touched = r.store.touched("fundamentals", r.companies.where("cik = 1"), "cik")
    after = {b: max(g for c, g in r.store._generations("fundamentals") if c == b) for b in before}
    assert {b for b in after if after[b] != before[b]} == set(touched)
    assert sorted((x.cik, x.metric, x.val) for x in r.fundamentals().collect()) == [(1, "total_assets", 6.0), (2, "total_assets", 7.0)]
    shown = r.snapshot()
    assert sorted((x.ticker, x.price, x.total_assets) for x in shown.collect()) == [("T1", 3.0, 6.0), ("T2", 2.0, 7.0)]


def test_refresh_without_new_filings_skips_the_second_pass(refreshed):
    r, land = refreshed
    land([(1, "2021-02-01", 5.0)], [("T1", "2021-01-04", 1.0)])
    assert [s["name"] for s in land([], [("T1", "2021-01-05", 2.0)])] == ["prices", "snapshot", "sentiment", "levels", "filings"]


def test_a_failing_step_stops_none_of_the_others(refreshed):
    r, land = refreshed
    land([(1, "2021-02-01", 5.0)], [("T1", "2021-01-04", 1.0)])
    r.bars = r.bars + "-not-there"
    states = {s["name"]: s["state"] for s in land([(1, "2021-05-01", 9.0)])}
    assert states["prices"] == "error" and {v for k, v in states.items() if k != "prices"} == {"ok"} and "normalise" in states


def test_rebased_history_is_reported(refreshed):
    _, land = refreshed
    land([], [("T1", "2021-01-04", 10.0), ("T2", "2021-01-04", 10.0)])
    said = land([], [("T1", "2021-01-04", 5.0), ("T2", "2021-01-04", 10.0), ("T2", "2021-01-05", 11.0)])
    assert said[0]["detail"].startswith("1 rebased")


def test_peers_are_the_nearest_of_all(spark):
    import random

    rnd = random.Random(4)
    rows = [(i, f"T{rnd.randrange(1000):04d}{i}", f"S{i % 3}" if i % 10 else None, rnd.choice([None, 1.0, 2.0, 5.0, float(rnd.randrange(100))])) for i in range(150)]
    want = set()
    for cik, _, sic, cap in rows:
        near = sorted((abs((cap or 0.0) - (c or 0.0)), t, k) for k, t, s, c in rows if s == sic and s is not None and k != cik)[:8]
        want |= {(cik, k, t, g, n + 1) for n, (g, t, k) in enumerate(near)}
    got = sc.peers(spark.createDataFrame(rows, "cik long, ticker string, sic_description string, market_cap double"))
    assert {tuple(r) for r in got.collect()} == want


def test_news_mentions(spark):
    from tidemark.operators import picker as pk

    companies = [("BRK", "Berkshire Hathaway Inc"), ("BRK-B", "Class B of Berkshire"), ("T", "Telephone & Telegraph"), ("SNOW", "Snowflake Inc"), ("FST", "First Solar"), ("NV", "Nvidia Corp"), ("AAA", "Acme One"), ("AAB", "Acme Two"), ("AAC", "Acme Three")]
    c = spark.createDataFrame(companies, "ticker string, name string")
    said = lambda *h: sorted(r.ticker for r in pk.news_mentions(c, spark.createDataFrame([(x,) for x in h], "headline string"), pk.common_first_words(c)).collect())
    assert said("Shares of (BRK-B) rise", None) == ["BRK", "BRK-B"]
    assert said("NYSE: T gains", "nvidia falls", "Nvidia rises") == ["NV", "T"]
    assert said("snow covers the first city", "Acme again", "AT&T") == []
    assert said("First Solar and acme two") == ["AAB", "FST"]
    assert [(r.word, r.companies) for r in pk.common_first_words(c).collect()] == [("acme", 3)]


def filed(rows, cik=7):
    """(concept, unit, start, end, val, filed, form) -> facts of one company."""
    return [(cik, "us-gaap", c, u, day(s), day(e), day(f), f"{cik}-{k}", v) for k, (c, u, s, e, v, f) in enumerate(rows)]


def test_trailing_earnings_use_the_newest_quarter(spark):
    """A fiscal year that ends in January: the fourth quarter is the year less three, and the trailing sum moves on with the next one."""
    from tidemark.operators import snapshot as sn

    eps = lambda s, e, v, f: ("EarningsPerShareDiluted", "USD/shares", s, e, v, f)
    rows = [eps("2025-01-27", "2026-01-25", 4.90, "2026-02-25"), eps("2025-01-27", "2025-04-27", 0.76, "2025-05-28"), eps("2025-04-28", "2025-07-27", 1.08, "2025-08-27"),
            eps("2025-07-28", "2025-10-26", 1.30, "2025-11-19"), eps("2026-01-26", "2026-04-26", 2.39, "2026-05-20")]
    facts = spark.createDataFrame(filed(rows), FACT)
    f = fu.fundamentals(facts, concept_map(spark), fu.detect_splits(facts))
    q4 = f.where("metric = 'eps_diluted' AND period_type = 'Q' AND derived = 1").collect()
    assert [(r.period_end, round(r.val, 9)) for r in q4] == [(day("2026-01-25"), 1.76)]
    assert [round(r.ttm, 9) for r in sn.ttm(f).where("metric = 'eps_diluted'").collect()] == [6.53]
    vintages = spark.createDataFrame([(day("2026-06-30"),)], "as_of date")
    assert hi.fundamentals_asof(facts, concept_map(spark), vintages).where("derived = 1").count() == 0


def test_a_vintage_shows_the_value_before_its_restatement(spark):
    rows = [("Revenues", "USD", "2022-01-01", "2022-03-31", 100.0, "2022-05-05"), ("Revenues", "USD", "2022-01-01", "2022-03-31", 150.0, "2023-06-01")]
    facts = spark.createDataFrame(filed(rows), FACT)
    vintages = spark.createDataFrame([(day(d),) for d in ("2022-03-31", "2022-12-31", "2023-12-31")], "as_of date")
    got = hi.fundamentals_asof(facts, concept_map(spark), vintages).select("as_of", "val").collect()
    assert sorted((r.as_of.isoformat(), r.val) for r in got) == [("2022-12-31", 100.0), ("2023-12-31", 150.0)]
    assert [r.val for r in fu.fundamentals(facts, concept_map(spark)).collect()] == [150.0]


def test_the_preferred_tag_wins_and_a_fiscal_year_may_end_in_september(spark):
    year = [("2023-10-01", "2023-12-30"), ("2023-12-31", "2024-03-30"), ("2024-03-31", "2024-06-29")]
    rows = [("RevenueFromContractWithCustomerExcludingAssessedTax", "USD", s, e, 10.0 + k, "2024-08-01") for k, (s, e) in enumerate(year)]
    rows += [("Revenues", "USD", s, e, 99.0, "2024-08-01") for s, e in year]
    rows += [("RevenueFromContractWithCustomerExcludingAssessedTax", "USD", "2023-10-01", "2024-09-28", 50.0, "2024-11-01")]
    f = fu.fundamentals(spark.createDataFrame(filed(rows), FACT), concept_map(spark)).where("metric = 'revenue'").collect()
    assert sorted(r.val for r in f if r.period_type == "Q") == [10.0, 11.0, 12.0, 17.0] and [r.val for r in f if r.period_type == "FY"] == [50.0]


def test_ratios_on_negative_equity_are_null(spark):
    from tidemark.operators import snapshot as sn

    rows = [(c, "USD", None, "2024-12-31", v, "2025-02-01") for c, v in (("StockholdersEquity", -5.0), ("Assets", 100.0), ("LongTermDebtNoncurrent", 10.0))]
    rows += [("NetIncomeLoss", "USD", "2024-01-01", "2024-12-31", 20.0, "2025-02-01"), ("CommonStockSharesOutstanding", "shares", None, "2024-12-31", 4.0, "2025-02-01")]
    companies = spark.createDataFrame([(7, "NEG", "Neg", "S", "X")], "cik long, ticker string, name string, sic_description string, exchange string")
    bars = spark.createDataFrame([("NEG", day("2025-03-01"), 3.0)], "ticker string, date date, close double")
    r = sn.snapshot(fu.fundamentals(spark.createDataFrame(filed(rows), FACT), concept_map(spark)), companies, bars).first()
    assert r.roe is None and r.pb is None and r.debt_to_equity is None and r.market_cap == 12.0 and r.roa == 20.0


def test_one_restated_quarter_is_no_split(spark):
    eps = lambda s, e, v, f: ("EarningsPerShareDiluted", "USD/shares", s, e, v, f)
    near = [eps("2023-01-01", "2023-12-31", 2.00, "2024-02-01"), eps("2023-01-01", "2023-12-31", 2.15, "2025-02-01")]
    odd = [eps("2023-01-01", "2023-03-31", 0.41, "2023-05-01"), eps("2023-01-01", "2023-03-31", 0.01, "2024-05-01"), eps("2023-04-01", "2023-06-30", 0.42, "2023-08-01"), eps("2023-04-01", "2023-06-30", 0.02, "2024-05-01")]
    assert fu.detect_splits(spark.createDataFrame(filed(near), FACT)).count() == 0
    assert fu.detect_splits(spark.createDataFrame(filed(odd), FACT)).count() == 0


def test_labels(spark):
    from pyspark.sql import functions as F

    from tidemark.functions.expressions import fiscal_quarter_label, zone
    from tidemark.sources.concepts import sic_ranges

    ends = [("2024-09-28", "0926", "Q4 2024"), ("2024-12-28", "0926", "Q1 2025"), ("2025-03-29", "0926", "Q2 2025"), ("2025-06-28", "0926", "Q3 2025"), ("2025-01-31", "0131", "Q4 2025"), ("2025-04-30", "0131", "Q1 2026"), ("2025-06-30", None, "Q2 2025")]
    d = spark.createDataFrame([(day(e), y, w) for e, y, w in ends], "e date, y string, want string")
    assert [r.got for r in d.withColumn("got", fiscal_quarter_label(F.col("e"), F.col("y"))).collect()] == [w for *_, w in ends]
    scores = [(0.0, "extreme-fear"), (19.9, "extreme-fear"), (20.0, "fear"), (50.0, "neutral"), (79.9, "greed"), (80.0, "extreme-greed"), (100.0, "extreme-greed"), (None, None)]
    assert [r.got for r in spark.createDataFrame(scores, "s double, want string").withColumn("got", zone(F.col("s"))).collect()] == [w for _, w in scores]
    codes = [("6022", "Banking"), ("3674", "Semiconductors"), ("7372", "Software & IT services"), ("2834", "Biotech & Pharma"), ("3711", "Manufacturing"), ("5812", "Retail trade"), (None, "Unclassified"), ("garbage", "Unclassified")]
    got = sc.with_sector(spark.createDataFrame([(i, c) for i, (c, _) in enumerate(codes)], "cik long, sic string"), sic_ranges(spark)).collect()
    assert {r.cik: r.sector for r in got} == {i: w for i, (_, w) in enumerate(codes)}


def test_facts_read_lineitem_once_and_companies_are_dealt_by_their_number(spark):
    from tidemark.operators import fundamentals as fu
    from tidemark.sources import adapters
    from tidemark.sources.concepts import concept_map

    x = adapters.Inputs(spark, "/root/testdata/sf0.001")
    assert "{lineitem}" not in adapters.FACTS_SPARK and adapters._V.count("{lineitem}") == 1
    tasks = fu.by_company(x.facts).rdd.getNumPartitions()
    fu_rows, fu.TASK_FACTS = fu.TASK_FACTS, 100
    try:
        many = fu.by_company(x.facts).rdd.getNumPartitions()
    finally:
        fu.TASK_FACTS = fu_rows
    assert many == max(tasks, -(-x.facts.count() // 100))
    plan = fu.fundamentals(x.facts, concept_map(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and "REPARTITION_BY_NUM" in plan
