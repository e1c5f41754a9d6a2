"""Six filers over four years, from filed facts to ratios, against figures worked out here."""

from __future__ import annotations

import calendar
import datetime as dt

import pytest

from tidemark.operators import fundamentals as fu
from tidemark.operators import history as hi
from tidemark.operators import snapshot as sn
from tidemark.sources.concepts import concept_map

SCHEMA = "cik long, taxonomy string, concept string, unit string, period_start date, period_end date, filed date, accn string, val double"
MODERN = "RevenueFromContractWithCustomerExcludingAssessedTax"
#: cik: ticker, revenue tag, revenue of 2021, net margin, growth a year, last month of the fiscal year.
FILERS = {
    1: ("MODT", MODERN, 10e9, 0.22, 0.15, 12), 2: ("LEGC", "Revenues", 4e9, 0.08, 0.03, 12), 3: ("DEPR", "SalesRevenueNet", 800e6, 0.14, 0.25, 12),
    4: ("BANQ", "Revenues", 6e9, 0.28, 0.05, 12), 5: ("NEGE", "Revenues", 2e9, 0.05, 0.02, 12), 6: ("SEPT", MODERN, 3e9, 0.18, 0.12, 9),
}
SHARES, WEIGHTS, YEARS, PRICE = 1e9, (0.22, 0.24, 0.25, 0.29), range(2021, 2025), 40.0


def revenue(cik, year):
    return FILERS[cik][2] * (1 + FILERS[cik][4]) ** (year - 2021)


def quarter_ends(cik, year):
    """The day before the year and the ends of its quarters."""
    months = [12 * year + FILERS[cik][5] - 1 - 3 * k for k in (4, 3, 2, 1, 0)]
    return [dt.date(m // 12, m % 12 + 1, calendar.monthrange(m // 12, m % 12 + 1)[1]) for m in months]


def filings(cik):
    _, tag, _, margin, _, _ = FILERS[cik]
    one = dt.timedelta(1)
    for year in YEARS:
        total, ends = revenue(cik, year), quarter_ends(cik, year)
        for q in (1, 2, 3, 4):
            filed, share = ends[q] + dt.timedelta(52 if q == 4 else 35), 1.0 if q == 4 else WEIGHTS[q - 1]
            begin, so_far = ends[0 if q == 4 else q - 1] + one, sum(WEIGHTS[:q])
            said = [(tag, "USD", begin, total * share), ("NetIncomeLoss", "USD", begin, total * share * margin), ("OperatingIncomeLoss", "USD", begin, total * share * margin * 1.3),
                    ("EarningsPerShareDiluted", "USD/shares", begin, total * share * margin / SHARES), ("WeightedAverageNumberOfDilutedSharesOutstanding", "shares", begin, SHARES),
                    ("NetCashProvidedByUsedInOperatingActivities", "USD", ends[0] + one, total * so_far * margin * 1.1),
                    ("Assets", "USD", None, total * 2), ("StockholdersEquity", "USD", None, total * (-0.35 if cik == 5 else 0.5)), ("LongTermDebtNoncurrent", "USD", None, total * 0.25),
                    ("CashAndCashEquivalentsAtCarryingValue", "USD", None, total * 0.1), ("CommonStockSharesOutstanding", "shares", None, SHARES)]
            if cik != 4:
                said.append(("CostOfRevenue", "USD", begin, total * share * 0.6))
            if q in (2, 3):  # the year to date beside the quarter
                said.append((tag, "USD", ends[0] + one, total * so_far))
            for concept, unit, start, val in said:
                yield cik, "us-gaap", concept, unit, start, ends[q], filed, f"{cik}-{year}-{q}", val
    if cik == 1:
        yield cik, "us-gaap", tag, "USD", dt.date(2022, 1, 1), dt.date(2022, 3, 31), dt.date(2023, 6, 1), "1-again", revenue(1, 2022) * WEIGHTS[0] * 1.5


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame([r for cik in FILERS for r in filings(cik)], SCHEMA).cache()


@pytest.fixture(scope="module")
def figures(spark, facts):
    return fu.fundamentals(facts, concept_map(spark), fu.detect_splits(facts)).cache()


def values(figures, metric, kind):
    return {(r.cik, r.period_end): r.val for r in figures.where(f"metric = '{metric}' AND period_type = '{kind}'").collect()}


def test_every_filer_has_sixteen_quarters(figures):
    want, cash, income = {}, {}, {}
    for cik in FILERS:
        for year in YEARS:
            ends, total = quarter_ends(cik, year), revenue(cik, year)
            own = [total * w for w in WEIGHTS]
            cash |= {(cik, e): x * FILERS[cik][3] * 1.1 for e, x in zip(ends[1:], own)}
            income |= {(cik, e): x * FILERS[cik][3] for e, x in zip(ends[1:], own)}  # no year to date: the year less three quarters
            if (cik, year) == (1, 2022):  # the fourth is the year less the nine months as filed, whatever became of the first
                own[0] *= 1.5
            want |= dict(zip(((cik, e) for e in ends[1:]), own))
    assert values(figures, "revenue", "Q") == pytest.approx(want)
    assert values(figures, "operating_cash_flow", "Q") == pytest.approx(cash)
    assert values(figures, "net_income", "Q") == pytest.approx(income)
    assert values(figures, "revenue", "FY") == pytest.approx({(c, quarter_ends(c, y)[4]): revenue(c, y) for c in FILERS for y in YEARS})


def test_only_fourth_quarters_and_differences_are_derived(figures):
    derived = {(r.cik, r.period_end) for r in figures.where("metric = 'revenue' AND derived = 1").collect()}
    assert derived == {(c, quarter_ends(c, y)[4]) for c in FILERS for y in YEARS}
    derived = {(r.cik, r.period_end) for r in figures.where("metric = 'operating_cash_flow' AND period_type = 'Q' AND derived = 1").collect()}
    assert derived == {(c, e) for c in FILERS for y in YEARS for e in quarter_ends(c, y)[2:]}


def test_ratios_of_every_filer(spark, figures):
    companies = spark.createDataFrame([(c, f[0], f[0], "S", "X") for c, f in FILERS.items()], "cik long, ticker string, name string, sic_description string, exchange string")
    bars = spark.createDataFrame([(f[0], dt.date(2025, 6, d), p) for f in FILERS.values() for d, p in ((29, 1.0), (30, PRICE))], "ticker string, date date, close double")
    got = {r.cik: r.asDict() for r in sn.snapshot(figures, companies, bars).collect()}
    assert set(got) == set(FILERS)
    for cik, (_, _, _, margin, growth, _) in FILERS.items():
        total, cap = revenue(cik, 2024), PRICE * SHARES
        net, equity = total * margin, total * (-0.35 if cik == 5 else 0.5)
        want = {"price": PRICE, "market_cap": cap, "revenue_ttm": total, "net_income_ttm": net, "operating_income_ttm": net * 1.3, "eps_ttm": net / SHARES, "ocf_ttm": net * 1.1,
                "total_equity": equity, "total_debt": total * 0.25, "ps": cap / total, "pe": PRICE / (net / SHARES), "ev": cap + total * 0.15, "roa": margin * 50, "net_margin": margin * 100,
                "operating_margin": margin * 130, "revenue_cagr_3y": growth * 100, "eps_cagr_3y": growth * 100}
        if cik != 4:
            want |= {"gross_profit_ttm": total * 0.4, "gross_margin": 40.0}
        if cik != 5:
            want |= {"pb": cap / equity, "roe": net / equity * 100, "debt_to_equity": 0.5}
        assert {k: got[cik][k] for k in want} == pytest.approx(want, rel=1e-8), cik
    assert got[4]["gross_margin"] is None and got[4]["gross_profit_ttm"] is None
    assert [got[5][k] for k in ("pb", "roe", "debt_to_equity")] == [None] * 3
    assert all(r["capex_ttm"] is None and r["fcf_ttm"] is None for r in got.values())


def test_what_was_known_before_and_after_the_restatement(spark, facts):
    vintages = spark.createDataFrame([(dt.date(2022, 5, 4),), (dt.date(2022, 5, 5),), (dt.date(2023, 5, 31),), (dt.date(2023, 6, 1),)], "as_of date")
    known = hi.fundamentals_asof(facts, concept_map(spark), vintages).where("cik = 1 AND metric = 'revenue' AND period_type = 'Q'").collect()
    at = {(r.as_of, r.period_end): r.val for r in known}
    first, last, total = dt.date(2022, 3, 31), dt.date(2022, 12, 31), revenue(1, 2022)
    assert (dt.date(2022, 5, 4), first) not in at
    assert at[dt.date(2022, 5, 5), first] == at[dt.date(2023, 5, 31), first] == pytest.approx(total * 0.22)
    assert at[dt.date(2023, 6, 1), first] == pytest.approx(total * 0.33)
    assert at[dt.date(2023, 5, 31), last] == at[dt.date(2023, 6, 1), last] == pytest.approx(total * 0.29)
