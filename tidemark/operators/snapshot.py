"""Trailing figures, prices as of a date, and the wide ratio table of today; :mod:`history` has those of past days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import at_vintages

# Metrics of trailing and instant figures, and the columns of a snapshot.
TTM_METRICS = ["revenue", "operating_income", "net_income", "eps_diluted", "operating_cash_flow", "capex", "shares_diluted", "gross_profit", "cost_of_revenue"]
INSTANTS = ["total_assets", "total_equity", "cash", "current_assets", "current_liabilities", "short_term_debt", "long_term_debt", "shares_outstanding"]
GROWTH = ["revenue", "eps_diluted"]
COLUMNS = ["price", "market_cap", "shares_diluted", "revenue_ttm", "gross_profit_ttm", "operating_income_ttm", "net_income_ttm", "eps_ttm", "ocf_ttm", "capex_ttm", "fcf_ttm", "total_assets", "total_equity", "total_debt", "cash", "pe", "pb", "ps", "ev", "ev_to_ebit", "roe", "roa", "gross_margin", "operating_margin", "net_margin", "debt_to_equity", "current_ratio", "revenue_cagr_3y", "eps_cagr_3y"]


def trailing(quarters: Column, year: Column) -> Column:
    """The sum of the four newest quarters, ``(at, v)`` newest first, if they span a year (238 to 308 days between ends), else ``year``."""
    known = F.filter(quarters, lambda q: q["v"].isNotNull())
    span = F.datediff(F.element_at(quarters, 1)["at"], F.element_at(quarters, -1)["at"])
    return F.when(F.when(F.size(known) == 4, span).between(238, 308), F.aggregate(known, F.lit(0.0), lambda a, q: a + q["v"])).otherwise(year)


def growth_of(new: Column, old: Column, years: int) -> Column:
    """Compound growth in percent, NULL unless both ends are above zero."""
    return F.when((new > 0) & (old > 0), (F.pow(new / old, F.lit(1.0 / years)) - 1) * 100)


def ttm(f: DataFrame) -> DataFrame:
    """Per company and metric the sum of the four newest quarters if they span a year, else the newest year."""
    w = Window.partitionBy("cik", "metric", "period_type").orderBy(F.desc("period_end"))
    r = f.where("period_type IN ('Q', 'FY')").withColumn("rn", F.row_number().over(w)).where("rn <= 4")
    quarter = F.when(F.col("period_type") == "Q", F.struct(F.col("period_end").alias("at"), F.col("val").alias("v")))
    g = r.groupBy("cik", "metric").agg(F.sort_array(F.collect_list(quarter), asc=False).alias("q"), F.max(F.when((F.col("period_type") == "FY") & (F.col("rn") == 1), F.col("val"))).alias("fy"))
    return g.select("cik", "metric", trailing(F.col("q"), F.col("fy")).alias("ttm"))


def latest_instant(f: DataFrame) -> DataFrame:
    return f.where("period_type = 'INSTANT'").groupBy("cik", "metric").agg(F.max_by("val", "period_end").alias("val"))


def cagr(f: DataFrame, years: int = 3) -> DataFrame:
    """Compound growth over ``years`` fiscal years, NULL unless both ends are above zero."""
    w = Window.partitionBy("cik", "metric").orderBy(F.desc("period_end"))
    r = f.where("period_type = 'FY'").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= years + 1)
    g = r.groupBy("cik", "metric").agg(F.max(F.when(F.col("rn") == 1, F.col("val"))).alias("new"), F.max(F.when(F.col("rn") == years + 1, F.col("val"))).alias("old"))
    return g.select("cik", "metric", growth_of(F.col("new"), F.col("old"), years).alias("cagr"))


def price_asof(prices: DataFrame, vintages: DataFrame | None = None) -> DataFrame:
    """Last known close per ticker: the latest, or by each ``as_of``, of all tickers or, with a ``ticker`` beside it, of its own.

    Bars and questions of a ticker are sorted together once, and each question takes the last bar before it: no
    join on a range, however many vintages there are. A ticker has one bar a day, which bounds what one task sorts.
    """
    p = prices.where("close IS NOT NULL")
    if vintages is None:
        return p.groupBy("ticker").agg(F.max_by("close", "date").alias("price"), F.max("date").alias("price_date"))
    if "ticker" in vintages.columns:
        asked = vintages.select("ticker", "as_of").distinct()
    else:  # the vintages travel in one row
        every = vintages.agg(F.collect_set("as_of").alias("every"))
        asked = p.select("ticker").distinct().crossJoin(F.broadcast(every)).select("ticker", F.explode("every").alias("as_of"))
    bars = p.select("ticker", F.col("date").alias("at"), F.lit(0).alias("asks"), F.struct("close", "date").alias("bar"))
    asked = asked.select("ticker", F.col("as_of").alias("at"), F.lit(1).alias("asks"), F.lit(None).cast(bars.schema["bar"].dataType).alias("bar"))
    so_far = Window.partitionBy("ticker").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = bars.unionByName(asked).withColumn("bar", F.last("bar", ignorenulls=True).over(so_far)).where("asks = 1 AND bar IS NOT NULL")
    return known.select(F.col("at").alias("as_of"), "ticker", F.col("bar.close").alias("price"), F.col("bar.date").alias("price_date"))


def universe_asof(facts: DataFrame, vintages: DataFrame) -> DataFrame:
    """Companies with a filing by each ``as_of``."""
    first = facts.groupBy("cik").agg(F.min("filed").alias("first_filed"))
    return at_vintages(first, vintages, "first_filed", None).select("as_of", "cik")


def data_age(facts: DataFrame, vintages: DataFrame) -> DataFrame:
    """Days from the newest filing known by each ``as_of``."""
    days = facts.select("cik", "filed").distinct()
    w = Window.partitionBy("cik").orderBy("filed")
    days = days.withColumn("until", F.lead("filed").over(w))
    return at_vintages(days, vintages, "filed", "until").select("as_of", "cik", F.datediff("as_of", "filed").alias("data_age_days"))


def ratios_wide(base: DataFrame, f: DataFrame, prices: DataFrame) -> DataFrame:
    """``base`` (cik, ticker, name, ...) with all 29 snapshot columns."""
    wide = lambda d, metrics, value, mark: d.groupBy("cik").pivot("metric", metrics).agg(F.first(value)).select("cik", *[F.col(m).alias(f"{mark}_{m}") for m in metrics])
    t, i = wide(ttm(f), TTM_METRICS, "ttm", "t"), wide(latest_instant(f), INSTANTS, "val", "i")
    g = wide(cagr(f.where(F.col("metric").isin(*GROWTH))), GROWTH, "cagr", "g")
    d = base.join(t, "cik", "left").join(i, "cik", "left").join(g, "cik", "left").join(prices.drop("price_date"), "ticker", "left")
    return ratio_columns(d, base.columns)


def ratio_columns(d: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the 29 columns, from price, trailing (``t_``), instant (``i_``) and growth (``g_``) figures."""
    c = F.col
    over = lambda a, b: F.try_divide(a, b)
    above = lambda guard, x: F.when(guard > 0, x)
    rev, ni, oi, eps, equity = c("t_revenue"), c("t_net_income"), c("t_operating_income"), c("t_eps_diluted"), c("i_total_equity")
    shares = F.coalesce(F.nullif(c("i_shares_outstanding"), F.lit(0.0)), c("t_shares_diluted"))
    debt: Column = F.when(c("i_short_term_debt").isNotNull() | c("i_long_term_debt").isNotNull(), F.coalesce("i_short_term_debt", F.lit(0.0)) + F.coalesce("i_long_term_debt", F.lit(0.0)))
    d = d.withColumn("market_cap", c("price") * shares).withColumn("total_debt", debt).withColumn("gross_profit_ttm", F.coalesce(c("t_gross_profit"), rev - c("t_cost_of_revenue")))
    cap = c("market_cap")
    d = d.withColumn("ev", cap + F.coalesce("total_debt", F.lit(0.0)) - F.coalesce("i_cash", F.lit(0.0)))
    made = {
        "price": c("price"), "market_cap": cap, "shares_diluted": c("t_shares_diluted"), "revenue_ttm": rev, "gross_profit_ttm": c("gross_profit_ttm"), "operating_income_ttm": oi, "net_income_ttm": ni,
        "eps_ttm": eps, "ocf_ttm": c("t_operating_cash_flow"), "capex_ttm": c("t_capex"), "fcf_ttm": c("t_operating_cash_flow") - F.abs(c("t_capex")), "total_assets": c("i_total_assets"), "total_equity": equity,
        "total_debt": c("total_debt"), "cash": c("i_cash"), "pe": above(eps, c("price") / eps), "pb": above(equity, cap / equity), "ps": over(cap, rev), "ev": c("ev"), "ev_to_ebit": above(oi, c("ev") / oi),
        "roe": above(equity, ni / equity * 100), "roa": over(ni, c("i_total_assets")) * 100, "gross_margin": over(c("gross_profit_ttm"), rev) * 100, "operating_margin": over(oi, rev) * 100, "net_margin": over(ni, rev) * 100,
        "debt_to_equity": above(equity, c("total_debt") / equity), "current_ratio": over(c("i_current_assets"), c("i_current_liabilities")), "revenue_cagr_3y": F.round("g_revenue", 8), "eps_cagr_3y": F.round("g_eps_diluted", 8),
    }
    return d.select(*keep, *[made[k].alias(k) for k in COLUMNS])


def snapshot(f: DataFrame, companies: DataFrame, prices: DataFrame) -> DataFrame:
    """One row per company with fundamentals, from the newest prices and filings."""
    who = companies.select("cik", "ticker", "name", "sic_description", "exchange")
    base = f.select("cik").distinct().join(who, "cik", "left")
    return ratios_wide(base, f, price_asof(prices))


def quarter_ends(start: str, end: str, spark) -> DataFrame:
    """Quarter-end vintages between two dates, bounds included."""
    months = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "quarter"), F.lit(end).cast("date"), F.expr("INTERVAL 3 MONTH"))).alias("m"))
    return months.select(F.last_day(F.add_months("m", 2)).alias("as_of")).where(F.col("as_of").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
