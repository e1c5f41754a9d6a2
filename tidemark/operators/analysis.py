"""Statements, ratio history, provenance and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import growth, positive_div

# The rows of each statement.
FLOWS = ["revenue", "gross_profit", "operating_income", "net_income", "eps_diluted", "operating_cash_flow", "capex"]
STOCKS = ["total_assets", "total_equity", "total_liabilities", "cash", "long_term_debt"]
ANNUAL = ["revenue", "gross_profit", "operating_income", "net_income", "eps_diluted", "operating_cash_flow", "total_assets", "total_equity"]


def periods(f: DataFrame, period_type: str, n: int) -> DataFrame:
    """Each company's n newest period ends of a type; ``at`` counts from the oldest of them."""
    d = f.where(F.col("period_type") == period_type).select("cik", "period_end").distinct()
    w = Window.partitionBy("cik")
    d = d.withColumn("newest", F.row_number().over(w.orderBy(F.desc("period_end")))).where(F.col("newest") <= n)
    return d.withColumn("at", F.row_number().over(w.orderBy("period_end"))).select("cik", "period_end", "at")


def _grid(f: DataFrame, cols: DataFrame, metrics: list[str], period_type: str) -> DataFrame:
    """Every metric that a company has in the window, by every period of it."""
    vals = f.where((F.col("period_type") == period_type) & F.col("metric").isin(*metrics)).select("cik", "metric", "period_end", "val")
    held = vals.join(cols, ["cik", "period_end"]).where("val IS NOT NULL").select("cik", "metric").distinct()
    return held.join(cols, "cik").join(vals, ["cik", "metric", "period_end"], "left")


def statement(f: DataFrame, period_type: str = "FY", n: int = 10) -> DataFrame:
    """Metric by period with growth on the year (and for quarters on the quarter before), by position in the window."""
    g = _grid(f, periods(f, period_type, n), FLOWS, period_type)
    w = Window.partitionBy("cik", "metric").orderBy("at")
    step = 4 if period_type == "Q" else 1
    return g.select("cik", "metric", "period_end", "val", growth(F.col("val"), F.lag("val", step).over(w)).alias("yoy"), growth(F.col("val"), F.lag("val", 1).over(w)).alias("qoq"))


def balance_sheet(f: DataFrame, n: int = 10) -> DataFrame:
    """Instants on the last date that any metric has in each calendar year."""
    i = f.where("period_type = 'INSTANT'")
    cols = i.groupBy("cik", F.year("period_end").alias("y")).agg(F.max("period_end").alias("period_end"))
    w = Window.partitionBy("cik")
    cols = cols.withColumn("rn", F.row_number().over(w.orderBy(F.desc("y")))).where(F.col("rn") <= n).withColumn("at", F.row_number().over(w.orderBy("y"))).select("cik", "period_end", "at")
    g = _grid(f, cols, STOCKS, "INSTANT")
    return g.select("cik", "metric", "period_end", "val", growth(F.col("val"), F.lag("val").over(Window.partitionBy("cik", "metric").orderBy("at"))).alias("yoy"))


def instants_at(flows: DataFrame, instants: DataFrame, days: int = 120) -> DataFrame:
    """``flows`` (cik, period_end) with the newest value of each instant metric in the ``days`` before."""
    i = instants.where("period_type = 'INSTANT'").select("cik", "metric", F.col("period_end").alias("at"), "val")
    near = flows.select("cik", "period_end").distinct().join(i, "cik").where(F.col("at").between(F.date_sub("period_end", days), F.col("period_end")))
    return near.groupBy("cik", "period_end", "metric").agg(F.max_by("val", "at").alias("val"))


def ratio_history(f: DataFrame, n: int = 10) -> DataFrame:
    """Ratios of each fiscal year from that year's own figures; every divisor must be above zero."""
    cols = periods(f, "FY", n).select("cik", "period_end")
    flow_names, stock_names = ["revenue", "gross_profit", "cost_of_revenue", "operating_income", "net_income"], ["total_assets", "total_equity", "current_assets", "current_liabilities", "short_term_debt", "long_term_debt"]
    flows = f.where("period_type = 'FY'").groupBy("cik", "period_end").pivot("metric", flow_names).agg(F.first("val"))
    stocks = instants_at(cols, f).groupBy("cik", "period_end").pivot("metric", stock_names).agg(F.first("val"))
    d = cols.join(flows, ["cik", "period_end"], "left").join(stocks, ["cik", "period_end"], "left")
    c = F.col
    gross = F.coalesce(c("gross_profit"), c("revenue") - c("cost_of_revenue"))
    debt = F.when(c("short_term_debt").isNotNull() | c("long_term_debt").isNotNull(), F.coalesce("short_term_debt", F.lit(0.0)) + F.coalesce("long_term_debt", F.lit(0.0)))
    made = {"gross_margin": positive_div(gross, c("revenue")) * 100, "operating_margin": positive_div(c("operating_income"), c("revenue")) * 100, "net_margin": positive_div(c("net_income"), c("revenue")) * 100,
            "roe": positive_div(c("net_income"), c("total_equity")) * 100, "roa": positive_div(c("net_income"), c("total_assets")) * 100, "roce": positive_div(c("operating_income"), c("total_assets") - c("current_liabilities")) * 100,
            "debt_to_equity": positive_div(debt, c("total_equity")), "current_ratio": positive_div(c("current_assets"), c("current_liabilities")), "asset_turnover": positive_div(c("revenue"), c("total_assets"))}
    return d.select("cik", "period_end", *[v.alias(k) for k, v in made.items()])


def annual_history(f: DataFrame, n: int = 10) -> DataFrame:
    """Calendar year by metric; in a year the last period end wins."""
    r = f.where((F.col("period_type").isin("FY", "INSTANT")) & F.col("metric").isin(*ANNUAL)).withColumn("year", F.year("period_end"))
    g = r.groupBy("cik", "year").pivot("metric", ANNUAL).agg(F.max_by("val", "period_end"))
    return g.withColumn("rn", F.row_number().over(Window.partitionBy("cik").orderBy(F.desc("year")))).where(F.col("rn") <= n).drop("rn")


def provenance(f: DataFrame) -> DataFrame:
    return f.select("cik", "metric", "source_concept").distinct()


def coverage(f: DataFrame, metrics: DataFrame) -> DataFrame:
    """Companies that each metric was resolved for, of all; metrics without any are listed."""
    total = f.agg(F.countDistinct("cik").alias("universe"))
    n = f.groupBy("metric").agg(F.countDistinct("cik").alias("companies"))
    return metrics.select("metric").join(n, "metric", "left").crossJoin(F.broadcast(total)).select("metric", F.coalesce("companies", F.lit(0)).alias("companies"), (F.coalesce("companies", F.lit(0)) / F.col("universe")).alias("share"))


def coverage_tags(f: DataFrame, n: int = 4) -> DataFrame:
    t = f.groupBy("metric", "source_concept").agg(F.countDistinct("cik").alias("companies"))
    w = Window.partitionBy("metric").orderBy(F.desc("companies"), "source_concept")
    return t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def tag_census(facts: DataFrame) -> DataFrame:
    return facts.groupBy("cik", "taxonomy", "concept").agg(F.count(F.lit(1)).alias("n_facts"))


def missing_tags(census: DataFrame, f: DataFrame, concept_map: DataFrame, n: int = 6) -> DataFrame:
    """Per metric, tags that companies without it carry and that are not yet mapped to it; boilerplate left out."""
    ciks = f.select("cik").distinct()
    universe = ciks.agg(F.count(F.lit(1)).alias("universe"))
    tags = census.where("taxonomy = 'us-gaap'").select("cik", "concept").distinct().join(ciks, "cik", "left_semi")
    common = tags.groupBy("concept").agg(F.countDistinct("cik").alias("n")).crossJoin(F.broadcast(universe)).where("n * 2 > universe").select("concept")
    lacking = concept_map.select("metric").distinct().crossJoin(ciks).join(f.select("metric", "cik").distinct(), ["metric", "cik"], "left_anti")
    rows = lacking.join(tags.join(F.broadcast(common), "concept", "left_anti"), "cik").join(F.broadcast(concept_map.select("metric", "concept")), ["metric", "concept"], "left_anti")
    g = rows.groupBy("metric", "concept").agg(F.countDistinct("cik").alias("companies"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("companies"), "concept"))).where(F.col("rank") <= n)
