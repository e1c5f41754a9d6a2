"""Screens, ranges, curated lists, search and browsing over a snapshot or a vintage of it."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.expressions import escape_like, mcap_band
from .ranking import neighbours, positions

# The names that a screen may use, suffixes of its thresholds, curated screens and lists.
FIELDS = {"price": "price", "market_cap": "market_cap", "mcap": "market_cap", "revenue": "revenue_ttm", "net_income": "net_income_ttm", "operating_income": "operating_income_ttm", "eps": "eps_ttm", "fcf": "fcf_ttm", "ocf": "ocf_ttm", "total_assets": "total_assets", "total_equity": "total_equity", "total_debt": "total_debt", "cash": "cash", "pe": "pe", "pb": "pb", "ps": "ps", "ev": "ev", "ev_ebit": "ev_to_ebit", "roe": "roe", "roa": "roa", "gross_margin": "gross_margin", "operating_margin": "operating_margin", "net_margin": "net_margin", "debt_to_equity": "debt_to_equity", "current_ratio": "current_ratio", "revenue_growth": "revenue_cagr_3y", "eps_growth": "eps_cagr_3y"}
SUFFIXES = {"k": 1e3, "m": 1e6, "b": 1e9, "t": 1e12, "cr": 1e7}
COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "=": operator.eq, "!=": operator.ne}
SCREENS = {
    "quality-at-a-fair-price": [[("roe", ">", 15), ("pe", "<", 25), ("debt_to_equity", "<", 1)]],
    "cheap-and-growing": [[("pe", "<", 20), ("revenue_growth", ">", 10)]],
    "high-margin-compounders": [[("net_margin", ">", 20), ("revenue_growth", ">", 12)]],
    "deep-value": [[("pb", "<", 1.5), ("pe", "<", 12)]],
    "cash-generators": [[("fcf", ">", "500m"), ("market_cap", ">", "2b")]],
}
LISTS = {"highest-roe-stocks": ("roe", True, False), "lowest-pe-stocks": ("pe", False, True), "highest-net-margin-stocks": ("net_margin", True, False), "highest-revenue-growth-stocks": ("revenue_cagr_3y", True, False),
         "lowest-debt-to-equity-stocks": ("debt_to_equity", False, True), "largest-companies": ("market_cap", True, False), "highest-fcf-stocks": ("fcf_ttm", True, False), "lowest-pb-stocks": ("pb", False, True)}
SORTS = {"active": ("volume", True), "mcap": ("market_cap", True), "gainers": ("change_pct", True), "losers": ("change_pct", False), "pe_low": ("pe", False), "roe_high": ("roe", True)}


def threshold(x: float | str) -> float:
    if not isinstance(x, str):
        return float(x)
    tail = next((s for s in sorted(SUFFIXES, key=len, reverse=True) if x.lower().endswith(s)), "")
    return float(x[: len(x) - len(tail)]) * SUFFIXES.get(tail, 1.0)


def field(name: str) -> Column:
    if name not in FIELDS:
        raise ValueError(f"unknown field {name!r}")
    return F.col(FIELDS[name])


def predicate(conditions: list[list[tuple]]) -> Column:
    """Or of ands of (field, operator, threshold); NULL never matches."""
    def one(name: str, op: str, value: float | str) -> Column:
        return COMPARE[op](field(name), F.lit(threshold(value)))

    return reduce(operator.or_, [reduce(operator.and_, [one(*c) for c in group]) for group in conditions])


def screen(snapshot: DataFrame, conditions: list[list[tuple]], order_by: str = "market_cap", desc: bool = True, limit: int | None = 50, as_of: str | None = None) -> DataFrame:
    """Matching companies in order; rows without the sort figure are left out. ``as_of`` bounds the whole screen."""
    key = field(order_by)
    rows = snapshot.where(predicate(conditions) & key.isNotNull())
    if as_of is not None:
        rows = rows.where(F.col("as_of") == F.lit(as_of).cast("date"))
    rows = rows.orderBy(key.desc() if desc else key.asc(), "ticker")
    return rows.limit(limit) if limit else rows


def screen_ranges(snapshot: DataFrame, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    out = snapshot
    for name, (lo, hi) in ranges.items():
        out = out if lo is None else out.where(field(name) >= lo)
        out = out if hi is None else out.where(field(name) <= hi)
    return out


def curated_list(snapshot: DataFrame, slug: str, n: int = 50) -> DataFrame:
    column, desc, positive = LISTS[slug]
    rows = snapshot.where(F.col(column).isNotNull() & (F.col(column) > 0 if positive else F.lit(True)))
    return rows.orderBy(F.col(column).desc() if desc else F.col(column).asc(), "ticker").limit(n)


def curated_screens(snapshot: DataFrame, most: int = 500) -> DataFrame:
    """How many companies match each curated screen: one pass for all."""
    counts = snapshot.agg(*[F.count_if(predicate(c) & F.col("market_cap").isNotNull()).alias(s) for s, c in SCREENS.items()])
    pairs = F.array(*[F.struct(F.lit(s).alias("slug"), F.least(F.col(f"`{s}`"), F.lit(most)).alias("matches")) for s in SCREENS])
    return counts.select(F.explode(pairs).alias("p")).select("p.slug", "p.matches")


def metric_ranges(snapshot: DataFrame) -> DataFrame:
    """5th and 95th percentile by offset of every screenable column that at least five companies have."""
    names = sorted(set(FIELDS.values()))
    long = snapshot.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in names])).alias("x")).select("x.metric", "x.v").where("v IS NOT NULL")
    counts = long.groupBy("metric", "v").agg(F.count(F.lit(1)).alias("n"))
    every = counts.groupBy("metric").agg(F.sum("n").alias("all")).where("all >= 5")  # one row for each of FIELDS
    placed = positions(counts, "v", ["metric"]).join(F.broadcast(every), "metric")
    at = lambda k: F.max(F.when((F.col("start") <= k) & (k < F.col("start") + F.col("n")), F.col("v")))
    return placed.groupBy("metric").agg(at(F.floor(F.col("all") * 0.05)).alias("p5"), at(F.least(F.col("all") - 1, F.floor(F.col("all") * 0.95))).alias("p95"))


GRAM = 3


def name_index(snapshot: DataFrame) -> DataFrame:
    """``(gram, cik)``: every run of one to GRAM letters of each ticker and name, in lower case, sorted by ``gram`` so that a reader skips what it does not ask for."""
    said = snapshot.select("cik", F.explode(F.array("ticker", "name")).alias("said")).where("said <> ''").select("cik", F.lower("said").alias("said"))
    one = lambda n: F.when(F.length("said") >= n, F.transform(F.sequence(F.lit(1), F.length("said") - n + 1), lambda i: F.substring("said", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = said.select("cik", F.explode(F.array_distinct(F.concat(*[one(n) for n in range(1, GRAM + 1)]))).alias("gram")).distinct()
    return grams.repartitionByRange("gram").sortWithinPartitions("gram", "cik")


def search(snapshot: DataFrame, term: str, index: DataFrame, n: int = 50) -> DataFrame:
    """Companies whose ticker or name holds the term: exact tickers first, then prefixes, then by size.

    Companies that have all of the term's runs of GRAM letters come from ``index`` (:func:`name_index`), and only
    those are read and looked at.
    """
    low, like = term.lower(), escape_like(term)
    grams = sorted({low[i : i + GRAM] for i in range(max(1, len(low) - GRAM + 1))})
    there = index.where(F.col("gram").isin(grams)).groupBy("cik").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)) if low else index.select("cik").distinct()
    hit = F.col("ticker").ilike(f"%{like}%") | F.col("name").ilike(f"%{like}%")
    rank = F.when(F.upper("ticker") == term.upper(), 0).when(F.col("ticker").ilike(f"{like}%"), 1).otherwise(2)
    return snapshot.join(there, "cik", "left_semi").where(hit).withColumn("rank", rank).orderBy("rank", F.desc_nulls_last("market_cap"), "ticker").limit(n)


def with_sector(companies: DataFrame, sic_ranges: DataFrame) -> DataFrame:
    """Sector of the narrowest range that holds the SIC code; 'Unclassified' without one."""
    code = companies.withColumn("sic_code", F.expr("try_cast(sic AS INT)"))
    hit = code.select("cik", "sic_code").join(F.broadcast(sic_ranges), F.col("sic_code").between(F.col("lo"), F.col("hi")))
    best = hit.groupBy("cik").agg(F.min_by(F.struct("sector", "sector_slug"), F.struct(F.col("hi") - F.col("lo"), "lo")).alias("b"))
    out = code.drop("sic_code").join(best, "cik", "left")
    return out.withColumn("sector", F.coalesce("b.sector", F.lit("Unclassified"))).withColumn("sector_slug", F.coalesce("b.sector_slug", F.lit("unclassified"))).drop("b")


def last_bar(prices: DataFrame) -> DataFrame:
    """Each ticker's newest bar with the close before it and the change in percent."""
    w = Window.partitionBy("ticker")
    r = prices.where("close IS NOT NULL").withColumn("prev_close", F.lag("close").over(w.orderBy("date"))).withColumn("rn", F.row_number().over(w.orderBy(F.desc("date"))))
    return r.where("rn = 1").select("ticker", "date", "close", "volume", "prev_close", ((F.try_divide("close", "prev_close") - 1) * 100).alias("change_pct"))


def browse(snapshot: DataFrame, bars: DataFrame, sectors: DataFrame, members: DataFrame, sector: str | None = None, band: str | None = None, index: str | None = None,
           letter: str | None = None, sort: str = "active", after: Row | None = None, per_page: int = 50) -> DataFrame:
    """One page of companies under all given filters, with the newest bar: the first, or the one that follows ``after``, the last row of the page before.

    A page is found by its key, so a late page costs what the first one does.
    """
    rows = snapshot.where("ticker IS NOT NULL").join(sectors.select("cik", "sector", "sector_slug"), "cik", "left").join(bars, "ticker", "left")
    if sector is not None:
        rows = rows.where(F.col("sector_slug") == sector)
    if band is not None:
        rows = rows.where(mcap_band(F.col("market_cap")) == band)
    if index is not None:
        rows = rows.join(members.where(F.col("index_slug") == index).select("ticker"), "ticker", "left_semi")
    if letter is not None:
        rows = rows.where(F.upper("ticker").startswith(letter.upper()))
    column, desc = SORTS[sort]
    order = [F.col(column).desc_nulls_last() if desc else F.col(column).asc_nulls_last(), F.col("ticker"), F.col("cik")]
    if after is not None:
        v = F.lit(after[column]).cast(rows.schema[column].dataType)
        later = (F.col("ticker") > after["ticker"]) | ((F.col("ticker") == after["ticker"]) & (F.col("cik") > after["cik"]))
        if after[column] is None:
            rows = rows.where(F.col(column).isNull() & later)
        else:
            rows = rows.where(F.col(column).isNull() | ((F.col(column) < v) if desc else (F.col(column) > v)) | ((F.col(column) == v) & later))
    return rows.orderBy(*order).limit(per_page)


def peers(snapshot: DataFrame, k: int = 8) -> DataFrame:
    """For every company the k nearest by market value of those with its industry, ties to the smaller ticker.

    Of companies of one industry and value only the first k + 1 tickers can be a peer, and only the k values next
    above and below a company's own. The values of an industry are numbered in order and looked at in blocks that
    lend each other k rows at their borders, so an industry of any size is many tasks.
    """
    c = snapshot.where("sic_description IS NOT NULL").select("cik", "ticker", "sic_description", F.coalesce("market_cap", F.lit(0.0)).alias("cap"))
    own = Window.partitionBy("sic_description", "cap").orderBy("ticker", "cik")
    few = c.withColumn("rn", F.row_number().over(own)).where(F.col("rn") <= k + 1)
    values = few.groupBy("sic_description", "cap").agg(F.collect_list(F.struct("cap", "ticker", "cik")).alias("near"))
    numbered = positions(values.select("sic_description", "cap", F.lit(1).alias("n")), "cap", ["sic_description"]).select("sic_description", "cap", "start")
    values = neighbours(values.join(numbered, ["sic_description", "cap"]), "start", ["sic_description"], "near", k).withColumn("near", F.flatten("near"))
    gap = lambda x: F.struct(F.abs(F.col("cap") - x["cap"]).alias("gap"), x["ticker"].alias("peer"), x["cik"].alias("peer_cik"))
    others = F.filter(F.transform("near", gap), lambda x: x["peer_cik"] != F.col("cik"))
    best = c.join(values, ["sic_description", "cap"]).select("cik", F.posexplode(F.slice(F.array_sort(others), 1, k)).alias("at", "p"))
    return best.select("cik", "p.peer_cik", "p.peer", "p.gap", (F.col("at") + 1).alias("rank"))
