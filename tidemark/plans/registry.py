"""Every registered query of the engine: a Spark job over the adapter inputs, and its statement in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import fiscal_quarter_label, mcap_band
from ..operators import analysis as an
from ..operators import fundamentals as fu
from ..operators import history as hi
from ..operators import levels as lv
from ..operators import picker as pk
from ..operators import screening as sc
from ..operators import sentiment as se
from ..operators import series as ts
from ..operators import snapshot as sn
from ..sources import filing_folder as ff
from ..sources import filings as fi
from ..sources.adapters import Inputs
from ..sources.concepts import concept_map, metrics, sic_ranges
from ..sources.stored import new_path
from ..streaming import refresh as rf
from ..streaming.store import Store
from .oracles import oracle

TODAY = "2001-11-04"
QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[Inputs], DataFrame]):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = oracle(sql)
        return f

    return add


def current(x: Inputs) -> DataFrame:
    facts = x.facts
    return x.keep("fundamentals", lambda: fu.fundamentals(facts, concept_map(x.spark), fu.detect_splits(facts)))


def snap(x: Inputs) -> DataFrame:
    return x.keep("snapshot", lambda: sn.snapshot(current(x), x.companies, x.prices))


def vintages_snap(x: Inputs) -> DataFrame:
    return x.keep("snapshot_history", lambda: hi.snapshot_asof(x.facts, concept_map(x.spark), x.companies, x.prices, x.vintages))


def _history_store(x: Inputs) -> DataFrame:
    """All vintages written by folder, then one of them again, from every second company."""
    path = new_path(x.spark, "history")
    hi.write_history(vintages_snap(x), path)
    again = x.vintages.where("as_of = DATE '1998-06-30'")
    hi.write_history(hi.snapshot_asof(x.facts.where("cik % 2 = 0"), concept_map(x.spark), x.companies, x.prices, again), path)
    return x.spark.read.parquet(path)


F_COLS = "metric, period_end, period_type, val, source_concept, derived, filed"

# ---- facts and fundamentals
query("SELECT * FROM c_latest", "latest_facts")(lambda x: fu.latest_facts(x.facts))
query("SELECT cik, period_start, period_end, metric, unit, val, source_concept FROM c_resolved", "resolve_metrics")(lambda x: fu.resolve_metrics(fu.latest_facts(x.facts), concept_map(x.spark)))
query("SELECT period_type, count(*) AS n FROM c_typed WHERE period_type IS NOT NULL GROUP BY period_type", "classify_period")(lambda x: fu.classify(fu.resolve_metrics(fu.latest_facts(x.facts), concept_map(x.spark))).groupBy("period_type").agg(F.count(F.lit(1)).alias("n")))
query("SELECT cik, metric, period_end, val FROM c_ytd", "diff_ytd")(lambda x: fu.diff_ytd(fu.reported_rows(x.facts, concept_map(x.spark))).where("derived = 1").select("cik", "metric", "period_end", "val"))
query("SELECT cik, metric, period_end, val FROM c_with_q4 WHERE derived = 1 AND period_type = 'Q' AND metric <> 'operating_cash_flow'", "derive_q4")(lambda x: fu.fundamentals(x.facts, concept_map(x.spark)).where("derived = 1 AND period_type = 'Q' AND metric <> 'operating_cash_flow'").select("cik", "metric", "period_end", "val"))
query("SELECT cik, metric, period_end, val FROM c_f WHERE derived = 1 AND metric IN ('eps_basic', 'eps_diluted')", "derive_q4_eps")(lambda x: current(x).where("derived = 1 AND metric IN ('eps_basic', 'eps_diluted')").select("cik", "metric", "period_end", "val"))
query("SELECT cik, effective_filed, factor FROM splits", "detect_splits")(lambda x: fu.detect_splits(x.facts))
query("SELECT f.cik, f.concept, f.period_end, f.filed, coalesce((SELECT product(s.factor) FROM splits AS s WHERE s.cik = f.cik AND s.effective_filed > f.filed), 1.0) AS split_factor FROM facts AS f WHERE concept = 'EarningsPerShareDiluted'", "split_factor")(
    lambda x: fu.split_factor(x.facts.where("concept = 'EarningsPerShareDiluted'"), fu.detect_splits(x.facts)).select("cik", "concept", "period_end", "filed", "split_factor"))
query("SELECT cik, metric, period_end, period_type, val FROM c_adjusted WHERE metric IN ('eps_diluted', 'shares_outstanding')", "adjust_splits")(
    lambda x: fu.adjust_splits(fu.fundamentals(x.facts, concept_map(x.spark)), fu.detect_splits(x.facts)).where("metric IN ('eps_diluted', 'shares_outstanding')").select("cik", "metric", "period_end", "period_type", "val"))
query(f"SELECT cik, {F_COLS} FROM c_f", "fundamentals")(current)
query("SELECT * FROM c_ttm", "ttm")(lambda x: sn.ttm(current(x)))
query("SELECT * FROM c_instant", "latest_instant")(lambda x: sn.latest_instant(current(x)))
query("SELECT cik, metric, round(cagr, 8) AS cagr FROM c_cagr", "cagr")(lambda x: sn.cagr(current(x)).withColumn("cagr", F.round("cagr", 8)))
query("SELECT v.as_of, p.ticker, p.close AS price, p.date AS price_date FROM prices AS p JOIN vintages AS v ON p.date <= v.as_of QUALIFY row_number() OVER (PARTITION BY v.as_of, p.ticker ORDER BY p.date DESC) = 1", "price_asof")(lambda x: sn.price_asof(x.prices, x.vintages))
query("SELECT DISTINCT v.as_of, f.cik FROM facts AS f JOIN vintages AS v ON f.filed <= v.as_of", "universe_asof")(lambda x: sn.universe_asof(x.facts, x.vintages))
query("SELECT v.as_of, f.cik, v.as_of - max(f.filed) AS data_age_days FROM facts AS f JOIN vintages AS v ON f.filed <= v.as_of GROUP BY v.as_of, f.cik", "data_age")(lambda x: sn.data_age(x.facts, x.vintages))
query("SELECT * FROM c_snap", "snapshot")(snap)
query("SELECT * FROM v_snap", "snapshot_asof")(vintages_snap)
query("SELECT as_of, count(*) AS companies, count(pe) AS with_pe, sum(data_age_days) AS age FROM v_snap GROUP BY as_of", "history")(lambda x: vintages_snap(x).groupBy("as_of").agg(F.count(F.lit(1)).alias("companies"), F.count("pe").alias("with_pe"), F.sum("data_age_days").alias("age")))
query("SELECT as_of, cik, metric, period_end, period_type, val, source_concept, derived, filed FROM v_f", "fundamentals_asof")(lambda x: hi.fundamentals_asof(x.facts, concept_map(x.spark), x.vintages))
query("SELECT ticker, as_of, price, price_date FROM (SELECT a.ticker, a.as_of, p.close AS price, p.date AS price_date, row_number() OVER (PARTITION BY a.ticker, a.as_of ORDER BY p.date DESC) AS rn FROM (SELECT DISTINCT c.ticker, f.filed AS as_of FROM facts AS f JOIN companies AS c ON f.cik = c.cik) AS a JOIN prices AS p ON p.ticker = a.ticker AND p.date <= a.as_of) WHERE rn = 1", "price_at_filing")(lambda x: sn.price_asof(x.prices, x.facts.select("cik", F.col("filed").alias("as_of")).join(x.companies.select("cik", "ticker"), "cik")))
query("SELECT * FROM v_snap WHERE as_of <> DATE '1998-06-30' OR cik % 2 = 0", "history_store")(lambda x: _history_store(x))
query("SELECT DISTINCT as_of FROM v_snap", "vintages")(lambda x: vintages_snap(x).select("as_of").distinct())
query("SELECT DISTINCT v.as_of FROM vintages AS v JOIN facts AS f ON f.filed <= v.as_of", "quarter_ends")(lambda x: sn.quarter_ends("1996-01-01", "2000-12-31", x.spark).join(x.facts.agg(F.min("filed").alias("first")), F.col("first") <= F.col("as_of")).select("as_of"))

# ---- screens
S3 = "cik, ticker, market_cap, roe, pe, debt_to_equity"
cols3 = ["cik", "ticker", "market_cap", "roe", "pe", "debt_to_equity"]
QUALITY = [[("roe", ">", 8), ("pe", "<", 25), ("debt_to_equity", "<", 1)]]
query(f"SELECT {S3} FROM c_snap WHERE roe > 8 AND pe < 25 AND debt_to_equity < 1 AND market_cap IS NOT NULL ORDER BY market_cap DESC, ticker LIMIT 50", "screen")(lambda x: sc.screen(snap(x), QUALITY).select(cols3))
query(f"SELECT {S3} FROM c_snap WHERE (pe < 6 OR roe > 40) AND market_cap IS NOT NULL ORDER BY market_cap DESC, ticker LIMIT 50", "screen_or")(lambda x: sc.screen(snap(x), [[("pe", "<", 6)], [("roe", ">", 40)]]).select(cols3))
query(f"SELECT {S3} FROM v_snap WHERE as_of = DATE '1998-06-30' AND (pe < 6 OR roe > 20) AND market_cap IS NOT NULL ORDER BY market_cap DESC, ticker LIMIT 50", "screen_asof")(lambda x: sc.screen(vintages_snap(x), [[("pe", "<", 6)], [("roe", ">", 20)]], as_of="1998-06-30").select(cols3))
query(f"SELECT {S3} FROM c_snap WHERE roe >= 5 AND roe <= 60 AND pe <= 30", "screen_ranges")(lambda x: sc.screen_ranges(snap(x), {"roe": (5, 60), "pe": (None, 30), "pb": (None, None)}).select(cols3))
query("SELECT slug, cik, rank FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS slug, cik, row_number() OVER (ORDER BY {c} {'DESC' if d else 'ASC'}, ticker) AS rank FROM c_snap WHERE {c} IS NOT NULL{f' AND {c} > 0' if p else ''}" for s, (c, d, p) in sc.LISTS.items()) + ") WHERE rank <= 50", "curated_list")(lambda x: _lists(x))
query("SELECT slug, least(n, 500) AS matches FROM (SELECT 'quality-at-a-fair-price' AS slug, count(*) AS n FROM c_snap WHERE roe > 15 AND pe < 25 AND debt_to_equity < 1 AND market_cap IS NOT NULL UNION ALL SELECT 'cheap-and-growing', count(*) FROM c_snap WHERE pe < 20 AND revenue_cagr_3y > 10 AND market_cap IS NOT NULL UNION ALL SELECT 'high-margin-compounders', count(*) FROM c_snap WHERE net_margin > 20 AND revenue_cagr_3y > 12 AND market_cap IS NOT NULL UNION ALL SELECT 'deep-value', count(*) FROM c_snap WHERE pb < 1.5 AND pe < 12 AND market_cap IS NOT NULL UNION ALL SELECT 'cash-generators', count(*) FROM c_snap WHERE fcf_ttm > 500e6 AND market_cap > 2e9)", "curated_screens")(lambda x: sc.curated_screens(snap(x)))


def _lists(x: Inputs) -> DataFrame:
    from pyspark.sql import Window

    s = snap(x)
    parts = []
    for slug in sc.LISTS:
        column, desc, _ = sc.LISTS[slug]
        top = sc.curated_list(s, slug).select(F.lit(slug).alias("slug"), "cik", "ticker", F.col(column).alias("v"))
        w = Window.partitionBy("slug").orderBy(F.desc("v") if desc else F.asc("v"), "ticker")
        parts.append(top.withColumn("rank", F.row_number().over(w)).select("slug", "cik", "rank"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


query("SELECT metric, max(CASE WHEN rn = floor(n * 0.05) THEN v END) AS p5, max(CASE WHEN rn = least(n - 1, floor(n * 0.95)) THEN v END) AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY v) - 1 AS rn, count(*) OVER (PARTITION BY metric) AS n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS metric, {c} AS v FROM c_snap WHERE {c} IS NOT NULL" for c in sorted(set(sc.FIELDS.values()))) + ")) WHERE n >= 5 GROUP BY metric", "metric_ranges")(lambda x: sc.metric_ranges(snap(x)))
query("SELECT cik, ticker, CASE WHEN upper(ticker) = '0000001' THEN 0 WHEN ticker ILIKE '0000001%' THEN 1 ELSE 2 END AS rank FROM c_snap WHERE ticker ILIKE '%0000001%' OR name ILIKE '%0000001%' ORDER BY rank, market_cap DESC NULLS LAST, ticker LIMIT 50", "search")(lambda x: sc.search(snap(x), "0000001", x.keep("name-index", lambda: sc.name_index(snap(x)))).select("cik", "ticker", "rank"))
query("SELECT cik, sector, sector_slug FROM sectors", "sector_of")(lambda x: sc.with_sector(x.companies, sic_ranges(x.spark)).select("cik", "sector", "sector_slug"))
query("SELECT cik, ticker FROM sectors WHERE sector_slug = 'manufacturing'", "sector_filter")(lambda x: sc.with_sector(x.companies, sic_ranges(x.spark)).where("sector_slug = 'manufacturing'").select("cik", "ticker"))
query("SELECT sector, count(*) AS companies FROM sectors GROUP BY sector", "sector_counts")(lambda x: sc.with_sector(x.companies, sic_ranges(x.spark)).groupBy("sector").agg(F.count(F.lit(1)).alias("companies")))
query("SELECT band, count(*) AS companies FROM banded WHERE band IS NOT NULL GROUP BY band", "mcap_bands")(lambda x: snap(x).select(mcap_band(F.col("market_cap")).alias("band")).where("band IS NOT NULL").groupBy("band").agg(F.count(F.lit(1)).alias("companies")))
query("SELECT s.cik, s.ticker FROM c_snap AS s JOIN members AS m ON s.ticker = m.ticker WHERE m.index_slug = 'i3'", "index_filter")(lambda x: snap(x).join(x.members.where("index_slug = 'i3'").select("ticker"), "ticker").select("cik", "ticker"))
query("SELECT index_slug, count(*) AS companies FROM c_snap AS s JOIN members AS m ON s.ticker = m.ticker GROUP BY index_slug", "index_counts")(lambda x: snap(x).join(x.members, "ticker").groupBy("index_slug").agg(F.count(F.lit(1)).alias("companies")))
query("SELECT ticker, date, close, volume, prev_close, change_pct FROM bars", "last_bar")(lambda x: sc.last_bar(x.prices))
query("SELECT ticker, close, change_pct FROM bars", "latest_change")(lambda x: sc.last_bar(x.prices).select("ticker", "close", "change_pct"))
BROWSE = "SELECT s.cik, s.ticker, g.sector_slug, b.volume, b.change_pct FROM banded AS s JOIN sectors AS g ON s.cik = g.cik LEFT JOIN bars AS b ON s.ticker = b.ticker"
browsed = ["cik", "ticker", "sector_slug", "volume", "change_pct"]


def _browse(x: Inputs, **how) -> DataFrame:
    return sc.browse(snap(x), sc.last_bar(x.prices), sc.with_sector(x.companies, sic_ranges(x.spark)), x.members, **how).select(browsed)


query(f"{BROWSE} WHERE s.band = 'small' AND s.ticker IN (SELECT ticker FROM members WHERE index_slug = 'i3') AND upper(s.ticker) LIKE 'S%' ORDER BY b.volume DESC NULLS LAST, s.ticker LIMIT 50", "browse")(lambda x: _browse(x, band="small", index="i3", letter="s"))
query(f"{BROWSE} ORDER BY b.change_pct DESC NULLS LAST, s.ticker LIMIT 20 OFFSET 20", "browse_sorted")(lambda x: _browse(x, sort="gainers", per_page=20, after=_browse(x, sort="gainers", per_page=20).collect()[-1]))
query(f"{BROWSE} ORDER BY b.volume DESC NULLS LAST, s.ticker LIMIT 10", "most_active")(lambda x: _browse(x, per_page=10))
query("SELECT cik, ticker, market_cap FROM c_snap WHERE market_cap IS NOT NULL ORDER BY market_cap DESC, ticker LIMIT 12", "largest")(lambda x: snap(x).where("market_cap IS NOT NULL").orderBy(F.desc("market_cap"), "ticker").limit(12).select("cik", "ticker", "market_cap"))
query("SELECT * FROM (SELECT a.cik, b.cik AS peer_cik, b.ticker AS peer, abs(coalesce(a.market_cap, 0) - coalesce(b.market_cap, 0)) AS gap, row_number() OVER (PARTITION BY a.cik ORDER BY abs(coalesce(a.market_cap, 0) - coalesce(b.market_cap, 0)), b.ticker) AS rank FROM c_snap AS a JOIN c_snap AS b ON a.sic_description = b.sic_description AND a.cik <> b.cik) WHERE rank <= 8", "peers")(lambda x: sc.peers(snap(x)))
query("SELECT ticker AS \"Ticker\", name AS \"Company\", cast(market_cap AS varchar) IS NOT NULL AS \"Priced\", roe > 8 AS \"Earns\" FROM c_snap ORDER BY ticker LIMIT 5000", "export_screen")(lambda x: _exported(x))
query("SELECT max(p.date) AS newest_price, max(f.filed) AS newest_filing FROM prices AS p CROSS JOIN (SELECT max(filed) AS filed FROM facts) AS f WHERE p.ticker = (SELECT ticker FROM c_snap ORDER BY market_cap DESC NULLS LAST, ticker LIMIT 1)", "freshness")(
    lambda x: x.prices.join(F.broadcast(snap(x).orderBy(F.desc_nulls_last("market_cap"), "ticker").limit(1).select("ticker")), "ticker").agg(F.max("date").alias("newest_price")).crossJoin(x.facts.agg(F.max("filed").alias("newest_filing"))))



def _exported(x: Inputs) -> DataFrame:
    """A screen written as CSV under display headings and read back."""
    shown = snap(x).orderBy("ticker").select("ticker", "name", F.col("market_cap").isNotNull().alias("priced"), (F.col("roe") > 8).alias("earns"))
    path = fi.export_screen(shown, {"ticker": "Ticker", "name": "Company", "priced": "Priced", "earns": "Earns"}, new_path(x.spark, "screen-csv"))
    return x.spark.read.option("header", True).option("inferSchema", True).csv(path)


# ---- statements
def _cols(ptype: str, n: int) -> str:
    return f"(SELECT cik, period_end, row_number() OVER (PARTITION BY cik ORDER BY period_end) AS pos FROM (SELECT DISTINCT cik, period_end FROM c_f WHERE period_type = '{ptype}') QUALIFY row_number() OVER (PARTITION BY cik ORDER BY period_end DESC) <= {n})"


def _stmt(ptype: str, n: int, step: int) -> str:
    grow = lambda k: f"CASE WHEN lag(val, {k}) OVER w > 0 THEN (val / lag(val, {k}) OVER w - 1) * 100 END"
    cols = f"(SELECT cik, period_end, pos - min(pos) OVER (PARTITION BY cik) + 1 AS pos FROM {_cols(ptype, n)})"
    return f"SELECT cik, metric, period_end, val, {grow(step)} AS yoy, {grow(1)} AS qoq FROM (SELECT g.cik, g.metric, g.period_end, g.pos, v.val FROM (SELECT DISTINCT c.cik, v.metric, c.period_end, c.pos FROM {cols} AS c JOIN (SELECT DISTINCT f.cik, f.metric FROM c_f AS f JOIN {cols} AS c ON f.cik = c.cik AND f.period_end = c.period_end JOIN flow_list AS l ON f.metric = l.metric WHERE f.period_type = '{ptype}' AND f.val IS NOT NULL) AS v ON c.cik = v.cik) AS g LEFT JOIN c_f AS v ON g.cik = v.cik AND g.metric = v.metric AND g.period_end = v.period_end AND v.period_type = '{ptype}') WINDOW w AS (PARTITION BY cik, metric ORDER BY pos)"


query(_stmt("FY", 10, 1), "statement_fy")(lambda x: an.statement(current(x), "FY", 10))
query(_stmt("Q", 12, 4), "statement_q")(lambda x: an.statement(current(x), "Q", 12))
query("SELECT cik, metric, period_end, val, CASE WHEN lag(val) OVER w > 0 THEN (val / lag(val) OVER w - 1) * 100 END AS yoy FROM (SELECT g.cik, g.metric, g.period_end, v.val FROM (SELECT DISTINCT c.cik, c.period_end, h.metric FROM (SELECT cik, max(period_end) AS period_end FROM c_f WHERE period_type = 'INSTANT' GROUP BY cik, year(period_end) QUALIFY row_number() OVER (PARTITION BY cik ORDER BY max(period_end) DESC) <= 10) AS c JOIN (SELECT DISTINCT f.cik, f.metric FROM c_f AS f JOIN stock_list AS l ON f.metric = l.metric WHERE period_type = 'INSTANT') AS h ON c.cik = h.cik) AS g LEFT JOIN c_f AS v ON g.cik = v.cik AND g.metric = v.metric AND g.period_end = v.period_end AND v.period_type = 'INSTANT') WINDOW w AS (PARTITION BY cik, metric ORDER BY period_end)", "balance_sheet")(lambda x: an.balance_sheet(current(x)))
AT = "(SELECT p.cik, p.period_end, f.metric, f.val FROM (SELECT DISTINCT cik, period_end FROM c_f WHERE period_type = 'FY') AS p JOIN c_f AS f ON f.cik = p.cik AND f.period_type = 'INSTANT' AND f.period_end BETWEEN p.period_end - 120 AND p.period_end QUALIFY row_number() OVER (PARTITION BY p.cik, p.period_end, f.metric ORDER BY f.period_end DESC) = 1)"
query(f"SELECT * FROM {AT}", "instants_at")(lambda x: (lambda f: an.instants_at(f.where("period_type = 'FY'"), f))(current(x)))
query(f"""SELECT cik, period_end, CASE WHEN rev > 0 THEN gp / rev * 100 END AS gross_margin, CASE WHEN rev > 0 THEN oi / rev * 100 END AS operating_margin, CASE WHEN rev > 0 THEN ni / rev * 100 END AS net_margin, CASE WHEN te > 0 THEN ni / te * 100 END AS roe, CASE WHEN ta > 0 THEN ni / ta * 100 END AS roa, CASE WHEN ta - cl > 0 THEN oi / (ta - cl) * 100 END AS roce, CASE WHEN te > 0 THEN debt / te END AS debt_to_equity, CASE WHEN cl > 0 THEN ca / cl END AS current_ratio, CASE WHEN ta > 0 THEN rev / ta END AS asset_turnover
 FROM (SELECT c.cik, c.period_end, rev, oi, ni, coalesce(gp, rev - cogs) AS gp, ta, te, ca, cl, CASE WHEN sd IS NOT NULL OR ld IS NOT NULL THEN coalesce(sd, 0) + coalesce(ld, 0) END AS debt FROM (SELECT cik, period_end, max(CASE metric WHEN 'revenue' THEN val END) AS rev, max(CASE metric WHEN 'gross_profit' THEN val END) AS gp, max(CASE metric WHEN 'cost_of_revenue' THEN val END) AS cogs, max(CASE metric WHEN 'operating_income' THEN val END) AS oi, max(CASE metric WHEN 'net_income' THEN val END) AS ni FROM c_f WHERE period_type = 'FY' GROUP BY cik, period_end QUALIFY row_number() OVER (PARTITION BY cik ORDER BY period_end DESC) <= 10) AS c
 LEFT JOIN (SELECT cik, period_end, max(CASE metric WHEN 'total_assets' THEN val END) AS ta, max(CASE metric WHEN 'total_equity' THEN val END) AS te, max(CASE metric WHEN 'current_assets' THEN val END) AS ca, max(CASE metric WHEN 'current_liabilities' THEN val END) AS cl, max(CASE metric WHEN 'short_term_debt' THEN val END) AS sd, max(CASE metric WHEN 'long_term_debt' THEN val END) AS ld FROM {AT} GROUP BY cik, period_end) AS i ON c.cik = i.cik AND c.period_end = i.period_end)""", "ratios")(lambda x: an.ratio_history(current(x)))
query("SELECT cik, year(period_end) AS year, " + ", ".join(f"arg_max(CASE WHEN metric = '{m}' THEN val END, CASE WHEN metric = '{m}' THEN period_end END) AS {m}" for m in an.ANNUAL) + " FROM c_f JOIN annual_list USING (metric) WHERE period_type IN ('FY', 'INSTANT') GROUP BY cik, year(period_end) QUALIFY row_number() OVER (PARTITION BY cik ORDER BY year(period_end) DESC) <= 10", "annual_history")(lambda x: an.annual_history(current(x)))
query("SELECT DISTINCT cik, metric, source_concept FROM c_f", "provenance")(lambda x: an.provenance(current(x)))
query("SELECT m.metric, count(DISTINCT f.cik) AS companies, count(DISTINCT f.cik) / (SELECT count(DISTINCT cik) FROM c_f) AS share FROM metric_list AS m LEFT JOIN c_f AS f ON m.metric = f.metric GROUP BY m.metric", "coverage")(lambda x: an.coverage(current(x), metrics(x.spark)))
query("SELECT * FROM (SELECT metric, source_concept, count(DISTINCT cik) AS companies, row_number() OVER (PARTITION BY metric ORDER BY count(DISTINCT cik) DESC, source_concept) AS rank FROM c_f GROUP BY metric, source_concept) WHERE rank <= 4", "coverage_tags")(lambda x: an.coverage_tags(current(x)))
query("SELECT cik, taxonomy, concept, count(*) AS n_facts FROM facts GROUP BY cik, taxonomy, concept", "tag_census")(lambda x: an.tag_census(x.facts))
query("""SELECT * FROM (SELECT l.metric, t.concept, count(DISTINCT t.cik) AS companies, row_number() OVER (PARTITION BY l.metric ORDER BY count(DISTINCT t.cik) DESC, t.concept) AS rank FROM (SELECT m.metric, u.cik FROM metric_list AS m CROSS JOIN (SELECT DISTINCT cik FROM c_f) AS u WHERE NOT EXISTS (SELECT 1 FROM c_f AS f WHERE f.metric = m.metric AND f.cik = u.cik)) AS l
 JOIN (SELECT DISTINCT cik, concept FROM facts) AS t ON t.cik = l.cik WHERE NOT EXISTS (SELECT 1 FROM concept_map AS c WHERE c.metric = l.metric AND c.concept = t.concept) AND t.concept NOT IN (SELECT concept FROM facts GROUP BY concept HAVING count(DISTINCT cik) * 2 > (SELECT count(DISTINCT cik) FROM c_f)) GROUP BY l.metric, t.concept) WHERE rank <= 6""", "missing_tags")(lambda x: an.missing_tags(an.tag_census(x.facts), current(x), concept_map(x.spark)))
query("SELECT DISTINCT period_end, concat('Q', cast(floor(((month(period_end) - 10 + 12) % 12) / 3) + 1 AS int), ' ', year(period_end) + CASE WHEN month(period_end) > 9 THEN 1 ELSE 0 END) AS label FROM facts", "fiscal_quarter_label")(lambda x: x.facts.select("period_end", fiscal_quarter_label(F.col("period_end"), F.lit("0926")).alias("label")).distinct())

# ---- series
query("SELECT ticker, concat(isoyear(date), '-W', lpad(cast(week(date) AS varchar), 2, '0')) AS bucket, max(date) AS date, arg_max(close, date) AS close FROM prices GROUP BY 1, 2", "downsample_week")(lambda x: ts.downsample(x.prices, F.lit("week")))
query("SELECT ticker, strftime(date, '%Y-%m') AS bucket, max(date) AS date, arg_max(close, date) AS close FROM prices GROUP BY 1, 2", "downsample_month")(lambda x: ts.downsample(x.prices, F.lit("month")))
query("SELECT ticker, max(date) - min(date) AS span_days, CASE WHEN max(date) - min(date) <= 400 THEN 'day' WHEN max(date) - min(date) <= 1400 THEN 'week' ELSE 'month' END AS bucket FROM prices GROUP BY ticker", "adaptive_bucket")(lambda x: ts.full_span(x.prices).withColumn("bucket", ts.adaptive_bucket(F.col("span_days"))))
query("SELECT ticker, max(date) - min(date) AS span_days FROM prices GROUP BY ticker", "full_span")(lambda x: ts.full_span(x.prices))
query("SELECT ticker, count(*) AS n, min(date) AS first_date, max(date) AS last_date, arg_min(close, date) AS first_close, arg_max(close, date) AS last_close, min(close) AS low, max(close) AS high, arg_max(close, date) - arg_min(close, date) AS change, arg_max(close, date) / nullif(arg_min(close, date), 0) * 100 - 100 AS pct, max(date) - min(date) AS span_days FROM prices GROUP BY ticker", "series_meta")(lambda x: ts.series_meta(x.prices))
query("SELECT ticker, date, close FROM prices QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 5", "last_5_bars")(lambda x: ts.last_n_bars(x.prices, 5).select("ticker", "date", "close"))
SERIES = """(SELECT ticker, date, close, bucket, fell_back, fell_back OR (span > 0 AND span < 1827 * 0.85) AS partial, span AS span_days, full_span AS full_span_days FROM (SELECT *, CASE WHEN span <= 400 THEN 'day' ELSE 'week' END AS bucket, row_number() OVER (PARTITION BY ticker, strftime(date, '%G-%V') ORDER BY date DESC) AS w
 FROM (SELECT p.ticker, p.date, p.close, c.choice = 'all' AS fell_back, c.full_span, max(p.date) OVER (PARTITION BY p.ticker) - min(p.date) OVER (PARTITION BY p.ticker) AS span
 FROM prices AS p JOIN (SELECT ticker, max(date) - 1827 AS own, max(date) - min(date) AS full_span, CASE WHEN count(CASE WHEN date BETWEEN DATE '2001-11-04' - 1827 AND DATE '2001-11-04' THEN 1 END) >= 2 THEN 'window' WHEN max(date) < DATE '2001-11-04' THEN 'own' ELSE 'all' END AS choice FROM prices GROUP BY ticker) AS c ON p.ticker = c.ticker
 WHERE c.choice = 'all' OR (c.choice = 'window' AND p.date BETWEEN DATE '2001-11-04' - 1827 AND DATE '2001-11-04') OR (c.choice = 'own' AND p.date >= c.own))) WHERE span <= 400 OR w = 1)"""
query(f"SELECT * FROM {SERIES}", "price_series")(lambda x: ts.price_series(x.prices, "5y", TODAY))
query(f"SELECT ticker, count(*) AS n, min(date) AS first_date, max(date) AS last_date, arg_min(close, date) AS first_close, arg_max(close, date) AS last_close, min(close) AS low, max(close) AS high, arg_max(close, date) - arg_min(close, date) AS change, arg_max(close, date) / nullif(arg_min(close, date), 0) * 100 - 100 AS pct, min(bucket) AS bucket, bool_or(fell_back) AS fell_back, bool_or(partial) AS partial, max(span_days) AS span_days, max(full_span_days) AS full_span_days, max(full_span_days) >= 45 AS has_6m, max(full_span_days) >= 90 AS has_1y, max(full_span_days) >= 400 AS has_5y FROM {SERIES} GROUP BY ticker", "price_series_meta")(lambda x: ts.price_series_meta(ts.price_series(x.prices, "5y", TODAY)))
query(f"SELECT * FROM {SERIES}", "series_from_levels")(lambda x: lv.series_from_levels(x.prices, {k: x.keep(f"level-{k}", lambda k=k: lv.rollup(x.prices, k)) for k in lv.LEVELS}, "5y", TODAY))
INTRA = "(SELECT cast(user_id AS varchar) AS ticker, ts, value AS close FROM events)"
LOCAL = f"(SELECT ticker, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M') AS minute, cast((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS date) AS session, close FROM {INTRA} WHERE close IS NOT NULL)"


def _ticks(x: Inputs) -> DataFrame:
    return ts.normalize_intraday(x.table("events").select(F.col("user_id").cast("string").alias("ticker"), "ts", F.col("value").alias("close")))


def _event_days(x: Inputs) -> DataFrame:
    e = x.table("events").where("value IS NOT NULL")
    return e.groupBy(F.col("user_id").cast("string").alias("ticker"), F.to_date("ts").alias("date")).agg(F.max("value").alias("close"))


query(f"SELECT * FROM {LOCAL}", "intraday_bars")(_ticks)
query(f"""SELECT g.ticker, g.n, g.first_session, g.last, b.base, g.last / nullif(b.base, 0) * 100 - 100 AS pct FROM (SELECT ticker, count(*) AS n, min(session) AS first_session, arg_max(close, struct_pack(a := minute, b := close)) AS last FROM {LOCAL} WHERE session >= DATE '2024-01-10' GROUP BY ticker HAVING count(*) >= 2) AS g
 LEFT JOIN LATERAL (SELECT d.close AS base FROM (SELECT cast(user_id AS varchar) AS ticker, cast(ts AS date) AS date, max(value) AS close FROM events WHERE value IS NOT NULL GROUP BY 1, 2) AS d WHERE d.ticker = g.ticker AND d.date < g.first_session ORDER BY d.date DESC LIMIT 1) AS b ON true""", "intraday_series")(lambda x: ts.intraday_series(_ticks(x).where("session >= DATE '2024-01-10'"), _event_days(x)))
DELAYED = "(SELECT ticker, CASE WHEN cast(right(ticker, 9) AS int) % 4 = 0 THEN close * 1.5 ELSE 0.0 END AS price, date AS as_of FROM bars WHERE cast(right(ticker, 9) AS int) % 4 IN (0, 1))"
QUOTES = f"(SELECT b.ticker, coalesce(nullif(d.price, 0), b.close) AS price, coalesce(CASE WHEN nullif(d.price, 0) IS NOT NULL THEN d.as_of END, b.date) AS as_of, CASE WHEN nullif(d.price, 0) IS NOT NULL THEN 'delayed' ELSE 'close' END AS source FROM bars AS b LEFT JOIN {DELAYED} AS d ON b.ticker = d.ticker)"


def _quotes(x: Inputs) -> DataFrame:
    k = F.substring("ticker", -9, 9).cast("int") % 4
    d = sc.last_bar(x.prices).where(k.isin(0, 1)).select("ticker", F.when(k == 0, F.col("close") * 1.5).otherwise(0.0).alias("price"), F.col("date").alias("as_of"))
    return ts.quotes(x.prices, d, x.prices)


query(f"SELECT * FROM {QUOTES}", "quotes")(_quotes)
query(f"SELECT p.ticker, p.date, CASE WHEN q.source = 'delayed' AND q.as_of = p.date THEN q.price ELSE p.close END AS close FROM prices AS p JOIN {QUOTES} AS q ON p.ticker = q.ticker", "apply_quote")(lambda x: ts.apply_quote(x.prices, _quotes(x)))

# ---- gauge
MOM = "(SELECT round(greatest(0, least(100, 50 + (avg(last / mean) - 1) * 500)), 6) AS score, count(*) AS tickers FROM (SELECT ticker, avg(close) AS mean, arg_max(close, date) AS last FROM (SELECT * FROM prices QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 125) GROUP BY ticker HAVING count(*) >= 10))"
STR = "(SELECT round(greatest(0, least(100, 50 + (near_high - near_low) / tickers * 50)), 6) AS score, near_high, near_low, tickers FROM (SELECT count(CASE WHEN last >= hi * (1 - 0.05) THEN 1 END) AS near_high, count(CASE WHEN last <= lo * (1 + 0.05) THEN 1 END) AS near_low, count(*) AS tickers FROM (SELECT ticker, max(close) AS hi, min(close) AS lo, arg_max(close, date) AS last FROM prices GROUP BY ticker HAVING count(*) >= 10)))"
BRE = "(SELECT round(CASE WHEN tickers >= 5 AND adv + decl > 0 THEN greatest(0, least(100, 50 + (adv - decl) / (adv + decl) * 50)) END, 6) AS score, adv AS advancing, decl AS declining, tickers FROM (SELECT coalesce(sum(CASE WHEN close > prev THEN volume ELSE 0 END), 0) AS adv, coalesce(sum(CASE WHEN close < prev THEN volume ELSE 0 END), 0) AS decl, count(*) AS tickers FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM prices) WHERE date = (SELECT max(date) FROM prices) AND prev IS NOT NULL AND volume > 0))"
query(f"SELECT * FROM {MOM}", "sentiment_momentum")(lambda x: se.momentum(x.prices))
query(f"SELECT * FROM {STR}", "sentiment_strength")(lambda x: se.strength(x.prices))
query(f"SELECT * FROM {BRE}", "sentiment_breadth")(lambda x: se.breadth(x.prices))
GAUGE = f"(SELECT *, CASE WHEN score < 20 THEN 'extreme-fear' WHEN score < 40 THEN 'fear' WHEN score < 60 THEN 'neutral' WHEN score < 80 THEN 'greed' WHEN score IS NOT NULL THEN 'extreme-greed' END AS zone FROM (SELECT DATE '{TODAY}' AS date, CASE WHEN (SELECT count(DISTINCT ticker) FROM prices) >= 5 THEN round((coalesce(m.score, 0) + coalesce(s.score, 0) + coalesce(b.score, 0)) / nullif((m.score IS NOT NULL)::int + (s.score IS NOT NULL)::int + (b.score IS NOT NULL)::int, 0), 1) END AS score, m.score AS momentum, s.score AS strength, b.score AS breadth FROM {MOM} AS m CROSS JOIN {STR} AS s CROSS JOIN {BRE} AS b))"
query(f"SELECT * FROM {GAUGE}", "sentiment")(lambda x: se.sentiment(x.prices, TODAY))
READ = "(SELECT date, round(sum(volume) % 101, 1) AS score FROM prices GROUP BY date)"
query(f"SELECT date, score, CASE WHEN score < 20 THEN 'extreme-fear' WHEN score < 40 THEN 'fear' WHEN score < 60 THEN 'neutral' WHEN score < 80 THEN 'greed' ELSE 'extreme-greed' END AS zone FROM {READ} ORDER BY date DESC LIMIT 90", "sentiment_history")(lambda x: se.sentiment_history(x.prices.groupBy("date").agg(F.round(F.sum("volume") % 101, 1).alias("score"))))

# ---- sources and planning
# the documents of companies whose number ends in 3 are cut short, in 5 blank, in 7 without facts, in 9 without a company number
READ = "cik % 10 NOT IN (3, 5, 7, 9)"


def _documents(x: Inputs, broken: bool) -> DataFrame:
    """``(value, company)``: the filing document of each company, all of them whole or some of them ``broken``.

    Facts are dealt by company once, to tasks that write as many files each however many companies there are.
    """
    facts = fu.by_company(x.facts)
    e = F.struct(F.col("period_start").cast("string").alias("start"), F.col("period_end").cast("string").alias("end"), "val", "accn", "fy", "fp", "form", F.col("filed").cast("string").alias("filed"))
    u = facts.groupBy("cik", "taxonomy", "concept", "unit").agg(F.collect_list(e).alias("entries"))
    t = u.groupBy("cik", "taxonomy", "concept").agg(F.map_from_entries(F.collect_list(F.struct("unit", "entries"))).alias("units"))
    c = t.groupBy("cik", "taxonomy").agg(F.map_from_entries(F.collect_list(F.struct(F.col("concept"), F.struct(F.col("concept").alias("label"), F.col("units")).alias("tag")))).alias("tags"))
    d = c.groupBy("cik").agg(F.map_from_entries(F.collect_list(F.struct("taxonomy", "tags"))).alias("facts"))
    kind = F.col("cik") % 10 if broken else F.lit(0)
    doc = F.to_json(F.struct(F.when(kind != 9, F.lpad(F.col("cik").cast("string"), 10, "0")).alias("cik"), F.concat(F.lit("Company "), "cik").alias("entityName"), F.when(kind != 7, F.col("facts")).alias("facts")))
    text = F.when(kind == 3, F.substring(doc, 1, 200)).when(kind == 5, "").otherwise(doc)
    return d.select(text.alias("value"), F.lpad(F.col("cik").cast("string"), 10, "0").alias("company"))


def _folder(x: Inputs, broken: bool) -> str:
    """A folder of those documents, one file a company."""
    path = new_path(x.spark, "filing-documents")
    _documents(x, broken).write.partitionBy("company").text(path)
    return path


def _scan(x: Inputs, broken: bool = True, **how) -> ff.Landed:
    return ff.scan(x.spark, _folder(x, broken), concept_map(x.spark), pattern="part-*", **how)


FACT_COLUMNS = ["cik", "concept", "unit", "period_start", "period_end", "filed", "accn", "val"]
query(f"SELECT {', '.join(FACT_COLUMNS)} FROM facts", "ingest_companyfacts")(lambda x: _scan(x, broken=False).facts().select(FACT_COLUMNS))
query(f"SELECT {', '.join(FACT_COLUMNS)} FROM facts WHERE {READ} AND cik IN (SELECT DISTINCT cik FROM facts ORDER BY cik LIMIT 9)", "ingest_first_files")(lambda x: _scan(x, first=9).facts().select(FACT_COLUMNS))
query("SELECT cik, taxonomy, concept, count(*) AS n_facts FROM facts GROUP BY cik, taxonomy, concept", "census_of_docs")(lambda x: _scan(x, broken=False).census())
query("SELECT DISTINCT cik, concat('Company ', cik) AS name FROM facts WHERE cik % 10 NOT IN (3, 5, 9)", "ingest_companies")(lambda x: _scan(x).companies())
query("SELECT cik AS company, CASE WHEN cik % 10 NOT IN (3, 5, 9) THEN cik END AS cik, CASE WHEN cik % 10 NOT IN (3, 5, 7, 9) THEN count(*) ELSE 0 END AS n_facts, CASE WHEN cik % 10 = 7 THEN 'empty' WHEN cik % 10 IN (3, 5, 9) THEN 'error' ELSE 'ok' END AS status, CASE cik % 10 WHEN 3 THEN 'not a filing document' WHEN 5 THEN 'no document' WHEN 9 THEN 'no company number' END AS message FROM facts GROUP BY cik", "ingest_log")(
    lambda x: _scan(x).log().select(F.regexp_extract("file", "company=(\\d+)", 1).cast("long").alias("company"), "cik", "n_facts", "status", "message"))


def _submissions(x: Inputs) -> DataFrame:
    held = x.facts.select("cik", "form", "accn", "filed").distinct()
    newest = x.facts.groupBy("cik").agg(F.max("filed").alias("newest"))
    extra = newest.where("cik % 4 = 0").select("cik", F.lit("10-Q").alias("form"), F.concat("cik", F.lit("-new")).alias("accn"), F.date_add("newest", 60).alias("filed"))
    other = newest.select("cik", F.lit("8-K").alias("form"), F.concat("cik", F.lit("-8k")).alias("accn"), F.date_add("newest", 61).alias("filed"))
    rows = held.unionByName(extra).unionByName(other)
    g = rows.groupBy("cik").agg(F.collect_list(F.struct("form", "accn", "filed")).alias("r"))
    return g.select("cik", F.col("r.form").alias("forms"), F.col("r.accn").alias("accessions"), F.col("r.filed").alias("dates"))


query("SELECT cik, concat(cik, '-new') AS accn, '10-Q' AS form, max(filed) + 60 AS filed FROM facts WHERE cik % 4 = 0 GROUP BY cik", "new_filings")(lambda x: fi.new_filings(_submissions(x), x.facts))
query("SELECT c.cik, upper(c.ticker) AS ticker, c.name, c.sic, c.sic_description, c.exchange, c.fiscal_year_end FROM companies AS c", "company_meta")(lambda x: fi.company_meta(x.companies.select(F.col("cik").cast("string").alias("cik"), F.array(F.lower("ticker"), F.lit("zzz")).alias("tickers"), F.array("exchange").alias("exchanges"), "name", "sic", F.col("sic_description").alias("sicDescription"), F.col("fiscal_year_end").alias("fiscalYearEnd"))))
query("SELECT cik, upper(trim(ticker)) AS ticker, trim(name) AS name FROM companies", "primary_ticker")(lambda x: fi.primary_ticker(x.companies.select("cik", "ticker", "name", F.lit(0).alias("ordinal")).unionByName(x.companies.select("cik", F.concat("ticker", F.lit("-PA")).alias("ticker"), "name", F.lit(1).alias("ordinal")))))
query("SELECT ticker, date, open, high, low, close, volume FROM prices", "normalize_bars")(lambda x: fi.normalize_bars(x.prices.withColumn("ticker", F.lower("ticker"))).withColumn("ticker", F.initcap("ticker")))
query("SELECT headline, source, url, to_timestamp(datetime)::timestamp AS published FROM headlines WHERE headline IS NOT NULL AND headline <> '' AND url IS NOT NULL", "clean_headlines")(lambda x: fi.clean_headlines(x.headlines))
query("SELECT ticker, date, CASE WHEN year(date) = 2000 THEN close * 2 ELSE close END AS close FROM prices", "upsert_latest")(lambda x: (lambda p: fi.upsert_latest(p, p.where("year(date) = 2000").withColumn("close", F.col("close") * 2), ["ticker", "date"]))(x.prices.select("ticker", "date", "close")))
query("SELECT cik, ticker, CASE WHEN cik % 2 = 0 THEN concat(name, '!') ELSE name END AS name, sic FROM companies", "upsert_companies")(lambda x: (lambda c: fi.upsert_partial(c, c.where("cik % 2 = 0").withColumn("name", F.concat("name", F.lit("!"))), ["cik"], ["name"]))(x.companies.select("cik", "ticker", "name", "sic")))
query("SELECT cik, effective_filed, CASE WHEN cik % 2 = 0 THEN factor * 2 ELSE factor END AS factor FROM splits", "replace_keys")(lambda x: (lambda s: fi.replace_keys(s, s.where("cik % 2 = 0").withColumn("factor", F.col("factor") * 2), ["cik"]))(fu.detect_splits(x.facts)))
LOG = "(SELECT cik, CASE cik % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' ELSE 'empty' END AS status FROM companies WHERE cik % 5 <> 0)"
query(f"SELECT cik, ticker FROM companies WHERE cik NOT IN (SELECT cik FROM {LOG} WHERE status <> 'error')", "ingest_targets")(lambda x: fi.ingest_targets(x.companies, x.companies.where("cik % 5 <> 0").select("cik", F.when(F.col("cik") % 3 == 0, "ok").when(F.col("cik") % 3 == 1, "error").otherwise("empty").alias("status"))))
query("SELECT DISTINCT cik FROM facts WHERE cik % 3 <> 0", "due_companies")(lambda x: fi.due_companies(x.facts, x.companies.where("cik % 3 <> 2").select("cik", F.when(F.col("cik") % 3 == 0, F.lit("2001-11-03 12:00:00")).otherwise(F.lit("2001-10-01 00:00:00")).cast("timestamp").alias("checked_at")), "2001-11-03 00:00:00"))
query("SELECT DISTINCT ticker FROM prices WHERE cast(right(ticker, 9) AS int) % 3 = 0", "rebased_tickers")(lambda x: fi.rebased_tickers(x.prices, x.prices.select("ticker", "date", F.when(F.substring("ticker", -9, 9).cast("int") % 3 == 0, F.col("close") * 1.01).otherwise(F.col("close") * 1.001).alias("close"))))
query("SELECT DISTINCT c.ticker, c.cik % 2 = 0 AS priced, CASE WHEN c.cik % 2 = 0 THEN '3mo' ELSE 'max' END AS pull FROM companies AS c JOIN facts AS f ON c.cik = f.cik", "price_refresh_plan")(lambda x: fi.price_refresh_plan(x.companies, x.facts, x.prices.where(F.substring("ticker", -9, 9).cast("int") % 2 == 0).withColumn("date", F.least("date", F.lit("2001-10-01").cast("date"))), TODAY))
query("SELECT 'facts' AS item, count(*) AS n FROM facts UNION ALL SELECT 'prices', count(*) FROM prices UNION ALL SELECT 'companies', count(*) FROM companies UNION ALL SELECT 'ingested', count(DISTINCT cik) FROM facts", "summary_counts")(lambda x: fi.summary_counts({"facts": x.facts, "prices": x.prices, "companies": x.companies}, {"ingested": ("facts", "cik")}))


def _price_csv(x: Inputs) -> DataFrame:
    """The bars as CSV files with another provider's headings, absent figures and lines that are no bars, read back."""
    path = new_path(x.spark, "bars-csv")
    day = F.dayofmonth("date")
    p = x.prices.select(F.when(day == 2, "no trade").otherwise(F.col("date").cast("string")).alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"),
                        F.when(day == 3, "null").otherwise(F.col("close").cast("string")).alias("Close"), F.when(day % 5 == 0, (F.col("close") / 2).cast("string")).otherwise(F.when(day % 2 == 0, "N/A")).alias("Adj Close"), F.col("volume").alias("Volume"), F.lower("ticker").alias("Ticker"))
    p.write.option("header", True).csv(path)
    return fi.read_price_csv(x.spark, path)


def _index_members(x: Inputs) -> DataFrame:
    path = new_path(x.spark, "members-csv")
    x.members.withColumn("as_of", F.lit("2001-01-01").cast("date")).write.option("header", True).csv(path)
    return fi.read_index_members(x.spark, path)


#: One refreshed store for each application and folder.
_REFRESHED: dict[tuple[str, str], rf.Refresh] = {}


def _refreshed(x: Inputs) -> rf.Refresh:
    """After refreshes of what was filed and traded up to 1997, of all since, and of the whole histories then wanted.

    Early bars of every third company are on another basis, as before a split, so its history is wanted again once
    later bars overlap it. Each company's last early bar landed twice, first with another close.
    """
    known = (x.spark.sparkContext.applicationId, x.sf_dir)
    if known in _REFRESHED:
        return _REFRESHED[known]
    base = new_path(x.spark, "refresh")
    facts, prices = x.facts, x.prices
    odd = F.substring("ticker", -9, 9).cast("int") % 3 == 0
    r = rf.Refresh(Store(x.spark, f"{base}/store", buckets=8, limit=64 << 10), f"{base}/bars", prices.schema, f"{base}/facts", facts.schema, x.companies, concept_map(x.spark), TODAY, f"{base}/histories")

    def land(rows: DataFrame, folder: str) -> None:
        rows.write.mode("append").parquet(f"{base}/{folder}")

    def go() -> None:
        failed = [s for s in rf.run(r) if s["state"] == "error"]
        if failed:
            raise RuntimeError(f"refresh failed: {failed}")

    land(prices.limit(0), "histories")
    land(facts.where("filed < '1998-01-01'"), "facts")
    land(prices.where("date < '1998-01-01' AND day(date) = 9").withColumn("close", F.col("close") + 1), "bars")
    land(prices.where("date < '1998-01-01'").withColumn("close", F.when(odd, F.col("close") * 2).otherwise(F.col("close"))), "bars")
    go()
    land(facts.where("filed >= '1998-01-01'"), "facts")
    land(prices.where("date >= '1997-11-01'"), "bars")
    go()
    land(prices.join(r.wanted(), "ticker", "left_semi").select(prices.columns), "histories")
    go()
    _REFRESHED[known] = r
    return r


query("SELECT upper(ticker) AS ticker, date, open, high, low, CASE WHEN day(date) % 5 = 0 THEN close / 2 ELSE close END AS close, cast(volume AS double) AS volume FROM prices WHERE day(date) NOT IN (2, 3)", "price_csv")(_price_csv)
query("SELECT index_slug, index_name, ticker, DATE '2001-01-01' AS as_of FROM members", "index_members")(_index_members)
query(f"SELECT cik, {F_COLS} FROM c_f", "incremental_refresh")(lambda x: _refreshed(x).fundamentals().select("cik", *fu.COLUMNS))
query("SELECT * FROM c_snap", "refreshed_snapshot")(lambda x: _refreshed(x).snapshot())
query("SELECT ticker, date, close FROM prices", "refreshed_prices")(lambda x: _refreshed(x).prices().select("ticker", "date", "close"))
query("""SELECT ticker, date, close, bucket, false AS fell_back, span < 1400 AS partial, span AS span_days, span AS full_span_days FROM (SELECT *, row_number() OVER (PARTITION BY ticker, CASE bucket WHEN 'day' THEN cast(date AS varchar) WHEN 'week' THEN strftime(date, '%G-%V') ELSE strftime(date, '%Y-%m') END ORDER BY date DESC) AS rn
 FROM (SELECT *, CASE WHEN span <= 400 THEN 'day' WHEN span <= 1400 THEN 'week' ELSE 'month' END AS bucket FROM (SELECT ticker, date, close, max(date) OVER (PARTITION BY ticker) - min(date) OVER (PARTITION BY ticker) AS span FROM prices))) WHERE rn = 1""", "refreshed_series")(lambda x: (lambda r: lv.series_from_levels(r.prices(), r.levels(), "max", TODAY))(_refreshed(x)))
query(f"SELECT * FROM {GAUGE}", "refreshed_gauge")(lambda x: x.spark.read.parquet(f"{_refreshed(x).store.path}/sentiment"))

# ---- picking
NAMES = "(SELECT cast(item_id AS varchar) AS ticker, array_to_string(regexp_extract_all(text, '[A-Za-z]+')[1:2], ' ') AS name FROM benchmark UNION ALL SELECT concat('P', p_partkey), concat('The ', p_name) FROM part)"
NOISE = ", ".join(f"'{w}'" for w in pk.NOISE)
WORDS = f"(SELECT ticker, list_filter(regexp_extract_all(name, '[A-Za-z]+'), lambda w: lower(w) NOT IN ({NOISE})) AS w FROM {NAMES})"


def _names(x: Inputs) -> DataFrame:
    items = x.table("benchmark").select(F.col("item_id").cast("string").alias("ticker"), F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]+"), F.lit(0)), 1, 2), " ").alias("name"))
    return items.union(x.table("part").select(F.concat(F.lit("P"), F.col("p_partkey")), F.concat(F.lit("The "), F.col("p_name"))))


query(f"SELECT lower(w[1]) AS word, count(*) AS companies FROM {WORDS} WHERE w[1] IS NOT NULL GROUP BY 1 HAVING count(*) >= 3", "common_first_words")(lambda x: pk.common_first_words(_names(x)))
query("SELECT ticker, CASE WHEN (SELECT count(net_income_ttm) FROM c_snap) <= 1 THEN 0.5 ELSE coalesce(p, 0) END AS percentile FROM (SELECT ticker, CASE WHEN net_income_ttm IS NOT NULL THEN percent_rank() OVER (PARTITION BY net_income_ttm IS NULL ORDER BY net_income_ttm) END AS p FROM c_snap)", "size_percentile")(lambda x: pk.size_percentile(snap(x).select("ticker", F.col("net_income_ttm").alias("size"))))
GENERIC = ", ".join(f"'{w}'" for w in pk.GENERIC)
query(f"""WITH n AS (SELECT ticker, w[1] AS a, w[2] AS b FROM {WORDS}), common AS (SELECT lower(a) AS w FROM n WHERE a IS NOT NULL GROUP BY 1 HAVING count(*) >= 3),
 t AS (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\s\\p{{L}}\\p{{N}}_]+') AS l FROM documents), u AS (SELECT DISTINCT l[i] AS x, lower(l[i]) AS a, lower(l[i + 1]) AS b FROM (SELECT l, unnest(range(1, len(l) + 1)) AS i FROM t)),
 k0 AS (SELECT DISTINCT unnest(regexp_extract_all(text, '(?:\\$|\\(|\\b(?:NYSE|NASDAQ|NYSEARCA|AMEX)\\s*:\\s*)([A-Za-z0-9.#-]+)', 1)) AS x FROM documents),
 k AS (SELECT DISTINCT x[1:i] AS ticker FROM (SELECT x, unnest(range(1, len(x) + 1)) AS i FROM k0) WHERE regexp_matches(x[i], '[A-Za-z0-9_]') <> regexp_matches(concat(x[i + 1], ''), '[A-Za-z0-9_]'))
 SELECT ticker FROM n WHERE ticker IN (SELECT ticker FROM k) OR (n.b IS NOT NULL AND EXISTS (SELECT 1 FROM u WHERE u.a = lower(n.a) AND u.b = lower(n.b))) OR (length(n.a) >= 5 AND lower(n.a) NOT IN ({GENERIC}) AND lower(n.a) NOT IN (SELECT w FROM common) AND EXISTS (SELECT 1 FROM u WHERE u.x IN (upper(n.a), concat(upper(n.a[1]), lower(n.a[2:])))))""", "news_mentions")(lambda x: pk.news_mentions(_names(x), x.headlines, pk.common_first_words(_names(x))))
query("SELECT ticker, name, 0.55 * CASE WHEN known <= 1 THEN 0.5 ELSE coalesce(p, 0) END + CASE WHEN cik % 7 = 0 THEN 0.45 ELSE 0 END AS score, concat('size p', cast(floor(CASE WHEN known <= 1 THEN 0.5 ELSE coalesce(p, 0) END * 100) AS bigint), CASE WHEN cik % 7 = 0 THEN ', in the news' ELSE '' END) AS reason FROM (SELECT *, percent_rank() OVER (ORDER BY size) AS p, count(size) OVER () AS known FROM (SELECT cik, ticker, name, nullif(greatest(coalesce(revenue_ttm, 0), coalesce(total_assets, 0)), 0) AS size FROM c_snap WHERE cik % 2 = 1)) ORDER BY score DESC, ticker DESC LIMIT 20", "pick_unpriced")(
    lambda x: (lambda s: pk.pick_unpriced(s, s.where("cik % 2 = 0"), s.where("cik % 7 = 0").select("ticker"), luck=0.0))(snap(x)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(f):
        return lambda spark, sf_dir: f(Inputs(spark, sf_dir))

    return {k: bind(f) for k, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
