"""Engine inputs made from the star-schema tables, one SQL text for Spark and DuckDB alike.

A supplier is a company; all its shipments count, and a year is filed as one where it has four quarters. Amounts are whole cents and share counts powers of two, so that every sum is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .stored import store

_Q = """SELECT l_suppkey AS s, year(l_shipdate) AS y, quarter(l_shipdate) AS q, power(2, l_suppkey % 12) AS k,
 sum(cast(round(l_extendedprice * 100) AS bigint)) AS c, sum(cast(round(l_extendedprice * 100) AS bigint) * cast(round(l_discount * 100) AS bigint)) AS cd
 FROM {lineitem} GROUP BY l_suppkey, year(l_shipdate), quarter(l_shipdate)"""

_V = f"""SELECT s, y, q, k, cast(c AS double) * k AS rev, CASE WHEN s % 7 = 6 THEN -1 ELSE 1 END * floor(cast(cd AS double) / 100) * k AS ni FROM ({_Q}) AS q"""

FACTS = f"""WITH v AS ({_V}),
per AS (
 SELECT s, y, k, make_date(y, 3 * q - 2, 1) AS ps, last_day(make_date(y, 3 * q, 1)) AS pe, cast(last_day(make_date(y, 3 * q, 1)) + INTERVAL 35 DAY AS date) AS filed, '10-Q' AS form, concat('Q', q) AS fp, concat(s, '-', y, '-', q) AS accn, rev, ni FROM v WHERE q <= 3
 UNION ALL
 SELECT s, y, k, make_date(y, 1, 1), make_date(y, 12, 31), cast(make_date(y, 12, 31) + INTERVAL 52 DAY AS date), '10-K', 'FY', concat(s, '-', y, '-K'), sum(rev), sum(ni) FROM v GROUP BY s, y, k HAVING count(*) = 4),
ytd AS (
 SELECT a.s, a.y, a.k, a.q, make_date(a.y, 1, 1) AS ps, last_day(make_date(a.y, 3 * a.q, 1)) AS pe, sum(b.ni) AS ni FROM v AS a JOIN v AS b ON a.s = b.s AND a.y = b.y AND b.q <= a.q GROUP BY a.s, a.y, a.k, a.q HAVING count(*) = a.q),
inst AS (
 SELECT v.s, v.y, v.k, v.q, last_day(make_date(v.y, 3 * v.q, 1)) AS pe, t.rev FROM v JOIN (SELECT s, y, sum(rev) AS rev FROM v GROUP BY s, y) AS t ON v.s = t.s AND v.y = t.y),
rows AS (
 SELECT s, CASE s % 3 WHEN 0 THEN 'RevenueFromContractWithCustomerExcludingAssessedTax' WHEN 1 THEN 'Revenues' ELSE 'SalesRevenueNet' END AS concept, 'USD' AS unit, ps, pe, y, fp, form, filed, accn, rev AS val FROM per
 UNION ALL SELECT s, 'NetIncomeLoss', 'USD', ps, pe, y, fp, form, filed, accn, ni FROM per
 UNION ALL SELECT s, 'CostOfRevenue', 'USD', ps, pe, y, fp, form, filed, accn, floor(rev / 2) FROM per WHERE s % 4 <> 3
 UNION ALL SELECT s, 'PaymentsToAcquirePropertyPlantAndEquipment', 'USD', ps, pe, y, fp, form, filed, accn, floor(rev / 16) FROM per WHERE fp = 'FY'
 UNION ALL SELECT s, 'EarningsPerShareDiluted', 'USD/shares', ps, pe, y, fp, form, filed, accn, ni / (1048576 * k) / CASE WHEN s % 5 = 0 AND filed >= DATE '1999-11-01' THEN 4 ELSE 1 END FROM per
 UNION ALL SELECT s, 'NetCashProvidedByUsedInOperatingActivities', 'USD', ps, pe, y, CASE WHEN q = 4 THEN 'FY' ELSE concat('Q', q) END, CASE WHEN q = 4 THEN '10-K' ELSE '10-Q' END, cast(pe + CASE WHEN q = 4 THEN INTERVAL 52 DAY ELSE INTERVAL 35 DAY END AS date), concat(s, '-', y, '-', CASE WHEN q = 4 THEN 'K' ELSE cast(q AS varchar(9)) END), 2 * ni FROM ytd
 UNION ALL SELECT s, c.concept, c.unit, cast(NULL AS date), pe, y, concat('Q', q), '10-Q', cast(pe + INTERVAL 35 DAY AS date), concat(s, '-', y, '-', q), CASE WHEN c.unit = 'shares' THEN 1048576 * k ELSE floor(rev * c.factor) * CASE WHEN c.concept = 'StockholdersEquity' AND s % 5 = 4 THEN -1 ELSE 1 END END
  FROM inst CROSS JOIN (VALUES ('Assets', 'USD', 2.0), ('StockholdersEquity', 'USD', 0.5), ('CashAndCashEquivalentsAtCarryingValue', 'USD', 0.25), ('LongTermDebtNoncurrent', 'USD', 0.125), ('AssetsCurrent', 'USD', 1.0), ('LiabilitiesCurrent', 'USD', 0.5), ('CommonStockSharesOutstanding', 'shares', 0.0)) AS c(concept, unit, factor)
 UNION ALL SELECT s, 'RevenueFromContractWithCustomerExcludingAssessedTax', 'USD', ps, pe, y, fp, '10-K/A', DATE '1999-06-01', concat(s, '-1998-A'), rev * 1.5 FROM per WHERE s % 3 = 0 AND y = 1998 AND fp = 'Q1'
 UNION ALL SELECT s, 'EarningsPerShareDiluted', 'USD/shares', ps, pe, y, fp, '10-K/A', DATE '1999-11-01', concat(s, '-1999-S'), ni / (1048576 * k) / 4 FROM per WHERE s % 5 = 0 AND y IN (1997, 1998) AND fp = 'FY')
SELECT s AS cik, 'us-gaap' AS taxonomy, concept, unit, cast(ps AS date) AS period_start, cast(pe AS date) AS period_end, cast(y AS int) AS fy, fp, form, filed, accn, cast(val AS double) AS val FROM rows"""

#: Spark reads the quarterly sums from where they are kept: the text names them in some fifteen places, each a scan and a shuffle of lineitem.
FACTS_SPARK = FACTS.replace(f"WITH v AS ({_V})", "WITH v AS (SELECT * FROM {quarters})", 1)

COMPANIES = """SELECT s_suppkey AS cik, s_name AS ticker, s_name AS name, CASE WHEN s_suppkey % 17 = 16 THEN NULL ELSE cast(100 + (s_suppkey * 397) % 9900 AS varchar(9)) END AS sic,
 concat('SIC ', s_suppkey % 20) AS sic_description, 'X' AS exchange, '1231' AS fiscal_year_end FROM {supplier}"""

_BARS = """SELECT s.s_name AS ticker, cast(l_shipdate AS date) AS date, l_extendedprice / 256.0 AS px, l_quantity AS qty, l_orderkey, l_linenumber, l_extendedprice FROM {lineitem} JOIN {supplier} AS s ON l_suppkey = s.s_suppkey"""
PRICES_SPARK = f"""SELECT ticker, date, min_by(px, struct(l_orderkey, l_linenumber, l_extendedprice)) AS open, max(px) AS high, min(px) AS low, max_by(px, struct(l_orderkey, l_linenumber, l_extendedprice)) AS close, sum(qty) AS volume FROM (SELECT /*+ REPARTITION(ticker) */ * FROM ({_BARS})) AS b GROUP BY ticker, date"""
PRICES_DUCK = f"""SELECT ticker, date, arg_min(px, struct_pack(a := l_orderkey, b := l_linenumber, c := l_extendedprice)) AS open, max(px) AS high, min(px) AS low, arg_max(px, struct_pack(a := l_orderkey, b := l_linenumber, c := l_extendedprice)) AS close, sum(qty) AS volume FROM ({_BARS}) AS b GROUP BY ticker, date"""

MEMBERS = """SELECT concat('i', m.k) AS index_slug, concat('Index ', m.k) AS index_name, s_name AS ticker FROM {supplier} JOIN (VALUES (3), (5), (7)) AS m(k) ON s_suppkey % m.k = 0"""
VINTAGES = " UNION ALL ".join(f"SELECT DATE '{y}-{d}' AS as_of" for y in range(1996, 2001) for d in ("03-31", "06-30", "09-30", "12-31"))
HEADLINES = """SELECT text AS headline, source, cast(doc_id AS varchar(20)) AS url, doc_id AS datetime FROM {documents}"""


class Inputs:
    """The engine's input tables over one scale-factor folder.

    Facts, prices and the tables that the engine stores (fundamentals, snapshots) are derived once for each
    application and folder, written to the shared folder and read from there, so that each job plans and prunes
    only its own part.
    """

    _kept: dict[tuple[str, str, str], tuple[str, StructType]] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def keep(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in self._kept:
            df = make()
            self._kept[key] = store(df, name), df.schema
        path, schema = self._kept[key]
        return self.spark.read.schema(schema).parquet(path)

    def _keep(self, name: str, text: str, *tables: str) -> DataFrame:
        return self.keep(name, lambda: self._sql(text, *tables))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, text: str, *tables: str) -> DataFrame:
        return self.spark.sql(text, **{t: self.table(t) for t in tables})

    @property
    def facts(self) -> DataFrame:
        def make() -> DataFrame:
            return self.spark.sql(FACTS_SPARK, quarters=self._keep("quarters", _V, "lineitem"))

        return self.keep("facts", make)

    @property
    def companies(self) -> DataFrame:
        return self._sql(COMPANIES, "supplier")

    @property
    def prices(self) -> DataFrame:
        return self._keep("prices", PRICES_SPARK, "lineitem", "supplier")

    @property
    def members(self) -> DataFrame:
        return self._sql(MEMBERS, "supplier")

    @property
    def headlines(self) -> DataFrame:
        return self._sql(HEADLINES, "documents")

    @property
    def vintages(self) -> DataFrame:
        return self.spark.sql(VINTAGES)
