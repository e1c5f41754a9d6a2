"""Readers of landed source files, and planning of what to load next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUBMISSIONS = "cik string, tickers array<string>, exchanges array<string>, name string, sic string, sicDescription string, fiscalYearEnd string, filings struct<recent:struct<form:array<string>,accessionNumber:array<string>,filingDate:array<string>>>"
# Forms that carry statements.
PERIODIC = ("10-K", "10-K/A", "10-KT", "10-Q", "10-Q/A", "20-F", "40-F")
#: Window names of a price pull, by the days they reach back.
PULLS = (("1mo", 31), ("3mo", 92), ("6mo", 183), ("1y", 366), ("2y", 731), ("5y", 1827))


def company_meta(submissions: DataFrame) -> DataFrame:
    return submissions.select(F.expr("try_cast(cik AS BIGINT)").alias("cik"), F.upper(F.get("tickers", F.lit(0))).alias("ticker"), "name", "sic", F.col("sicDescription").alias("sic_description"), F.get("exchanges", F.lit(0)).alias("exchange"), F.col("fiscalYearEnd").alias("fiscal_year_end"))


def primary_ticker(listed: DataFrame) -> DataFrame:
    """The first listed ticker of each company (``ordinal``: its place in the listing)."""
    best = listed.groupBy("cik").agg(F.min_by(F.struct("ticker", "name"), "ordinal").alias("b"))
    return best.select("cik", F.upper(F.trim("b.ticker")).alias("ticker"), F.trim("b.name").alias("name"))


def read_price_csv(spark: SparkSession, path: str, ticker: str | None = None) -> DataFrame:
    """Daily bars of CSV files with any usual heading style; unreadable lines are dropped.

    ``ticker`` names the bars of files that have no ticker column.
    """
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.strip().lower().replace(" ", "_") for c in raw.columns])
    number = lambda c: F.expr(f"try_cast(CASE WHEN upper(trim(`{c}`)) IN ('', 'N/A', 'NULL') THEN NULL ELSE trim(`{c}`) END AS DOUBLE)") if c in raw.columns else F.lit(None).cast("double")
    close = F.coalesce(number("adjusted_close"), number("adj_close"), number("close"))
    who = F.upper(F.trim("ticker")) if ticker is None else F.lit(ticker.upper())
    d = raw.where(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    return d.select(who.alias("ticker"), F.expr("try_to_date(date, 'yyyy-MM-dd')").alias("date"), number("open").alias("open"), number("high").alias("high"), number("low").alias("low"), close.alias("close"), number("volume").alias("volume")).where("date IS NOT NULL AND close IS NOT NULL")


def normalize_bars(bars: DataFrame) -> DataFrame:
    return bars.where(F.col("close").isNotNull() & ~F.isnan("close")).select(F.upper("ticker").alias("ticker"), F.to_date("date").alias("date"), "open", "high", "low", "close", "volume")


def clean_headlines(h: DataFrame) -> DataFrame:
    when = F.timestamp_seconds(F.col("datetime").cast("bigint"))
    return h.where("headline IS NOT NULL AND headline <> '' AND url IS NOT NULL AND url <> ''").select("headline", "source", "url", when.alias("published"))


def read_index_members(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("index_slug string, index_name string, ticker string, as_of date").option("header", True).csv(path)


def last_written(rows: DataFrame, keys: list[str], order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Of rows of one key the last in ``order``, a column that goes. ``by``: columns that follow from the first key, to sort by first."""
    if not by:
        w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order))
        return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", order)
    # most keys come once: a row is looked at beside the one before it, not in a window of its own
    w = Window.partitionBy(*by, keys[0]).orderBy(*keys[1:], F.desc_nulls_last(order))
    again = F.row_number().over(w) > 1
    for k in keys[1:]:
        again = again & F.col(k).eqNullSafe(F.lag(k).over(w))
    return rows.withColumn("_again", again).where("NOT _again").drop("_again", order)


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Keyed upsert: an incoming row replaces the existing one of its key; of several, the last in ``order``, a column of ``incoming``.

    ``by``: columns of both that follow from the first key. Rows are dealt by the last of them alone, and sorted by them first.
    """
    new = incoming.withColumn("_order", F.struct(F.lit(1).alias("batch"), F.lit(0) if order is None else F.col(order)))
    old = existing.withColumn("_order", F.lit(None).cast(new.schema["_order"].dataType))
    both = old.unionByName(new if order is None else new.drop(order))
    return last_written(both.repartition(by[-1]) if by else both, keys, "_order", by)


def upsert_partial(existing: DataFrame, incoming: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Update ``columns`` of known keys, add unknown ones, keep everything else."""
    i = incoming.select(*[F.col(k) for k in keys], *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_there"))
    j = existing.join(i, keys, "full_outer")
    return j.select(*[F.when(F.col("_there"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in existing.columns])


def replace_keys(existing: DataFrame, incoming: DataFrame, keys: list[str], touched: DataFrame | None = None) -> DataFrame:
    """All rows of the touched keys give way to the incoming ones."""
    gone = (incoming if touched is None else touched).select(*keys).distinct()
    return existing.join(gone, keys, "left_anti").unionByName(incoming)


def export_screen(df: DataFrame, headings: dict[str, str], path: str, most: int = 5000) -> str:
    """Write the first rows of a screen, in its order, as one CSV file under display headings; returns ``path``.

    One task writes the file, of at most ``most`` rows.
    """
    df.select(*headings).limit(most).toDF(*headings.values()).coalesce(1).write.option("header", True).csv(path)
    return path


def ingest_targets(companies: DataFrame, log: DataFrame, refresh: bool = False) -> DataFrame:
    """Companies never loaded, or whose last load failed; with ``refresh`` all."""
    done = log.where("status IN ('ok', 'empty')").select("cik")
    return companies.select("cik", "ticker") if refresh else companies.select("cik", "ticker").join(done, "cik", "left_anti")


def due_companies(facts: DataFrame, checks: DataFrame, cutoff: str) -> DataFrame:
    j = facts.select("cik").distinct().join(checks, "cik", "left")
    return j.where(F.col("checked_at").isNull() | (F.col("checked_at") < F.lit(cutoff).cast("timestamp"))).select("cik")


def new_filings(submissions: DataFrame, facts: DataFrame) -> DataFrame:
    """Periodic filings on or after a company's newest one that are not held. ``submissions``: cik, forms, accessions, dates."""
    held = facts.groupBy("cik").agg(F.max("filed").alias("newest"))
    e = submissions.select("cik", F.explode(F.arrays_zip("forms", "accessions", "dates")).alias("f")).select("cik", "f.forms", "f.accessions", "f.dates")
    e = e.where(F.col("forms").isin(*PERIODIC)).join(held, "cik").where("dates >= newest")
    known = facts.select("cik", F.col("accn").alias("accessions")).distinct()
    return e.join(known, ["cik", "accessions"], "left_anti").select("cik", F.col("accessions").alias("accn"), F.col("forms").alias("form"), F.col("dates").alias("filed"))


def rebased_tickers(stored: DataFrame, incoming: DataFrame, tolerance: float = 0.002) -> DataFrame:
    """Tickers whose first bar that overlaps the store, of the first six incoming, has another close."""
    w = Window.partitionBy("ticker").orderBy("date")
    head = incoming.withColumn("rn", F.row_number().over(w)).where("rn <= 6").select("ticker", "date", F.col("close").alias("c"))
    known = stored.where("close IS NOT NULL AND close <> 0").select("ticker", "date", F.col("close").alias("s"))
    first = head.join(known, ["ticker", "date"]).groupBy("ticker").agg(F.min_by(F.struct("c", "s"), "date").alias("f"))
    return first.where(F.abs(F.col("f.c") / F.col("f.s") - 1) > tolerance).select("ticker")


def price_refresh_plan(companies: DataFrame, facts: DataFrame, prices: DataFrame, today: str) -> DataFrame:
    """Every company with facts: whether it has prices, and how far back to pull."""
    t = companies.where("ticker IS NOT NULL").join(facts.select("cik").distinct(), "cik", "left_semi").select("ticker").distinct()
    have = prices.select("ticker", F.lit(True).alias("known")).distinct()
    newest = prices.agg(F.max("date").alias("newest"))
    need = F.greatest(F.datediff(F.lit(today).cast("date"), F.col("newest")), F.lit(0)) + 10
    pull = F.when(F.col("known").isNull(), "max")
    for name, reach in PULLS:
        pull = pull.when(need <= reach, name)
    return t.join(have, "ticker", "left").crossJoin(F.broadcast(newest)).select("ticker", F.coalesce("known", F.lit(False)).alias("priced"), pull.otherwise("max").alias("pull"))


def summary_counts(tables: dict[str, DataFrame], distinct: dict[str, tuple[str, str]]) -> DataFrame:
    parts = [df.agg(F.lit(name).alias("item"), F.count(F.lit(1)).alias("n")) for name, df in tables.items()]
    parts += [tables[t].agg(F.lit(name).alias("item"), F.countDistinct(c).alias("n")) for name, (t, c) in distinct.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
