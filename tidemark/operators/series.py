"""Price series: windows, honest buckets, summaries, intraday sessions and quote overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Days of each range (None: all) and the bucket it prefers; spans that keep denser buckets.
RANGES = {"5d": (10, "day"), "1m": (31, "day"), "6m": (183, "day"), "ytd": (366, "day"), "1y": (366, "day"), "5y": (1827, "week"), "max": (None, "month")}
DAY_SPAN, WEEK_SPAN = 400, 1400


def bucket_key(date: Column, bucket: Column) -> Column:
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), date).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))
    return F.when(bucket == "day", date.cast("string")).when(bucket == "week", week).otherwise(F.date_format(date, "yyyy-MM"))


def adaptive_bucket(span: Column, preferred: str = "month") -> Column:
    """Daily up to 13 months; never monthly up to 4 years; else the preferred bucket."""
    return F.when(span <= DAY_SPAN, "day").when((span <= WEEK_SPAN) & F.lit(preferred == "month"), "week").otherwise(preferred)


def downsample(prices: DataFrame, bucket: Column) -> DataFrame:
    """The last close of each bucket, on its own date."""
    p = prices.where("close IS NOT NULL").withColumn("bucket", bucket_key(F.col("date"), bucket))
    return p.groupBy("ticker", "bucket").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))


def full_span(prices: DataFrame) -> DataFrame:
    return prices.where("close IS NOT NULL").groupBy("ticker").agg(F.datediff(F.max("date"), F.min("date")).alias("span_days"))


def series_meta(points: DataFrame) -> DataFrame:
    g = points.where("close IS NOT NULL").groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.min_by("close", "date").alias("first_close"),
        F.max_by("close", "date").alias("last_close"), F.min("close").alias("low"), F.max("close").alias("high"))
    return g.withColumn("change", F.col("last_close") - F.col("first_close")).withColumn("pct", F.try_divide("last_close", "first_close") * 100 - 100).withColumn("span_days", F.datediff("last_date", "first_date"))


def last_n_bars(prices: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy(F.desc("date"))
    return prices.where("close IS NOT NULL").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def cutoff(range_name: str, anchor: Column) -> Column | None:
    """The first day of a range that ends at ``anchor``; a year to date begins with the last close of the year before."""
    days = RANGES[range_name][0]
    if days is None:
        return None
    return F.make_date(F.year(anchor) - 1, F.lit(12), F.lit(31)) if range_name == "ytd" else F.date_sub(anchor, days)


def _windowed(prices: DataFrame, range_name: str, today: str) -> DataFrame:
    """Every ticker's bars of a range, with ``first``, ``last``, ``span`` of them, ``full_span`` of its history and ``fell_back``.

    The window up to today; if that has fewer than two bars, the same one up to the ticker's own last bar; if that
    has too, the whole history. Five days are the last five bars.
    """
    p = prices.where("close IS NOT NULL").select("ticker", "date", "close")
    end = F.lit(today).cast("date")
    whole = p.groupBy("ticker").agg(F.min("date").alias("oldest"), F.max("date").alias("newest"))
    begin, own = cutoff(range_name, end), cutoff(range_name, F.col("newest"))
    r = p.join(whole, "ticker").withColumn("own", own if own is not None else F.col("oldest"))
    in_window = F.col("date").between(begin, end) if begin is not None else F.lit(True)
    stale = (F.col("newest") < end) & (F.col("date") >= F.col("own"))
    every = Window.partitionBy("ticker")
    r = r.withColumn("n_window", F.count_if(in_window).over(every)).withColumn("n_own", F.count_if(stale).over(every))
    fell_back = (F.col("n_window") < 2) & (F.col("n_own") < 2) if begin is not None else F.lit(False)
    chosen = r.withColumn("fell_back", fell_back).where(F.when(F.col("fell_back"), True).when(F.col("n_window") >= 2, in_window).otherwise(stale) if begin is not None else F.lit(True))
    if range_name == "5d":
        chosen = chosen.withColumn("rn", F.row_number().over(every.orderBy(F.desc("date")))).where("fell_back OR rn <= 5").drop("rn")
    span = F.datediff(F.max("date").over(every), F.min("date").over(every))
    return chosen.withColumn("span", span).withColumn("full_span", F.datediff("newest", "oldest")).select("ticker", "date", "close", "span", "full_span", "fell_back")


def price_series(prices: DataFrame, range_name: str, today: str) -> DataFrame:
    """Every ticker's points of a range: the last close of each bucket that suits the span, with what is true of the whole series.

    ``fell_back``: all of the history is shown as there is too little for the range. ``partial``: less than 85 % of
    what the range asks for is covered, or all of it is shown for want of more.
    """
    preferred = RANGES[range_name][1]
    rows = _windowed(prices, range_name, today).withColumn("bucket", adaptive_bucket(F.col("span"), preferred))
    points = rows.groupBy("ticker", "bucket", "span", "full_span", "fell_back", bucket_key(F.col("date"), F.col("bucket")).alias("key")).agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))
    return flagged(points, range_name, today)


def flagged(points: DataFrame, range_name: str, today: str) -> DataFrame:
    """Points with the flags and spans of their series; ``span`` and ``full_span`` in days."""
    end = F.lit(today).cast("date")
    begin = cutoff(range_name, end)
    short = (F.col("span") > 0) & (F.col("span") < F.datediff(end, begin) * 0.85) if begin is not None and range_name != "5d" else F.lit(False)
    partial = F.col("fell_back") | short | (F.lit(range_name == "max") & (F.col("full_span") < WEEK_SPAN))
    return points.select("ticker", "date", "close", "bucket", "fell_back", partial.alias("partial"), F.col("span").alias("span_days"), F.col("full_span").alias("full_span_days"))


def price_series_meta(points: DataFrame) -> DataFrame:
    """One row a ticker of :func:`price_series`: its flags and spans, figures of the points shown, and which ranges its history can fill."""
    of_series = ["bucket", "fell_back", "partial", "span_days", "full_span_days"]
    flags = points.groupBy("ticker").agg(*[F.first(c).alias(c) for c in of_series])
    full = F.col("full_span_days")
    ranges = [(full >= 45).alias("has_6m"), (full >= 90).alias("has_1y"), (full >= DAY_SPAN).alias("has_5y")]
    return series_meta(points.select("ticker", "date", "close")).drop("span_days").join(flags, "ticker").select("ticker", "n", "first_date", "last_date", "first_close", "last_close", "low", "high", "change", "pct", *of_series, *ranges)


def normalize_intraday(bars: DataFrame, zone: str = "America/New_York") -> DataFrame:
    local = F.from_utc_timestamp("ts", zone)
    return bars.where(F.col("close").isNotNull() & ~F.isnan("close")).select("ticker", F.date_format(local, "yyyy-MM-dd HH:mm").alias("minute"), F.to_date(local).alias("session"), "close")


def intraday_series(bars: DataFrame, prices: DataFrame) -> DataFrame:
    """Change of each ticker's session from the last close before it; tickers with fewer than two points give no row."""
    g = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.min("session").alias("first_session"), F.max_by("close", F.struct("minute", "close")).alias("last")).where("n >= 2")
    before = g.join(prices.where("close IS NOT NULL").select("ticker", "date", F.col("close").alias("base")), "ticker").where("date < first_session")
    base = before.groupBy("ticker").agg(F.max_by("base", "date").alias("base"))
    return g.join(base, "ticker", "left").select("ticker", "n", "first_session", "last", "base", (F.try_divide("last", "base") * 100 - 100).alias("pct"))


def quotes(symbols: DataFrame, delayed: DataFrame, prices: DataFrame) -> DataFrame:
    """A delayed quote where there is one (zero counts as none), else the last close, and which of the two it is."""
    last = prices.where("close IS NOT NULL").groupBy("ticker").agg(F.max_by("close", "date").alias("last_close"), F.max("date").alias("date"))
    d = delayed.select("ticker", F.nullif("price", F.lit(0.0)).alias("quote"), F.col("as_of").alias("quote_date"))
    j = symbols.select("ticker").distinct().join(last, "ticker", "left").join(d, "ticker", "left")
    source = F.when(F.col("quote").isNotNull(), "delayed").when(F.col("last_close").isNotNull(), "close")
    return j.select("ticker", F.coalesce("quote", "last_close").alias("price"), F.when(F.col("quote").isNotNull(), F.col("quote_date")).otherwise(F.col("date")).alias("as_of"), source.alias("source"))


def apply_quote(points: DataFrame, quoted: DataFrame) -> DataFrame:
    """Series whose tip is the delayed quote: it replaces a bar of its date or follows the last one; an older one is ignored."""
    last = points.groupBy("ticker").agg(F.max("date").alias("last"))
    tip = quoted.where("source = 'delayed'").join(last, "ticker").where("as_of >= last").select("ticker", F.col("as_of").alias("date"), F.col("price").alias("close"), F.lit(1).alias("prio"))
    both = points.select("ticker", "date", "close", F.lit(0).alias("prio")).unionByName(tip)
    w = Window.partitionBy("ticker", "date").orderBy(F.desc("prio"))
    return both.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("ticker", "date", "close")
