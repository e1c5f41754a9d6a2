"""Price series from stored weeks and months: a long range reads its own level, and days only at its ends.

A level has one row for each bucket of a ticker: how many bars it has, the first day, the last day and its close. Days
are the bars themselves. A bucket that an end of the window may cut is made again from its days, so the points are those
of :func:`series.price_series` over all bars.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import RANGES, adaptive_bucket, bucket_key, cutoff, flagged, price_series

LEVELS = ("week", "month")
ROW = ["ticker", "key", "n", "first", "date", "close"]


def rollup(prices: DataFrame, level: str) -> DataFrame:
    """``(ticker, key, n, first, date, close)`` of each day, week or month; a ticker's rows change only with its own bars."""
    begins = F.col("date") if level == "day" else F.trunc("date", level)  # grouped by a day, named once it is whole
    g = prices.where("close IS NOT NULL").groupBy("ticker", begins.alias("begins")).agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.max_by("close", "date").alias("close"))
    return g.select("ticker", bucket_key(F.col("first"), F.lit(level)).alias("key"), "n", "first", F.col("last").alias("date"), "close")


def _within(prices: DataFrame, levels: dict[str, DataFrame], level: str, range_name: str, today: str) -> DataFrame:
    """Rows of a level in the window of a range that ends today."""
    end = F.lit(today).cast("date")
    begin = cutoff(range_name, end)
    if begin is None:
        return levels[level].select(ROW) if level != "day" else rollup(prices, "day")
    days = prices.where(F.col("date").between(begin, end))
    if level == "day":
        return rollup(days, "day")
    ends = [bucket_key(x, F.lit(level)) for x in (begin, end)]
    inside = levels[level].where((F.col("first") >= begin) & (F.col("date") <= end) & ~F.col("key").isin(*ends))
    return inside.select(ROW).unionByName(rollup(days.where(bucket_key(F.col("date"), F.lit(level)).isin(*ends)), level))


def series_from_levels(prices: DataFrame, levels: dict[str, DataFrame], range_name: str, today: str) -> DataFrame:
    """The rows of :func:`series.price_series`; ``levels``: week and month of :func:`rollup`.

    Ranges that show days read the days of their window. Tickers with fewer than two bars in a window are looked at
    by all of theirs.
    """
    preferred = RANGES[range_name][1]
    if preferred == "day":
        return price_series(prices, range_name, today)
    whole = levels["month"].groupBy("ticker").agg(F.datediff(F.max("date"), F.min("first")).alias("full_span"))
    seen = _within(prices, levels, preferred, range_name, today).groupBy("ticker").agg(F.sum("n").alias("n"), F.datediff(F.max("date"), F.min("first")).alias("span"))
    if cutoff(range_name, F.lit(today)) is not None:
        seen = seen.where("n >= 2")
    chosen = seen.join(whole, "ticker").select("ticker", "span", "full_span", F.lit(False).alias("fell_back"), adaptive_bucket(F.col("span"), preferred).alias("bucket"))
    picks = ("day", "week", "month") if preferred == "month" else ("day", preferred)
    parts = [_within(prices, levels, level, range_name, today).join(chosen.where(F.col("bucket") == level), "ticker") for level in picks]
    shown = flagged(reduce(DataFrame.unionByName, parts), range_name, today)
    rest = whole.join(chosen, "ticker", "left_anti")
    return shown.unionByName(price_series(prices.join(rest, "ticker", "left_semi"), range_name, today))
