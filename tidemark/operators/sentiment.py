"""The market gauge: momentum, strength and breadth over all priced companies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import clamp, zone

LOOKBACK, LEAST_CLOSES, NEAR, LEAST_TICKERS = 125, 10, 0.05, 5


def ticker_figures(prices: DataFrame) -> DataFrame:
    """What the gauge needs of each ticker, from one sort of its bars; a ticker's row changes only with its own bars.

    Closes known ``n``, highest and lowest, the last one with the one before it, its day and volume, the mean of the
    last LOOKBACK, and the ``newest`` day with any bar.
    """
    w = Window.partitionBy("ticker").orderBy(F.col("close").isNull(), F.desc("date"))
    r = prices.select("ticker", "date", "close", "volume").withColumn("rn", F.row_number().over(w)).withColumn("prev", F.lead("close").over(w))
    known, last = F.col("close").isNotNull(), (F.col("rn") == 1) & F.col("close").isNotNull()
    at_last = lambda c: F.max(F.when(last, F.col(c)))
    return r.groupBy("ticker").agg(
        F.count("close").alias("n"), F.max("close").alias("hi"), F.min("close").alias("lo"), at_last("close").alias("last"), at_last("date").alias("last_date"), at_last("prev").alias("prev"),
        at_last("volume").alias("volume"), F.avg(F.when(known & (F.col("rn") <= LOOKBACK), F.col("close"))).alias("mean"), F.max("date").alias("newest"))


def momentum_of(t: DataFrame) -> DataFrame:
    g = t.where((F.col("n") >= LEAST_CLOSES) & (F.col("mean") != 0)).agg(F.avg(F.col("last") / F.col("mean")).alias("ratio"), F.count(F.lit(1)).alias("tickers"))
    return g.select(F.round(clamp(50 + (F.col("ratio") - 1) * 500), 6).alias("score"), "tickers")


def strength_of(t: DataFrame) -> DataFrame:
    near_high = (F.col("hi") != 0) & (F.col("last") >= F.col("hi") * (1 - NEAR))
    near_low = (F.col("lo") != 0) & (F.col("last") <= F.col("lo") * (1 + NEAR))
    g = t.where(F.col("n") >= LEAST_CLOSES).agg(F.count_if(near_high).alias("near_high"), F.count_if(near_low).alias("near_low"), F.count(F.lit(1)).alias("tickers"))
    return g.select(F.round(clamp(50 + F.try_divide(F.col("near_high") - F.col("near_low"), F.col("tickers")) * 50), 6).alias("score"), "near_high", "near_low", "tickers")


def breadth_of(t: DataFrame) -> DataFrame:
    latest = t.agg(F.max("newest").alias("latest"))  # one row
    r = t.join(F.broadcast(latest), F.col("last_date") == F.col("latest")).where("prev IS NOT NULL AND volume > 0")
    up, down = F.col("last") > F.col("prev"), F.col("last") < F.col("prev")
    g = r.agg(F.sum(F.when(up, F.col("volume")).otherwise(0.0)).alias("adv"), F.sum(F.when(down, F.col("volume")).otherwise(0.0)).alias("decl"), F.count(F.lit(1)).alias("tickers"))
    ok = (F.col("tickers") >= LEAST_TICKERS) & (F.col("adv") + F.col("decl") > 0)
    return g.select(F.round(F.when(ok, clamp(50 + F.try_divide(F.col("adv") - F.col("decl"), F.col("adv") + F.col("decl")) * 50)), 6).alias("score"), F.coalesce("adv", F.lit(0.0)).alias("advancing"), F.coalesce("decl", F.lit(0.0)).alias("declining"), "tickers")


def momentum(prices: DataFrame) -> DataFrame:
    return momentum_of(ticker_figures(prices))


def strength(prices: DataFrame) -> DataFrame:
    return strength_of(ticker_figures(prices))


def breadth(prices: DataFrame) -> DataFrame:
    return breadth_of(ticker_figures(prices))


def reading(t: DataFrame, as_of: str) -> DataFrame:
    """One reading from :func:`ticker_figures`: the mean of the components there are; none below five priced tickers."""
    parts = momentum_of(t).select(F.col("score").alias("momentum"))
    parts = parts.crossJoin(strength_of(t).select(F.col("score").alias("strength"))).crossJoin(breadth_of(t).select(F.col("score").alias("breadth")))
    parts = parts.crossJoin(t.where("n > 0").agg(F.count(F.lit(1)).alias("priced")))
    known = F.array_compact(F.array("momentum", "strength", "breadth"))
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))
    score = F.when(F.col("priced") >= LEAST_TICKERS, F.round(mean, 1))
    return parts.select(F.lit(as_of).cast("date").alias("date"), score.alias("score"), zone(score).alias("zone"), "momentum", "strength", "breadth")


def sentiment(prices: DataFrame, as_of: str) -> DataFrame:
    return reading(ticker_figures(prices), as_of)


def sentiment_history(readings: DataFrame, n: int = 90) -> DataFrame:
    """The last n readings, oldest first."""
    return readings.orderBy(F.desc("date")).limit(n).withColumn("zone", zone(F.col("score"))).orderBy("date")
