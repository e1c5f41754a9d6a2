"""Which unpriced companies to price next: size, news and a little reproducible luck."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import positions

# Weights, words of names that say nothing, and words that name no single company alone.
SIZE, NEWS, LUCK = 0.55, 0.45, 0.30
NOISE = ["inc", "corp", "corporation", "co", "company", "ltd", "plc", "holdings", "group", "the", "of", "and", "de", "new", "class"]
GENERIC = ["first", "general", "american", "united", "national", "community", "capital", "southern", "northern", "western", "eastern", "central", "pacific", "atlantic", "international", "global", "financial", "bancorp", "bancshares", "bankshares", "bank", "energy", "industries", "systems", "technologies", "technology", "resources", "services", "partners", "trust", "federal", "republic", "peoples", "citizens", "farmers", "merchants", "mutual", "commerce", "premier", "independent", "world", "washington", "texas", "california", "china", "russia", "europe", "london", "america", "states"]


def significant_words(name: Column) -> Column:
    words = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))
    return F.filter(words, lambda w: ~F.lower(w).isin(*NOISE))


def common_first_words(companies: DataFrame, least: int = 3) -> DataFrame:
    w = companies.select(F.lower(F.get(significant_words(F.col("name")), F.lit(0))).alias("word")).where("word IS NOT NULL")
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("companies")).where(F.col("companies") >= least)


def size_percentile(df: DataFrame, key: str = "ticker", size: str = "size") -> DataFrame:
    """Rank share among known sizes (ties share it); unknown is 0; with at most one known size all are 0.5."""
    known = df.where(F.col(size).isNotNull())
    ranked = _percent_rank(known, key, size)
    n = known.agg(F.count(F.lit(1)).alias("known"))
    return df.select(key).join(ranked, key, "left").crossJoin(F.broadcast(n)).select(key, F.when(F.col("known") <= 1, 0.5).otherwise(F.coalesce("p", F.lit(0.0))).alias("percentile"))


def _percent_rank(known: DataFrame, key: str, size: str) -> DataFrame:
    counts = known.groupBy(size).agg(F.count(F.lit(1)).alias("n"))
    n = known.agg(F.count(F.lit(1)).alias("all"))
    ranks = positions(counts, size).crossJoin(F.broadcast(n)).select(size, (F.col("start") / F.greatest(F.col("all") - 1, F.lit(1))).alias("p"))
    return known.select(key, size).join(ranks, size).select(key, "p")


def _bounded(token: Column) -> Column:
    """A token's beginnings that end at a word boundary: BRK and BRK-B of BRK-B."""
    word = lambda i: F.substring(token, i, F.lit(1)).rlike(r"[A-Za-z0-9_]")
    ends = F.filter(F.sequence(F.lit(1), F.length(token)), lambda i: word(i) != word(i + 1))
    return F.transform(ends, lambda i: F.substring(token, F.lit(1), i))


#: Stands beside a token that is written as a ticker; no text has it as a word.
_MARK = "\u0001"


def news_mentions(companies: DataFrame, headlines: DataFrame, common: DataFrame) -> DataFrame:
    """Tickers that headlines name: written as a ticker, by the two first words of the name, or by a distinctive first word.

    Headlines are read once and cut into tokens with the next one beside each. Only tokens that begin a company's
    name, or are written as a ticker, go on; each of those pairs once says what it can mean, which meets what
    companies can be named by in one join on equality, never company by company.
    """
    key = lambda kind, said: F.concat(F.lit(kind), said)
    c = companies.select("ticker", significant_words(F.col("name")).alias("w")).select("ticker", F.get("w", F.lit(0)).alias("w0"), F.get("w", F.lit(1)).alias("w1"))
    lone = c.where((F.length("w0") >= 5) & ~F.lower("w0").isin(*GENERIC)).join(common.select("word"), F.lower("w0") == F.col("word"), "left_anti")
    names = c.select("ticker", key("t", F.col("ticker")).alias("said")).union(c.where("w1 IS NOT NULL").select("ticker", key("p", F.concat(F.lower("w0"), F.lit(" "), F.lower("w1")))))
    names = names.union(lone.select("ticker", F.explode(F.array(key("w", F.initcap(F.lower("w0"))), key("w", F.upper("w0"))))))
    text = F.coalesce("headline", F.lit(""))
    cut = headlines.select(F.regexp_extract_all(text, F.lit(r"(?:\$|\(|\b(?:NYSE|NASDAQ|NYSEARCA|AMEX)\s*:\s*)([A-Za-z0-9.#-]+)"), F.lit(1)).alias("marked"),
                           F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]+"), F.lit(0)).alias("words"))
    beside = F.concat(F.slice("words", 2, 1 << 30), F.slice(F.array(F.lit("")), 1, F.least(F.size("words"), F.lit(1))), F.array_repeat(F.lit(_MARK), F.size("marked")))
    cut = cut.select(F.concat("words", "marked").alias("x"), beside.alias("y"))
    tokens = cut.select(F.inline(F.arrays_zip("x", "y"))).withColumn("first", F.when(F.col("y") == _MARK, _MARK).otherwise(F.lower("x")))
    begins = c.where("w0 IS NOT NULL").select(F.lower("w0").alias("first")).union(c.sparkSession.range(1).select(F.lit(_MARK))).distinct()
    tokens = tokens.join(begins, "first", "left_semi").select("x", "y").distinct()
    means = F.when(F.col("y") == _MARK, F.transform(_bounded(F.col("x")), lambda t: key("t", t))).otherwise(F.array_compact(F.array(key("w", F.col("x")), key("p", F.concat(F.lower("x"), F.lit(" "), F.lower("y"))))))
    return tokens.select(F.explode(means).alias("said")).join(names, "said").select("ticker").distinct()


def pick_unpriced(snapshot: DataFrame, prices: DataFrame, mentions: DataFrame, n: int = 20, luck: float = LUCK, seed: int = 0) -> DataFrame:
    """The n unpriced companies with the best score, and why."""
    rows = snapshot.where("ticker IS NOT NULL").join(prices.select("ticker").distinct(), "ticker", "left_anti").where(~F.col("ticker").rlike("-P[A-Z]?$"))
    rows = rows.withColumn("size", F.nullif(F.greatest(F.coalesce("revenue_ttm", F.lit(0.0)), F.coalesce("total_assets", F.lit(0.0))), F.lit(0.0))).select("ticker", "name", "size")
    j = rows.join(size_percentile(rows), "ticker").join(mentions.select("ticker", F.lit(True).alias("news")), "ticker", "left")
    chance = F.pmod(F.xxhash64("ticker", F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    score = F.col("percentile") * SIZE + F.when(F.col("news"), NEWS).otherwise(0.0) + chance * luck
    reason = F.concat(F.lit("size p"), F.floor(F.col("percentile") * 100).cast("string"), F.when(F.col("news"), ", in the news").otherwise(""))
    return j.select("ticker", "name", score.alias("score"), reason.alias("reason")).orderBy(F.desc("score"), F.desc("ticker")).limit(n)
