"""From filed facts to canonical fundamentals: restatements, tag choice, derived quarters, splits.

Every function works on the whole market, keyed by ``cik``; :mod:`history` has the same steps for every past day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import period_type
from ..sources.concepts import EPS_TAGS

# Split ratios, and how near a restatement must come to one.
CLEAN_RATIOS = (2, 3, 4, 5, 6, 7, 8, 10, 15, 20, 25, 30, 40, 50)
TOLERANCE = 0.03
PER_SHARE, SHARE_COUNT = ("eps_basic", "eps_diluted"), ("shares_diluted", "shares_outstanding")
STAGES = ("Q", "H", "T9", "FY")
#: Facts that one task takes, about.
TASK_FACTS = 50_000
FACT = ["cik", "unit", "concept", "period_start", "period_end"]


def stage() -> Column:
    """The place of a row's type among STAGES, from 1; 0 elsewhere."""
    return F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("period_type")).cast("int")


def precedence() -> list[Column]:
    """Reported beats derived, then the later first sighting wins."""
    return [F.asc("derived"), F.desc("first_filed"), F.desc("first_accn"), F.desc_nulls_last("period_start")]


def by_company(facts: DataFrame) -> DataFrame:
    """Facts dealt by company to as many tasks as they need: windows and groups within companies shuffle no more, and a task's share doesn't grow with the table."""
    tasks = max(facts.sparkSession.sparkContext.defaultParallelism, -(-facts.count() // TASK_FACTS))
    return facts.repartition(tasks, "cik")


def latest_facts(facts: DataFrame, beside: tuple[str, ...] = ()) -> DataFrame:
    """The value in force of each fact, of all versions; ``beside``: columns that a period has once."""
    return facts.groupBy(*FACT).agg(F.max_by("val", F.struct("filed", "accn", "taxonomy")).alias("val"), *[F.first(c).alias(c) for c in beside])


def period_filed(facts: DataFrame) -> DataFrame:
    """Per period: the latest filing of any of its facts, and its first one (``first_filed``, ``first_accn``)."""
    period = ["cik", "period_start", "period_end"]
    out = facts.groupBy(*period).agg(F.max("filed").alias("filed"), F.min(F.struct("filed", "accn")).alias("first"))
    return out.select(*period, "filed", F.col("first.filed").alias("first_filed"), F.col("first.accn").alias("first_accn"))


def resolve_metrics(latest: DataFrame, concept_map: DataFrame, beside: tuple[str, ...] = ()) -> DataFrame:
    """Per period and metric the first tag, in order of preference, that has a value in the metric's unit; ``beside``: columns that a period has once."""
    joined = latest.join(F.broadcast(concept_map.select("metric", "unit", "concept", "priority")), ["unit", "concept"])
    best = joined.groupBy("cik", "period_start", "period_end", "metric", "unit").agg(F.min_by(F.struct("val", "concept"), "priority").alias("best"), *[F.first(c).alias(c) for c in beside])
    return best.select("cik", "period_start", "period_end", "metric", "unit", "best.val", F.col("best.concept").alias("source_concept"), *beside)


def classify(df: DataFrame) -> DataFrame:
    return df.withColumn("period_type", period_type(F.col("period_start"), F.col("period_end"))).where("period_type IS NOT NULL")


def dedupe(rows: DataFrame) -> DataFrame:
    """One row for each metric, period end and type, by :func:`precedence`."""
    w = Window.partitionBy("cik", "metric", "period_end", "period_type").orderBy(*precedence())
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def _with_derived(rows: DataFrame, val: Column, keep: Column) -> DataFrame:
    """``rows`` that are kept, and beside them a derived quarter where ``val`` is not NULL: one pass, no second read.

    Only what differs travels in the array; all other columns stay what they are to Spark, so rows dealt by company need not be dealt again.
    """
    made = {"val": val, "period_type": F.lit("Q"), "derived": F.lit(1)}
    out = rows.withColumn("_derived", val).withColumn("_keep", keep)
    made["val"] = F.col("_derived")
    own, new = F.struct(*[F.col(c) for c in made]), F.struct(*[v.alias(c) for c, v in made.items()])
    there = F.col("_derived").isNotNull()
    each = F.when(there & F.col("_keep"), F.array(own, new)).when(there, F.array(new)).when(F.col("_keep"), F.array(own))
    out = out.select(*[c for c in rows.columns if c not in made], F.explode(each).alias("_made"))
    return out.select(*[F.col(f"_made.{c}") if c in made else F.col(c) for c in rows.columns])


def diff_ytd(rows: DataFrame) -> DataFrame:
    """Rows of type Q, FY and INSTANT, and quarters from year-to-date figures: each stage less the one before it, dollars only."""
    columns = rows.columns
    w = Window.partitionBy("cik", "metric", "period_start").orderBy("stage", "period_end")
    out = rows.withColumn("stage", stage()).withColumn("prev", F.lag("val").over(w)).withColumn("step", F.col("stage") - F.lag("stage").over(w))
    val = F.when((F.col("unit") == "USD") & (F.col("stage") > 0) & (F.col("step") == 1), F.col("val") - F.col("prev"))
    return _with_derived(out, val, F.col("period_type").isin("Q", "FY", "INSTANT")).select(*columns)


def derive_q4(rows: DataFrame, per_share: bool = False) -> DataFrame:
    """``rows`` and fourth quarters: the year less exactly three quarters inside it, where no quarter ends with the year.

    Dollar metrics; with ``per_share`` earnings per share. A metric's quarters travel with its rows as an
    array, which is as long as the company has quarters on file.
    """
    columns = rows.columns
    wanted = F.col("metric").isin(*PER_SHARE) if per_share else F.col("unit") == "USD"
    of_metric = F.col("metric").isin(*PER_SHARE) if per_share else F.lit(True)  # arrays of metrics that nobody asks for stay empty
    quarter = F.when((F.col("period_type") == "Q") & of_metric, F.struct(F.col("period_end").alias("at"), F.col("val").alias("v")))
    out = rows.withColumn("quarters", F.collect_list(quarter).over(Window.partitionBy("cik", "metric")))
    own = F.filter("quarters", lambda q: q["at"].between(F.col("period_start"), F.col("period_end")) & q["v"].isNotNull())
    out = out.withColumn("own", F.when(wanted & (F.col("period_type") == "FY"), own))
    ends_with = F.exists("quarters", lambda q: q["at"] == F.col("period_end"))
    total = F.aggregate("own", F.lit(0.0), lambda a, q: a + q["v"])
    return _with_derived(out, F.when((F.size("own") == 3) & ~ends_with, F.col("val") - total), F.lit(True)).select(*columns)


def detect_splits(facts: DataFrame) -> DataFrame:
    """Stock splits from restated earnings per share: ``(cik, effective_filed, factor)``.

    Two filed versions of a period in a near-clean ratio are a vote; a filing's best-backed factor needs two
    periods; of each factor the earliest sighting stays.
    """
    eps = facts.where(F.col("concept").isin(*EPS_TAGS) & (F.col("unit") == "USD/shares"))
    w = Window.partitionBy("cik", "concept", "period_start", "period_end").orderBy("filed", "accn")
    pairs = eps.withColumn("old", F.lag("val").over(w)).where("old <> 0 AND val <> 0 AND sign(old) = sign(val)")
    pairs = pairs.withColumn("forward", F.abs("old") >= F.abs("val")).withColumn("m", F.greatest(F.abs(F.col("old") / F.col("val")), F.abs(F.col("val") / F.col("old"))))
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col("m") - r).alias("off"), F.lit(float(r)).alias("r")) for r in CLEAN_RATIOS]))
    pairs = pairs.withColumn("near", nearest).where(F.col("near.off") / F.col("near.r") <= TOLERANCE)
    factor = F.when(F.col("forward"), F.col("near.r")).otherwise(1 / F.col("near.r"))
    votes = pairs.groupBy("cik", "filed", factor.alias("factor")).agg(F.countDistinct(F.struct(F.coalesce("period_start", F.lit("0001-01-01").cast("date")), "period_end")).alias("n"))
    best = Window.partitionBy("cik", "filed").orderBy(F.desc("n"), "factor")
    won = votes.withColumn("rn", F.row_number().over(best)).where("rn = 1 AND n >= 2")
    return won.groupBy("cik", "factor").agg(F.min("filed").alias("effective_filed")).select("cik", "effective_filed", "factor")


def split_factor(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """``rows`` with ``split_factor``: the product of all splits that took effect after the row was filed."""
    per_company = splits.groupBy("cik").agg(F.collect_list(F.struct("effective_filed", "factor")).alias("splits"))
    later = F.filter(F.col("splits"), lambda s: s["effective_filed"] > F.col("filed"))
    factor = F.aggregate(later, F.lit(1.0), lambda p, s: p * s["factor"])
    return rows.join(per_company, "cik", "left").withColumn("split_factor", F.coalesce(factor, F.lit(1.0))).drop("splits")


def adjust_splits(rows: DataFrame, splits: DataFrame) -> DataFrame:
    out, f = split_factor(rows, splits), F.col("split_factor")
    val: Column = F.when(F.col("metric").isin(*PER_SHARE), F.col("val") / f).when(F.col("metric").isin(*SHARE_COUNT), F.col("val") * f).otherwise(F.col("val"))
    return out.withColumn("val", val).drop("split_factor")


def reported_rows(facts: DataFrame, concept_map: DataFrame) -> DataFrame:
    """Resolved, classified rows with their filing dates; of two periods with one start and type the later seen one."""
    period = Window.partitionBy("cik", "period_start", "period_end")
    dates = F.struct(F.max("filed").over(period).alias("filed"), F.min(F.struct("filed", "accn")).over(period).alias("first"))
    dated = by_company(facts).withColumn("dates", dates)
    resolved = classify(resolve_metrics(latest_facts(dated, ("dates",)), concept_map, ("dates",)))
    rows = resolved.select(*[c for c in resolved.columns if c != "dates"], "dates.filed", F.col("dates.first.filed").alias("first_filed"), F.col("dates.first.accn").alias("first_accn"))
    w = Window.partitionBy("cik", "period_start", "period_type")
    best = F.max(F.struct("first_filed", "first_accn", "period_end")).over(w)
    return rows.withColumn("best", best).where((F.col("period_type") == "INSTANT") | (F.col("best.period_end") == F.col("period_end"))).drop("best").withColumn("derived", F.lit(0))


COLUMNS = ["metric", "period_end", "period_type", "val", "source_concept", "derived", "filed"]


def fundamentals(facts: DataFrame, concept_map: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """Canonical rows by metric, period and type, of all that is filed. Split adjustment and fourth-quarter EPS with ``splits``."""
    known = derive_q4(dedupe(diff_ytd(reported_rows(facts, concept_map))))
    if splits is not None:
        known = derive_q4(adjust_splits(known, splits), per_share=True)
    return known.select("cik", *COLUMNS)
