"""Fundamentals and snapshots as they could have been made on any past day, by validity intervals.

The steps are those of :mod:`fundamentals`, each on rows with ``since`` and ``until``: a restated value, a preferred tag
that appears later, a period that a later seen one replaces, a quarter that can be derived once its parts are there. No
step knows the vintages; trailing figures, newest balances and growth become intervals too, and only those are read at
them. Facts are dealt by company once, and every window and grouping starts from there.

No split adjustment and no fourth-quarter EPS: those look at filings that came later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fundamentals import COLUMNS, FACT, by_company, classify, precedence, stage
from .intervals import at_vintages, first_in_force, let, pieces, versions
from .snapshot import GROWTH, INSTANTS, TTM_METRICS, growth_of, price_asof, ratio_columns, trailing


def resolved_spans(facts: DataFrame, concept_map: DataFrame) -> DataFrame:
    """Per period and metric, the value of the first tag in force, with the period's filing days, first filing, and type."""
    period = Window.partitionBy("cik", "period_start", "period_end")
    seen = facts.withColumn("first", F.min(F.struct("filed", "accn")).over(period)).withColumn("days", F.sort_array(F.collect_set("filed").over(period)))
    known = versions(seen, FACT, ["accn", "taxonomy"])
    rows = known.join(F.broadcast(concept_map.select("metric", "unit", "concept", "priority")), ["unit", "concept"])
    rows = rows.select("cik", "period_start", "period_end", "metric", "unit", "val", F.col("concept").alias("source_concept"), F.col("first.filed").alias("first_filed"), F.col("first.accn").alias("first_accn"), "days", "priority", "since", "until")
    best = first_in_force(rows, ["cik", "period_start", "period_end", "metric", "unit"], ["priority"]).drop("priority")
    return classify(best).withColumn("derived", F.lit(0))


def replaced_periods(rows: DataFrame) -> DataFrame:
    """Of two periods with one start and type the earlier seen one holds only until the later seen one comes."""
    own = F.struct("first_filed", "first_accn", "period_end")
    entry = F.min("since").over(Window.partitionBy("cik", "period_start", "period_type", "period_end"))
    rivals = F.collect_set(F.struct(own.alias("seen"), F.col("entry"))).over(Window.partitionBy("cik", "period_start", "period_type"))
    out = rows.withColumn("entry", entry).withColumn("rivals", F.when(F.col("period_type") != "INSTANT", rivals))
    cut = F.array_min(F.transform(F.filter("rivals", lambda r: r["seen"] > own), lambda r: r["entry"]))
    return out.withColumn("until", F.least("until", cut)).drop("entry", "rivals").where("since < until")


def _with_more(rows: DataFrame, more: Column, keep: Column) -> DataFrame:
    """``rows`` that are kept, and beside them a derived quarter for each ``(since, until, v)`` of ``more``."""
    own = F.struct(*[F.col(c) for c in rows.columns])
    made = lambda m: {"since": m["since"], "until": m["until"], "val": m["v"], "period_type": F.lit("Q"), "derived": F.lit(1)}
    new = F.transform(F.filter(F.coalesce(more, F.array().cast("array<struct<since:date,until:date,v:double>>")), lambda m: m["v"].isNotNull()), lambda m: F.struct(*[made(m).get(c, F.col(c)).alias(c) for c in rows.columns]))
    return rows.select(F.explode(F.concat(F.when(keep, F.array(own)).otherwise(F.filter(F.array(own), lambda _: F.lit(False))), new)).alias("r")).select("r.*")


def ytd_spans(rows: DataFrame) -> DataFrame:
    """Quarters from year-to-date figures, while both a stage and the one before it hold; dollars only."""
    columns = rows.columns
    other = F.when(F.col("stage") > 0, F.struct("stage", "since", "until", "val"))
    out = rows.withColumn("stage", F.when(F.col("unit") == "USD", stage())).withColumn("others", F.collect_list(other).over(Window.partitionBy("cik", "metric", "period_start")))
    before = F.filter("others", lambda o: (o["stage"] == F.col("stage") - 1) & (o["since"] < F.col("until")) & (o["until"] > F.col("since")))
    less = F.transform(before, lambda o: F.struct(F.greatest(o["since"], F.col("since")).alias("since"), F.least(o["until"], F.col("until")).alias("until"), (F.col("val") - o["val"]).alias("v")))
    return _with_more(out.withColumn("more", less), F.col("more"), F.col("period_type").isin("Q", "FY", "INSTANT")).select(*columns)


def q4_spans(rows: DataFrame) -> DataFrame:
    """Fourth quarters: the year less exactly three quarters inside it, while no quarter ends with the year; dollars only."""
    columns = rows.columns
    quarter = F.when((F.col("period_type") == "Q") & (F.col("unit") == "USD"), F.struct("since", "until", F.col("period_end").alias("at"), F.col("val").alias("v")))
    out = rows.withColumn("quarters", F.collect_list(quarter).over(Window.partitionBy("cik", "metric")))
    year = (F.col("period_type") == "FY") & (F.col("unit") == "USD")
    clip = lambda q: F.struct(F.greatest(q["since"], F.col("since")).alias("since"), F.least(q["until"], F.col("until")).alias("until"), q["at"].alias("at"), q["v"].alias("v"))
    near = F.transform(F.filter("quarters", lambda q: q["at"].between(F.col("period_start"), F.col("period_end")) & (q["since"] < F.col("until")) & (q["until"] > F.col("since"))), clip)
    out = out.withColumn("near", F.when(year, near))

    def rest(held: Column) -> Column:
        own = F.filter(held, lambda q: q["v"].isNotNull())
        total = F.aggregate(own, F.lit(0.0), lambda a, q: a + q["v"])
        return F.when((F.size(own) == 3) & ~F.exists(held, lambda q: q["at"] == F.col("period_end")), F.col("val") - total)

    return _with_more(out.withColumn("more", pieces(F.col("near"), rest)), F.col("more"), F.lit(True)).select(*columns)


def fundamentals_spans(facts: DataFrame, concept_map: DataFrame) -> DataFrame:
    """Canonical rows with the interval in which each was known; at any day one row a metric, period end and type."""
    rows = ytd_spans(replaced_periods(resolved_spans(by_company(facts), concept_map)))
    return q4_spans(first_in_force(rows, ["cik", "metric", "period_end", "period_type"], precedence()))


def fundamentals_asof(facts: DataFrame, concept_map: DataFrame, vintages: DataFrame) -> DataFrame:
    """``(as_of, cik, ...)``: canonical rows as known on each ``as_of``; ``filed``: the newest filing of the period by then."""
    known = at_vintages(fundamentals_spans(facts, concept_map), vintages)
    filed = F.array_max(F.filter("days", lambda d: d <= F.col("as_of")))
    return known.withColumn("filed", filed).select("as_of", "cik", *COLUMNS)


def figure_spans(spans: DataFrame) -> DataFrame:
    """``(cik, metric, kind, since, until, v)``: the trailing (``t``), instant (``i``) and growth (``g``) figures of a company, by interval."""
    wanted = spans.where(F.col("metric").isin(*TTM_METRICS, *INSTANTS) & F.col("period_type").isin("Q", "FY", "INSTANT"))
    row = F.struct("since", "until", F.col("period_type").alias("kind"), F.col("period_end").alias("at"), F.col("val").alias("v"))
    held = wanted.groupBy("cik", "metric").agg(F.collect_list(row).alias("rows"))

    def newest(rows: Column, kind: str, n: int) -> Column:
        """Values of the n newest periods, newest first."""
        return F.slice(F.sort_array(F.transform(F.filter(rows, lambda r: r["kind"] == kind), lambda r: F.struct(r["at"].alias("at"), r["v"].alias("v"))), asc=False), 1, n)

    at = lambda rows, k: F.try_element_at(rows, F.lit(k))["v"]
    made = {
        "t": (TTM_METRICS, lambda rows: let(newest(rows, "Q", 4), lambda q: trailing(q, at(newest(rows, "FY", 1), 1)))),
        "i": (INSTANTS, lambda rows: at(newest(rows, "INSTANT", 1), 1)),
        "g": (GROWTH, lambda rows: let(newest(rows, "FY", 4), lambda y: growth_of(at(y, 1), at(y, 4), 3))),
    }

    def marked(kind: str, value) -> Column:
        return F.transform(pieces(F.col("rows"), value), lambda p: F.struct(F.lit(kind).alias("kind"), p["since"].alias("since"), p["until"].alias("until"), p["v"].alias("v")))

    parts = [F.when(F.col("metric").isin(*metrics), marked(kind, value)) for kind, (metrics, value) in made.items()]
    none = F.array().cast("array<struct<kind:string,since:date,until:date,v:double>>")
    return held.select("cik", "metric", F.explode(F.concat(*[F.coalesce(p, none) for p in parts])).alias("p")).select("cik", "metric", "p.*").where("v IS NOT NULL")


def filing_days(facts: DataFrame) -> DataFrame:
    """``(cik, filed, since, until)``: the newest filing of each company, by interval."""
    return versions(facts.select("cik", "filed").distinct(), ["cik"], [])


def snapshot_asof(facts: DataFrame, concept_map: DataFrame, companies: DataFrame, prices: DataFrame, vintages: DataFrame) -> DataFrame:
    """The snapshot as it could have been made on each ``as_of``, with the age of its data: one job for all vintages."""
    figures = at_vintages(figure_spans(fundamentals_spans(facts, concept_map)), vintages)
    pick = lambda kind, metric, name: F.max(F.when((F.col("kind") == kind) & (F.col("metric") == metric), F.col("v"))).alias(name)
    wide = figures.groupBy("as_of", "cik").agg(*[pick("t", m, f"t_{m}") for m in TTM_METRICS], *[pick("i", m, f"i_{m}") for m in INSTANTS], *[pick("g", m, f"g_{m}") for m in GROWTH])
    age = at_vintages(filing_days(facts), vintages).select("as_of", "cik", F.datediff("as_of", "filed").alias("data_age_days"))
    who = companies.select("cik", "ticker", "name", "sic_description", "exchange")
    base = age.join(who, "cik", "left").select("as_of", "cik", "ticker", "name", "sic_description", "exchange", "data_age_days")
    priced = base.join(price_asof(prices, vintages).drop("price_date"), ["as_of", "ticker"], "left")
    return ratio_columns(priced.join(wide, ["as_of", "cik"], "left"), base.columns)


def write_history(history: DataFrame, path: str) -> None:
    """One folder per vintage; vintages that are written again replace their own folder only."""
    history.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of").parquet(path)
