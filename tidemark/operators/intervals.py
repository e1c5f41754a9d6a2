"""Validity intervals: what is known holds from a day (``since``) to before another one (``until``).

A fact's version holds until the next one is filed. Every step of a point-in-time view keeps such intervals and cuts
them only where something it depends on changes, so its cost follows the filings; how many vintages are asked for
matters where intervals are read at them (:func:`at_vintages`), and nowhere before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: ``until`` of what still holds.
FOREVER = "9999-12-31"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once however often ``use`` has it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def versions(rows: DataFrame, keys: list[str], order: list[str], day: str = "filed") -> DataFrame:
    """``rows`` with the interval of each version of ``keys``, from its ``day`` to the next one's; of versions of one day the last holds."""
    following = Window.partitionBy(*keys).orderBy(day, *order)
    until = F.coalesce(F.lead(day).over(following), F.lit(FOREVER).cast("date"))
    return rows.withColumn("until", until).withColumn("since", F.col(day)).where("since < until")


def at_vintages(spans: DataFrame, vintages: DataFrame, since: str = "since", until: str | None = "until") -> DataFrame:
    """``spans`` once for each ``as_of`` from ``since`` to before ``until`` (none: for good).

    The vintages travel as one array in one row, so a span picks its own without a join on a range.
    """
    every = vintages.agg(F.sort_array(F.collect_set("as_of")).alias("vintages"))
    ends = F.lit(None).cast("date") if until is None else F.col(until)
    held = F.filter("vintages", lambda v: (v >= F.col(since)) & (ends.isNull() | (v < ends)))
    return spans.crossJoin(F.broadcast(every)).withColumn("as_of", F.explode(held)).drop("vintages")


def pieces(spans: Column, value: Callable[[Column], Column]) -> Column:
    """An array of intervals -> array of ``(since, until, v)`` between neighbouring ends of them; ``v``: ``value`` of the intervals that hold there."""
    ends = F.array_sort(F.array_distinct(F.concat(F.transform(spans, lambda s: s["since"]), F.transform(spans, lambda s: s["until"]))))
    n = F.greatest(F.size(ends) - 1, F.lit(0))
    hold = lambda a: F.filter(spans, lambda s: (s["since"] <= a) & (s["until"] > a))
    return F.zip_with(F.slice(ends, 1, n), F.slice(ends, 2, n), lambda a, b: F.struct(a.alias("since"), b.alias("until"), value(hold(a)).alias("v")))


def first_in_force(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """At each moment the first row of ``keys`` in ``order`` that holds: ``rows`` with intervals that no longer overlap within their keys."""
    rest = [c for c in rows.columns if c not in (*keys, "since", "until")]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    span = F.struct("since", "until", F.col("place"), F.struct(*rest).alias("row"))
    held = rows.withColumn("place", place).groupBy(*keys).agg(F.collect_list(span).alias("spans"))
    best = lambda spans: F.array_min(F.transform(spans, lambda s: F.struct(s["place"].alias("place"), s["row"].alias("row"))))["row"]
    alone = F.transform("spans", lambda s: F.struct(s["since"].alias("since"), s["until"].alias("until"), s["row"].alias("v")))
    out = held.withColumn("piece", F.explode(F.when(F.size("spans") == 1, alone).otherwise(pieces(F.col("spans"), best)))).where("piece.v IS NOT NULL")
    return out.select(*keys, "piece.v.*", "piece.since", "piece.until").select(*rows.columns)
