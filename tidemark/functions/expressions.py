"""Column expressions shared by the analytic jobs. A figure that cannot be stated honestly is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.concepts import MCAP_BANDS

# Period lengths in days.
PERIODS = (("Q", 80, 100), ("H", 170, 190), ("T9", 260, 290), ("FY", 340, 400))


def positive_div(a: Column, b: Column) -> Column:
    """a / b where b is above zero."""
    return F.when(b > 0, a / b)


def growth(now: Column, base: Column) -> Column:
    """Percent change on a base above zero."""
    return F.when(base > 0, (now / base - 1) * 100)


def period_type(start: Column, end: Column) -> Column:
    days = F.datediff(end, start)
    out = F.when(start.isNull(), "INSTANT")
    for name, lo, hi in PERIODS:
        out = out.when(days.between(lo, hi), name)
    return out


def mcap_band(cap: Column) -> Column:
    out = F.lit(None).cast("string")
    for slug, lo, hi in reversed(MCAP_BANDS):
        inside = cap.isNotNull()
        inside = inside & (cap >= lo) if lo is not None else inside
        inside = inside & (cap < hi) if hi is not None else inside
        out = F.when(inside, slug).otherwise(out)
    return out


def fiscal_quarter_label(end: Column, fiscal_year_end: Column) -> Column:
    """'Q1 2026': the quarter of the fiscal year that ends in the month of ``MMDD``; the calendar's without one."""
    last = F.coalesce(F.try_to_number(F.substring(F.nullif(fiscal_year_end, F.lit("")), 1, 2), F.lit("99")).cast("int"), F.lit(12))
    quarter = F.floor(F.pmod(F.month(end) - (last % 12 + 1), F.lit(12)) / 3) + 1
    year = F.year(end) + F.when(F.month(end) > last, 1).otherwise(0)
    return F.concat(F.lit("Q"), quarter.cast("string"), F.lit(" "), year.cast("string"))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def zone(score: Column) -> Column:
    return (F.when(score < 20, "extreme-fear").when(score < 40, "fear").when(score < 60, "neutral").when(score < 80, "greed").when(score.isNotNull(), "extreme-greed"))


def escape_like(term: str) -> str:
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
