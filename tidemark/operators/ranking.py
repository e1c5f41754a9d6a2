"""Positions and neighbours in sorted order without one task that sorts all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that the values of a key are cut into, and how fine the sketch is that cuts them: a range is off by a few hundredths.
PARTS, ACCURACY = 64, 4096
#: Rows of a block of neighbours.
BLOCK = 4096


def in_parts(rows: DataFrame, value: str, keys: list[str], parts: int = PARTS) -> DataFrame:
    """``rows`` with ``part``: ranges of ``value`` that hold about as many rows of a key each, whatever its distribution.

    A quantile sketch of each key says where to cut, in one row a key.
    """
    at = [(i + 1) / parts for i in range(parts - 1)]
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(value, F.array(*[F.lit(x) for x in at]), F.lit(ACCURACY)).alias("_cuts"))
    held = rows.join(cuts, keys) if keys else rows.crossJoin(F.broadcast(cuts))
    return held.withColumn("part", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")


def positions(counts: DataFrame, value: str, keys: list[str] | None = None, parts: int = PARTS) -> DataFrame:
    """``(keys, value, n)``, one row per distinct value -> those and ``start``: how many rows of the keys are smaller.

    Values are counted exactly within their range; what lies below a range is a total of at most ``parts`` rows a key.
    """
    keys = keys or []
    cut = in_parts(counts, value, keys, parts)
    inner = Window.partitionBy(*keys, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("inside", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    below = Window.partitionBy(*keys or [F.lit(0)]).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "part").agg(F.sum("n").alias("total"))
    below = totals.select(*keys, "part", F.coalesce(F.sum("total").over(below), F.lit(0)).alias("below"))
    return cut.join(below, [*keys, "part"]).withColumn("start", F.col("inside") + F.col("below")).select(*counts.columns, "start")


def neighbours(rows: DataFrame, at: str, keys: list[str], column: str, k: int, block: int = BLOCK) -> DataFrame:
    """``rows``, numbered ``at`` = 0, 1, ... within their keys, with ``column`` as an array of its values in the k rows either way and the row itself.

    Rows go to blocks by their number; the first and last k of a block are its neighbours' guests as well, so every
    window is whole within one block, and a key of any size is spread over as many tasks as it has blocks.
    """
    block = max(block, k)
    own, place = F.floor(F.col(at) / block).cast("long"), F.col(at) % block
    homes = F.array_compact(F.array(own, F.when((place < k) & (own > 0), own - 1), F.when(place >= block - k, own + 1)))
    dealt = rows.withColumn("_own", own).withColumn("_home", F.explode(homes))
    around = Window.partitionBy(*keys, "_home").orderBy(at).rowsBetween(-k, k)
    return dealt.withColumn(column, F.collect_list(column).over(around)).where("_home = _own").drop("_home", "_own")
