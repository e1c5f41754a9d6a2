"""Running totals of array columns in time that grows with their length, as DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are gone through one by one before the totals of whole blocks are.
BLOCK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once however often ``use`` has it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _one_by_one(values: Column, start: Column, merge: Callable[[Column, Column], Column]) -> Column:
    none = F.struct(start.alias("at"), F.array().cast("array<int>").alias("before"))
    step = lambda done, x: F.struct(merge(done["at"], x).alias("at"), F.concat(done["before"], F.array(done["at"])).alias("before"))
    return F.aggregate(values, none, step, lambda done: done["before"])


def running(values: Column, merge: Callable[[Column, Column], Column], start: int = 0) -> Column:
    """For each of the ints ``values``, what ``merge`` (associative; ``start`` its neutral value) makes of those before it."""
    zero = F.lit(start)
    firsts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(firsts, lambda b: F.slice(values, b, F.lit(BLOCK)))

    def placed(b: Column) -> Column:
        heads = _one_by_one(F.transform(b, lambda x: F.aggregate(x, zero, merge)), zero, merge)
        return F.flatten(F.zip_with(b, heads, lambda x, head: _one_by_one(x, head, merge)))

    return let(blocks, placed)
