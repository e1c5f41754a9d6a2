"""Filter interaction audit: what each of several filters removes, in every order in which they could be applied.

What a document fails is a mask of one bit a filter. Documents of one part and mask are one cell, so the corpus becomes
at most 32 cells a part. Each cell is folded across the array of all orders, which travels as one broadcast row: an
``aggregate`` along an order knows whether the cell is gone yet and makes one weighted struct a step, and ``transform``
does that for each order. A part's arrays, one a cell, are then added element by element.

Copies: a text is known by its SHA-256. Rows of one text, part and label are counted together before they meet, with
the smallest doc_id among them, so a text that a third of all rows share is a few rows. A null text is an empty one. A
null doc_id is no smaller and no larger than any: its row is no copy and makes no other row one. Rows that repeat each
count. Of several label rows of a document, one that says 1 is enough; a document without one counts as 0. Other
columns never clash. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import need

WORD = r"[^\x20\x09-\x0D]+"
COPY = "E"
_WEIGHTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_filters() -> dict[str, Column]:
    """What makes a text fail, by a filter's letter, over ``text`` and its ``words``: few words, few distinct ones, capitals, symbols."""
    words = F.size("words")
    return {
        "A": words < 200,
        "B": 100 * F.size(F.array_distinct("words")) < 50 * words,
        "C": 100 * F.regexp_count("text", F.lit("[A-Z]")) > 2 * F.length("text"),
        "D": F.col("text").rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """``(doc_id, part, mask, digest)`` of every row; bit k of ``mask``: it fails the k-th filter."""
    d = need(docs, "doc_id", "text", "source").select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    mask = F.lit(0)
    for k, fails in enumerate(filters.values()):
        mask = mask + F.when(fails, 1 << k).otherwise(0)
    return d.select("doc_id", "part", mask.alias("mask"), F.sha2("text", 256).alias("digest"))


def cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """``(part, mask, n, good, toxic)``; the bit after those of ``filters`` says that a smaller doc_id has the same text."""
    one = lambda c: F.max((F.col(c) == 1).cast("int"))
    known = need(labels, "doc_id", "quality", "toxic").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    d = masks(docs, filters).join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    kind = ["digest", "part", "mask", "good", "toxic"]
    own = d.groupBy("doc_id", *kind).agg(F.count(F.lit(1)).alias("n"))
    there = F.col("doc_id").isNotNull()
    groups = own.groupBy(*kind).agg(F.sum("n").alias("n"), F.min("doc_id").alias("lo"), F.min_by(F.when(there, F.col("n")), "doc_id").alias("at_lo"), F.sum(F.when(~there, F.col("n")).otherwise(0)).alias("nameless"))
    first = F.min("lo").over(Window.partitionBy("digest"))
    fresh = F.col("nameless") + F.when(F.col("lo") == F.col("first"), F.col("at_lo")).otherwise(0)
    both = groups.withColumn("first", first).select("part", "mask", "good", "toxic", F.explode(F.array(
        F.struct(F.lit(0).alias("copy"), fresh.alias("n")), F.struct(F.lit(1 << len(filters)).alias("copy"), (F.col("n") - fresh).alias("n")))).alias("c"))
    n = F.col("c.n")
    return both.where(n > 0).groupBy("part", (F.col("mask") + F.col("c.copy")).alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def _along(order: Column) -> Column:
    """One weighted struct a step of ``order``, for the cell of the row."""
    bit = lambda k: F.call_function("shiftright", F.col("mask"), k) % 2 == 1
    weight = lambda when, by: F.when(when, F.col(by)).otherwise(F.lit(0)).cast("long")

    def step(done: Column, k: Column) -> Column:
        gone, fails = done["gone"], bit(k)
        here = fails & ~gone
        made = F.struct(weight(~gone & ~fails, "n").alias("kept"), weight(here, "n").alias("removed"), weight(fails & gone, "n").alias("redundant"),
                        weight(F.col("mask") == F.call_function("shiftleft", F.lit(1), k), "n").alias("unique_fails"), weight(here, "good").alias("good_lost"), weight(here, "toxic").alias("toxic_lost"))
        return F.struct((gone | fails).alias("gone"), F.concat(done["steps"], F.array(made)).alias("steps"))

    kind = "array<struct<" + ",".join(f"{w}:bigint" for w in _WEIGHTS) + ">>"
    return F.aggregate(order, F.struct(F.lit(False).alias("gone"), F.array().cast(kind).alias("steps")), step, lambda done: done["steps"])


def fold(found: DataFrame, letters: str) -> DataFrame:
    """:func:`cells` -> one row a part, order and step, with the six counts and the step's filter summed over all orders."""
    orders = list(permutations(range(len(letters))))
    names = F.array(*[F.lit("".join(letters[k] for k in o)) for o in orders])
    table = found.sparkSession.range(1).select(F.array(*[F.array(*[F.lit(k) for k in o]) for o in orders]).alias("orders"), names.alias("names"))
    # the orders in one row: their number depends on the filters alone
    folded = found.crossJoin(F.broadcast(table.select("orders"))).select("part", F.flatten(F.transform("orders", _along)).alias("steps"))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: F.struct(*[(x[w] + y[w]).alias(w) for w in _WEIGHTS]))
    per = folded.groupBy("part").agg(F.collect_list("steps").alias("all"))  # a part has at most one array a mask
    per = per.select("part", F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.element_at("all", 1), add).alias("steps")).crossJoin(F.broadcast(table))
    filters = F.flatten("orders")
    per = per.withColumn("shapley", F.transform(F.sequence(F.lit(0), F.lit(len(letters) - 1)), lambda f: F.aggregate(F.zip_with("steps", filters, lambda s, k: F.when(k == f, s["removed"]).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)))
    rows = per.select("part", "names", "shapley", filters.alias("filters"), F.posexplode("steps").alias("at", "step_counts"))
    return rows.select("part", F.element_at("names", F.floor(F.col("at") / len(letters)).cast("int") + 1).alias("filter_order"), (F.col("at") % len(letters) + 1).cast("int").alias("step"),
                       *[F.col(f"step_counts.{w}").alias(w) for w in _WEIGHTS], F.element_at("shapley", F.element_at("filters", F.col("at") + 1) + 1).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None) -> DataFrame:
    """The audit of ``filters`` (a letter each; :func:`text_filters` by default) and of COPY behind them.

    ``docs``: doc_id, text, source; ``labels``: doc_id, quality, toxic. Five and COPY make 720 orders; more are refused.
    """
    filters = text_filters() if filters is None else filters
    if len(filters) > 5 or any(len(k) != 1 or k == COPY for k in filters):
        raise ValueError(f"at most five filters of one letter each, other than {COPY}")
    return fold(cells(docs, labels, filters), "".join(filters) + COPY)
