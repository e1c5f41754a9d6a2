"""Mix sources to target weights by a low-discrepancy schedule of slots over equal-token blocks.

Each source's documents stand in a shuffled order (by a digest of id and text) as one stream of words, repeated as
often as its target asks and cut into blocks of BLOCK words. Golden-ratio points go through the cumulative shares of
the sources and give each slot of the mix its source; a slot's rank among the slots of its source is the block that it
takes. A source stops at its target, in the middle of its last block if need be, and the few slots that the points
leave a source short of follow at the end, so each source's words are its target, rounded to a whole word.

DataFrame functions only. Nothing of a source or of the corpus meets in one task: running totals and ranks are taken
in buckets, about as many as each holds rows, and only the buckets' totals are summed in order. A null source is a
source of its own, the last one. Texts that are null or have no words take part with size 0 and are never taken; rows
that repeat each count. Only ``doc_id``, ``text`` and ``source`` are read, so other columns never clash. An empty
table gives no rows.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, need

WEIGHTS = (5, 2, 1)
#: How often a source may be gone through.
MOST = 3
#: Words of a slot.
BLOCK = 1024
WORD = r"[^\x20\x09-\x0D]+"
#: The golden ratio's fraction, from two neighbouring Fibonacci numbers, and slots that share one multiple of it.
_GOLDEN = Fraction(1779979416004714189, 2880067194370816120)
_STRIDE = 1 << 16


def running(df: DataFrame, groups: list[str], bucket: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of its group before it, by bucket, then by ``order``; and ``<name>_row``, its number within its bucket."""
    totals = df.groupBy(*groups, bucket).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*groups or [F.lit(0)]).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, bucket, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    own = Window.partitionBy(*groups, bucket).orderBy(*order)
    inside = F.coalesce(F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = df.withColumn(name, inside).withColumn(f"{name}_row", F.row_number().over(own)).join(offsets, [*groups, bucket])
    return out.withColumn(name, (F.col(name) + F.col("_offset")).cast("long")).drop("_offset")


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, key)``: words of the whole text, and the place in the shuffled order; written once."""
    d = need(docs, "doc_id", "text", "source")
    size = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).cast("long")
    key = F.substring(F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "text"), 256), 1, 32)
    return materialize(d.select("doc_id", "source", size.alias("size"), key.alias("key")), "sized")


def targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, sid, source_size, rows, target, quota)`` of each source of a :func:`sized` table; written once.

    ``sid``: the place by code point, nulls last, which picks the weight. All words are shared by weight; what a
    share has above ``most`` times its source goes to the others by weight, until none is above. ``quota``: the
    target in whole words. Only totals over all sources reach the driver.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_name = F.col("source").asc_nulls_last()
    per = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    placed = materialize(per.repartitionByRange(parts, by_name).withColumn("part", F.spark_partition_id()), "sources")
    ranked = running(placed, [], "part", [by_name], F.lit(1), "sid").drop("sid_row")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    ranked = materialize(ranked, "sources")
    total, share, stopped = ranked.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        above = F.col("source_size") * most < F.col("weight") * F.lit(share)
        n, held, weight = ranked.agg(F.count_if(above), F.sum(F.when(above, F.col("source_size") * most)), F.sum(F.when(~above, F.col("weight")))).first()
        if n == stopped or not weight:
            break
        stopped, share = n, (total - (held or 0)) / weight
    target = F.least(F.col("weight") * F.lit(share), (F.col("source_size") * most).cast("double"))
    return materialize(ranked.withColumn("target", target).withColumn("quota", F.round("target").cast("long")), "targets")


def positions(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Each row's place in its source's shuffled stream: ``sid, bucket, start_row`` name a row, ``start`` is the words before it."""
    rows = sources.agg(F.sum("rows")).first()[0] or 0
    buckets = max(1, math.isqrt(rows))
    bucket = F.floor(F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * buckets / (1 << 28)).cast("long")
    s = sources.select(F.col("source").alias("_source"), "sid", "source_size", "target", "quota")
    placed = docs.join(s, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("bucket", bucket)
    return running(placed, ["sid"], "bucket", [F.col("key"), F.col("size")], F.col("size"), "start")


def pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """What the blocks hold of each row of :func:`positions`: ``block`` of its source, ``first`` and ``n`` words of the row, ``at`` in the block. A row of which nothing is taken stays, with nulls."""
    begin = lambda p: p * F.col("source_size") + F.col("start")
    last = F.greatest(F.ceil(F.col("quota") / F.nullif("source_size", F.lit(0))) - 1, F.lit(0))
    passes = F.filter(F.sequence(F.lit(0).cast("long"), last), lambda p: begin(p) < F.col("quota"))

    def cut(p: Column) -> Column:
        lo, hi = begin(p), F.least(begin(p) + F.col("size"), F.col("quota"))
        of = lambda b: F.greatest(lo, b * block)
        piece = lambda b: F.struct(b.alias("block"), (of(b) - lo).alias("first"), (F.least(hi, (b + 1) * block) - of(b)).alias("n"), (of(b) - b * block).alias("at"))
        return F.transform(F.sequence(F.floor(lo / block), F.floor((hi - 1) / block)), piece)

    taken = F.when(F.col("size") > 0, F.flatten(F.transform(passes, cut)))
    return placed.withColumn("piece", F.explode_outer(taken)).select("*", "piece.*").drop("piece")


def golden(i: Column) -> Column:
    """The fraction of ``i`` times the golden ratio, as near for the billionth slot as for the first."""
    high, low = F.floor(i / _STRIDE).cast("double"), (i % _STRIDE).cast("double")
    whole = float(_GOLDEN * _STRIDE % 1)
    x = high * whole
    x = x - F.floor(x) + low * float(_GOLDEN)
    return x - F.floor(x)


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(slot, sid, block)``: which block of which source each slot of the mix takes, in the order of ``slot``.

    A point meets its source by the cell of the cumulative shares that it falls into; there are at least as many
    cells as sources, so at most twice as many pairs are looked at as there are slots.
    """
    spark = sources.sparkSession
    s = sources.select("sid", "part", F.ceil(F.col("quota") / block).alias("blocks"))
    s = materialize(running(s, [], "part", [F.col("sid")], F.col("blocks"), "lo").drop("lo_row"), "shares")
    n, count = s.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.count(F.lit(1))).first()
    width = max(1, -(-n // max(count, 1)))
    cells = s.where("blocks > 0").select("sid", "lo", (F.col("lo") + F.col("blocks")).alias("hi"), "blocks")
    cells = cells.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    slots = spark.range(n).select(F.col("id").alias("slot"), F.least(F.floor(golden(F.col("id")) * n), F.lit(n - 1)).alias("x"))
    slots = slots.withColumn("cell", F.floor(F.col("x") / width))
    met = slots.join(cells, "cell").where("x >= lo AND x < hi").select("slot", "sid", "blocks", F.floor(F.col("slot") / max(1, math.isqrt(n))).alias("chunk"))
    ranked = running(met, ["sid"], "chunk", [F.col("slot")], F.lit(1), "block").where("block < blocks").select("slot", "sid", "block")
    ranked = materialize(ranked, "slots")
    have = ranked.groupBy("sid").agg(F.count(F.lit(1)).alias("have"))
    short = s.join(have, "sid", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < blocks")
    short = short.withColumn("block", F.explode(F.sequence("have", F.col("blocks") - 1)))
    return ranked.unionByName(short.select((F.col("lo") + F.col("block") + n).alias("slot"), "sid", "block"))


def mix_spans(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """The mix as spans, one row for each piece of a document in a slot, and one with a null slot for each row of which nothing is taken.

    ``doc_id, source, size, source_size, target, sid, bucket, start_row`` (the last three name a row), ``key``, and of
    the piece ``slot, at, first, n``: words ``first`` to ``first + n`` of the document, ``at`` words into the slot.
    """
    own = sized(docs)
    sources = targets(own, weights)
    return pieces(positions(own, sources), block).join(schedule(sources, block), ["sid", "block"], "left")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """``(slot, source, n_words, text)``: the mix itself, in slots of at most ``block`` words joined by a space; order by ``slot``."""
    spans = mix_spans(docs, weights, block).where("slot IS NOT NULL")
    d = need(docs, "doc_id", "text")
    texts = d.select(F.substring(F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "text"), 256), 1, 32).alias("key"), "text").dropDuplicates(["key"])
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("first") + 1).cast("int"), F.col("n").cast("int"))
    part = spans.join(texts, "key").select("slot", "source", F.struct("at", F.array_join(words, " ").alias("text")).alias("part"), "n")
    return part.groupBy("slot", "source").agg(F.sum("n").alias("n_words"), F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["text"]), " ").alias("text"))


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of every row: words that the mix takes of it, repeats counted."""
    spans = mix_spans(docs, weights, block)
    row = ["sid", "bucket", "start_row", "doc_id", "size", "source_size", "target"]
    taken = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("n"))), F.lit(0)).cast("long")
    return spans.groupBy(*row).agg(taken.alias("taken")).select("doc_id", "size", "source_size", "target", "taken")
