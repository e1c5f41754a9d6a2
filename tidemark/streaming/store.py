"""Tables in buckets of their key and generations of a bucket, under one folder.

A batch writes a new generation of the buckets that it touches and nothing else, so a batch that was cut short is
simply run again: it reads the generations before its own. Generations before the one that a bucket had are deleted.

Buckets are the leaves of a trie over the low bits of the key's hash. A bucket that has grown beyond ``limit`` bytes is
written as two of one more bit in its next generation, so tasks stay of one size however large a table becomes. A split
counts once it is on record, which is after both halves are written; what it replaces is kept until the generation
after it. Each bucket costs the driver a listing and a value in an expression, so a large table's are not cut below a
share of it: it has some ``MOST`` of them, and a large one is written by several tasks.

What a batch leaves as it was is most of a bucket. Such rows are written from where they are read: a file's rows are of
one bucket, so they need no shuffle to get there. Only what the batch can have changed is shuffled, once, by place: a
bucket or a part of one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.filings import upsert_latest
from ..sources.stored import shuffles_dropped

BUCKETS, LIMIT = 64, 256 << 20
#: A bucket splits only if it holds more than this part of its table.
MOST = 64
#: Files of a bucket from which on all of its rows are shuffled, so that they come to lie in few files again.
MANY = 24
#: More keys than these are not given to all tasks at once.
SENT = 4_000_000
#: Bits of the hash that tell places of a bucket apart.
PLACES = 2
#: Bits of the hash that tell buckets apart at most; rows of one key cannot be told apart by any.
DEEPEST = 30


@dataclass
class Store:
    """``buckets``, a power of two, must stay what it was when the folder was first written; ``limit`` may change."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS
    limit: int = LIMIT

    def __post_init__(self) -> None:
        self.bits = self.buckets.bit_length() - 1
        if self.buckets != 1 << self.bits:
            raise ValueError("buckets must be a power of two")

    def empty(self, schema: StructType | str) -> DataFrame:
        """No rows: with a limit of none Spark plans nothing, while an empty list alone is read by Python workers."""
        return self.spark.createDataFrame([], schema).limit(0)

    def fs(self, *parts: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def names(self, *parts: str) -> list[str]:
        """What a folder holds; nothing if there is none."""
        fs, p = self.fs(*parts)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def delete(self, *parts: str) -> None:
        fs, p = self.fs(*parts)
        fs.delete(p, True)

    def note(self, *parts: str) -> None:
        """Put a name on record, as an empty folder: there or not there, never half."""
        fs, p = self.fs(*parts)
        fs.mkdirs(p)

    def has(self, table: str) -> bool:
        return bool(self._generations(table))

    def _generations(self, table: str) -> list[tuple[str, int]]:
        """(bucket, generation) folders, read from their names."""
        fs, p = self.fs(table, "bucket=*", "generation=*")
        found = (s.getPath().toString().split("/")[-2:] for s in fs.globStatus(p) or ())
        return [(b[7:], int(g[11:])) for b, g in found]

    def _splits(self, table: str, before: int | None) -> dict[str, int]:
        """Buckets that are split, by a generation below ``before``, and by which."""
        found = (n.split("@") for n in self.names(table, "_splits"))
        return {b: int(g) for b, g in found if before is None or int(g) < before}

    def next_generation(self, table: str) -> int:
        return max((g for _, g in self._generations(table)), default=-1) + 1

    def _bucket(self, key: str, split: set[str]) -> Column:
        h = F.xxhash64(key)
        place = lambda d: F.pmod(h, F.lit(1 << d))
        deepest = max([self.bits, *(int(b.split("-")[0]) + 1 for b in split)])
        out = None
        for d in range(deepest, self.bits - 1, -1):
            own = F.concat(F.lit(f"{d}-"), place(d).cast("string"))
            gone = [int(b.split("-")[1]) for b in split if b.startswith(f"{d}-")]
            out = own if out is None else F.when(place(d).isin(gone), out).otherwise(own) if gone else own
        return out

    def _newest(self, table: str, before: int | None, buckets: list[str] | None = None) -> dict[str, int]:
        """The buckets that hold the table's rows, each with its newest generation below ``before``."""
        split = self._splits(table, before)

        def leaf(b: str) -> bool:
            d, v = map(int, b.split("-"))
            return b not in split and (d == self.bits or f"{d - 1}-{v % (1 << (d - 1))}" in split)

        out: dict[str, int] = {}
        for b, g in self._generations(table):
            if (before is None or g < before) and (buckets is None or b in buckets) and leaf(b):
                out[b] = max(g, out.get(b, g))
        return out

    def read(self, table: str, schema: StructType, before: int | None = None, buckets: list[str] | None = None) -> DataFrame:
        """The newest generation of each bucket (of generations below ``before``): a pruned scan of their folders."""
        paths = [f"{self.path}/{table}/bucket={b}/generation={g}" for b, g in sorted(self._newest(table, before, buckets).items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.empty(schema)

    def touched(self, table: str, df: DataFrame, key: str, before: int | None = None) -> list[str]:
        """Buckets of the table that the keys of ``df`` fall into; there are no more of them than buckets."""
        found = df.select(self._bucket(key, set(self._splits(table, before))).alias("bucket")).distinct()
        return sorted(r["bucket"] for r in found.collect())

    def _sizes(self, table: str, newest: dict[str, int]) -> dict[str, tuple[int, int]]:
        """Bytes and files of buckets in a generation."""
        out = {}
        for b, g in newest.items():
            fs, p = self.fs(table, f"bucket={b}", f"generation={g}")
            held = fs.getContentSummary(p)
            out[b] = held.getLength(), held.getFileCount()
        return out

    def sent(self, keys: DataFrame) -> DataFrame:
        """``keys``, read from a table, given to every task if they are not too many: what they are joined to is not shuffled."""
        return F.broadcast(keys) if keys.count() <= SENT else keys

    def write(self, df: DataFrame, table: str, key: str, generation: int, touched: list[str], kept: DataFrame | None = None) -> None:
        """``df`` and ``kept`` hold all rows of the ``touched`` buckets. Those that have grown too large split.

        ``kept``: rows as the table has them. They are not shuffled, but for those of buckets in many files. Rows of
        ``df`` that have a ``_place`` are dealt by it already.
        """
        split, sizes = self._splits(table, generation), self._sizes(table, self._newest(table, generation))
        most = max(self.limit, sum(n for n, _ in sizes.values()) // MOST)
        grown = {b for b in touched if sizes.get(b, (0, 0))[0] > most and int(b.split("-")[0]) < DEEPEST}
        crowded = [b for b in touched if sizes.get(b, (0, 0))[1] >= MANY]

        def placed(rows: DataFrame) -> DataFrame:
            return rows.withColumn("bucket", self._bucket(key, {*split, *grown})).withColumn("generation", F.lit(generation))

        dealt = "_place" in df.columns
        rows = placed(df.drop("_hash", "_place"))
        if not dealt:
            rows = rows.hint("rebalance", "bucket")
        if kept is not None:
            if crowded:
                among = self._bucket(key, set(split)).isin(crowded)
                rows = rows.unionByName(placed(kept.where(among)).hint("rebalance", "bucket"))
                kept = kept.where(~among)
            rows = rows.unionByName(placed(kept))
        with shuffles_dropped(rows.sparkSession):
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "generation").parquet(f"{self.path}/{table}")
        for b in sorted(grown):
            self.note(table, "_splits", f"{b}@{generation}")
        for b in split:  # by an earlier generation, so nothing reads it again
            self.delete(table, f"bucket={b}")
        known = self._generations(table)
        for b, g in known:
            later = sorted(x for c, x in known if c == b and x > g)
            if len(later) > 1 and later[-1] == generation:
                self.delete(table, f"bucket={b}", f"generation={g}")

    def replace(self, table: str, key: str, fresh: DataFrame, keys: DataFrame) -> list[str]:
        """All rows of ``keys`` (one column, read from a table) give way to ``fresh``, in a new generation. Returns the buckets written."""
        generation, touched = self.next_generation(table), self.touched(table, keys, key)
        held = self.read(table, fresh.schema, buckets=touched)
        self.write(fresh, table, key, generation, touched, held.join(self.sent(keys), key, "left_anti"))
        return touched

    def _dealt(self, rows: DataFrame, table: str, key: str, generation: int) -> DataFrame:
        """``rows`` with the hash of their key and their place, which is never of two buckets."""
        depth = max([self.bits, *(int(b.split("-")[0]) + 1 for b in self._splits(table, generation))]) + PLACES
        return rows.withColumn("_hash", F.xxhash64(key)).withColumn("_place", F.pmod("_hash", F.lit(1 << depth)))

    def apart(self, held: DataFrame, reach: DataFrame, key: str, along: str) -> tuple[DataFrame, DataFrame]:
        """``held`` outside of what ``reach`` says of its key, and all else of it: what a batch can have changed."""
        there = self.sent(reach.select(F.col(key).alias("_key"), "lo", "hi", F.lit(True).alias("_there")))
        known = held.join(there, F.col(key).eqNullSafe(F.col("_key")), "left")
        outside = F.col("_there").isNull() | F.coalesce((F.col(along) < F.col("lo")) | (F.col(along) > F.col("hi")), F.lit(False))
        return known.where(outside).select(held.columns), known.where(~outside).select(held.columns)

    def upsert(self, table: str, batch: DataFrame, keys: list[str], generation: int, order: str | None = None, reach: DataFrame | None = None, along: str | None = None, held: DataFrame | None = None) -> None:
        """Last write wins by ``keys``, whose first column deals rows to buckets; within the batch, the last in ``order``.

        ``reach``, read from a table: ``lo`` and ``hi`` of ``along``, another of the keys, for each first key of the
        batch. Stored rows outside of them are kept without a look at the batch. ``held``: what of the touched buckets
        takes part, if not all.
        """
        touched = self.touched(table, batch if reach is None else reach, keys[0], generation)
        if held is None:
            held = self.read(table, StructType([f for f in batch.schema if f.name != order]), generation, touched)
        kept = None
        if reach is not None and self._newest(table, generation, touched):
            kept, held = self.apart(held, reach, keys[0], along)
        dealt = lambda rows: self._dealt(rows, table, keys[0], generation)
        self.write(upsert_latest(dealt(held), dealt(batch), keys, order, ("_hash", "_place")), table, keys[0], generation, touched, kept)
