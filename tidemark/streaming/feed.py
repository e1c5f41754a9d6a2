"""A feed of changed keys between the steps of a refresh.

A step that changes rows writes their keys under its own name and batch number, before the rows themselves, so no change
is ever forgotten; a step that reads the feed notes how far it has come once its own work is written. A step that was
cut short therefore does the same keys again. Batches that every reader is past are deleted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store


@dataclass
class Feed:
    """``readers``: which sources each reader follows."""

    store: Store
    readers: dict[str, tuple[str, ...]]

    def publish(self, source: str, keys: DataFrame, batch: int) -> None:
        """``keys``: one column. Publishing a batch again replaces it."""
        key = keys.columns[0]
        rows = keys.select(F.col(key).cast("string").alias("key")).distinct().withColumn("batch", F.lit(batch))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.store.path}/feed/{source}")

    def published(self, source: str, batch: int) -> DataFrame:
        """``(key)``: what :meth:`publish` has written for a batch."""
        return self.store.spark.read.schema("key string").parquet(f"{self.store.path}/feed/{source}/batch={batch}")

    def _position(self, reader: str, source: str) -> int:
        return max((int(n.split("@")[1]) for n in self.store.names("positions", reader) if n.startswith(f"{source}@")), default=-1)

    def _batches(self, source: str) -> list[int]:
        return sorted(int(n[6:]) for n in self.store.names("feed", source) if n.startswith("batch="))

    def pending(self, reader: str) -> dict[str, int]:
        """The newest batch of each source that ``reader`` has not seen all of."""
        newest = {s: max(self._batches(s), default=-1) for s in self.readers[reader]}
        return {s: n for s, n in newest.items() if n > self._position(reader, s)}

    def keys(self, reader: str, *sources: str) -> DataFrame:
        """``(key)``: what has changed in ``sources`` since ``reader`` last came by."""
        spark = self.store.spark
        paths = [f"{self.store.path}/feed/{s}/batch={b}" for s in sources for b in self._batches(s) if b > self._position(reader, s)]
        return spark.read.schema("key string").parquet(*paths).distinct() if paths else self.store.empty("key string")

    def done(self, reader: str, upto: dict[str, int]) -> None:
        for source, batch in upto.items():
            self.store.note("positions", reader, f"{source}@{batch}")
            for n in self.store.names("positions", reader):
                if n.startswith(f"{source}@") and int(n.split("@")[1]) < batch:
                    self.store.delete("positions", reader, n)
            seen = min(self._position(r, source) for r, followed in self.readers.items() if source in followed)
            for b in self._batches(source):
                if b <= seen:
                    self.store.delete("feed", source, f"batch={b}")
