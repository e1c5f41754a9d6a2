"""Incremental refresh: landed files change only what they touch.

Prices, facts, fundamentals, snapshot rows and the gauge's figures of each ticker are kept in a :mod:`store`; what one
step changes the next ones learn from a :mod:`feed`. Of rows of one key the one that landed last wins: by the time of
its file, the file's name, then its place in the file.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.fundamentals import detect_splits, fundamentals
from ..operators.levels import LEVELS, rollup
from ..operators.sentiment import reading, ticker_figures
from ..operators.snapshot import snapshot
from ..sources.filings import last_written, rebased_tickers
from .feed import Feed
from .store import Store

FACT_KEYS = ["cik", "period_end", "concept", "accn", "period_start", "unit", "taxonomy"]
BAR_KEYS = ["ticker", "date"]
LANDED = "_landed"
READERS = {"normalise": ("facts",), "snapshot": ("bars", "fundamentals"), "sentiment": ("bars",), "levels": ("bars",)}


def _drain(landed: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """All landed files, batch by batch, then stop."""
    query = landed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _written_as(file: Column) -> Column:
    """What tells histories apart: the files of one Spark write carry its id in their names and are one, any other file is one alone."""
    return F.regexp_replace(file, r"part-\d+-([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})[^/]*$", "$1")


@dataclass
class Refresh:
    """What a refresh reads and where it keeps its tables, stream checkpoints among them.

    ``histories``: a folder for whole price histories, which replace all that is stored of their tickers.
    """

    store: Store
    bars: str
    bar_schema: StructType
    facts: str
    fact_schema: StructType
    companies: DataFrame
    concept_map: DataFrame
    as_of: str
    histories: str | None = None

    files_per_batch: int = 1000

    def __post_init__(self) -> None:
        self.feed = Feed(self.store, READERS)

    def _landed(self, path: str, schema: StructType) -> DataFrame:
        rows = self.store.spark.readStream.schema(schema).option("maxFilesPerTrigger", self.files_per_batch).parquet(path)
        place = F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        return rows.select("*", place.alias(LANDED))

    def _checkpoint(self, name: str) -> str:
        return f"{self.store.path}/_checkpoints/{name}"

    def _record(self, table: str, rows: DataFrame, batch_id: int) -> None:
        """Rows of a batch beside those of other batches; a batch that is run again replaces its own."""
        rows.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.store.path}/{table}")

    def _noted(self, table: str, schema: str | StructType) -> DataFrame:
        """What :meth:`_record` has written."""
        spark = self.store.spark
        return spark.read.schema(schema).parquet(f"{self.store.path}/{table}") if self.store.names(table) else self.store.empty(schema)

    # ---- prices

    def _apply_bars(self, batch: DataFrame, batch_id: int) -> None:
        """Bars are put in by ticker and date. A whole history takes the place of all that landed before it, stored or in the batch.

        A history may lie in several files (:func:`_written_as`) and, if it is large, in several batches: those after its
        first add to it. Tickers whose first bar that overlaps the store has another close are put on the list of those wanted whole.
        """
        file = F.struct(f"{LANDED}.time", f"{LANDED}.file")
        written = _written_as(F.col(f"{LANDED}.file"))
        # a batch is read whole each time, so what is asked of it ticker by ticker is asked once
        asked = batch.groupBy("ticker", F.when(F.col("whole"), file).alias("file")).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
        asked = asked.groupBy("ticker").agg(F.max("file").alias("newest"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        self._record("arrived", asked, batch_id)
        arrived = self._noted("arrived", asked.withColumn("batch", F.lit(0)).schema).where(F.col("batch") == batch_id).drop("batch")
        self.feed.publish("bars", arrived.select("ticker"), batch_id)
        held = self.store.read("prices", self.bar_schema, batch_id, self.store.touched("prices", arrived, "ticker", batch_id))
        whole = arrived.where("newest IS NOT NULL").select("ticker", "newest", _written_as(F.col("newest.file")).alias("history"))
        self._record("replaced", whole.select("ticker", "history"), batch_id)
        known = batch.join(self.store.sent(whole), "ticker", "left")
        own = F.when(F.col("whole"), written == F.col("history")).otherwise(file > F.col("newest"))
        fresh = known.where(F.col("newest").isNull() | own).drop("newest", "history", "whole")
        if self.store.has("prices"):
            stored, among = held.agg(F.max("date").alias("last")), self.store.apart(held, arrived, "ticker", "date")[1]
            added = known.where("newest IS NULL").drop("newest", "history", "whole").join(F.broadcast(stored), F.col("date").isNull() | (F.col("date") <= F.col("last"))).drop("last")
            self._record("rebased", rebased_tickers(among, self._head(added)), batch_id)
        before = self._noted("replaced", "ticker string, history string, batch int").where(F.col("batch") < batch_id)
        begun = before.groupBy("ticker").agg(F.max_by("history", "batch").alias("history"))
        gone = whole.join(begun, ["ticker", "history"], "left_anti").select("ticker")
        left = held.join(self.store.sent(gone), "ticker", "left_anti").select(held.columns)
        self.store.upsert("prices", fresh, BAR_KEYS, batch_id, LANDED, arrived, "date", left)

    @staticmethod
    def _head(bars: DataFrame, days: int = 6) -> DataFrame:
        """The first days of each ticker, all that tells whether it was rebased, as they landed last."""
        w = Window.partitionBy("ticker").orderBy("date")
        return last_written(bars.withColumn("_day", F.dense_rank().over(w)).where(F.col("_day") <= days).drop("_day"), BAR_KEYS, LANDED)

    def step_prices(self) -> tuple[str, str]:
        landed = self._landed(self.bars, self.bar_schema).withColumn("whole", F.lit(False))
        if self.histories is not None:
            landed = landed.unionByName(self._landed(self.histories, self.bar_schema).withColumn("whole", F.lit(True)))
        _drain(landed, self._apply_bars, self._checkpoint("prices"))
        n = self.wanted().count()
        return "ok", f"{n} rebased tickers need their history again" if n else "up to date"

    def wanted(self) -> DataFrame:
        """``(ticker)``: rebased since their whole history last came."""
        newest = self._noted("rebased", "ticker string, batch int").groupBy("ticker").agg(F.max("batch").alias("batch"))
        came = self._noted("replaced", "ticker string, batch int").groupBy("ticker").agg(F.max("batch").alias("came"))
        return newest.join(came, "ticker", "left").where("came IS NULL OR came < batch").select("ticker")

    def prices(self) -> DataFrame:
        return self.store.read("prices", self.bar_schema)

    def _prices_of(self, tickers: DataFrame) -> DataFrame:
        """Bars of some tickers, from their buckets alone."""
        return self.store.read("prices", self.bar_schema, buckets=self.store.touched("prices", tickers, "ticker")).join(tickers, "ticker", "left_semi")

    # ---- gauge

    def step_sentiment(self) -> tuple[str, str]:
        """Figures of changed tickers anew, then one reading from those of all; one a date, a second one replaces it."""
        upto = self.feed.pending("sentiment")
        if upto:
            tickers = self.feed.keys("sentiment", *upto).select(F.col("key").alias("ticker"))
            self.store.replace("figures", "ticker", ticker_figures(self._prices_of(tickers)), tickers)
            self.feed.done("sentiment", upto)
        figures = self.store.read("figures", ticker_figures(self.store.spark.createDataFrame([], self.bar_schema)).schema)
        made = reading(figures, self.as_of).where("score IS NOT NULL")
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{self.store.path}/sentiment")
        return "ok", "written"

    # ---- weeks and months

    def level(self, name: str) -> DataFrame:
        return self.store.read(name, rollup(self.store.spark.createDataFrame([], self.bar_schema), name).schema)

    def levels(self) -> dict[str, DataFrame]:
        return {name: self.level(name) for name in LEVELS}

    def step_levels(self) -> tuple[str, str]:
        """Weeks and months of changed tickers anew."""
        upto = self.feed.pending("levels")
        if not upto:
            return "ok", "up to date"
        tickers = self.feed.keys("levels", *upto).select(F.col("key").alias("ticker"))
        bars = self._prices_of(tickers)
        for name in LEVELS:
            self.store.replace(name, "ticker", rollup(bars, name), tickers)
        self.feed.done("levels", upto)
        return "ok", "written"

    # ---- filings

    def _apply_facts(self, batch: DataFrame, batch_id: int) -> None:
        asked = batch.groupBy("cik").agg(F.min("period_end").alias("lo"), F.max("period_end").alias("hi"))
        self._record("filed", asked, batch_id)
        filed = self._noted("filed", asked.withColumn("batch", F.lit(0)).schema).where(F.col("batch") == batch_id).drop("batch")
        self.feed.publish("facts", filed.select("cik"), batch_id)
        self.store.upsert("facts", batch, FACT_KEYS, batch_id, LANDED, filed, "period_end")

    def step_filings(self) -> tuple[str, str]:
        _drain(self._landed(self.facts, self.fact_schema), self._apply_facts, self._checkpoint("facts"))
        return "ok", "up to date"

    def fundamentals(self) -> DataFrame:
        return self.store.read("fundamentals", self._fundamental_schema)

    @cached_property
    def _fundamental_schema(self) -> StructType:
        return fundamentals(self.store.spark.createDataFrame([], self.fact_schema), self.concept_map).schema

    def step_normalise(self) -> tuple[str, str]:
        """Fundamentals of the changed companies anew; those of all others are carried over as they are."""
        upto = self.feed.pending("normalise")
        if not upto:
            return "ok", "up to date"
        changed = self.feed.keys("normalise", *upto).select(F.col("key").cast("long").alias("cik"))
        own = self.store.read("facts", self.fact_schema, buckets=self.store.touched("facts", changed, "cik")).join(changed, "cik", "left_semi")
        fresh = fundamentals(own, self.concept_map, detect_splits(own))
        self.feed.publish("fundamentals", changed, max(upto.values()))
        self.store.replace("fundamentals", "cik", fresh, changed)
        n = changed.count()
        self.feed.done("normalise", upto)
        return "ok", f"{n} companies"

    # ---- snapshot

    @cached_property
    def _snapshot_schema(self) -> StructType:
        empty = self.store.spark.createDataFrame
        return snapshot(empty([], self._fundamental_schema), self.companies.limit(0), empty([], self.bar_schema)).schema

    def snapshot(self) -> DataFrame:
        return self.store.read("snapshot", self._snapshot_schema)

    def step_snapshot(self) -> tuple[str, str]:
        """Rows of companies whose fundamentals or bars have changed; all others stay as they are."""
        if not self.store.has("fundamentals"):
            return "skipped", "no fundamentals yet"
        upto = self.feed.pending("snapshot")
        if not upto:
            return "ok", "up to date"
        by_bars = self.companies.join(self.feed.keys("snapshot", "bars"), F.col("ticker") == F.col("key"), "left_semi").select("cik")
        changed = by_bars.union(self.feed.keys("snapshot", "fundamentals").select(F.col("key").cast("long"))).distinct()
        own = self.store.read("fundamentals", self._fundamental_schema, buckets=self.store.touched("fundamentals", changed, "cik")).join(changed, "cik", "left_semi")
        who = self.companies.join(changed, "cik", "left_semi")
        fresh = snapshot(own, who, self._prices_of(who.where("ticker IS NOT NULL").select("ticker")))
        touched = self.store.replace("snapshot", "cik", fresh, changed)
        self.feed.done("snapshot", upto)
        return "ok", f"{len(touched)} buckets written"


_LOCK = threading.Lock()


def run(refresh: Refresh) -> list[dict]:
    """Prices, snapshot, gauge, weeks and months, filings; then, only if filings changed, fundamentals of those companies and the snapshot again.

    Returns one ``{name, state, detail, seconds}`` a step. A step that fails is recorded as an error and stops
    none of the others. A call while another one of the process runs does nothing.
    """
    if not _LOCK.acquire(blocking=False):
        return []
    steps: list[dict] = []

    def timed(name: str, step: Callable[[], tuple[str, str]]) -> None:
        began = time.monotonic()
        try:
            state, detail = step()
        except Exception as e:  # noqa: BLE001  a failed step is reported, the next one still has its turn
            state, detail = "error", f"{type(e).__name__}: {e}"[:300]
        steps.append({"name": name, "state": state, "detail": detail, "seconds": time.monotonic() - began})

    def changed() -> tuple[str, str]:
        if refresh.feed.pending("normalise"):
            timed("normalise", refresh.step_normalise)
            timed("snapshot (after filings)", refresh.step_snapshot)
        return "ok", ""

    try:
        timed("prices", refresh.step_prices)
        timed("snapshot", refresh.step_snapshot)
        timed("sentiment", refresh.step_sentiment)
        timed("levels", refresh.step_levels)
        timed("filings", refresh.step_filings)
        timed("changes", changed)
        if steps[-1]["state"] == "ok":
            steps.pop()  # only a failure to tell what changed is worth a line
    finally:
        _LOCK.release()
    return steps
