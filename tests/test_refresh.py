"""What a refresh changes and what it leaves: landing order, whole histories, the change feed, buckets that split."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import filings as fi
from tidemark.sources.concepts import concept_map
from tidemark.streaming import refresh as rf
from tidemark.streaming.feed import Feed
from tidemark.streaming.store import Store

FACT = "cik long, taxonomy string, concept string, unit string, period_start date, period_end date, filed date, accn string, val double"
BAR = "ticker string, date date, open double, high double, low double, close double, volume double"


def day(s):
    return dt.date.fromisoformat(s)


class Landing:
    def __init__(self, spark, path):
        self.spark, self.n = spark, 0
        companies = spark.createDataFrame([(i, f"T{i}", f"Name {i}", "S", "X") for i in range(1, 41)], "cik long, ticker string, name string, sic_description string, exchange string")
        schema = lambda text: spark.createDataFrame([], text).schema
        for folder in ("bars", "facts", "histories"):
            os.makedirs(f"{path}/{folder}")
        self.r = rf.Refresh(Store(spark, f"{path}/store", buckets=4), f"{path}/bars", schema(BAR), f"{path}/facts", schema(FACT), companies, concept_map(spark), "2021-06-01", f"{path}/histories")

    def bars(self, rows, folder="bars", at=None):
        """One file; ``at``: the second at which it landed."""
        path = getattr(self.r, folder)
        before = set(os.listdir(path))
        self.spark.createDataFrame([(t, day(d), c, c, c, c, 10.0) for t, d, c in rows], BAR).coalesce(1).write.mode("append").parquet(path)
        if at is not None:
            for f in set(os.listdir(path)) - before:
                os.utime(f"{path}/{f}", (at, at))

    def facts(self, rows):
        self.spark.createDataFrame([(c, "us-gaap", "Assets", "USD", None, day("2020-12-31"), day(f), f"{c}-{f}", v) for c, f, v in rows], FACT).coalesce(1).write.mode("append").parquet(self.r.facts)

    def go(self):
        steps = rf.run(self.r)
        assert not [s for s in steps if s["state"] == "error"], steps
        return {s["name"]: s for s in steps}

    def closes(self, ticker):
        return {r.date.isoformat(): r.close for r in self.r.prices().where(f"ticker = '{ticker}'").collect()}


@pytest.fixture
def landing(spark, tmp_path):
    return Landing(spark, str(tmp_path))


def test_the_row_that_landed_last_wins(landing):
    landing.bars([("T1", "2021-01-04", 3.0), ("T1", "2021-01-04", 4.0), ("T1", "2021-01-05", 1.0)], at=1_700_000_200)
    landing.bars([("T1", "2021-01-04", 1.0), ("T1", "2021-01-05", 9.0)], at=1_700_000_100)
    landing.bars([("T1", "2021-01-05", 2.0)], at=1_700_000_300)
    landing.go()
    assert landing.closes("T1") == {"2021-01-04": 4.0, "2021-01-05": 2.0}
    spark = landing.spark
    both = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", None), (2, "d", 5)], "k int, v string, at int")
    kept = fi.upsert_latest(spark.createDataFrame([(1, "old"), (3, "old")], "k int, v string"), both, ["k"], "at")
    assert sorted(map(tuple, kept.collect())) == [(1, "b"), (2, "d"), (3, "old")]


def test_a_rebased_ticker_gets_its_whole_history_again(landing):
    old = [("T1", f"2021-01-{d:02d}", 100.0) for d in range(4, 9)]
    landing.bars([*old, ("T2", "2021-01-08", 7.0)])
    landing.facts([(1, "2021-02-01", 5.0), (2, "2021-02-01", 6.0)])
    landing.go()
    landing.bars([("T1", "2021-01-08", 50.0), ("T1", "2021-01-11", 51.0), ("T2", "2021-01-08", 7.0)], at=1_900_000_000)
    assert landing.go()["prices"]["detail"].startswith("1 rebased")
    assert [r.ticker for r in landing.r.wanted().collect()] == ["T1"]
    landing.bars([("T1", f"2021-01-{d:02d}", 50.0) for d in range(5, 9)], folder="histories", at=1_900_000_100)  # the fourth is no longer told
    landing.bars([("T1", "2021-01-07", 1.0)], at=1_900_000_050)  # landed before the history, so it is gone
    landing.bars([("T1", "2021-01-12", 52.0)], at=1_900_000_200)
    landing.go()
    assert landing.closes("T1") == {"2021-01-05": 50.0, "2021-01-06": 50.0, "2021-01-07": 50.0, "2021-01-08": 50.0, "2021-01-12": 52.0}
    assert landing.closes("T2") == {"2021-01-08": 7.0} and landing.r.wanted().count() == 0
    assert sorted((r.ticker, r.price) for r in landing.r.snapshot().collect()) == [("T1", 52.0), ("T2", 7.0)]


@pytest.mark.parametrize("files_per_batch", [1000, 2])
def test_a_whole_history_may_lie_in_several_files(landing, files_per_batch):
    bar = lambda d, c: ("T1", f"2021-01-{d:02d}", c)
    landing.bars([bar(d, 100.0) for d in range(4, 9)])
    landing.go()
    landing.r.files_per_batch = files_per_batch

    def history(rows, at):
        before, path = set(os.listdir(landing.r.histories)), landing.r.histories
        landing.spark.createDataFrame([(t, day(d), c, c, c, c, 10.0) for t, d, c in rows], BAR).repartition(4, "date").write.mode("append").parquet(path)
        new = sorted(f for f in set(os.listdir(path)) - before if f.endswith(".parquet"))
        for i, f in enumerate(new):
            os.utime(f"{path}/{f}", (at + i, at + i))
        return len(new)

    assert history([bar(d, 50.0) for d in range(5, 29)], 1_900_000_000) > 2
    landing.go()
    assert landing.closes("T1") == {f"2021-01-{d:02d}": 50.0 for d in range(5, 29)}
    assert history([bar(d, 40.0) for d in range(6, 20)], 1_900_001_000) + history([bar(d, 20.0) for d in range(8, 25)], 1_900_002_000) > 4
    landing.go()
    assert landing.closes("T1") == {f"2021-01-{d:02d}": 20.0 for d in range(8, 25)}


def test_only_what_is_on_the_feed_gets_new_snapshot_rows(landing):
    landing.facts([(i, "2021-02-01", float(i)) for i in range(1, 31)])
    landing.bars([(f"T{i}", "2021-01-04", float(i)) for i in range(1, 31)])
    landing.go()
    store = landing.r.store
    newest = lambda table: store._newest(table, None)
    snap, figures = newest("snapshot"), newest("figures")
    landing.bars([("T3", "2021-01-05", 33.0)])
    landing.go()
    own = set(store.touched("snapshot", landing.r.companies.where("cik = 3"), "cik"))
    assert {b for b, g in newest("snapshot").items() if g != snap.get(b)} == own
    assert {b for b, g in newest("figures").items() if g != figures.get(b)} == set(store.touched("figures", landing.r.companies.where("cik = 3"), "ticker"))
    got = {r.cik: (r.price, r.total_assets) for r in landing.r.snapshot().collect()}
    assert got == {i: (33.0 if i == 3 else float(i), float(i)) for i in range(1, 31)}
    assert landing.go()["snapshot"]["detail"] == "up to date"
    gauge = landing.spark.read.parquet(f"{store.path}/sentiment").collect()
    assert len(gauge) <= 1


def test_the_feed_gives_keys_again_until_they_are_done(spark, tmp_path):
    feed = Feed(Store(spark, f"{tmp_path}/f"), {"a": ("x",), "b": ("x", "y")})
    keys = lambda *k: spark.createDataFrame([(i,) for i in k], "cik long")
    assert feed.pending("b") == {} and feed.keys("b", "x").count() == 0
    feed.publish("x", keys(1, 2, 2), 0), feed.publish("x", keys(2, 3), 1), feed.publish("y", keys(9), 0)
    assert feed.pending("b") == {"x": 1, "y": 0} and sorted(r.key for r in feed.keys("b", "x", "y").collect()) == ["1", "2", "3", "9"]
    feed.done("b", {"x": 0})
    assert sorted(r.key for r in feed.keys("b", "x").collect()) == ["2", "3"] and feed._batches("x") == [0, 1]
    feed.done("a", {"x": 1})
    assert feed.pending("a") == {} and feed._batches("x") == [1]
    feed.publish("x", keys(7), 1)  # a batch that is run again replaces its keys
    assert [r.key for r in feed.keys("b", "x").collect()] == ["7"]


def test_buckets_split_as_they_grow(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/t", buckets=2, limit=2500)
    rows = lambda a, b, v: spark.createDataFrame([(i, f"{v}-{i * 7919 % 1000003}") for i in range(a, b)], "k long, v string")
    want: dict[int, str] = {}
    for g in range(6):
        a, b = 300 * g, 300 * g + 400  # a hundred keys are written again
        store.upsert("t", rows(a, b, g), ["k"], g)
        want |= {i: f"{g}-{i * 7919 % 1000003}" for i in range(a, b)}
        assert {r.k: r.v for r in store.read("t", rows(0, 1, 0).schema).collect()} == want
    leaves = store._newest("t", None)
    assert len(leaves) > 4 and store._splits("t", None) and all(f"bucket={b}" not in store.names("t") for b, g in store._splits("t", None).items() if g < 5)
    before = {r.k: r.v for r in store.read("t", rows(0, 1, 0).schema, before=5).collect()}
    store.upsert("t", rows(1500, 1900, 5), ["k"], 5)  # a batch that was cut short is run again
    assert {r.k: r.v for r in store.read("t", rows(0, 1, 0).schema).collect()} == want and len(before) == 1600
    for b in leaves:  # every row lies where its key says
        assert set(store.touched("t", store.read("t", rows(0, 1, 0).schema, buckets=[b]), "k")) <= {b}
    with pytest.raises(ValueError):
        Store(spark, "x", buckets=3)


def test_a_table_has_few_buckets_however_small_their_limit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidemark.streaming.store.MOST", 4, raising=False)
    s = Store(spark, str(tmp_path), buckets=1, limit=1)
    for n in range(7):
        rows = spark.range(64).select(F.col("id").alias("k"), F.lit(n).alias("v"))
        s.upsert("t", rows, ["k"], n)
    assert 4 <= len(s._newest("t", None)) <= 16
    back = s.read("t", rows.schema).collect()
    assert sorted(r.k for r in back) == list(range(64)) and {r.v for r in back} == {6}


def test_only_the_first_days_of_a_batch_tell_a_rebased_ticker(landing):
    landing.bars([("T1", f"2021-01-{d:02d}", 2.0) for d in range(4, 14)] + [("T2", f"2021-01-{d:02d}", 2.0) for d in range(4, 14)])
    landing.go()
    # T1: the first day that overlaps is another, though it landed before a row with the stored close; T2: only a later day is
    landing.bars([("T1", "2021-01-04", 2.0)] + [("T1", f"2021-01-{d:02d}", 1.0) for d in range(5, 13)], at=1_900_000_000)
    landing.bars([("T1", "2021-01-04", 1.0), ("T2", "2021-01-12", 1.0)] + [("T2", f"2021-01-{d:02d}", 2.0) for d in range(4, 12)], at=1_900_000_100)
    landing.go()
    assert [r.ticker for r in landing.r.wanted().collect()] == ["T1"]


def test_a_bucket_of_many_files_is_put_together_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidemark.streaming.store.MANY", 4)
    s = Store(spark, str(tmp_path), buckets=1)
    files = []
    for g in range(8):
        rows = spark.createDataFrame([(k, g, f"{k}-{g}") for k in range(20)], "k long, at int, v string")
        rows.groupBy("k").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).write.parquet(f"{tmp_path}/reach-{g}")
        s.upsert("t", rows, ["k", "at"], g, reach=spark.read.parquet(f"{tmp_path}/reach-{g}"), along="at")
        files.append(s._sizes("t", s._newest("t", None))["0-0"][1])
    assert sorted(map(tuple, s.read("t", rows.schema).collect())) == sorted((k, g, f"{k}-{g}") for k in range(20) for g in range(8))
    assert max(files) <= 12 and files[-1] < 8, files


def test_fundamentals_with_splits_deal_facts_once(spark):
    from tidemark.operators import fundamentals as fu

    facts = spark.createDataFrame([(1, "us-gaap", "Revenues", "USD", day("2020-01-01"), day("2020-03-31"), day("2020-05-01"), "a", 5.0)], FACT)
    plan = fu.fundamentals(facts, concept_map(spark))._jdf.queryExecution().executedPlan().toString()
    plan = plan[:plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert plan.count("Exchange hashpartitioning") == 1


def _written(monkeypatch):
    """What the store writes from here on: (table, how many rows are kept or None if all are shuffled, joins that shuffle those kept)."""
    seen, write = [], Store.write

    def spy(self, df, table, key, generation, touched, kept=None):
        plan = "" if kept is None else kept._jdf.queryExecution().executedPlan().toString()
        seen.append((table, None if kept is None else kept.count(), plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin")))
        return write(self, df, table, key, generation, touched, kept)

    monkeypatch.setattr(Store, "write", spy)
    return seen


def test_bars_that_a_batch_cannot_have_changed_are_not_shuffled(landing, monkeypatch):
    days = [f"2021-01-{d:02d}" for d in range(4, 29)]
    landing.bars([(f"T{i}", d, 1.0) for i in range(1, 9) for d in days] + [(None, days[0], 1.0)])
    landing.go()
    seen = _written(monkeypatch)
    # T1: a day again and a new one; T2: a day before all that is stored; without a ticker: the day again
    landing.bars([("T1", days[-1], 1.0), ("T1", "2021-02-01", 3.0), ("T2", "2021-01-01", 4.0), (None, days[0], 5.0)])
    landing.go()
    got = {(r.ticker, r.date.isoformat()): r.close for r in landing.r.prices().collect()}
    assert got == {(f"T{i}", d): 1.0 for i in range(1, 9) for d in days} | {("T1", "2021-02-01"): 3.0, ("T2", "2021-01-01"): 4.0, (None, days[0]): 5.0}
    assert landing.r.prices().count() == len(got)
    [(kept, shuffles)] = [(k, n) for t, k, n in seen if t == "prices"]
    touched = landing.r.store.touched("prices", landing.spark.createDataFrame([("T1",), ("T2",), (None,)], "ticker string"), "ticker")
    inside = landing.r.store.read("prices", landing.r.bar_schema, buckets=touched).count() - 4  # the rows of the batch
    assert kept == inside and shuffles == 0


@pytest.mark.parametrize("level", ["week", "month", "day"])
def test_a_level_is_grouped_before_its_buckets_are_named(spark, level):
    from tidemark.operators.levels import rollup
    from tidemark.operators.series import bucket_key

    bars = spark.createDataFrame([(f"T{i % 3}", day("2019-12-20") + dt.timedelta(days=i), float(i)) for i in range(60)] + [("T1", None, 1.0), ("T1", day("2020-01-01"), None)], "ticker string, date date, close double")
    want = bars.where("close IS NOT NULL").groupBy("ticker", bucket_key(F.col("date"), F.lit(level)).alias("key")).agg(F.count(F.lit(1)), F.min("date"), F.max("date"), F.max_by("close", "date"))
    order = lambda rows: sorted((tuple(r) for r in rows), key=str)
    got = rollup(bars, level)
    assert order(got.collect()) == order(want.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "weekofyear" not in plan[plan.index("Aggregate"):] or level != "week"
    assert "date_format" not in plan[plan.index("Aggregate"):] or level != "month"


def test_rows_of_other_companies_and_tickers_are_not_shuffled(landing, monkeypatch):
    landing.facts([(i, "2021-02-01", float(i)) for i in range(1, 31)])
    landing.bars([(f"T{i}", d, float(i)) for i in range(1, 31) for d in ("2021-01-04", "2021-02-04")])
    landing.go()
    seen = _written(monkeypatch)
    landing.bars([("T3", "2021-02-05", 33.0)])
    landing.facts([(4, "2021-03-01", 44.0)])
    landing.go()
    tables = {t for t, _, _ in seen}
    assert tables == {"prices", "facts", "fundamentals", "snapshot", "figures", "week", "month"}
    assert all(kept and not shuffles for _, kept, shuffles in seen), seen
    figures = landing.r.store.read("figures", rf.ticker_figures(landing.r.prices()).schema)
    assert sorted(map(tuple, figures.collect())) == sorted(map(tuple, rf.ticker_figures(landing.r.prices()).collect()))
    for name, level in landing.r.levels().items():
        assert sorted(map(tuple, level.collect())) == sorted(map(tuple, rf.rollup(landing.r.prices(), name).collect()))
    assert {r.cik: (r.price, r.total_assets) for r in landing.r.snapshot().collect()} == {i: (33.0 if i == 3 else float(i), 44.0 if i == 4 else float(i)) for i in range(1, 31)}
