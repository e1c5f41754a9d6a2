"""Windows of a price series, its flags, buckets and quote tips."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import series as ts


def day(s):
    return dt.date.fromisoformat(s)


def daily(spark, ticker, first, last, close=100.0):
    d = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date")).where("weekday(date) < 5")
    return d.select(F.lit(ticker).alias("ticker"), "date", F.lit(close).alias("close"))


def shown(prices, range_name, today):
    points = ts.price_series(prices, range_name, today)
    return sorted(points.collect(), key=lambda r: r.date), {r.ticker: r for r in ts.price_series_meta(points).collect()}


def test_a_stale_ticker_keeps_its_window(spark):
    deep = daily(spark, "DEEP", "1980-12-12", "2026-09-21").cache()
    points, meta = shown(deep, "5d", "2026-09-30")
    assert len(points) == 5 and points[-1].date == day("2026-09-21") and not meta["DEEP"].fell_back and meta["DEEP"].span_days <= 10
    points, meta = shown(daily(spark, "M", "2020-01-01", "2026-11-10"), "ytd", "2026-11-17")
    assert points[0].date == day("2025-12-31") and not meta["M"].fell_back


def test_five_days_are_five_bars(spark):
    points, meta = shown(daily(spark, "A", "2020-01-01", "2026-09-30"), "5d", "2026-09-30")
    assert len(points) == 5 and not meta["A"].partial and not meta["A"].fell_back and meta["A"].has_5y


def test_one_bar_is_all_there_is(spark):
    one = spark.createDataFrame([("NEW", day("2026-09-29"), 10.0), ("THIN", day("2026-01-05"), 50.0), ("NONE", day("2026-01-05"), None)], "ticker string, date date, close double")
    points, meta = shown(one, "5d", "2026-09-30")
    assert [(r.ticker, r.close, r.fell_back, r.partial) for r in points] == [("THIN", 50.0, True, True), ("NEW", 10.0, True, True)]
    assert (meta["NEW"].n, meta["NEW"].change, meta["NEW"].has_6m, meta["NEW"].span_days) == (1, 0.0, False, 0) and "NONE" not in meta


def test_a_year_begins_with_the_last_close_before_it(spark):
    points, meta = shown(daily(spark, "A", "2020-01-01", "2026-11-17"), "ytd", "2026-11-17")
    assert points[0].date == day("2025-12-31") and points[-1].date == day("2026-11-17") and not meta["A"].partial


def test_partial_windows(spark):
    short = daily(spark, "S", "2024-01-01", "2026-09-30").cache()
    assert shown(short, "5y", "2026-09-30")[1]["S"].partial and not shown(short, "1y", "2026-09-30")[1]["S"].partial
    whole, meta = shown(short, "max", "2026-09-30")
    assert meta["S"].partial and not meta["S"].fell_back and meta["S"].bucket == "week" and len(whole) < 150
    long = shown(daily(spark, "L", "2010-01-01", "2026-09-30"), "max", "2026-09-30")[1]["L"]
    assert not long.partial and long.bucket == "month" and long.full_span_days == long.span_days


def test_weeks_over_a_year_end(spark):
    bars = spark.createDataFrame([("A", day(d), c) for d, c in (("2024-12-30", 5.0), ("2024-12-31", 6.0), ("2025-01-02", 7.0))], "ticker string, date date, close double")
    assert [(r.date.isoformat(), r.close) for r in ts.downsample(bars, F.lit("week")).collect()] == [("2025-01-02", 7.0)]
    assert ts.downsample(bars, F.lit("month")).count() == 2 and ts.downsample(bars, F.lit("day")).count() == 3


def test_a_delayed_quote_tips_the_series(spark):
    points = spark.createDataFrame([("A", day("2025-01-02"), 100.0), ("A", day("2025-01-03"), 110.0), ("B", day("2025-01-03"), 9.0)], "ticker string, date date, close double")
    quote = lambda *rows: spark.createDataFrame([(t, p, day(d), s) for t, p, d, s in rows], "ticker string, price double, as_of date, source string")
    tips = lambda q: {r.ticker: (r.last_date.isoformat(), r.last_close, r.n) for r in ts.series_meta(ts.apply_quote(points, q)).collect()}
    assert tips(quote(("A", 112.5, "2025-01-03", "delayed"), ("B", 8.0, "2025-01-06", "delayed"))) == {"A": ("2025-01-03", 112.5, 2), "B": ("2025-01-06", 8.0, 2)}
    assert tips(quote(("A", 999.0, "2025-01-03", "close"), ("B", 1.0, "2025-01-01", "delayed"))) == {"A": ("2025-01-03", 110.0, 2), "B": ("2025-01-03", 9.0, 1)}


def test_levels_give_the_points_of_all_bars(spark):
    import random

    from tidemark.operators import levels as lv

    rnd = random.Random(3)
    rows = []
    for k, (first, n, step) in enumerate([("2010-03-01", 900, 5), ("2024-06-03", 300, 2), ("2023-01-02", 150, 5), ("2026-09-28", 1, 1), ("2015-01-05", 40, 3), ("2020-12-28", 700, 3), ("2021-09-30", 500, 4)]):
        d = day(first)
        for _ in range(n):
            rows.append((f"T{k}", d, None if rnd.random() < 0.03 else float(rnd.randrange(1, 500))))
            d += dt.timedelta(rnd.randint(1, step))
    prices = spark.createDataFrame(rows, "ticker string, date date, close double").cache()
    held = {k: lv.rollup(prices, k).cache() for k in lv.LEVELS}
    for name, today in (("5y", "2026-09-30"), ("5y", "2024-02-13"), ("max", "2026-09-30"), ("1y", "2026-09-30")):
        want = sorted(map(tuple, ts.price_series(prices, name, today).collect()))
        assert sorted(map(tuple, lv.series_from_levels(prices, held, name, today).collect())) == want and len(want) > 100
