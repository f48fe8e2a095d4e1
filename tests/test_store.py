"""Stores, screens and formulas against small tables worked by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.test_operators import OPS, series
from tidemark.operators import filters
from tidemark.operators.filters import Filter
from tidemark.sources import store

DAY = dt.datetime(2020, 1, 1)
KEYS = ["year", "symbol", "ts"]


def bars_of(spark, rows):
    df = spark.createDataFrame([(s, DAY + dt.timedelta(days=d), float(c), k) for s, d, c, k in rows], "symbol string, ts timestamp_ntz, close double, version int")
    return df.select(F.year("ts").alias("year"), "symbol", "ts", "close", "version")


def held(spark, path):
    return sorted((r.symbol, (r.ts - DAY).days, r.close) for r in spark.read.parquet(path).collect())


def test_merge_keeps_the_latest_and_a_second_run_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    assert store.merge(bars_of(spark, [("a", 0, 1, 1), ("a", 0, 2, 2), ("b", 400, 5, 1)]), path, KEYS, "year", ["version"]) == store.Counts(2, 0, 0)
    load = bars_of(spark, [("a", 0, 3, 3), ("a", 1, 4, 1), ("a", 1, 9, 0), ("b", 400, 5, 1), ("c", 800, None or 7, 1)])
    assert store.merge(load, path, KEYS, "year", ["version"]) == store.Counts(2, 1, 1)
    want = [("a", 0, 3.0), ("a", 1, 4.0), ("b", 400, 5.0), ("c", 800, 7.0)]
    assert held(spark, path) == want
    files = sorted(str(p) for p in (tmp_path / "s").rglob("*.parquet"))
    assert store.merge(load, path, KEYS, "year", ["version"]) == store.Counts(0, 0, 4)
    assert held(spark, path) == want and sorted(str(p) for p in (tmp_path / "s").rglob("*.parquet")) == files
    with pytest.raises(ValueError):
        store.merge(load, path, ["symbol", "ts"], "year", ["version"])


def test_a_merge_shuffles_load_and_store_once(spark, tmp_path):
    path = str(tmp_path / "s")
    load = bars_of(spark, [("a", d, d, 1) for d in range(0, 1000, 50)])
    store.merge(load, path, KEYS, "year", ["version"])
    plan = store._judged(load, path, KEYS, ["version"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


@pytest.mark.parametrize("few", [0, 64])
def test_rows_without_a_partition_stay(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(store, "FEW_PARTS", few)
    path = str(tmp_path / "s")
    load = lambda *rows: spark.createDataFrame(rows, "year int, symbol string, ts int, close double, version int")
    assert store.merge(load((None, "a", 1, 1.0, 1), (2020, "b", 1, 2.0, 1)), path, KEYS, "year", ["version"]) == store.Counts(2, 0, 0)
    assert store.merge(load((None, "a", 2, 3.0, 1), (None, "a", 1, 1.0, 1)), path, KEYS, "year", ["version"]) == store.Counts(1, 0, 1)
    assert sorted((r.symbol, r.ts, r.close) for r in spark.read.parquet(path).collect()) == [("a", 1, 1.0), ("a", 2, 3.0), ("b", 1, 2.0)]


def test_archive_and_store_together_are_the_input(spark, tmp_path):
    path, to = str(tmp_path / "s"), str(tmp_path / "a")
    store.merge(bars_of(spark, [("a", d, d, 1) for d in range(0, 1000, 50)]), path, KEYS, "year", ["version"])
    before, cutoff = held(spark, path), DAY + dt.timedelta(days=500)
    assert store.archive(spark, path, to, KEYS, "year", "ts", cutoff).inserted == 10
    assert sorted(held(spark, path) + held(spark, to)) == before and all(d < 500 for _, d, _ in held(spark, to)) and all(d >= 500 for _, d, _ in held(spark, path))
    assert store.archive(spark, path, to, KEYS, "year", "ts", cutoff) == store.Counts(0, 0, 0)
    # broken off between the two steps: what is archived already comes again
    store.merge(bars_of(spark, [("a", 50, 50, 1)]), path, KEYS, "year", ["version"])
    assert store.archive(spark, path, to, KEYS, "year", "ts", cutoff) == store.Counts(0, 0, 1)
    assert sorted(held(spark, path) + held(spark, to)) == before


@pytest.mark.parametrize(
    "f, want",
    [
        (Filter("x", "gt", 2.0), "d"), (Filter("x", "gte", 2.0), "bd"), (Filter("x", "lt", 2.0), "a"), (Filter("x", "lte", 2.0), "ab"), (Filter("x", "eq", 2.0005), "b"), (Filter("x", "eq", 2.002), ""),
        (Filter("x", "between", (1.0, 2.0)), "ab"), (Filter("x", "in", (1.0, 3.0)), "ad"), (Filter("symbol", "eq", "a"), "a"), (Filter("none", "gt", 9.0), "abcd"), (Filter("x", "near", 9.0), "abcd"),
    ],
)
def test_filters(spark, f, want):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None), ("d", 3.0)], "symbol string, x double")
    assert "".join(sorted(r.symbol for r in rows.where(filters.condition([f], rows)).collect())) == want


def test_screens_sort_and_are_pushed_to_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0, 5.0), ("b", 2.0, None), ("c", 3.0, 7.0), ("d", 3.0, 7.0)], "symbol string, x double, y double")
    rows.write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    both = filters.Screen((Filter("x", "gte", 2.0), Filter("x", "eq", 3.0)), "y")
    plan = both(rows)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(x,2.0)" in plan and "LessThanOrEqual(x,3.001)" in plan
    assert [r.symbol for r in both(rows).collect()] == ["c", "d"]
    assert [r.symbol for r in filters.Screen((), "y", False, 6.0, 3)(rows).collect()] == ["a", "b", "c"]
    assert [r.symbol for r in filters.Screen((), "gone")(rows).collect()] == ["a", "b", "c", "d"]


def test_trend_is_the_mean_of_both_slopes(spark):
    # highs rise by 2 a bar, lows stay: the mean slope of 1 passes a tenth of the mean range, one slope alone does not
    rows = [("a", DAY + dt.timedelta(days=i), 0.0, 10.0 + 2 * i, 9.0 - 8 * (i % 2), 9.5, 1.0, i) for i in range(20)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, seq int")
    got = OPS["trend_slopes"](bars).where("trend is not null").orderBy("ts").collect()[-1]
    span = sum(r[3] - r[4] for r in rows) / 20
    assert got.high_slope == 2 and got.low_slope < 0.1 * span
    assert got.trend == ("up" if (got.high_slope + got.low_slope) / 2 > 0.1 * span else "sideways")


@pytest.mark.parametrize("falls, alignment", [(False, 1.0), (True, 0.0)])
def test_strength_of_a_fall_has_no_alignment(spark, falls, alignment):
    from tidemark.operators import scan

    closes = [200 - i if falls else 100 + i for i in range(80)]
    got = OPS["trend_strength"](scan.indicators(series(spark, closes))).first()
    structure = 0.0 if falls else 1.0
    assert (got.alignment, got.structure) == (alignment, structure)
    assert got.strength == pytest.approx((min(got.adx / 50, 1) + alignment + structure) / 3, abs=1e-5)


def test_weights_of_deviations(spark):
    # volumes of 0 and 10 alternate; the last is so far out that its z-score lies between 1.5 and 2.5
    rows = [("a", DAY + dt.timedelta(days=i), 1.0, 1.0, 1.0, 1.0, v, i) for i, v in enumerate([0.0, 10.0] * 10 + [16.0])]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, seq int")
    assert OPS["adaptive_signal"](bars).first().weight == 3


def test_pain_is_least_where_contracts_pay_least(spark):
    rows = [("a", i, k, float(s), o, 0, 0.1) for i, (k, s, o) in enumerate([("call", 10, 5), ("call", 20, 1), ("put", 30, 4), ("put", 20, 2), ("call", 40, 9)])]
    chain = spark.createDataFrame(rows, "symbol string, id int, kind string, strike double, oi int, volume int, iv double")
    pay = {x: sum(o * (max(x - s, 0) if k == "call" else max(s - x, 0)) for _, _, k, s, o, _, _ in rows) for x in (10, 20, 30, 40)}
    got = OPS["max_pain"](chain).first()
    assert (got.strike, got.pain) == min(((x, p) for x, p in pay.items()), key=lambda t: (t[1], t[0]))
