"""Scans of linear recurrences against plain folds, whatever the size of a block."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import recursive, scan

DAY = dt.datetime(2020, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    r, rows = random.Random(8), []
    for symbol, n in (("long", 700), ("mid", 60), ("short", 20), ("one", 1), ("flat", 45)):
        close = 100.0
        for i in range(n):
            close = 100.0 if symbol == "flat" else max(close * (1 + r.gauss(0, 0.02)), 1.0)
            rows.append((symbol, DAY + dt.timedelta(days=i), close, close * 1.01, close * 0.99 if symbol != "flat" else close * 1.01, close, 10.0, i))
    r.shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, seq int")


def same(got, want, names):
    a, b = ({(r.symbol, r.ts): r for r in x.collect()} for x in (got, want))
    assert a.keys() == b.keys()
    for k, r in a.items():
        for n in names:
            w = b[k][n]
            assert (r[n] is None) == (w is None or w != w), (k, n, r[n], w)
            assert r[n] is None or r[n] == pytest.approx(w, rel=1e-9, abs=1e-9), (k, n)


@pytest.mark.parametrize("chunk", [None, 700, 64])
def test_indicators_equal_the_fold(bars, chunk):
    names = "ema12 ema26 ema20 signal rsi atr14 atr10 plus_di minus_di adx".split()
    same(scan.indicators(bars, chunk), recursive.indicators(bars), names)


def test_single_indicators_take_their_periods(bars):
    sizes = 30
    same(scan.ema(bars, 5, chunk=sizes), recursive.ema(bars, 5), ["ema"])
    same(scan.rsi(bars, 9, sizes), recursive.rsi(bars, 9), ["rsi"])
    same(scan.macd(bars, 5, 8, 4, sizes), recursive.macd(bars, 5, 8, 4), ["line", "signal", "histogram"])
    same(scan.atr(bars, 6, sizes), recursive.atr(bars, 6), ["atr"])
    same(scan.keltner(bars, 7, 5, 1.5, sizes), recursive.keltner(bars, 7, 5, 1.5), ["lower", "middle", "upper"])
    same(scan.adx(bars, 5, sizes), recursive.adx(bars, 5), ["plus_di", "minus_di", "adx"])
    same(scan.ewma_chart(bars, "close", chunk=sizes), recursive.ewma_chart(bars, "close"), ["ewma", "low", "high"])
    a, b = ({r.symbol: r.forecast for r in f(bars).collect()} for f in (lambda x: scan.garch(x, chunk=sizes), recursive.garch))
    assert a == pytest.approx(b) and len(a) == 4


def test_lanes_of_unlike_memory_have_chunks_of_their_own(bars):
    keeps = {"slow": 0.999, "mid": 0.9, "fast": 1 / 3, "none": 0.0}
    lanes = {n: (k, F.col("close")) for n, k in keeps.items()}
    assert scan.groups(lanes) == [["slow"], ["mid"], ["fast"]]
    with pytest.raises(ValueError):
        scan.scan(bars, {"x": (1.0, F.col("close"))})
    got = {(r.symbol, r.seq): r for r in scan.scan(bars, lanes).collect()}
    for n, k in keeps.items():
        x = 0.0
        for i in range(700):
            x = k * x + got["long", i].close
            assert got["long", i][n] == pytest.approx(x, rel=1e-11)


def test_no_window_holds_a_whole_series():
    for keeps in ([1 - 2 / 13], [1 - 1 / 14, 0.8], [1 - 2 / 27, 1 - 2 / 13]):
        halo, chunk = scan.lengths(keeps)
        assert max(keeps) ** halo < 1e-19 and min(keeps) ** -float(chunk + halo) < 1e261 and chunk >= halo


def test_scan_of_nothing(bars):
    assert scan.indicators(bars.limit(0)).count() == 0
