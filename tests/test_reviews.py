"""Reviews of series against values worked by hand and plain loops."""

import datetime as dt
import random

import pytest

from tidemark.operators import reviews

START = dt.datetime(2020, 1, 1)


def day(n):
    return START + dt.timedelta(days=n)


def test_alignment(spark):
    rising, falling = [(day(i), 100.0 + i) for i in range(700)], [(day(i), 1000.0 - i) for i in range(700)]
    turning = [(day(i), 100.0 + i if i < 685 else 785.0 - 5 * (i - 685)) for i in range(700)]
    series = {"up": rising, "down": falling, "turn": turning, "short": rising[:19], "flat": [(day(i), 5.0) for i in range(700)], "days": rising[:20]}
    bars = spark.createDataFrame([(s, t, c) for s, rows in series.items() for t, c in rows], "symbol string, ts timestamp, close double")
    got = {r.symbol: (r.grains, r.rising, round(r.alignment, 6), r.trend, r.signal, round(r.confidence, 6), r.best_grain) for r in reviews.alignment(bars).collect()}
    assert got["up"] == (3, 3, 1.0, "buy", "buy", 1.0, "month") and got["down"] == (3, 0, 1.0, "sell", "sell", 1.0, "month")
    assert got["turn"] == (3, 2, 0.333333, "buy", "neutral", 0.3, "month")
    assert got["short"] == (0, 0, 0.0, "neutral", "neutral", 0.5, None)
    assert got["flat"] == (3, 0, 1.0, "sell", "sell", 1.0, None)
    assert got["days"] == (1, 1, 1.0, "buy", "buy", 1.0, "day")
    assert reviews.alignment(bars.where("false")).count() == 0


def test_diversification_and_rolling_correlation(spark):
    rng = random.Random(1)
    base = [rng.gauss(0, 1) for _ in range(60)]
    noise = [rng.gauss(0, 1) for _ in range(60)]
    marks = [("a", day(i), x) for i, x in enumerate(base)] + [("b", day(i), -x) for i, x in enumerate(base)] + [("c", day(i), x) for i, x in enumerate(noise)] + [("flat", day(i), 0.0) for i in range(60)] + [("none", day(900), 1.0)]
    own = [x + y for x, y in zip(base, noise)]
    rows = [("s", day(i), x) for i, x in enumerate(own)] + [("t", day(900), 1.0), ("u", day(0), None)]
    returns, benchmarks = spark.createDataFrame(rows, "symbol string, ts timestamp, r double"), spark.createDataFrame(marks, "benchmark string, ts timestamp, r double")

    def corr(x, y):
        mx, my = sum(x) / len(x), sum(y) / len(y)
        cov = sum((a - mx) * (b - my) for a, b in zip(x, y))
        return cov / (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5

    got = {r.symbol: r for r in reviews.diversification(returns, benchmarks, days=49).collect()}
    a, c = round(corr(own[10:], base[10:]), 3), round(corr(own[10:], noise[10:]), 3)
    assert set(got) == {"s", "t"} and got["s"].benchmarks == 3 and got["s"].diversification == pytest.approx(100 * (1 - (2 * abs(a) + abs(c)) / 3))
    high = ("a", a) if abs(a) >= abs(c) else ("c", c)  # a and b are of one size; the first name counts
    assert (got["s"].highest, got["s"].highest_correlation) == high and (got["s"].lowest, got["s"].lowest_correlation) == (("c", c) if abs(c) < abs(a) else ("a", a))
    assert (got["t"].benchmarks, got["t"].highest, got["t"].diversification) == (0, None, 50.0)
    rolled = {(r.benchmark, r.ts): r.correlation for r in reviews.rolling_correlation(returns, benchmarks).where("symbol = 's'").collect()}
    assert len(rolled) == 4 * 31 and rolled["flat", day(40)] is None
    assert rolled["c", day(40)] == pytest.approx(corr(own[11:41], noise[11:41])) and rolled["b", day(59)] == pytest.approx(-corr(own[30:], base[30:]))


def drawdowns(points, top):
    """By a plain loop: (start, trough, recovery, depth)."""
    out, peak, start, low, trough = [], points[0][1], points[0][0], None, None
    for t, v in points:
        if v >= peak:
            if low is not None:
                out.append((start, trough, t, (peak - low) / peak * 100))
            peak, start, low = v, t, None
        elif low is None or v < low:
            low, trough = v, t
    if low is not None:
        out.append((start, trough, None, (peak - low) / peak * 100))
    return sorted(out, key=lambda e: (-e[3], e[0]))[:top]


def test_deepest_drawdowns(spark):
    rng, series = random.Random(2), {"one": [(day(0), 5.0)], "rise": [(day(i), 1.0 + i) for i in range(9)], "tie": [(day(i), v) for i, v in enumerate((100.0, 90.0, 90.0, 100.0, 90.0, 101.0, 50.5, 60.0))]}
    for s in range(20):
        v, rows = 100.0, []
        for i in range(200):
            v += rng.choice((-3, -1, 0, 1, 2))
            rows.append((day(i), max(v, 1.0)))
        series[f"r{s}"] = rows
    frame = spark.createDataFrame([(s, t, v) for s, rows in series.items() for t, v in rows] + [("one", day(1), None)], "symbol string, ts timestamp, equity double")
    got = {}
    for r in reviews.deepest_drawdowns(frame, 4).orderBy("symbol", "rank").collect():
        got.setdefault(r.symbol, []).append((r.start, r.trough, r.recovery, pytest.approx(r.depth)))
        assert r.days_down == (r.trough - r.start).days and r.days_up == (None if r.recovery is None else (r.recovery - r.trough).days)
    assert got == {s: want for s, rows in series.items() if (want := drawdowns(rows, 4))}


def test_year_end_by_hand(spark):
    lots = [
        ("a", day(0), day(365), 1500.0, 1000.0, None), ("a", day(300), day(364), 900.0, 1000.0, 50.0), ("a", day(1), day(364), 1100.0, 1000.0, None), ("b", day(300), day(310), 1000.0, 6000.0, None), ("c", None, day(310), 10.0, 4.0, None),
        ("d", day(1), None, 10.0, 4.0, None), ("d", day(1), day(2), None, 4.0, None),
    ]
    frame = spark.createDataFrame(lots, "symbol string, entry_date timestamp, exit_date timestamp, proceeds double, basis double, adjustment double")
    got = {(r.symbol, r.jurisdiction): (r.tax_year, r.short_gains, r.short_losses, r.long_gains, r.long_losses, round(r.net, 6), round(r.tax, 6), r.carried) for r in reviews.year_end(frame).collect()}
    # 2020 has 366 days: day 365 is in 2020, held for 365 days
    assert got["a", "US"] == (2020, 100.0, 150.0, 500.0, 0.0, 450.0, 100.0, 0.0) and got["a", "Australia"][6] == 112.5
    assert got["a", "UK"] == (2020, 0.0, 0.0, 600.0, 150.0, 450.0, 90.0, 0.0) and got["a", "Germany"][6] == pytest.approx(118.6875)
    assert got["b", "US"] == (2020, 0.0, 5000.0, 0.0, 0.0, -5000.0, -1110.0, 2000.0) and got["b", "Canada"][6:] == (-1250.0, 0.0)
    assert got["c", "US"][1:4] == (6.0, 0.0, 0.0) and not any(s == "d" for s, _ in got)
    assert reviews.year_end(frame.where("false")).count() == 0
