"""Correlations by blocks against the statements and plain numbers."""

import datetime as dt
import random

import pytest

from tidemark.operators import market, pairs

OPS = {op.name: op for op in market.OPERATORS}
START = dt.datetime(2020, 1, 1)


def bars_of(spark, symbols=70, days=160, seed=3):
    rng = random.Random(seed)
    move = [rng.gauss(0, 0.01) for _ in range(days)]
    rows = []
    for s in range(symbols):
        close, skipped = 100.0, rng.random() * 0.5
        for d in range(days):
            close *= 1 + move[d] * (1 if s % 3 else -1) + rng.gauss(0, 0.01)
            if rng.random() > skipped:
                rows.append((s, START + dt.timedelta(days=d), close))
    rows += [(400, START + dt.timedelta(days=d), 5.0) for d in range(days)]  # has no spread; of sector 4
    rows += [(401, START + dt.timedelta(days=d), 5.0 + d % 7) for d in range(50)]  # has too few days
    return spark.createDataFrame(rows, "symbol bigint, ts timestamp_ntz, close double")


@pytest.mark.parametrize("returns", [pairs.RETURNS, 1200, 1])
def test_blocks_equal_the_statements(spark, returns):
    bars = bars_of(spark)
    spread = bars.where("symbol < 400")
    want = sorted(tuple(r) for r in OPS["correlations"](spread).collect())
    got = sorted(tuple(r) for r in pairs.correlations(bars, returns).collect() if 400 not in r[:2])
    assert got == want and len(want) > 24
    flat = [r for r in pairs.correlations(bars, returns).collect() if 400 in r[:2]]
    assert flat and all(r.correlation != r.correlation for r in flat)
    want = sorted(tuple(r) for r in OPS["substitutes"](spread).collect())
    got = sorted(tuple(r) for r in pairs.substitutes(bars, returns=returns).collect())
    assert got == want and {r[1] for r in want} == {1, 2, 3}


def test_no_number_in_one_series_leaves_the_others(spark):
    bars = bars_of(spark)
    odd = bars.selectExpr("symbol", "ts", "case when symbol = 1 and day(ts) = 3 then double('NaN') else close end as close")
    got = {(r.one, r.two): (r.days, r.correlation) for r in pairs.correlations(odd).collect()}
    want = {(r.one, r.two): (r.days, r.correlation) for r in pairs.correlations(bars).collect() if 400 not in (r.one, r.two)}
    assert any(1 in p for p in want)
    for p, x in want.items():
        assert got[p][0] == x[0] and (got[p][1] != got[p][1] if 1 in p else got[p] == x)


def test_no_row_is_made_of_a_pair_and_a_day(spark):
    """The number of rows that are shuffled is bounded by the number of series and blocks."""
    bars = bars_of(spark)
    assert pairs.packed(bars).count() <= 71 and pairs.packed(bars, returns=1).count() <= 71 * 8
    assert pairs.correlations(bars.where("false")).count() == 0 and pairs.substitutes(bars.where("false")).count() == 0
