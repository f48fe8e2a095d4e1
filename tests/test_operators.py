"""Operators against small series with known results, plain folds, the portable SQL and streams."""

import datetime as dt
import random

import duckdb
import pytest

from tidemark import registry
from tidemark.operators import fitted, lots, recursive
from tidemark.plans import MODULES
from tidemark.sources.views import view
from tidemark.streaming import bars as live

SF = "/root/testdata/sf0.001"
OPS = {op.name: op for m in MODULES for op in m.OPERATORS}
TABLES = "customer nation region supplier part orders lineitem events documents labels embeddings pages benchmark conversations".split()


def series(spark, closes, symbol="a"):
    day = dt.datetime(2024, 1, 1)
    rows = [(symbol, day + dt.timedelta(days=i), float(c), c + 2.0, c - 2.0, float(c), 10.0, i) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, seq int")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted({*OPS, "garch", "cusum", "ewma_chart", "average_cost", "event_bars", "sliding_volume"}))
def test_equals_portable_sql(spark, con, name):
    got = registry.queries()[name](spark, SF)
    want = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(float(x) if type(x).__name__ == "Decimal" else x for x in r) for r in got.select(names).collect()), key=key)
    b = sorted((tuple(float(x) if type(x).__name__ == "Decimal" else x for x in r) for r in want.fetchall()), key=key)
    assert sorted(got.columns) == sorted(names) and len(a) == len(b)
    for x, y in zip(a, b):
        assert all(u == v or isinstance(u, float) and u == pytest.approx(v, rel=1e-5, abs=1e-6) for u, v in zip(x, y)), (x, y)


def test_sma_is_null_until_warm(spark):
    rows = OPS["sma"](series(spark, range(1, 26))).orderBy("ts").collect()
    assert [r.sma20 for r in rows[:19]] == [None] * 19 and rows[19].sma20 == 10.5


def test_ema_starts_at_the_mean(spark):
    got = [r.ema for r in recursive.ema(series(spark, [22, 24, 23, 25, 26]), 3).orderBy("ts").collect()]
    assert got == [None, None, 23.0, 24.0, 25.0]


def walk(n, seed=5):
    rng = random.Random(seed)
    closes = [100.0]
    for _ in range(n):
        closes.append(closes[-1] * (1 + rng.uniform(-0.05, 0.05)))
    return closes


def test_rsi_equals_a_plain_fold(spark):
    closes = walk(60)
    got = [r.rsi for r in recursive.rsi(series(spark, closes), 14).orderBy("ts").collect()]
    up = down = 0.0
    for i, (a, b) in enumerate(zip(closes, closes[1:]), 1):
        gain, loss = max(b - a, 0), max(a - b, 0)
        up, down = (up + gain / 14, down + loss / 14) if i <= 14 else ((up * 13 + gain) / 14, (down * 13 + loss) / 14)
        assert got[i] is None if i <= 14 else got[i] == pytest.approx(100 - 100 / (1 + up / down))
    flat = [r.rsi for r in recursive.rsi(series(spark, range(1, 40)), 14).orderBy("ts").collect()]
    assert flat[-1] == pytest.approx(100 - 100 / 101)


def test_macd_atr_adx_keltner_equal_plain_folds(spark):
    rng = random.Random(1)
    closes = walk(80, 3)
    bars = series(spark, closes)
    rows = bars.orderBy("ts").collect()
    k = lambda n: 2 / (n + 1)

    def ema(x, n):
        out = [None] * (n - 1) + [sum(x[:n]) / n]
        for v in x[n:]:
            out.append(out[-1] + k(n) * (v - out[-1]))
        return out

    fast, slow = ema(closes, 12), ema(closes, 26)
    line = [a - b if b is not None else None for a, b in zip(fast, slow)]
    signal = [None] * 25 + ema([x for x in line if x is not None], 9)
    got = recursive.macd(bars).orderBy("ts").collect()
    for g, a, b in zip(got, line, signal):
        assert g.line == (a if a is None else pytest.approx(a)) and g.signal == (b if b is None else pytest.approx(b))
    tr = [max(r.high - r.low, abs(r.high - p.close), abs(r.low - p.close)) for p, r in zip(rows, rows[1:])]
    want = [None] * 14 + [sum(tr[:14]) / 14]
    for t in tr[14:]:
        want.append((want[-1] * 13 + t) / 14)
    got = [r.atr for r in recursive.atr(bars).orderBy("ts").collect()]
    assert [g is None for g in got] == [w is None for w in want] and got[14:] == pytest.approx(want[14:])
    up = [max(r.high - p.high, 0) if r.high - p.high > p.low - r.low else 0 for p, r in zip(rows, rows[1:])]
    down = [max(p.low - r.low, 0) if p.low - r.low > r.high - p.high else 0 for p, r in zip(rows, rows[1:])]
    a, b, c = sum(up[:14]), sum(down[:14]), sum(tr[:14])
    dx, plus = [], []
    for i in range(14, len(tr)):
        a, b, c = a - a / 14 + up[i], b - b / 14 + down[i], c - c / 14 + tr[i]
        plus.append(100 * a / c)
        dx.append(100 * abs(a - b) / (a + b))
    index = [sum(dx[:14]) / 14]
    for x in dx[14:]:
        index.append((index[-1] * 13 + x) / 14)
    got = recursive.adx(bars).orderBy("ts").collect()
    assert [r.plus_di for r in got][15:] == pytest.approx(plus) and [r.adx for r in got][28:] == pytest.approx(index) and got[27].adx is None
    middle = ema(closes, 20)
    got = recursive.keltner(bars, 20, 14, 2).orderBy("ts").collect()
    assert all(g.upper == pytest.approx(m + 2 * w) and g.lower < g.middle < g.upper for g, m, w in list(zip(got, middle, want))[19:])
    every = recursive.indicators(bars).orderBy("ts").collect()
    assert every[-1].adx == pytest.approx(index[-1]) and every[-1].atr14 == pytest.approx(want[-1]) and every[-1].signal == pytest.approx(signal[-1]) and rng


def test_garch_equals_a_plain_fold(spark):
    closes = walk(40)
    r = [b / a - 1 for a, b in zip(closes, closes[1:])]
    v = sum(x * x for x in r) / len(r)
    for x in r:
        v = 1e-5 + 0.1 * x * x + 0.85 * v
    assert recursive.garch(series(spark, closes)).first().forecast == pytest.approx(100 * (252 * (1e-5 + 0.1 * r[-1] ** 2 + 0.85 * v)) ** 0.5)


def test_drawdown(spark):
    row = OPS["drawdown"](series(spark, [100, 110, 105, 95, 100, 115, 108])).first()
    assert (row.max_drawdown, row.current_drawdown) == (round(15 / 110, 6), round(7 / 115, 6))


def values(spark, x):
    day = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("a", day + dt.timedelta(days=i), float(v)) for i, v in enumerate(x)], "symbol string, ts timestamp_ntz, value double")


def test_cusum_sees_a_step(spark):
    assert recursive.cusum(values(spark, [1.0] * 50 + [-1.0] * 50)).where("change = -1").count() > 0
    assert recursive.cusum(values(spark, [0.5] * 100)).where("change <> 0").count() == 0
    assert recursive.cusum(values(spark, [9.0, -9.0] * 5)).where("change <> 0").count() == 0
    chart = recursive.ewma_chart(values(spark, walk(50))).orderBy("ts").collect()
    assert all(r.low < r.high for r in chart) and chart[-1].high - chart[-1].low > chart[0].high - chart[0].low


def test_breaks_of_a_step(spark):
    closes = [100.0]
    for i in range(60):
        closes.append(closes[-1] * (1 + (0.01 if i < 30 else 0.2) + 0.001 * (i % 2)))
    row = OPS["breaks"](series(spark, closes)).first()
    assert row.split == 30 and row.is_break


def trades(spark, rows):
    return spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), side, float(n), float(p), 0.0, i, 1, 1) for i, (side, n, p) in enumerate(rows)],
        "symbol string, ts timestamp_ntz, side string, shares double, price double, pnl double, id long, line int, part long",
    )


def test_fifo_equals_a_plain_loop(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["buy", "sell"]), rng.randint(1, 900), rng.randint(1, 90)) for _ in range(120)]
    lots, want = [], []
    for k, (side, n, _) in enumerate(rows, 1):
        if side == "buy":
            lots.append([k, n])
            continue
        while n and lots:
            take = min(n, lots[0][1])
            want.append((lots[0][0], k, float(take)))
            lots[0][1] -= take
            n -= take
            if not lots[0][1]:
                lots.pop(0)
    got = OPS["fifo_lots"](trades(spark, rows)).select("buy_no", "sell_no", "shares").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_fifo_of_large_lots(spark):
    rows = [("buy", 10000, 5)] + [("sell", 1000, 6)] * 10 + [("buy", 300, 5), ("buy", 12000, 7), ("sell", 12300, 8)]
    got = OPS["fifo_lots"](trades(spark, rows)).select("buy_no", "sell_no", "shares", "realised").collect()
    want = [(1, k, 1000.0, 1000.0) for k in range(2, 12)] + [(12, 14, 300.0, 900.0), (13, 14, 12000.0, 12000.0)]
    assert sorted(map(tuple, got)) == want


def test_lifo_and_average_cost(spark):
    rows = [("sell", 5, 9), ("buy", 10, 5), ("buy", 10, 8), ("sell", 12, 10), ("sell", 20, 6)]
    got = lots.lifo_lots(trades(spark, rows)).select("buy_no", "sell_no", "shares", "realised").collect()
    assert sorted(map(tuple, got)) == [(2, 4, 2.0, 10.0), (2, 5, 8.0, 8.0), (3, 4, 10.0, 20.0)]
    row = lots.average_cost(trades(spark, rows)).first()
    assert (row.held, row.cost) == (0.0, 0.0) and row.realised == pytest.approx(12 * 3.5 + 8 * -0.5)


def test_open_lots_are_what_fifo_leaves(spark):
    rows = [("buy", 10, 150), ("buy", 5, 160), ("sell", 8, 170)]
    got = OPS["open_lots"](trades(spark, rows)).select("buy_no", "shares", "unrealised").collect()
    assert sorted(map(tuple, got)) == [(1, 2.0, 40.0), (2, 5.0, 50.0)]


def test_candles(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(10.0, 10.6, 7.0, 10.5), (10.5, 14.0, 10.4, 11.0), (12.0, 12.1, 9.9, 10.0), (9.0, 9.2, 8.8, 9.0), (9.5, 12.0, 9.4, 11.5)]
    bars = spark.createDataFrame([("a", day + dt.timedelta(days=i), o, h, lo, c, 1.0, i) for i, (o, h, lo, c) in enumerate(rows)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, seq int")
    got = {(r.seq, r.pattern) for r in OPS["candles"](bars).collect()}
    # bar 2 opens at 12 over the close of 11 and closes at 10 under the open of 10.5
    assert got == {(0, "hammer"), (1, "inverted hammer"), (1, "shooting star"), (2, "bearish engulfing"), (3, "doji"), (4, "morning star")}


def test_fitted_operators(spark):
    rng = random.Random(3)
    frame = spark.createDataFrame([("a" if i % 2 else "b", rng.gauss(0.5 if i % 2 else -0.5, 1), i) for i in range(600)], "key string, value double, id long")
    got = {r.key: r for r in fitted.bootstrap(frame, 100).collect()}
    assert 0.3 < got["a"].sharpe_low < 0.5 < got["a"].sharpe_high < 0.75 and got["b"].win_rate_high < 0.4
    again = {r.key: r for r in fitted.bootstrap(frame.repartition(5), 100).collect()}
    assert again["a"].sharpe_low == pytest.approx(got["a"].sharpe_low)
    p = spark.createDataFrame([(i, "s", c, int(rng.random() < c * c)) for i, c in enumerate([(i % 99 + 0.5) / 100 for i in range(990)])], "id long, source string, confidence double, outcome int")
    curve = fitted.isotonic(p).orderBy("confidence").toPandas()
    assert curve["calibrated"].is_monotonic_increasing and abs(curve["calibrated"].iloc[500] - 0.25) < 0.12
    assert fitted.platt(p).first().slope > 0.5 and fitted.platt(p.limit(0)).count() == 0


def test_wash_sales_equal_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(900), rng.choice(["buy", "sell"]), rng.choice([-900.0, -200.0, -199.5, -0.25, 0.0, 40.0])) for _ in range(150)]
    day = dt.datetime(2024, 1, 1)
    frame = spark.createDataFrame(
        [(s, day + dt.timedelta(days=d), side, 1.0, 1.0, pnl, i, 1, 1) for i, (s, d, side, pnl) in enumerate(rows)],
        "symbol string, ts timestamp_ntz, side string, shares double, price double, pnl double, id long, line int, part long",
    )
    want = []
    for i, (s, d, side, pnl) in enumerate(rows):
        near = [b for t, b, what, _ in rows if t == s and what == "buy" and abs(b - d) <= 30]
        if side == "sell" and pnl < 0 and near:
            want.append((s, i, pnl, day + dt.timedelta(days=min(near))))
    got = OPS["wash_sales"](frame).select("symbol", "id", "loss", "purchase").collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(-200 < w[2] < 0 for w in want)


def test_stream_of_bars_equals_the_batch(spark, tmp_path):
    ticks = view(spark, SF, "events").selectExpr("event_type as symbol", "cast(ts as timestamp) as ts", "value as price", "1.0D as size")
    ticks.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    out = live.tumbling_bars(stream).writeStream.format("memory").queryName("live_bars").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    out.awaitTermination()
    got, want = (sorted(map(tuple, df.drop("vwap").collect())) for df in (spark.table("live_bars"), live.tumbling_bars(ticks)))
    assert got == want and len(got) > 10


def test_streams_of_feeds_quotes_and_stops(spark, tmp_path):
    lines = [("{\"ev\":\"T\",\"sym\":\"A\",\"t\":%d,\"p\":%f,\"s\":1}" % (1700000000000 + 60000 * i, p)) for i, p in enumerate([10.0, 12.0, 11.0, 10.5, 13.0])]
    lines += ["nonsense", "{\"ev\":\"X\"}", "{\"ev\":\"Q\",\"sym\":\"B\",\"t\":1700000000000,\"bp\":1,\"ap\":3}"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(str(tmp_path / "in"))
    ticks = live.feed(spark.readStream.text(str(tmp_path / "in")))
    for name, frame in (("quotes_now", live.latest_quotes(ticks)), ("stops_now", live.stops(ticks.select("symbol", "ts", "price")))):
        frame.writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
    assert {r.symbol: r.price for r in spark.table("quotes_now").collect()} == {"A": 13.0, "B": 2.0}
    assert {r.symbol: (r.high, r.hit) for r in spark.table("stops_now").collect()} == {"A": (13.0, True), "B": (2.0, False)}


def test_news_before_moves_and_statistics(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    quotes = spark.createDataFrame([("a", at(10), 5.0), ("a", at(30), 1.0), ("b", at(10), 2.0)], "symbol string, ts timestamp, change double")
    news = spark.createDataFrame([("a", at(5), 1), ("a", at(3), 2), ("a", at(11), 3), ("b", at(10), 4)], "symbol string, published timestamp, id int")
    for name, frame in (("q", quotes), ("n", news)):
        frame.coalesce(1).write.parquet(str(tmp_path / name))
    streams = [spark.readStream.schema(f.schema).parquet(str(tmp_path / n)) for n, f in (("q", quotes), ("n", news))]
    live.news_before_moves(*streams).writeStream.format("memory").queryName("near_news").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert sorted(r.id for r in spark.table("near_news").collect()) == [1, 4] == sorted(r.id for r in live.news_before_moves(quotes, news).collect())
    row = live.strategy_statistics(spark.createDataFrame([("s", 2.0), ("s", -1.0), ("s", 4.0)], "strategy string, pnl double")).first()
    assert (row.wins, row.losses, row.pnl, row.profit_factor) == (2, 1, 5.0, 6.0)


def test_alerts_do_not_repeat(spark, tmp_path):
    events = view(spark, SF, "events").selectExpr("event_id", "value")
    events.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        live.alerts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), 10.0).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.where("value > 10").count()


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
