"""Opinions, gates and vendors' responses against values worked by hand and a plain loop."""

import datetime as dt
import json
import random

import pytest

from tidemark.operators import engines
from tidemark.sources import quarantine, vendor

DAY = dt.datetime(2020, 1, 1)
OPINION = "symbol string, ts timestamp, regime string, engine string, score int, confidence double"


def test_labels_at_their_bounds(spark):
    want = {100: "strong_buy", 70: "strong_buy", 69: "buy", 30: "buy", 29: "weak_buy", 5: "weak_buy", 4: "neutral", -5: "neutral", -6: "weak_sell", -30: "weak_sell", -31: "sell", -70: "sell", -71: "strong_sell", None: None}
    rows = spark.createDataFrame([(k,) for k in want], "score int")
    assert {r.score: r.label for r in rows.withColumn("label", engines.label(rows.score)).collect()} == want


def test_ensemble_by_hand(spark):
    rows = [
        # 25 * 60 + 35 * 30 + 15 * -60 + 25 * 100 = 4150: 41; .75 of confidences less (160 / 200) * .3
        *[("a", DAY, "normal_bull", e, s, 0.75) for e, s in (("technical", 60), ("fundamental", 30), ("quantitative", -60), ("sentiment", 100))],
        # 15 * -60 + 35 * 30 = 150 over 50: 3; confidence .4 * .15 + .6 * .35 less .135 = .135
        ("b", DAY, "high_vol_bear", "technical", -60, 0.4), ("b", DAY, "high_vol_bear", "quantitative", 30, 0.6),
        # no regime; -30 * 20 / 20, cut towards zero stays; confidence .1 * .2 is raised
        ("c", DAY, None, "technical", -30, 0.1), ("c", DAY, None, "fundamental", None, 0.9), ("c", DAY, None, "oracle", 100, 0.9), ("c", DAY, None, "sentiment", 5, None),
        ("d", DAY, "x", "technical", None, 0.5),
    ]
    got = {r.symbol: (r.engines, r.score, r.label, round(r.confidence, 9), r.conviction) for r in engines.ensemble(spark.createDataFrame(rows, OPINION)).collect()}
    assert got == {"a": (4, 41, "buy", 0.51, "HIGH"), "b": (2, 3, "neutral", 0.135, "LOW"), "c": (1, -30, "weak_sell", 0.05, "LOW")}
    assert engines.ensemble(spark.createDataFrame([], OPINION)).count() == 0
    point = engines.point_in_time(spark.createDataFrame([("a", DAY, "low_vol_bull", "technical", 100, 0.9), ("a", DAY, "low_vol_bull", "quantitative", -60, 0.7)], OPINION)).first()
    assert (point.score, point.label, round(point.confidence, 9)) == (36, "buy", 0.82)


def test_ensemble_equals_a_loop(spark):
    rng, rows = random.Random(3), []
    for s in range(150):
        regime = rng.choice([*engines.WEIGHTS, None, "other"])
        for e in engines.WEIGHTS["unknown"]:
            if rng.random() < 0.8:
                rows.append((str(s), DAY, regime, e, rng.choice([None, -100, -60, -30, -20, -19, 0, 19, 20, 30, 60, 100]), rng.choice([None, 0.1, 0.5, 0.66, 0.9]), rng.choice([None, 0.1, 0.25, 0.6])))
    frame = spark.createDataFrame(rows, OPINION + ", share double")
    for learned in (None, "share"):
        want = {}
        for symbol in {r[0] for r in rows}:
            mine = [r for r in rows if r[0] == symbol and r[4] is not None and r[5] is not None]
            if not mine:
                continue
            table = engines.WEIGHTS.get(mine[0][2], engines.WEIGHTS["unknown"])
            w = [int(r[6] * 100) if learned and r[6] is not None else table[r[3]] for r in mine]
            score = int(sum(r[4] * k for r, k in zip(mine, w)) / sum(w))
            high, low = max(r[4] for r in mine), min(r[4] for r in mine)
            c = sum(r[5] * k / 100 for r, k in zip(mine, w)) - ((high - low) / 200 * 0.3 if high >= 30 and low <= -30 else 0)
            agree, mean = max(sum(r[4] >= 20 for r in mine), sum(r[4] <= -20 for r in mine)), sum(r[5] for r in mine) / len(mine)
            want[symbol] = (score, round(max(c, 0.05), 9), "HIGH" if agree >= 3 and mean > 0.65 else "MODERATE" if agree >= 2 and mean > 0.5 else "LOW")
        assert {r.symbol: (r.score, round(r.confidence, 9), r.conviction) for r in engines.ensemble(frame, learned=learned).collect()} == want


def test_tradable_and_gate(spark):
    rows = [
        (1, "buy", 0.6, 0.4, 90.0, 2.0, "up"), (2, "weak_sell", 0.5, -0.4, 90.0, 2.0, "down"), (3, "strong_buy", 0.97, 0.4, None, None, None), (4, "neutral", 0.9, None, None, None, None), (5, "sell", 0.49, None, None, None, None),
        (6, None, 0.9, None, None, None, None), (7, "buy", None, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, "id int, label string, confidence double, smart_money double, iv_percentile double, put_call_ratio double, gap string")
    got = {r.id: (r.side, round(r.confidence, 9), r.adjustments) for r in engines.tradable(frame).collect()}
    assert got == {1: ("BUY", 0.61, ["smart money", "high volatility", "high put call ratio", "gap"]), 2: ("SELL", 0.47, ["smart money against", "gap"]), 3: ("BUY", 0.98, ["smart money"])}
    assert {r.id: r.adjustments for r in engines.tradable(frame.select("id", "label", "confidence")).collect()} == {1: [], 2: [], 3: []}
    cases = [
        ("normal_bull", 0.5, 0.51, None, "ML_PASS"), ("normal_bull", 0.7, 0.5, None, "ORCH_OVERRIDE"), ("low_vol_bull", 0.5, 0.46, None, "ML_PASS"), ("low_vol_bear", 0.5, 0.6, None, "FAIL"), ("high_vol_bull", 0.7, 0.44, 0.65, "CONSENSUS"),
        ("normal_bear", 0.69, 0.40, None, "CONSENSUS"), ("normal_bear", 0.69, 0.40, 0.6, "FAIL"), (None, 0.55, None, None, "FALLBACK"), ("high_vol_x", 0.64, None, 0.9, "FAIL"), ("low_vol_bull", 0.5, None, None, "FALLBACK"), (None, None, None, None, "FAIL"),
    ]
    gates = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, regime string, confidence double, probability double, calibrated double, want string")
    assert [(r.reason, r.approved) for r in engines.gate(gates).orderBy("id").collect()] == [(c[4], c[4] != "FAIL") for c in cases]


def write(path, rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return str(path)


def test_statements_of_a_vendor(spark, tmp_path):
    def entry(year="2020", revenue=10.5, **more):
        income = {"revenues": {"value": revenue, "unit": "USD"}, "net_income_loss": {"value": 3}}
        return {"fiscal_period": "Q1", "fiscal_year": year, "financials": {"income_statement": income, "balance_sheet": {"assets": {"value": 7}}, "cash_flow_statement": {}}} | more

    path = write(
        tmp_path / "s.json",
        [
            {"symbol": "a", "body": {"status": "OK", "results": [entry(), entry("FY", None), entry(revenue="n/a"), entry(financials=None), {"fiscal_period": "Q1"}, 5]}}, {"symbol": "b", "body": {"results": []}}, {"symbol": "c", "body": {}},
            {"symbol": "d", "body": {"results": {"no": "list"}}}, {"symbol": "e", "body": "denied"}, {"symbol": "f", "body": None}, "{broken",
        ],
    )
    judged = vendor.judge(vendor.responses(spark, path), "statements")
    rows = judged.collect()
    assert [(r.symbol, r.reason) for r in rows] == [("a", None), ("a", None), ("a", None), ("a", "field"), ("a", "field"), ("a", "malformed"), ("d", "malformed"), ("e", "malformed"), ("f", "malformed"), (None, "malformed")]
    assert [(r.fiscal_year, r.revenue, r.net_income, r.total_assets, r.eps, r.cash_flow_operating) for r in rows[:3]] == [(2020, 10.5, 3.0, 7.0, None, None), (0, None, 3.0, 7.0, None, None), (2020, None, 3.0, 7.0, None, None)]
    assert rows[-1].raw == "{broken"
    assert quarantine.keep(judged, str(tmp_path / "kept"), "one") == quarantine.Judged(3, 7)


def test_news_of_a_vendor(spark, tmp_path):
    good = {"id": "1", "title": "t", "published_utc": "2020-01-01T02:00:00+02:00", "article_url": "u", "tickers": ["A", "B", "A", None, ""], "description": "ü" * 100_000}
    path = write(tmp_path / "n.json", [{"symbol": "A", "body": {"results": [good, good | {"published_utc": "soon", "keywords": ["k"]}, good | {"tickers": None}, {"id": 3}]}}])
    rows = vendor.judge(vendor.responses(spark, path), "news")
    got = rows.collect()
    assert [r.reason for r in got] == [None, None, "field", "field"]
    assert [(r.published_utc, r.keywords) for r in got[:2]] == [(DAY, []), (None, ["k"])] and len(got[0].description) == 100_000
    assert sorted(r.ticker for r in vendor.mentions(quarantine.accepted(rows)).collect()) == ["A", "A", "B", "B"]


FLAT = {
    "dividends": ({"cash_amount": 0.5, "ex_dividend_date": "2020-01-01", "frequency": 4}, {"cash_amount": 0.5, "frequency": 4, "pay_date": None}),
    "insiders": ({"name": "n", "transaction_type": "P", "shares": 3, "extra": 1}, {"name": "n", "shares": 3.0, "total_value": None}),
    "consensus": ({"consensus_rating": "buy", "buy_count": 3}, {"consensus_rating": "buy", "buy_count": 3, "contributors": None}),
    "ratings": ({"rating": "hold", "date": "2020-01-01"}, {"rating": "hold", "price_target": None, "date": "2020-01-01"}),
    "tickers": ({"ticker": "A"}, {"ticker": "A"}),
    "options": (
        {"details": {"contract_type": "put", "strike_price": 5, "expiration_date": "2020-02-30"}, "greeks": {"delta": -0.5}, "open_interest": 7, "day": {"volume": 2}},
        {"kind": "put", "strike": 5.0, "expiration": None, "delta": -0.5, "oi": 7, "volume": 2, "iv": None},
    ),
    "snapshots": (
        {"ticker": "A", "day": {"c": 2, "v": 5}, "prevDay": {"c": 1}, "lastTrade": {"p": 2, "s": 1, "t": 1577836800000}, "todaysChangePerc": 100},
        {"ticker": "A", "close": 2.0, "prev_close": 1.0, "open": None, "price": 2.0, "traded": DAY, "change_percent": 100.0},
    ),
}


@pytest.mark.parametrize("kind", sorted(FLAT))
def test_other_lists_of_a_vendor(spark, kind):
    entry, want = FLAT[kind]
    bodies = [("x", json.dumps({vendor.KINDS[kind].entries: [entry, "no entry"]})), (None, None), ("y", "")]
    rows = vendor.judge(spark.createDataFrame(bodies, "symbol string, body string"), kind).collect()
    assert [r.reason for r in rows] == [None, "malformed", "malformed", "malformed"]
    assert {c: rows[0][c] for c in want} == want
    assert vendor.judge(spark.createDataFrame([], "symbol string, body string"), kind).count() == 0
