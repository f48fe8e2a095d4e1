"""Judged loads, nested JSON, breaks, arrays of bars and phrases against plain Python and tables worked by hand."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import nested, phrases, series
from tidemark.sources import quarantine

DAY = dt.datetime(2020, 1, 1)


def test_every_line_is_accepted_or_rejected(spark, tmp_path):
    lines = [
        "symbol,action,shares,price,date,commission,notes", " aapl ,BUY,10,1.5,2020-01-01,0.5,first", "msft,sell,5,none,2020-01-02", ",buy,1,1,2020-01-01,,", "x,buy,1,1, ,,", "x,buy,0,1,2020-01-01,,",
        "x,buy,many,1,2020-01-01,,", "x,hold,1,1,2020-01-01,,", 'y,buy,2,3,2020-01-03,,"a, b",more', "x,buy,NaN,1,2020-01-01,,", "x,buy,Infinity,1,2020-01-01,,", "x",
    ]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    judged = quarantine.judge_trades(spark, str(tmp_path / "in.csv"))
    rows = judged.collect()
    assert [r.reason for r in rows] == [None, None, "symbol", "date", "shares", "shares", "action", None, "shares", "shares", "date"]
    good = [r for r in rows if r.reason is None]
    assert [(r.symbol, r.action, r.shares, r.price, r.commission, r.notes) for r in good] == [("AAPL", "buy", 10.0, 1.5, 0.5, "first"), ("MSFT", "sell", 5.0, 0.0, None, None), ("Y", "buy", 2.0, 3.0, None, "a, b")]
    assert rows[-1].raw == "x" and rows[7].raw == lines[8]
    for _ in range(2):  # the same load again is the same load
        assert quarantine.keep(judged, str(tmp_path / "kept"), "monday") == quarantine.Judged(3, 8)
        assert spark.read.parquet(str(tmp_path / "kept")).count() == len(lines) - 1
    assert quarantine.keep(quarantine.judge_trades(spark, str(tmp_path / "in.csv")), str(tmp_path / "kept"), "tuesday").accepted == 3
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 2 * (len(lines) - 1)


def test_every_message_is_accepted_or_rejected(spark):
    t = '{"ev":"T","sym":"a","p":2.5,"s":3,"t":1000}'
    lines = [
        ("[" + t + ',{"ev":"Q","sym":"b","bp":1,"ap":2,"t":2000}]', [None, None]), (t, [None]), ("[]", ["malformed"]), ("no json", ["malformed"]), ('[{"ev":"T"', ["malformed"]), (None, ["malformed"]), ("", ["malformed"]),
        ('[{"ev":"status","message":"m"},' + t + "]", ["kind", None]), ('{"ev":"T","sym":"a","p":2.5,"t":1}', ["field"]), ('{"ev":"T","sym":"a","p":"two","s":1,"t":1}', ["field"]), ('{"ev":"T","sym":"a","p":0,"s":1,"t":1}', ["price"]),
        ('{"ev":"Q","sym":"b","bp":1,"t":2000}', ["field"]), ("[1]", ["malformed"]),
    ]
    judged = quarantine.judge_feed(spark.createDataFrame([(v,) for v, _ in lines], "value string"))
    rows = judged.collect()
    assert [r.reason for r in rows] == [x for _, want in lines for x in want]
    assert [(r.kind, r.symbol, r.price, r.size, r.bid, r.ask) for r in rows[:2]] == [("T", "a", 2.5, 3.0, None, None), ("Q", "b", 1.5, 0.0, 1.0, 2.0)]
    assert quarantine.accepted(judged).count() + quarantine.rejected(judged).count() == len(rows)


CONTEXTS = [
    (1, "a", 5.0, "win", "high", '["flow (+3)","macro"]'), (1, "b", -2.0, "loss", "high", '["flow (-1)", "flow"]'), (1, "c", 9.0, "rejected", None, '["macro(1)"]'), (1, "d", 7.0, None, "low", "[]"),
    (2, "a", None, "win", "low", None), (2, "b", 1.0, "win", "low", '["macro"'), (3, None, None, None, None, None),
]


def test_adjustments_by_outcome_and_day(spark):
    rows = spark.createDataFrame([(DAY.date() + dt.timedelta(days=d - 1), *r) for d, *r in CONTEXTS], "day date, symbol string, pnl double, outcome string, tier string, signal_adjustments string")
    got = {r.adjustment: (r.total, r.wins, r.win_rate) for r in nested.adjustment_outcomes(rows).collect()}
    assert got == {"flow": (3, 1, pytest.approx(1 / 3)), "macro": (1, 1, 1.0)}
    days = nested.daily_snapshot(rows).orderBy("day").collect()
    assert [(r.signals, r.best_symbol, r.best_pnl, r.worst_symbol, r.worst_pnl) for r in days] == [(4, "a", 5.0, "b", -2.0), (2, "b", 1.0, "b", 1.0), (1, None, None, None, None)]
    assert [json.loads(r.tiers) for r in days] == [{"high": 2, "low": 1, "UNKNOWN": 1}, {"low": 2}, {"UNKNOWN": 1}]
    assert json.loads(days[0].adjustments) == {"flow": 3, "macro": 2} and days[1].adjustments is None
    assert nested.adjustment_outcomes(rows.limit(0)).count() == 0 and nested.daily_snapshot(rows.limit(0)).count() == 0


def test_tear_sheets_are_whole_documents(spark):
    deals = spark.createDataFrame([("s", DAY, 3.0), ("s", DAY + dt.timedelta(days=40), -1.0), ("s", DAY + dt.timedelta(days=1), 2.0), ("t", DAY, 1.0)], "strategy string, exit_date timestamp_ntz, pnl double")
    sheets = nested.tear_sheets(deals)
    s, t = (json.loads(r.document) for r in sheets.orderBy("strategy").collect())
    assert s == {
        "strategy": "s", "summary": {"trades": 3, "pnl": 4.0, "win_rate": pytest.approx(2 / 3), "profit_factor": 5.0}, "extremes": {"best": 3.0, "worst": -1.0},
        "months": [{"month": "2020-01", "trades": 2, "pnl": 5.0}, {"month": "2020-02", "trades": 1, "pnl": -1.0}],
    }
    assert "profit_factor" not in t["summary"]
    assert nested.read_tear_sheets(sheets).count() == 3


def loop_breaks(values, segment):
    def rss(x):
        return sum((v - sum(x) / len(x)) ** 2 for v in x)

    found, n = [], len(values)
    for i in range(segment, n - segment):
        parts, whole = rss(values[:i]) + rss(values[i:]), rss(values)
        f = (whole - parts) / 2 / (parts / (n - 4)) if parts > 0 else float("inf") if whole > 0 else 0
        if f > 10 and (not found or i - found[-1] >= segment):
            found.append(i)
    return found


def test_all_breaks_equal_a_loop(spark):
    rng = random.Random(3)
    made = {
        "two": [0.0] * 30 + [10.0] * 30, "three": [rng.gauss(m, 1) for m in (0, 5, 10, 15) for _ in range(25)], "noise": [rng.gauss(0, 1) for _ in range(80)], "flat": [2.0] * 50, "short": [0.0, 9.0] * 5,
        "far": [1e4 + rng.gauss(m, 1) for m in (0, 2, 0) for _ in range(30)],
    }
    rows = spark.createDataFrame([(k, i, v) for k, x in made.items() for i, v in enumerate(x)], "symbol string, i int, value double").repartition(3)
    got = {}
    for r in series.breaks(rows).collect():
        got.setdefault(r.symbol, []).append(r.split)
    want = {k: loop_breaks(x, 10) for k, x in made.items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert len(want["three"]) >= 3 and want["two"]
    assert series.breaks(rows.limit(0)).count() == 0


@pytest.mark.parametrize("stride", [1, 3])
def test_sequences_are_slices(spark, stride):
    closes = [100 + 3 * ((7 * i) % 5) * (i % 3) for i in range(20)]
    rows = [(s, DAY + dt.timedelta(days=i), float(i), float(i), float(i), float(c), 1.0, i) for s, n in (("a", 20), ("b", 7), ("c", 6)) for i, c in enumerate(closes[:n])]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, seq int")
    got = {(r.symbol, (r.ts - DAY).days): r for r in series.sequences(bars, 4, 3, stride).collect()}
    assert set(got) == {("a", i) for i in range(0, 14, stride)} | {("b", 0)}
    for (_, i), r in got.items():
        assert [(b.open, b.close) for b in r.context] == [(float(j), closes[j]) for j in range(i, i + 4)]
        assert r.target == closes[i + 4 : i + 7]
        steps = [(closes[j] - closes[j - 1]) / closes[j - 1] for j in range(i + 4, i + 7)]
        assert r.direction == ["up" if x > 0.001 else "down" if x < -0.001 else "neutral" for x in steps]


LEXICON = [("good", "positive"), ("go", "positive"), ("bad", "negative"), ("not", "negation"), ("very good", "positive"), ("aa", "negative"), ("", "positive"), (None, "positive"), ("good", "topic"), (".", "topic"), ("größe", "positive")]


def test_phrases_equal_a_plain_search(spark):
    rng = random.Random(5)
    texts = ["", None, "good", "Very  GOOD, good.not aaa aaaa", "größe Größe", "." * 5] + [" ".join(rng.choice("good go goodgo bad, not. very aaaa x".split(" ")) for _ in range(rng.randrange(60))) for _ in range(30)] + ["very good " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("phrase", F.lit("clash")).repartition(3)
    lexicon = spark.createDataFrame(LEXICON, "phrase string, kind string")
    held = {p for p, _ in LEXICON if p}
    want, counts, whole = set(), {}, set()
    for d, t in enumerate(texts):
        t = (t or "").lower()
        for p in held:
            for m in re.finditer(f"(?={re.escape(p)})", t):
                want.update((d, p, k, m.start()) for q, k in LEXICON if q == p)
            counts[d, p] = t.count(p)
        words = [w for w in re.split(r"[\s,;.!?]+", t) if w]
        for p in held - {"."}:
            n = len(p.split())
            whole.update((d, i, p, k) for i in range(len(words)) if words[i : i + n] == p.split() for q, k in LEXICON if q == p)
    found = phrases.find(docs, lexicon).collect()
    assert {(r.doc_id, r.phrase, r.kind, r["at"]) for r in found} == want and len(found) == len(want)
    got = {(r.doc_id, r.phrase): r.n for r in phrases.phrase_counts(docs, lexicon.where("kind <> 'topic' or phrase = '.'")).collect()}
    assert got == {k: n for k, n in counts.items() if n}
    rows = phrases.hits(docs, lexicon).collect()
    assert {tuple(r) for r in rows} == whole and len(rows) == len(whole)
    assert phrases.find(docs, lexicon.limit(0)).count() == 0 and phrases.hits(docs.limit(0), lexicon).count() == 0


def test_a_lexicon_that_is_too_large_is_joined(spark):
    docs = spark.createDataFrame([(1, "Good, bad very good"), (2, None), (3, "x")], "doc_id int, text string")
    lexicon = spark.createDataFrame(LEXICON, "phrase string, kind string")
    small = {tuple(r) for r in phrases.hits(docs, lexicon).collect()}
    joined = phrases.hits(docs, lexicon.where("phrase not like '% %'"), 60).collect()
    assert {tuple(r) for r in joined} == {r for r in small if " " not in r[2]}
    with pytest.raises(ValueError):
        phrases.find(docs, lexicon, most_bytes=60)


def test_articles_by_hand(spark):
    news = [(1, "good", "not a good bad", ["good", "bad good"]), (2, None, None, None), (3, "not", "good", []), (4, "not one two three good", "x", None)]
    rows = spark.createDataFrame(news, "id int, title string, description string, keywords array<string>")
    got = {r.id: r.score for r in phrases.articles(rows, spark.createDataFrame([r for r in LEXICON if r[0] in ("good", "bad", "not")], "phrase string, kind string")).collect()}
    # 1: title 2, description -1 + 1, keywords .5 and 0; 3: a negation does not reach into another field; 4: it stands four before
    assert got == {1: 2.5, 2: 0.0, 3: 1.0, 4: 2.0}


def test_keywords_count_inside_words(spark):
    docs = spark.createDataFrame([(1, "Goodness: good bad"), (2, None), (3, "aaa")], "doc_id int, text string")
    got = {r.doc_id: (r.positive, r.negative, r.sentiment) for r in phrases.keyword_counts(docs, spark.createDataFrame([r for r in LEXICON if r[0] in ("good", "bad", "aa") and r[1] != "topic"], "phrase string, kind string")).collect()}
    assert got == {1: (2, 1, pytest.approx(1 / 3)), 2: (0, 0, 0.0), 3: (0, 1, -1.0)}

def test_topics_of_odd_rows_are_those_of_the_statement(spark):

    from tests.test_operators import OPS
    from tidemark.plans import FORMS

    rng, vocabulary = random.Random(8), ["alpha", "beta", "Gamma", "gamma", "no", "früh", "delta,", "echo!", "zeta", "eta."]
    rows = [(i % 50 if i % 50 < 6 else i, rng.choice(["en", "de", None]), " ".join(rng.choices(vocabulary, k=rng.randint(0, 7)))) for i in range(200)]
    rows += [(None, "en", "lonely words"), (900, "en", None), (901, "fr", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    for some in (docs, docs.where("doc_id >= 6 or doc_id is null")):
        got, want = FORMS["topics"](phrases.words(some), some), OPS["topics"](phrases.words(some), some)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.dtypes == want.dtypes


def test_topics_shuffle_no_word_of_a_document(spark):
    from tidemark.plans import FORMS

    docs = spark.createDataFrame([(1, "en", "alpha beta alpha")], "doc_id bigint, lang string, text string")
    plan = FORMS["topics"](phrases.words(docs), docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "count(distinct" not in plan
