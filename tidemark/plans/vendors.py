"""Queries over vendors' responses and tables of opinions: responses are made from the given tables, stored, read back and judged."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.operator import doubles
from ..operators import engines
from ..registry import query
from ..sources import store, vendor
from ..sources.views import portable_views, view

#: Opinions of four engines at every bar from the twentieth on, as one text for both engines: the close beside its mean of twenty, momentum of
#: twenty bars, the day's volume and the bar's body. Every seventh bar has no opinion on volume.
OPINIONS = """select symbol, ts, concat(case when sd > .2 * m then 'high_vol' when sd < .05 * m then 'low_vol' else 'normal' end, case when close > 1.02 * m then '_bull' when close < .98 * m then '_bear' else '_sideways' end) as regime, engine,
    cast(greatest(-100, least(100, case engine when 'technical' then floor(round(300 * (close / m - 1), 6)) when 'quantitative' then floor(round(200 * (close / back - 1), 6)) when 'sentiment' then floor(round(150 * (close / open - 1), 6))
        when 'fundamental' then floor(round(60 * (volume / v - 1), 6)) end)) as integer) as score,
    case engine when 'technical' then .5 + .4 * (seq % 11) / 10 when 'quantitative' then .45 + .5 * (seq % 7) / 6 when 'sentiment' then .6 + .3 * (seq % 5) / 4 when 'fundamental' then case when seq % 7 = 0 then null else .55 + .4 * (seq % 3) / 2 end end as confidence
    from (select symbol, ts, seq, open, close, volume, avg(close) over (partition by symbol order by seq rows between 19 preceding and current row) as m, stddev_samp(close) over (partition by symbol order by seq rows between 19 preceding and current row) as sd,
        avg(volume) over (partition by symbol order by seq rows between 19 preceding and current row) as v, lag(close, 19) over (partition by symbol order by seq) as back from bars) b cross join (select unnest(['technical', 'fundamental', 'quantitative', 'sentiment']) as engine) e where seq >= 19"""
#: Weights as rows, for another engine.
WEIGHTS = "w(r, engine, w) as (values " + ", ".join(f"('{r}', '{e}', {w})" for r, of in engines.WEIGHTS.items() for e, w in of.items()) + ")"
LABEL = "case when score >= 70 then 'strong_buy' when score >= 30 then 'buy' when score >= 5 then 'weak_buy' when score >= -5 then 'neutral' when score >= -30 then 'weak_sell' when score >= -70 then 'sell' else 'strong_sell' end"
UNIFIED = f"""o as materialized ({OPINIONS}), {WEIGHTS}, g as (select symbol, ts, regime, count(*) as engines, sum(score * w) as s, sum(w) as w, sum(confidence * w / 100) as c, max(score) as high, min(score) as low, avg(confidence) as mean,
    greatest(count(*) filter (where score >= 20), count(*) filter (where score <= -20)) as agree from o join w on o.regime = w.r and o.engine = w.engine where confidence is not null group by symbol, ts, regime),
u as (select symbol, ts, regime, engines, cast(trunc(s / w) as integer) as score, greatest(.05, c - case when high >= 30 and low <= -30 then (high - low) / 200.0 * .3 else 0 end) as confidence,
    case when agree >= 3 and mean > .65 then 'HIGH' when agree >= 2 and mean > .5 then 'MODERATE' else 'LOW' end as conviction from g),
l as materialized (select *, {LABEL} as label from u)"""


def _with(names: str) -> str:
    return ", ".join(f"{n} as ({text})" for n, text in portable_views(names.split()).items())


def opinions(spark, sf_dir):
    """(symbol, ts, regime, engine, score, confidence) of the given tables: a bar is made once and its four opinions exploded from it."""
    inner = OPINIONS[OPINIONS.index("from (") + 6 : OPINIONS.index(") b cross join")]
    bars = spark.sql(doubles(inner).replace("from bars", "from {bars}"), bars=view(spark, sf_dir, "bars")).where("seq >= 19")
    each = bars.withColumn("engine", F.explode(F.array(*[F.lit(e) for e in engines.WEIGHTS["unknown"]])))
    names = OPINIONS[len("select ") : OPINIONS.index("from (")]
    return spark.sql(f"select {doubles(names)} from {{each}}", each=each)


def unified(spark, sf_dir):
    return engines.ensemble(opinions(spark, sf_dir))


def win_rates(spark, sf_dir):
    """(symbol, ts, probability, calibrated): the share of won deals among those that a symbol had finished before the day; days are summed up first."""
    text = """select symbol, ts, sum(won) over w / sum(n) over w as probability from (select symbol, exit_date as ts, sum(case when pnl > 0 then 1.0D else 0.0D end) as won, count(*) as n from {deals} group by symbol, exit_date) d
        window w as (partition by symbol order by ts rows between unbounded preceding and 1 preceding)"""
    return spark.sql(text, deals=view(spark, sf_dir, "deals"))


def _stored(spark, sf_dir, name: str, bodies: str, kind: str, **frames):
    """Bodies written as a vendor's files, read back and judged."""
    path = store.scratch(spark, name)
    spark.sql(bodies, **frames).select(F.to_json(F.struct("symbol", "body")).alias("value")).write.text(path)
    return vendor.judge(vendor.responses(spark, path), kind)


def register() -> None:
    @query(
        "unified_signals",
        f"with {_with('bars')}, {UNIFIED} select symbol, ts, regime, engines, score, label, round(confidence, 5) as confidence, conviction from l",
    )
    def unified_signals(spark, sf_dir):
        """E1, E2 at every bar."""
        return unified(spark, sf_dir).withColumn("confidence", F.round("confidence", 5))

    @query(
        "point_in_time_signals",
        f"""with {_with('bars')}, o as materialized ({OPINIONS}), g as (select symbol, ts, cast(trunc(sum(score * case engine when 'technical' then 60 else 40 end) / 100) as integer) as score, round(sum(confidence * case engine when 'technical' then .6 else .4 end), 5) as confidence
            from o where engine in ('technical', 'quantitative') group by symbol, ts)
        select symbol, ts, score, confidence, case when score >= 5 then 'BUY' else 'SELL' end as side from g where score >= 5 or score < -5""",
    )
    def point_in_time_signals(spark, sf_dir):
        """E16 technical and quantitative opinions of each bar, 60 to 40, that say buy or sell."""
        x = engines.point_in_time(opinions(spark, sf_dir)).withColumn("side", engines.side("label")).where("side is not null")
        return x.select("symbol", "ts", "score", F.round("confidence", 5).alias("confidence"), "side")

    @query(
        "gated_signals",
        f"""with {_with('bars deals')}, {UNIFIED}, d as (select symbol, exit_date as ts, sum(case when pnl > 0 then 1.0 else 0.0 end) as won, count(*) as n from deals group by symbol, exit_date),
        p as (select symbol, ts, sum(won) over w / sum(n) over w as p from d window w as (partition by symbol order by ts rows between unbounded preceding and 1 preceding)),
        m as (select symbol, ts, close / lag(close) over (partition by symbol order by seq) - 1 as day, open / lag(close) over (partition by symbol order by seq) - 1 as gap from bars),
        t as (select l.symbol, l.ts, l.regime, case when label like '%buy' then 'BUY' when label like '%sell' then 'SELL' end as side, p.p, m.day, m.gap,
            case when day > .3 then least(.98, confidence + .05) when day < -.3 then greatest(.05, confidence - .05) else confidence end as c from l left join p on l.symbol = p.symbol and l.ts = p.ts left join m on l.symbol = m.symbol and l.ts = m.ts where confidence >= .5 and label <> 'neutral'),
        c as (select *, case when (side = 'BUY' and gap > .02) or (side = 'SELL' and gap < -.02) then least(.98, c + .02) else c end as confidence from t),
        r as (select *, case when p is null then case when confidence >= case when regime like '%bear%' or regime like '%high_vol%' then .65 when regime = 'low_vol_bull' then .5 else .55 end then 'FALLBACK' else 'FAIL' end
            when p > case when regime like '%bear%' or regime like '%high_vol%' then .6 when regime = 'low_vol_bull' then .45 else .5 end then 'ML_PASS' when p >= .45 and confidence >= .7 then 'ORCH_OVERRIDE' when confidence >= .65 and p >= .4 then 'CONSENSUS' else 'FAIL' end as reason from c)
        select symbol, ts, side, round(confidence, 5) as confidence, round(p, 6) as probability, reason, reason <> 'FAIL' as approved from r""",
    )
    def gated_signals(spark, sf_dir):
        """E16, E17 signals of every bar with the day's move as smart money and the opening gap, gated by the share of won deals before the day."""
        moves = """select symbol, ts, close / lag(close) over (partition by symbol order by seq) - 1 as smart_money,
            case when open / lag(close) over (partition by symbol order by seq) - 1 > 0.02D then 'up' when open / lag(close) over (partition by symbol order by seq) - 1 < -0.02D then 'down' end as gap from {bars}"""
        moved = spark.sql(moves, bars=view(spark, sf_dir, "bars"))
        x = unified(spark, sf_dir).join(moved.hint("merge"), ["symbol", "ts"], "left").join(win_rates(spark, sf_dir).hint("merge"), ["symbol", "ts"], "left")
        gated = engines.gate(engines.tradable(x).withColumn("calibrated", F.lit(None).cast("double")))
        return gated.select("symbol", "ts", "side", F.round("confidence", 5).alias("confidence"), F.round("probability", 6).alias("probability"), "reason", "approved")

    @query(
        "vendor_statements",
        f"""with {_with('statements')} select cast(symbol as varchar) as symbol, case when symbol % 5 = 4 and fiscal_quarter = 4 then null else 'Q' || fiscal_quarter end as fiscal_period, case when fiscal_quarter = 3 then 0 else fiscal_year end as fiscal_year,
            case when fiscal_quarter = 2 then null else round(revenue, 2) end as revenue, round(net_income, 2) as net_income, round(total_assets, 2) as total_assets, round(total_liabilities, 2) as total_liabilities, round(total_assets - total_liabilities, 2) as shareholders_equity,
            case when symbol % 7 = 6 then null else round(cash_flow_operating, 2) end as cash_flow_operating, case when (symbol % 5 = 4 and fiscal_quarter = 4) or symbol % 7 = 6 then 'field' end as reason from statements
        union all select cast(symbol as varchar), null, 0, null, null, null, null, null, null, 'malformed' from (select distinct symbol, fiscal_year from statements where symbol % 3 = 0) x""",
    )
    def vendor_statements(spark, sf_dir):
        """S6 a response for each symbol and year, some entries without what they must have, and a broken one for every third symbol."""
        entry = """named_struct('fiscal_period', if(symbol % 5 = 4 and fiscal_quarter = 4, null, concat('Q', fiscal_quarter)), 'fiscal_year', if(fiscal_quarter = 3, 'FY', cast(fiscal_year as string)), 'financials', named_struct(
            'income_statement', named_struct('revenues', named_struct('value', if(fiscal_quarter = 2, null, revenue), 'unit', 'USD'), 'net_income_loss', named_struct('value', net_income)),
            'balance_sheet', named_struct('assets', named_struct('value', total_assets), 'liabilities', named_struct('value', total_liabilities), 'equity', named_struct('value', total_assets - total_liabilities)),
            'cash_flow_statement', if(symbol % 7 = 6, null, named_struct('net_cash_flow_from_operating_activities', named_struct('value', cash_flow_operating)))))"""
        bodies = f"""select cast(symbol as string) as symbol, concat('{{{{"status":"OK","results":', to_json(collect_list({entry})), '}}}}') as body from {{s}} group by symbol, fiscal_year
            union all select distinct cast(symbol as string), concat('{{{{"status":', fiscal_year) from {{s}} where symbol % 3 = 0"""
        rows = _stored(spark, sf_dir, "statements", bodies, "statements", s=view(spark, sf_dir, "statements"))
        money = ["revenue", "net_income", "total_assets", "total_liabilities", "shareholders_equity", "cash_flow_operating"]
        return rows.select("symbol", "fiscal_period", "fiscal_year", *[F.round(c, 2).alias(c) for c in money], "reason")

    @query(
        "vendor_news",
        """with d as (select *, ['t' || (doc_id % 7), 't' || (doc_id % 11), 'x'] as named from documents), n as (select doc_id, lang, source, text, unnest(list_distinct(named)) as ticker from d where doc_id % 10 <> 3 and lang is not null and source is not null)
        select ticker, cast(doc_id as varchar) as id, lang || ' ' || source as title, make_timestamp(2020, 1, 1, cast(doc_id % 22 as bigint), cast(doc_id % 60 as bigint), 0.0) - case when doc_id % 2 = 0 then interval 2 hour else interval 0 hour end as published_utc,
            md5(text) as description_md5, cast(case when doc_id % 4 = 0 then 0 else 2 end as integer) as keywords from n""",
    )
    def vendor_news(spark, sf_dir):
        """S7 every document as an article of a response, with its whole text as description; accepted ones by the tickers that they name."""
        entry = """named_struct('id', cast(doc_id as string), 'title', concat(lang, ' ', source), 'published_utc', concat('2020-01-01T', lpad(doc_id % 22, 2, '0'), ':', lpad(doc_id % 60, 2, '0'), ':00', if(doc_id % 2 = 0, '+02:00', 'Z')), 'article_url', 'u',
            'description', text, 'keywords', if(doc_id % 4 = 0, null, array(lang, source)), 'tickers', if(doc_id % 10 = 3, null, array(concat('t', doc_id % 7), concat('t', doc_id % 11), 'x', 'x')))"""
        bodies = f"""select 'x' as symbol, concat('{{{{"results":[', to_json({entry}), ']}}}}') as body from {{d}}"""
        rows = _stored(spark, sf_dir, "news", bodies, "news", d=view(spark, sf_dir, "documents"))
        named = vendor.mentions(rows.where("reason is null").drop("raw", "reason"))
        return named.select("ticker", "id", "title", "published_utc", F.md5("description").alias("description_md5"), F.size("keywords").alias("keywords"))

    @query(
        "vendor_options",
        f"""with {_with('chain')} select symbol, 'c' || id as contract, kind, strike, cast(date '2020-01-17' + cast(id % 30 as integer) as varchar) as expiration, case when id % 9 = 0 then null else round(iv, 6) end as iv, oi, case when id % 8 = 0 then null else volume end as volume from chain""",
    )
    def vendor_options(spark, sf_dir):
        """S8 the chain as pages of at most 250 contracts a symbol, some without volatility or the day's part."""
        entry = """named_struct('details', named_struct('ticker', concat('c', id), 'contract_type', kind, 'strike_price', strike, 'expiration_date', cast(date_add(date'2020-01-17', cast(id % 30 as int)) as string)), 'implied_volatility', if(id % 9 = 0, null, iv), 'open_interest', oi,
            'day', if(id % 8 = 0, null, named_struct('volume', volume)))"""
        bodies = f"""select symbol, concat('{{{{"results":', to_json(collect_list({entry})), '}}}}') as body from {{c}} group by symbol, id div 250"""
        rows = _stored(spark, sf_dir, "options", bodies, "options", c=view(spark, sf_dir, "chain")).where("reason is null")
        return rows.select("symbol", "contract", "kind", "strike", F.col("expiration").cast("string").alias("expiration"), F.round("iv", 6).alias("iv"), "oi", "volume")
