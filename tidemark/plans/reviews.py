"""Queries over reviews of series, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reviews
from ..registry import query
from ..sources.views import portable_views, view

RETURNS = "select symbol, ts, close / lag(close) over (partition by symbol order by seq) - 1 as r from bars"
#: Benchmarks of the given tables: the mean return of all symbols and of each third of them, by day.
BENCHMARKS = """select 'all' as benchmark, ts, avg(r) as r from returns where r is not null group by ts
    union all select concat('third ', cast(symbol % 3 as string)) as benchmark, ts, avg(r) as r from returns where r is not null group by symbol % 3, ts"""
EQUITY = "select symbol, ts, round(100000 + sum(pnl) over (partition by symbol order by ts), 6) as equity from (select symbol, ts, sum(pnl) as pnl from trades group by symbol, ts) d"
RATES = ", ".join(f"('{j}', {d}, {s}, {g}, {'null' if m is None else m})" for j, d, s, g, m in reviews.TAXES)


def _with(names: str) -> str:
    return ", ".join(f"{n} as ({text})" for n, text in portable_views(names.split()).items())


def _pairs(spark, sf_dir):
    returns = spark.sql(RETURNS.replace("from bars", "from {bars}"), bars=view(spark, sf_dir, "bars"))
    return returns, spark.sql(BENCHMARKS.replace("from returns", "from {returns}"), returns=returns)


def register() -> None:
    @query(
        "timeframe_alignment",
        f"""with {_with('bars')}, c as (select symbol, 0 as g, ts as bar, ts, close from bars union all select symbol, 1, date_trunc('week', ts), ts, close from bars union all select symbol, 2, date_trunc('month', ts), ts, close from bars),
        e as (select symbol, g, bar, arg_max(close, ts) as close from c group by symbol, g, bar), w as (select symbol, g, bar, close, avg(close) over (partition by symbol, g order by bar rows 9 preceding) as a, avg(close) over (partition by symbol, g order by bar rows 19 preceding) as b, count(*) over (partition by symbol, g) as n,
            row_number() over (partition by symbol, g order by bar desc) as k from e), t as (select symbol, g, n >= 20 as whole, a > b and n >= 20 as up, case when n >= 20 then abs((a - b) / close) end as gap from w where k = 1),
        s as (select symbol, count(*) filter (where whole) as grains, count(*) filter (where up) as rising, bool_or(up and g = 0) as first_up, (list(['day', 'week', 'month'][g + 1] order by gap desc, g) filter (where gap > 0))[1] as best_grain from t group by symbol),
        u as (select *, case when grains = 0 then 0 else abs(rising / grains - .5) * 2 end as alignment, case when rising > .6 * grains then 'buy' when rising < .4 * grains then 'sell' else 'neutral' end as trend from s)
        select symbol, grains, rising, round(alignment, 6) as alignment, trend, case when trend = 'buy' and first_up or trend = 'sell' and not first_up then trend else 'neutral' end as signal,
            round(case when trend = 'neutral' then .5 when (trend = 'buy') = first_up then .7 + .3 * alignment else .3 end, 6) as confidence, best_grain from u""",
    )
    def timeframe_alignment(spark, sf_dir):
        return reviews.alignment(view(spark, sf_dir, "bars")).withColumns({c: F.round(c, 6) for c in ("alignment", "confidence")})

    @query(
        "diversification",
        f"""with {_with('bars')}, returns as ({RETURNS}), m as ({BENCHMARKS}), x as (select v.symbol, benchmark, v.ts, v.r, m.r as b, max(v.ts) over (partition by v.symbol) as last_ts from returns v join m on v.ts = m.ts where v.r is not null),
        c as (select symbol, benchmark, round(corr(r, b), 3) + 0.0 as c from x where date_diff('day', ts, last_ts) <= 365 group by symbol, benchmark),
        k as (select *, row_number() over (partition by symbol order by abs(c) desc, benchmark) as h, row_number() over (partition by symbol order by abs(c), benchmark) as l from c where c is not null and not isnan(c))
        select symbol, count(*) as benchmarks, max(case when h = 1 then benchmark end) as highest, max(case when h = 1 then c end) as highest_correlation, max(case when l = 1 then benchmark end) as lowest, max(case when l = 1 then c end) as lowest_correlation, round(100 * (1 - avg(abs(c))), 4) as diversification from k group by symbol""",
    )
    def diversification(spark, sf_dir):
        return reviews.diversification(*_pairs(spark, sf_dir), days=365).withColumn("diversification", F.round("diversification", 4))

    @query(
        "rolling_correlation",
        f"""with {_with('bars')}, returns as ({RETURNS}), m as (select ts, avg(r) as b from returns where r is not null group by ts), x as (select v.symbol, v.ts, r, b from returns v join m on v.ts = m.ts where r is not null),
        y as (select symbol, ts, count(*) over w as n, avg(r * b) over w as rb, avg(r) over w as mr, avg(b) over w as mb, stddev_pop(r) over w as sr, stddev_pop(b) over w as sb from x window w as (partition by symbol order by ts rows 29 preceding))
        select symbol, 'all' as benchmark, ts, round((rb - mr * mb) / (sr * sb), 5) as correlation from y where n = 30""",
    )
    def rolling_correlation(spark, sf_dir):
        returns, benchmarks = _pairs(spark, sf_dir)
        return reviews.rolling_correlation(returns, benchmarks.where("benchmark = 'all'")).withColumn("correlation", F.round("correlation", 5))

    @query(
        "deepest_drawdowns",
        f"""with {_with('trades')}, q as ({EQUITY}), p as (select *, max(equity) over (partition by symbol order by ts) as peak from q), s as (select *, max(case when equity = peak then ts end) over (partition by symbol order by ts) as start from p),
        g as (select symbol, start, max(peak) as peak, min(equity) as low from s where equity < peak group by symbol, start), t as (select g.symbol, g.start, g.peak, g.low, min(s.ts) as trough from g join s on g.symbol = s.symbol and g.start = s.start and s.equity = g.low group by all),
        b as (select t.*, (select min(ts) from s where s.symbol = t.symbol and s.ts > t.start and s.equity = s.peak) as recovery, 100 * (peak - low) / peak as depth from t), k as (select *, row_number() over (partition by symbol order by depth desc, start) as rank from b)
        select symbol, cast(rank as integer) as rank, start, trough, recovery, round(depth, 6) as depth, cast(date_diff('day', start, trough) as integer) as days_down, cast(date_diff('day', trough, recovery) as integer) as days_up from k where rank <= 5""",
    )
    def deepest_drawdowns(spark, sf_dir):
        curve = spark.sql(EQUITY.replace("from trades", "from {trades}"), trades=view(spark, sf_dir, "trades"))
        return reviews.deepest_drawdowns(curve).withColumn("depth", F.round("depth", 6))

    @query(
        "year_end_taxes",
        f"""with {_with('deals')}, rules(jurisdiction, d, s, l, most) as (values {RATES}), x as (select symbol, year(exit_date) as tax_year, jurisdiction, s, l, most, pnl - case when id % 9 = 0 then 10.0 else 0.0 end as gain, date_diff('day', cast(entry_date as date), cast(exit_date as date)) >= d as far from deals cross join rules),
        y as (select symbol, tax_year, jurisdiction, s, l, most, sum(case when not far and gain > 0 then gain else 0 end) as sg, -sum(case when not far and gain < 0 then gain else 0 end) as sl, sum(case when far and gain > 0 then gain else 0 end) as lg, -sum(case when far and gain < 0 then gain else 0 end) as ll, sum(gain) as net from x group by all)
        select symbol, cast(tax_year as integer) as tax_year, jurisdiction, round(sg, 4) as short_gains, round(sl, 4) + 0.0 as short_losses, round(lg, 4) as long_gains, round(ll, 4) + 0.0 as long_losses, round(net, 4) as net,
            round(case when net >= 0 then greatest(sg - sl, 0) * s + greatest(lg - ll, 0) * l when most is not null and -net > most then -most * s else net * s end / nullif(net, 0), 6) as tax_rate, round(case when most is not null and -net > most then -net - most else 0 end, 4) as carried from y""",
    )
    def year_end_taxes(spark, sf_dir):
        """X7; one deal in nine carries 10 of a wash sale in its basis. The tax as a share of the net, which has no ties of rounding."""
        lots = "select symbol, entry_date, exit_date, entry_price * shares + pnl as proceeds, entry_price * shares as basis, case when id % 9 = 0 then 10.0D end as adjustment from {deals}"
        x = reviews.year_end(spark.sql(lots, deals=view(spark, sf_dir, "deals"))).withColumn("tax_rate", F.round(F.try_divide("tax", "net"), 6)).drop("tax")
        return x.withColumns({c: F.round(c, 4) for c in ("short_gains", "short_losses", "long_gains", "long_losses", "net", "carried")})
