"""Queries over judged loads, nested JSON, breaks, arrays of bars and phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nested, phrases, series
from ..registry import query
from ..sources import quarantine, store
from ..sources.views import portable_views, view

#: The mean of the last twenty closes of each symbol, from the first whole one.
MEANS = "select symbol, cast(seq - 19 as integer) as i, round(avg(close) over (partition by symbol order by seq rows between 19 preceding and current row), 8) as value, seq from bars"
#: Lines of a file of trades and messages of a feed, made from the given rows, some of them broken.
LINE = """select case when id % 50 = 0 then ' ' else concat(' s', cast(symbol as string), ' ') end as symbol, case when line = 7 then 'hold' else upper(side) end as action,
    case when line = 6 then 'many' when line = 5 then '-1' else cast(cast(shares as integer) as string) end as shares, case when id % 7 = 0 then 'x' else cast(cast(floor(price) as integer) as string) end as price,
    case when part % 40 = 0 then '' else cast(cast(ts as date) as string) end as date from trades"""
MESSAGE = """select case when event_id % 13 = 0 then '{"ev":' when event_id % 11 = 0 then '[{"ev":"status","message":"x"}]'
    else concat('[{"ev":"T","sym":"', event_type, case when event_id % 7 = 0 then '","p":' else '","s":2,"p":' end, cast(event_id % 5 as string), ',"t":', cast(event_id * 1000 as string), '},{"ev":"Q","sym":"', event_type, '","bp":1,"ap":', cast(event_id % 9 as string), ',"t":', cast(event_id * 1000 as string), '}]') end as value from events"""


def _with(names: str) -> str:
    return ", ".join(f"{n} as ({text})" for n, text in portable_views(names.split()).items())


def register() -> None:
    @query(
        "judged_trades",
        f"""with {_with("trades")}, lines as ({LINE}), x as (select upper(trim(symbol)) as symbol, lower(action) as action, try_cast(shares as double) as shares, coalesce(try_cast(price as double), 0) as price, date from lines)
        select symbol, action, shares, price, date, case when symbol = '' then 'symbol' when date = '' then 'date' when shares is null or shares <= 0 then 'shares' when action not in ('buy', 'sell') then 'action' end as reason from x""",
    )
    def judged_trades(spark, sf_dir):
        """S5 lines written as CSV, read back, judged and kept; accepted and rejected rows."""
        path, to = store.scratch(spark, "lines"), store.scratch(spark, "trades")
        spark.sql(LINE.replace("from trades", "from {trades}"), trades=view(spark, sf_dir, "trades")).write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        quarantine.keep(quarantine.judge_trades(spark, path), to, "one")
        return spark.read.parquet(f"{to}/load=one").select("symbol", "action", "shares", "price", "date", "reason")

    @query(
        "judged_feed",
        """with e as (select event_id as i, event_type as symbol from events), g as (select * from e where i % 13 <> 0 and i % 11 <> 0)
        select cast(null as varchar) as kind, cast(null as varchar) as symbol, cast(null as double) as price, 'malformed' as reason from e where i % 13 = 0
        union all select 'status', null, null, 'kind' from e where i % 13 <> 0 and i % 11 = 0
        union all select 'T', symbol, cast(i % 5 as double), case when i % 7 = 0 then 'field' when i % 5 = 0 then 'price' end from g
        union all select 'Q', symbol, (1 + i % 9) / 2.0, null from g""",
    )
    def judged_feed(spark, sf_dir):
        lines = spark.sql(MESSAGE.replace("{", "{{").replace("}", "}}").replace("from events", "from {events}"), events=view(spark, sf_dir, "events"))
        return quarantine.judge_feed(lines).select("kind", "symbol", "price", "reason")

    @query(
        "adjustment_outcomes",
        f"""with {_with("contexts")}, a as (select outcome, trim(split_part(unnest(json_extract_string(case when json_valid(signal_adjustments) then signal_adjustments else '[]' end, '$[*]')), '(', 1)) as adjustment from contexts where outcome in ('win', 'loss'))
        select adjustment, count(*) as total, count(*) filter (where outcome = 'win') as wins, round(avg(case when outcome = 'win' then 1.0 else 0.0 end), 6) as win_rate from a group by adjustment""",
    )
    def adjustment_outcomes(spark, sf_dir):
        return nested.adjustment_outcomes(view(spark, sf_dir, "contexts")).withColumn("win_rate", F.round("win_rate", 6))

    @query(
        "daily_snapshot",
        f"""with {_with("contexts")}, d as (select day, count(*) as signals from contexts group by day),
        k as (select day, symbol, pnl, row_number() over (partition by day order by pnl desc, symbol desc) as b, row_number() over (partition by day order by pnl, symbol) as w from contexts where outcome in ('win', 'loss')),
        e as (select day, max(case when b = 1 then symbol end) as best_symbol, max(case when b = 1 then pnl end) as best_pnl, max(case when w = 1 then symbol end) as worst_symbol, max(case when w = 1 then pnl end) as worst_pnl from k group by day),
        t as (select day, '{{' || string_agg('"' || key || '":' || n, ',' order by key) || '}}' as tiers from (select day, coalesce(tier, 'UNKNOWN') as key, count(*) as n from contexts group by 1, 2) x group by day),
        a as (select day, '{{' || string_agg('"' || key || '":' || n, ',' order by key) || '}}' as adjustments from (select day, key, count(*) as n from (select day, trim(split_part(unnest(json_extract_string(case when json_valid(signal_adjustments) then signal_adjustments else '[]' end, '$[*]')), '(', 1)) as key from contexts) y group by 1, 2) x group by day)
        select d.day, signals, best_symbol, round(best_pnl, 4) as best_pnl, worst_symbol, round(worst_pnl, 4) as worst_pnl, tiers, adjustments from d left join e on d.day = e.day left join t on d.day = t.day left join a on d.day = a.day""",
    )
    def daily_snapshot(spark, sf_dir):
        return nested.daily_snapshot(view(spark, sf_dir, "contexts")).withColumns({c: F.round(c, 4) for c in ("best_pnl", "worst_pnl")})

    @query(
        "tear_sheet_months",
        f"""with {_with("deals")}, s as (select strategy, count(*) as trades, round(sum(pnl), 2) as pnl, round(avg(case when pnl > 0 then 1.0 else 0.0 end), 6) as win_rate, round(sum(greatest(pnl, 0)) / sum(greatest(-pnl, 0)), 6) as profit_factor, round(max(pnl), 4) as best, round(min(pnl), 4) as worst from deals group by strategy),
        m as (select strategy, strftime(exit_date, '%Y-%m') as month, count(*) as month_trades, round(sum(pnl), 2) as month_pnl from deals group by 1, 2)
        select s.strategy, trades, pnl, win_rate, profit_factor, best, worst, month, month_trades, month_pnl from s join m on s.strategy = m.strategy""",
    )
    def tear_sheet_months(spark, sf_dir):
        """K21 the documents of all strategies, read back."""
        rows = nested.read_tear_sheets(nested.tear_sheets(view(spark, sf_dir, "deals")))
        return rows.withColumns({c: F.round(c, n) for c, n in {"pnl": 2, "win_rate": 6, "profit_factor": 6, "best": 4, "worst": 4, "month_pnl": 2}.items()})

    @query(
        "structural_breaks",
        f"""with recursive {_with("bars")}, v as materialized (select symbol, i, value from ({MEANS}) x where seq >= 19),
        p as (select symbol, i, count(*) over u as n, var_pop(value) over u * count(*) over u as whole, var_pop(value) over a * count(*) over a as one, var_pop(value) over b * count(*) over b as two from v
            window u as (partition by symbol), a as (partition by symbol order by i rows between unbounded preceding and 1 preceding), b as (partition by symbol order by i rows between current row and unbounded following)),
        c as materialized (select symbol, i from p where i >= 10 and i < n - 10 and (whole - one - two) / 2 / ((one + two) / (n - 4)) > 10),
        r as (select symbol, min(i) as split from c group by symbol union all select * from (select c.symbol, min(c.i) as split from r join c on r.symbol = c.symbol and c.i >= r.split + 10 group by c.symbol) z)
        select symbol, cast(split as integer) as split from r""",
    )
    def structural_breaks(spark, sf_dir):
        values = spark.sql(f"select symbol, i, value from ({MEANS.replace('from bars', 'from {bars}')}) x where seq >= 19", bars=view(spark, sf_dir, "bars"))
        return series.breaks(values)

    @query(
        "bar_sequences",
        f"""with {_with("bars")}, x as (select symbol, ts, seq, close, case when (close - lag(close) over s) / (lag(close) over s + 1e-8) > .001 then 'up' when (close - lag(close) over s) / (lag(close) over s + 1e-8) < -.001 then 'down' else 'neutral' end as d,
            lead(seq, 24) over s as last_seq, sum(volume) over (s rows between current row and 19 following) as volume, lead(close, 19) over s as context_close, lead(close, 20) over s as first_target, lead(close, 24) over s as last_target from bars window s as (partition by symbol order by seq)),
        y as (select *, concat(lead(d, 20) over s, ',', lead(d, 21) over s, ',', lead(d, 22) over s, ',', lead(d, 23) over s, ',', lead(d, 24) over s) as directions from x window s as (partition by symbol order by seq))
        select symbol, ts, cast(20 as integer) as bars, close as first_close, context_close, round(volume, 4) as volume, first_target, last_target, directions from y where seq % 5 = 0 and last_seq is not null""",
    )
    def bar_sequences(spark, sf_dir):
        x = series.sequences(view(spark, sf_dir, "bars"), stride=5)
        volume = F.aggregate("context", F.lit(0.0), lambda a, b: a + b["volume"])
        return x.select(
            "symbol", "ts", F.size("context").alias("bars"), F.col("context")[0]["close"].alias("first_close"), F.element_at("context", -1)["close"].alias("context_close"), F.round(volume, 4).alias("volume"),
            F.col("target")[0].alias("first_target"), F.element_at("target", -1).alias("last_target"), F.array_join("direction", ",").alias("directions"),
        )

    @query("keyword_occurrences")
    def keyword_occurrences(spark, sf_dir):
        """N9 occurrences of the lexicon's words in every text, inside words too. SQL takes minutes; tests compare with a plain search."""
        return phrases.keyword_counts(view(spark, sf_dir, "documents"), view(spark, sf_dir, "lexicon").where("kind <> 'negation'"))
