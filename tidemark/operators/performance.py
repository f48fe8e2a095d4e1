"""Fundamentals, trades, lots, streaks, calibration, interactions and operational reports."""

from ..functions.operator import operator

S = "over (partition by symbol order by ts)"
Q = "over (partition by symbol order by fiscal_year, fiscal_quarter"
T = "order by ts, id, line, part, price, shares"
DAILY = "e as (select symbol, ts, sum(pnl) as pnl from trades group by symbol, ts), q as (select symbol, ts, round(100000 + sum(pnl) over (partition by symbol order by ts), 3) as equity from e)"

OPERATORS = [
    operator("ttm", "statements", "F1 sums of what is there of the last four quarters, null if nothing is", f"""
select symbol, fiscal_year, fiscal_quarter, round(sum(revenue) {Q} rows between 3 preceding and current row), 2) as revenue_ttm,
    round(sum(net_income) {Q} rows between 3 preceding and current row), 2) as net_income_ttm from statements"""),
    operator("ratios", "statements", "F2, F5, F8 margins, leverage, DuPont parts and earnings quality", """
select symbol, fiscal_year, fiscal_quarter, round(case when revenue > 0 then net_income / revenue end, 6) as net_margin, round(case when revenue > 0 then gross_profit / revenue end, 6) as gross_margin,
    round(case when total_assets - total_liabilities > 0 then total_liabilities / (total_assets - total_liabilities) end, 6) as debt_to_equity,
    round(case when total_assets > 0 then revenue / total_assets end, 6) as asset_turnover,
    round(case when total_assets - total_liabilities > 0 then net_income / (total_assets - total_liabilities) end, 6) as roe,
    round(case when net_income > 0 then cash_flow_operating / net_income end, 6) as earnings_quality from statements"""),
    operator("revenue_growth", "statements", "F3, F17 growth of four quarters over the four before and over the year-ago quarter", f"""
with x as (select symbol, fiscal_year, fiscal_quarter, revenue, lag(revenue, 4) {Q}) as ago, sum(revenue) {Q} rows between 3 preceding and current row) as now4,
    sum(revenue) {Q} rows between 7 preceding and 4 preceding) as before4, count(*) {Q} rows between 7 preceding and 4 preceding) as n from statements)
select symbol, fiscal_year, fiscal_quarter, round(revenue / ago - 1, 6) as yoy, round(case when n = 4 then now4 / before4 - 1 end, 6) as ttm_growth from x where ago is not null"""),
    operator("metric_z", "statements", "F4 z-score of the net margin in the company's own history", """
with x as (select symbol, fiscal_year, fiscal_quarter, net_income / revenue as m from statements where revenue > 0),
y as (select *, avg(m) over (partition by symbol) as mean, stddev_samp(m) over (partition by symbol) as sd, count(*) over (partition by symbol) as n from x)
select symbol, fiscal_year, fiscal_quarter, round(case when sd > 0.0000001 then (m - mean) / sd else 0.0 end, 5) as z from y where n >= 3"""),
    operator("piotroski", "statements", "F6 the tests of the F-score that the statements allow", f"""
with x as (select *, lag(net_income / total_assets) {Q}) as roa1, lag(gross_profit / revenue) {Q}) as gm1, lag(total_liabilities / total_assets) {Q}) as lev1 from statements where revenue > 0 and total_assets > 0)
select symbol, fiscal_year, fiscal_quarter, cast((case when net_income > 0 then 1 else 0 end) + (case when cash_flow_operating > 0 then 1 else 0 end)
    + (case when net_income / total_assets > roa1 then 1 else 0 end) + (case when gross_profit / revenue > gm1 then 1 else 0 end)
    + (case when total_liabilities / total_assets < lev1 then 1 else 0 end) + (case when cash_flow_operating > net_income then 1 else 0 end) as integer) as score from x where roa1 is not null"""),
    operator("growth_runs", "statements", "F9 latest run of quarters with rising revenue", f"""
with x as (select symbol, fiscal_year, fiscal_quarter, revenue, lag(revenue) {Q}) as before from statements),
y as (select *, sum(case when revenue > before then 0 else 1 end) over (partition by symbol order by fiscal_year desc, fiscal_quarter desc) as breaks from x)
select symbol, cast(sum(case when breaks = 0 then 1 else 0 end) as bigint) as run from y group by symbol"""),
    operator("trade_stats", "trades", "B12, K7 wins, losses, profit factor, payoff and expectancy", """
select symbol, cast(count(*) as bigint) as trades, round(avg(case when pnl > 0 then 1.0 else 0.0 end), 6) as win_rate, round(avg(pnl), 4) as expectancy,
    round(sum(case when pnl > 0 then pnl else 0.0 end) / -sum(case when pnl < 0 then pnl else 0.0 end), 5) as profit_factor,
    round(avg(case when pnl > 0 then pnl end) / -avg(case when pnl < 0 then pnl end), 5) as payoff from trades group by symbol having sum(case when pnl < 0 then 1 else 0 end) > 0"""),
    operator("streaks", "trades", "K8 histogram of win and loss streaks by gaps and islands", f"""
with x as (select symbol, pnl > 0 as win, row_number() over (partition by symbol {T}) - row_number() over (partition by symbol, pnl > 0 {T}) as island from trades),
s as (select symbol, win, island, count(*) as length from x group by symbol, win, island)
select symbol, win, cast(length as integer) as length, cast(count(*) as bigint) as times from s group by symbol, win, length"""),
    operator("win_after", "trades", "K8 chance of a win after a win and after a loss", f"""
with x as (select symbol, pnl > 0 as win, lag(pnl > 0) over (partition by symbol {T}) as before from trades)
select symbol, before as after_win, round(avg(case when win then 1.0 else 0.0 end), 6) as win_rate, cast(count(*) as bigint) as trades from x where before is not null group by symbol, before"""),
    operator("fifo_lots", "trades", "B2, X6 FIFO lots by one sort of the bounds of running share intervals, over-selling clipped", f"""
with x as (select *, row_number() over (partition by symbol {T}) as k from trades),
c as (select symbol, k, ts, side, price, shares, sum(case when side = 'buy' then shares else 0.0 end) over (partition by symbol order by k) as b,
    sum(case when side = 'sell' then shares else 0.0 end) over (partition by symbol order by k) as s from x),
o as (select *, greatest(0.0, max(s - b) over (partition by symbol order by k)) as excess from c),
sells as (select symbol, k, ts, price, lag(s - excess, 1, 0.0) over (partition by symbol order by k) as s0, s - excess as s1 from o where side = 'sell'),
buys as (select symbol, k, ts, price, b - shares as b0, b as b1 from c where side = 'buy'),
bounds as (select symbol, b0 as place, k as buy, 0 as sell from buys where b1 > b0 union all select symbol, s0 as place, 0 as buy, k as sell from sells where s1 > s0),
p as (select symbol, place, max(buy) as buy, max(sell) as sell from bounds group by symbol, place),
r as (select symbol, place, lead(place) over (partition by symbol order by place) as till, max(buy) over (partition by symbol order by place) as buy, max(sell) over (partition by symbol order by place) as sell from p),
m as (select r.symbol, buy, sell, least(coalesce(till, s1), b1, s1) - place as n, buys.price as paid, buys.ts as bought, sells.price as got, sells.ts as sold
    from r join buys on r.symbol = buys.symbol and r.buy = buys.k join sells on r.symbol = sells.symbol and r.sell = sells.k where least(coalesce(till, s1), b1, s1) > place)
select symbol, cast(buy as bigint) as buy_no, cast(sell as bigint) as sell_no, round(n, 4) as shares, round(n * (got - paid), 8) as realised, DAYS(sold, bought) as days_held from m"""),
    operator("wash_sales", "trades", "X9 losses with a purchase within 30 days either side; each triggers once, by the first", """
with near as (select -1 as o union all select 0 union all select 1), l as (select symbol, id, line, ts, pnl, floor(DAYS(ts, '1970-01-01') / 31.0) + o as bucket from trades cross join near where side = 'sell' and pnl < 0),
b as (select distinct symbol, ts, floor(DAYS(ts, '1970-01-01') / 31.0) as bucket from trades where side = 'buy')
select l.symbol, l.id, l.line, round(l.pnl, 4) as loss, min(b.ts) as purchase from l join b on l.symbol = b.symbol and l.bucket = b.bucket and abs(DAYS(b.ts, l.ts)) <= 30 group by l.symbol, l.id, l.line, l.ts, l.pnl"""),
    operator("drawdown_events", "trades", "K3 drawdowns of each equity curve: peak, trough, depth and length", f"""
with {DAILY}, h as (select symbol, ts, equity, max(equity) over (partition by symbol order by ts) as top from q),
i as (select *, sum(case when equity >= top then 1 else 0 end) over (partition by symbol order by ts) as island from h),
g as (select symbol, island, min(ts) as peak, max(ts) as last_ts, max(1 - equity / top) as depth, count(*) as bars from i group by symbol, island)
select symbol, peak, last_ts, round(depth, 6) as depth, cast(bars as bigint) as bars from g where depth > 0.000001"""),
    operator("equity_risk", "trades", "K5 ulcer index, mean squared drawdown and total return over it, of each equity curve", f"""
with {DAILY}, h as (select symbol, ts, equity, 100 * (1 - equity / max(equity) over (partition by symbol order by ts)) as dd, first_value(equity) over (partition by symbol order by ts desc) as latest from q)
select symbol, round(sqrt(avg(dd * dd)), 4) as ulcer, round(avg(dd * dd), 3) as pain,
    round(case when avg(dd * dd) > 0.0000000001 then 100 * (max(latest) / 100000 - 1) / avg(dd * dd) end, 5) as gain_to_pain from h group by symbol"""),
    operator("monthly_returns", "trades", "R25, K4 return of each month from its last equity to the one before", f"""
with {DAILY}, m as (select symbol, date_trunc('month', ts) as month, ts, equity, row_number() over (partition by symbol, date_trunc('month', ts) order by ts desc) as k from q),
l as (select symbol, month, equity, lag(equity) over (partition by symbol order by month) as before from m where k = 1)
select symbol, cast(year(month) * 100 + month(month) as integer) as month, round(equity / coalesce(before, 100000) - 1, 5) as month_return from l"""),
    operator("trailing_stop", "bars", "X3, W5 first breach of a 10 % trailing stop below the running high", f"""
with x as (select symbol, ts, low, max(high) {S} * .9 as stop from bars)
select symbol, min(ts) as breached, round(max(stop), 4) as highest_stop from x where low < stop group by symbol"""),
    operator("net_positions", "trades", "B1 net shares, cost and volume by side", """
select symbol, round(sum(case when side = 'buy' then shares else -shares end), 4) as net_shares, round(sum(case when side = 'buy' then shares * price else 0.0 end), 2) as bought,
    round(sum(case when side = 'sell' then shares * price else 0.0 end), 2) as sold from trades group by symbol"""),
    operator("calibration", "predictions", "C1 ten buckets of confidence with gap, and Brier score", """
with x as (select source, least(floor(confidence * 10), 9) as bucket, confidence, outcome from predictions)
select source, cast(bucket as integer) as bucket, cast(count(*) as bigint) as n, round(avg(confidence), 6) as predicted, round(avg(cast(outcome as double)), 6) as observed,
    round(abs(avg(confidence) - avg(cast(outcome as double))), 6) as gap, round(avg(power(confidence - outcome, 2)), 6) as brier from x group by source, bucket"""),
    operator("temperature", "predictions", "C4 temperature of least log loss on a grid of .1 to 10", """
with digits as (select 0 as d union all select 1 union all select 2 union all select 3 union all select 4 union all select 5 union all select 6 union all select 7 union all select 8 union all select 9),
grid as (select (a.d * 10 + b.d + 1) / 10.0 as t from digits a cross join digits b),
c as (select source, outcome, greatest(least(confidence, .99), .01) as p from predictions),
s as (select source, outcome, ln(p / (1 - p)) as z from c),
l as (select source, t, -avg(case when outcome = 1 then ln(1 / (1 + exp(-z / t))) else ln(1 - 1 / (1 + exp(-z / t))) end) as loss from s cross join grid group by source, t),
r as (select *, row_number() over (partition by source order by loss, t) as k from l)
select source, cast(t as double) as temperature, round(loss, 5) as loss from r where k = 1"""),
    operator("signal_quality", "predictions", "B13, D2 outcome by source and confidence band, with grand totals", """
with x as (select source, case when confidence < .33 then 'low' when confidence < .66 then 'medium' else 'high' end as band, outcome, confidence from predictions)
select source, band, cast(count(*) as bigint) as n, round(avg(cast(outcome as double)), 6) as win_rate, round(avg(confidence), 6) as confidence from x group by rollup(source, band)"""),
    operator("psi_drift", "bars", "C11 population stability of volume between the halves of a series, ten equal bins", """
with x as (select symbol, volume, seq, count(*) over (partition by symbol) as n, min(volume) over (partition by symbol) as lo, max(volume) over (partition by symbol) as hi from bars),
b as (select symbol, least(cast(floor((volume - lo) / (hi - lo) * 10) as integer), 9) as bin, case when seq * 2 < n then 1.0 else 0.0 end as old from x where hi > lo),
t as (select symbol, bin, sum(old) as a, sum(1 - old) as e from b group by symbol, bin),
s as (select symbol, greatest(a / sum(a) over (partition by symbol), .0001) as p, greatest(e / sum(e) over (partition by symbol), .0001) as q from t)
select symbol, round(sum((q - p) * ln(q / p)), 6) as psi from s group by symbol"""),
    operator("training_rows", "bars", "M1 point-in-time features with a five-bar forward label, every fifth bar from the 60th", f"""
with x as (select symbol, ts, seq, close, avg(close) over (partition by symbol order by ts rows between 19 preceding and current row) as sma20, close / lag(close, 5) {S} - 1 as m5,
    volume / avg(volume) over (partition by symbol order by ts rows between 19 preceding and current row) as activity, 100 * (lead(close, 5) {S} / close - 1) as label from bars)
select symbol, ts, round(close / sma20 - 1, 6) as to_sma20, round(m5, 6) as momentum5, round(activity, 6) as activity, round(label, 5) as label
from x where seq >= 59 and (seq - 59) % 5 = 0 and label is not null and abs(label) <= 50"""),
    operator("affinity", "interactions", "E9 decayed weight of what users did in the last 90 days, by each user's largest, 1 at least", """
with l as (select max(ts) as now from interactions), x as (select user_id, symbol, case action when 'purchase' then 5.0 when 'signup' then 3.0 when 'view' then 2.0 when 'click' then 1.0 else -2.0 end * power(.95, DAYS(now, ts)) as w
    from interactions cross join l where DAYS(now, ts) <= 90),
s as (select user_id, symbol, sum(w) as w from x group by user_id, symbol)
select user_id, symbol, round(w / greatest(max(abs(w)) over (partition by user_id), 1.0), 6) as affinity from s"""),
    operator("interests", "interactions", "E10 the five symbols that each user is most interested in, and the five most dismissed", """
with l as (select max(ts) as now from interactions), x as (select user_id, concat(symbol, '-', cast(cast(floor(value) as bigint) % 7 as string)) as symbol, case action when 'purchase' then 5.0 when 'signup' then 3.0 when 'view' then 2.0 when 'click' then 1.0 else -2.0 end * power(.95, DAYS(now, ts)) as w
    from interactions cross join l where DAYS(now, ts) <= 90),
s as (select user_id, symbol, round(sum(w), 9) as w from x group by user_id, symbol),
k as (select *, row_number() over (partition by user_id, w > 0 order by abs(w) desc, symbol) as place from s where w <> 0)
select user_id, case when w > 0 then 'interested' else 'dismissed' end as kind, cast(place as integer) as place, symbol, round(w, 5) as weight from k where place <= 5"""),
    operator("sessions", "interactions", "W3 sessions of users, closed by half an hour of silence", """
with x as (select user_id, ts, event_id, value, case when lag(ts) over (partition by user_id order by ts, event_id) >= ts - interval '30' minute then 0 else 1 end as fresh from interactions),
y as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as session from x)
select user_id, min(ts) as started, max(ts) as ended, cast(count(*) as bigint) as events, round(sum(value), 4) as value from y group by user_id, session"""),
    operator("latest", "interactions", "S9, W4 the latest row of each key", """
with x as (select *, row_number() over (partition by user_id, symbol order by ts desc, event_id desc) as k from interactions)
select user_id, symbol, ts, value from x where k = 1"""),
    operator("bar_quality", "bars", "Q1 gaps, spikes, likely splits and inconsistent bars", f"""
with x as (select symbol, ts, close, lag(close) {S} as before, high, low, open, volume, DAYS(ts, lag_ts) as gap from (select *, lag(ts) {S} as lag_ts from bars) z)
select symbol, cast(sum(case when volume = 0 then 1 else 0 end) as bigint) as no_volume, cast(sum(case when high < low or close > high or close < low then 1 else 0 end) as bigint) as inconsistent,
    cast(sum(case when abs(close / before - 1) > .2 then 1 else 0 end) as bigint) as spikes, cast(sum(case when abs(close / before - 1) > .5 then 1 else 0 end) as bigint) as extreme,
    cast(sum(case when abs(close / before - .5) < .05 or abs(close / before - 2) < .1 then 1 else 0 end) as bigint) as splits,
    cast(sum(case when gap > 4 then gap - 3 else 0 end) as bigint) as missing_days from x group by symbol"""),
]
