"""Portfolio and backtest reports: lots, holding periods, risk, benchmarks, rebalancing, fills, resampling, tax."""

from ..functions.operator import operator

S = "over (partition by symbol order by ts)"
ALL = "over (partition by symbol)"
T = "order by ts, id, line, part, price, shares"
#: Order of one strategy's finished deals.
D = "order by exit_date, id, line, part, entry_price, shares"
EQUITY = "d as (select symbol, ts, sum(pnl) as pnl from trades group by symbol, ts), q as (select symbol, ts, pnl, round(100000 + sum(pnl) over (partition by symbol order by ts), 6) as equity from d)"
RETURNS = f"{EQUITY}, r as (select symbol, ts, equity, equity / lag(equity) {S} - 1 as r from q)"
#: Daily returns of each strategy and the mean return of all of them, on days when the strategy finished a deal.
DAILY = """p as (select strategy, exit_date as ts, sum(pnl) as pnl from deals group by strategy, exit_date), e as (select strategy, ts, pnl / 1000000.0 as r, 1000000 + sum(pnl) over (partition by strategy order by ts) as equity from p),
m as (select ts, avg(r) as b from e group by ts), j as (select e.strategy, e.ts, e.r, e.equity, m.b, row_number() over (partition by e.strategy order by e.ts) as k, count(*) over (partition by e.strategy) as n from e join m on e.ts = m.ts)"""
#: The standard normal distribution at z, by a rational approximation of the error function.
PHI = "case when z >= 0 then 1 - exp(-z * z / 2) * (.254829592 * u - .284496736 * u * u + 1.421413741 * u * u * u - 1.453152027 * u * u * u * u + 1.061405429 * u * u * u * u * u) / 2 else exp(-z * z / 2) * (.254829592 * u - .284496736 * u * u + 1.421413741 * u * u * u - 1.453152027 * u * u * u * u + 1.061405429 * u * u * u * u * u) / 2 end"
U = "1 / (1 + .3275911 * abs(z) / sqrt(2.0))"
#: Open lots of each symbol under FIFO: what the sells so far have not used up, the oldest first.
OPEN = f"""t as (select *, row_number() over (partition by symbol {T}) as k from trades),
c as (select symbol, k, ts, side, price, shares, sum(case when side = 'buy' then shares else 0.0 end) over (partition by symbol order by k) as b, sum(case when side = 'sell' then shares else 0.0 end) over (partition by symbol order by k) as s from t),
o as (select *, s - greatest(0.0, max(s - b) over (partition by symbol order by k)) as used from c), u as (select symbol, max(used) as used, max(ts) as as_of from o group by symbol),
lots as (select c.symbol, c.k, c.ts, c.price, least(c.shares, c.b - u.used) as shares, u.as_of from c join u on c.symbol = u.symbol where c.side = 'buy' and c.b > u.used),
now as (select symbol, price as mark from (select symbol, price, row_number() over (partition by symbol order by ts desc, id desc, line desc, part desc, price desc, shares desc) as k from trades) z where k = 1)"""
RATES = "case when days > 365 then .15 else .35 end"

OPERATORS = [
    operator("open_lots", "trades", "X6, B1 open remainders of FIFO lots with market value and unrealised profit at the latest price", f"""
with {OPEN} select lots.symbol, cast(k as bigint) as buy_no, shares, shares * mark as market_value, shares * (mark - price) as unrealised from lots join now on lots.symbol = now.symbol"""),
    operator("holding_periods", "deals", "B5 mean, upper median and buckets of holding periods, by strategy", """
with x as (select strategy, greatest(DAYS(exit_date, entry_date), 0) as days from deals), y as (select strategy, days, row_number() over (partition by strategy order by days) - 1 as k, count(*) over (partition by strategy) as n from x)
select strategy, round(avg(days), 4) as mean_days, max(case when k = floor(n / 2.0) then days end) as median_days, cast(sum(case when days < 7 then 1 else 0 end) as bigint) as under_7,
    cast(sum(case when days >= 7 and days < 30 then 1 else 0 end) as bigint) as under_30, cast(sum(case when days >= 30 and days < 90 then 1 else 0 end) as bigint) as under_90, cast(sum(case when days >= 90 then 1 else 0 end) as bigint) as longer from y group by strategy"""),
    operator("payoff_by_holding", "deals", "K9 trades, win rate and payoff by holding bucket", """
with x as (select strategy, pnl, greatest(DAYS(exit_date, entry_date), 0) as days from deals), b as (select *, case when days <= 1 then '0-1' when days <= 5 then '2-5' when days <= 10 then '6-10' when days <= 20 then '11-20' else '21+' end as held from x)
select strategy, held, cast(count(*) as bigint) as trades, round(avg(case when pnl > 0 then 1.0 else 0.0 end), 6) as win_rate, round(avg(pnl), 4) as mean_pnl, round(avg(case when pnl > 0 then pnl end) / nullif(-avg(case when pnl < 0 then pnl end), 0), 5) as payoff from b group by strategy, held"""),
    operator("exposure", "deals", "K10 most positions held at once and share of days in the market, by a sweep over entries and exits", """
with x as (select strategy, entry_date, greatest(exit_date, entry_date) as exit_date from deals), s as (select strategy, entry_date as ts, 1 as step from x union all select strategy, exit_date as ts, -1 as step from x),
d as (select strategy, ts, sum(step) as step from s group by strategy, ts), r as (select strategy, ts, sum(step) over (partition by strategy order by ts) as held, lead(ts) over (partition by strategy order by ts) as till from d)
select strategy, cast(max(held) as bigint) as most_held, round(sum(case when held > 0 then DAYS(till, ts) else 0 end) * 1.0 / sum(DAYS(till, ts)), 6) as in_market from r where till is not null group by strategy"""),
    operator("portfolio_risk", "trades", "B6 volatility, Sharpe, Sortino, VaR, CVaR and drawdown of each equity curve", f"""
with {RETURNS}, y as (select symbol, r, row_number() over (partition by symbol order by r) as k, count(*) {ALL} as n, 1 - equity / max(equity) {S} as dd from r where r is not null)
select symbol, round(stddev_samp(r) * sqrt(252.0), 6) as volatility, round((avg(r) * 252 - .05) / nullif(stddev_samp(r) * sqrt(252.0), 0), 4) as sharpe,
    round((avg(r) * 252 - .05) / nullif(sqrt(sum(power(least(r - .05 / 252, 0.0), 2)) / (max(n) - 1)) * sqrt(252.0), 0), 4) as sortino, round(-max(case when k = floor(.05 * n) + 1 then r end), 8) as var95,
    round(-avg(case when k <= greatest(1, floor(.05 * n)) then r end), 8) as cvar95, round(max(dd), 7) as max_drawdown from y group by symbol having count(*) >= 20"""),
    operator("concentration", "trades", "B6, R25 Herfindahl index and largest weight of the bought value, by side", """
with v as (select side, symbol, sum(shares * price) as v from trades group by side, symbol), w as (select side, v / sum(v) over (partition by side) as w from v)
select side, round(sum(w * w), 8) as hhi, round(max(w), 8) as largest, cast(count(*) as bigint) as symbols from w group by side"""),
    operator("time_weighted", "trades", "B7 time-weighted return, year to date and share of each symbol in the total profit", f"""
with {RETURNS}, y as (select symbol, ts, r, equity, max(ts) {ALL} as as_of from r), a as (select symbol, exp(sum(ln(1 + coalesce(r, equity / 100000 - 1)))) - 1 as twr,
    exp(sum(case when year(ts) = year(as_of) then ln(1 + coalesce(r, 0.0)) else 0.0 end)) - 1 as ytd, max(equity) as top from y where coalesce(r, equity / 100000 - 1) > -1 group by symbol)
select symbol, round(twr, 7) as twr, round(ytd, 7) as ytd from a"""),
    operator("benchmark", "deals", "B8, K2 alpha, beta, R squared, tracking error, information ratio, Treynor and Jensen against the mean of all strategies", f"""
with {DAILY}, a as (select strategy, regr_intercept(r, b) * 252 as alpha, regr_slope(r, b) as beta, regr_r2(r, b) as r2, stddev_samp(r - b) * sqrt(252.0) as te, avg(r - b) * 252 as active, avg(r) * 252 as mean, avg(b) * 252 as market from j group by strategy)
select strategy, round(alpha, 6) as alpha, round(beta, 5) as beta, round(r2, 5) as r2, round(te, 6) as tracking_error, round(active / nullif(te, 0), 5) as information_ratio,
    round((mean - .05) / nullif(beta, 0), 5) as treynor, round(mean - (.05 + beta * (market - .05)), 6) as jensen from a"""),
    operator("rolling_alpha", "deals", "B8 alpha over 63 days and the strategy's index from 100, at the last day", f"""
with {DAILY}, x as (select strategy, k, n, equity, first_value(equity) over (partition by strategy order by ts) as base, r, b from j)
select strategy, round(max(case when k = n then 100 * equity / base end), 5) as index_100, round(regr_intercept(case when k > n - 63 then r end, case when k > n - 63 then b end) * 252, 6) as alpha63 from x group by strategy"""),
    operator("rebalancing", "trades", "B9 drift of each symbol's weight from an equal one, its proposed trade and whether the drift passes a quarter of it", """
with v as (select symbol, sum(case when side = 'buy' then shares else -shares end) as net, max(price) as price from trades group by symbol), h as (select symbol, greatest(net, 0.0) * price as value from v),
w as (select symbol, value, value / nullif(sum(value) over (), 0) as w, 1.0 / count(*) over () as target, sum(value) over () as total from h)
select symbol, round(w, 8) as weight, round(w - target, 8) as drift, round((target - w) * total, 2) as proposal, abs(w - target) > .25 * target as beyond from w"""),
    operator("fills", "bars", "K1 next bar's open with .1 % slippage and tiered commission for a cross of the 5 and 20 bar means", f"""
with x as (select symbol, ts, seq, avg(close) over (partition by symbol order by ts rows between 4 preceding and current row) - avg(close) over (partition by symbol order by ts rows between 19 preceding and current row) as gap, lead(open) {S} as next_open, lead(ts) {S} as next_ts from bars),
y as (select *, lag(gap) {S} as before from x where seq >= 19), f as (select symbol, next_ts as ts, case when gap > 0 then 'buy' else 'sell' end as side, case when gap > 0 then next_open * 1.001 else next_open * .999 end as fill from y
    where next_open is not null and (gap > .0000001 and before < -.0000001 or gap < -.0000001 and before > .0000001))
select symbol, ts, side, fill, greatest(1.0, 100 * fill * case when fill < 1000 then .001 when fill < 1500 then .0008 else .0005 end) as commission from f"""),
    operator("recovery", "trades", "K6, K3 drawdowns with trough and recovery: share of days under water, mean and longest length, by equity curve", f"""
with {EQUITY}, h as (select symbol, ts, equity, max(equity) over (partition by symbol order by ts) as top from q), i as (select *, sum(case when equity >= top then 1 else 0 end) over (partition by symbol order by ts) as island, max(ts) {ALL} as last_ts from h),
g as (select symbol, island, min(ts) as peak, max(1 - equity / top) as depth, count(*) - 1 as days, max(ts) as till, max(last_ts) as last_ts from i group by symbol, island), e as (select * from g where days > 0)
select symbol, cast(count(*) as bigint) as drawdowns, cast(sum(case when till = last_ts then 1 else 0 end) as bigint) as unrecovered, round(avg(days), 4) as mean_days, cast(max(days) as bigint) as longest, round(max(depth), 7) as deepest from e group by symbol"""),
    operator("drawdown_ratios", "trades", "K5 conditional drawdown at risk of 5 %, Burke and Sterling ratios over the five deepest drawdowns", f"""
with {EQUITY}, h as (select symbol, ts, equity, max(equity) over (partition by symbol order by ts) as top, first_value(equity) over (partition by symbol order by ts desc) as latest from q),
i as (select *, 100 * (1 - equity / top) as dd, sum(case when equity >= top then 1 else 0 end) over (partition by symbol order by ts) as island from h),
k as (select symbol, dd, row_number() over (partition by symbol order by dd desc) as j, count(*) {ALL} as n from i), c as (select symbol, avg(case when j <= ceil(.05 * n) then dd end) as cdar from k group by symbol),
g as (select symbol, island, max(dd) as depth, max(100 * (latest / 100000 - 1)) as total from i group by symbol, island), t as (select *, row_number() over (partition by symbol order by depth desc, island) as j from g where depth > 0)
select t.symbol, round(max(cdar), 6) as cdar, round(max(total) / nullif(sqrt(sum(depth * depth)), 0), 5) as burke, round(max(total) / (avg(depth) + 10), 5) as sterling from t join c on t.symbol = c.symbol where j <= 5 group by t.symbol"""),
    operator("sqn", "trades", "K7 system quality number, expectancy and payoff of each symbol with 30 trades or more", """
select symbol, round(sqrt(least(count(*), 100.0)) * avg(pnl) / nullif(stddev_samp(pnl), 0), 5) as sqn, round(avg(pnl), 4) as expectancy, round(avg(case when pnl > 0 then pnl end) / nullif(-avg(case when pnl < 0 then pnl end), 0), 5) as payoff from trades group by symbol having count(*) >= 30"""),
    operator("buy_and_hold", "bars", "K11 value of 10,000 held in each symbol and in all equally since the first day, by month's last bar, a missing day at the last price", f"""
with x as (select symbol, ts, date_trunc('month', ts) as month, close, first_value(close) {S} as base from bars), m as (select symbol, month, close / base as growth, row_number() over (partition by symbol, month order by ts desc) as k from x),
a as (select month, avg(growth) as every from m where k = 1 group by month)
select m.symbol, cast(year(m.month) * 100 + month(m.month) as integer) as month, round(10000 * m.growth, 4) as held, round(10000 * a.every, 4) as market from m join a on m.month = a.month where k = 1"""),
    operator("strategy_ratios", "deals", "K12 Sharpe, Sortino, Calmar, recovery factor and omega, tail ratio of each strategy", f"""
with {DAILY}, x as (select strategy, r, equity, 1 - equity / max(equity) over (partition by strategy order by ts) as dd, row_number() over (partition by strategy order by r) as q, n, k from j)
select strategy, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252.0), 5) as sharpe, round(avg(r) / nullif(sqrt(avg(power(least(r, 0.0), 2))), 0) * sqrt(252.0), 5) as sortino, round(avg(r) * 252 / nullif(max(dd), 0), 5) as calmar,
    round((max(case when k = n then equity end) / 1000000 - 1) / nullif(max(dd), 0), 5) as recovery, round(sum(greatest(r, 0.0)) / nullif(sum(greatest(-r, 0.0)), 0), 5) as omega,
    round(abs(max(case when q = floor(.95 * (n - 1) + .5) + 1 then r end)) / nullif(abs(max(case when q = floor(.05 * (n - 1) + .5) + 1 then r end)), 0), 5) as tail_ratio from x group by strategy"""),
    operator("folds_cv", "deals", "K15 combinatorial purged folds: Sharpe of every pair of six time folds, without five days on either side of a fold", f"""
with {DAILY}, f as (select strategy, r, k, n, cast(floor((k - 1) * 6.0 / n) as integer) as fold from j), g as (select *, min(k) over (partition by strategy, fold) as a, max(k) over (partition by strategy, fold) as b from f),
h as (select * from g where k - a >= 5 and b - k >= 5), c as (select distinct x.fold as one, y.fold as two from f x join f y on x.fold < y.fold),
s as (select h.strategy, c.one, c.two, avg(h.r) / nullif(stddev_samp(h.r), 0) * sqrt(252.0) as sharpe from h join c on h.fold = c.one or h.fold = c.two group by h.strategy, c.one, c.two)
select strategy, cast(count(*) as bigint) as paths, round(avg(sharpe), 5) as mean_sharpe, round(min(sharpe), 5) as worst, round(avg(case when sharpe > 0 then 1.0 else 0.0 end), 6) as positive from s group by strategy"""),
    operator("overfitting", "deals", "K16 probability of overfitting: how often the best strategy of one half of eight blocks is below the middle in the other, over all 70 splits", f"""
with {DAILY}, f as (select strategy, r, cast(floor((k - 1) * 8.0 / n) as integer) as block from j), bits as (select 0 as v union all select 1), splits as (select a.v + 2 * b.v + 4 * c.v + 8 * d.v + 16 * e.v + 32 * f.v + 64 * g.v + 128 * h.v as mask from bits a, bits b, bits c, bits d, bits e, bits f, bits g, bits h where a.v + b.v + c.v + d.v + e.v + f.v + g.v + h.v = 4),
sides as (select mask, strategy, avg(case when floor(mask / power(2, block)) % 2 = 1 then r end) / nullif(stddev_samp(case when floor(mask / power(2, block)) % 2 = 1 then r end), 0) as inside,
    avg(case when floor(mask / power(2, block)) % 2 = 0 then r end) / nullif(stddev_samp(case when floor(mask / power(2, block)) % 2 = 0 then r end), 0) as outside from f cross join splits group by mask, strategy),
k as (select *, row_number() over (partition by mask order by inside desc, strategy) as best, (rank() over (partition by mask order by outside) - .5) / count(*) over (partition by mask) as place from sides)
select cast(count(*) as bigint) as splits, round(avg(case when place < .5 then 1.0 else 0.0 end), 6) as pbo, round(avg(outside), 6) as mean_outside from k where best = 1"""),
    operator("deflated_sharpe", "deals", "K17 Sharpe deflated by the number of strategies tried, with skewness and kurtosis, and the share lost out of sample", f"""
with {DAILY}, y as (select strategy, r, r - avg(r) over (partition by strategy) as d, n, case when k <= .7 * n then 1 else 0 end as inside from j),
a as (select strategy, max(n) as n, avg(r) / nullif(stddev_samp(r), 0) as sr, avg(d * d * d) / power(avg(d * d), 1.5) as skew, avg(d * d * d * d) / power(avg(d * d), 2) as kurt,
    avg(case when inside = 1 then r end) / nullif(stddev_samp(case when inside = 1 then r end), 0) as inside, avg(case when inside = 0 then r end) / nullif(stddev_samp(case when inside = 0 then r end), 0) as outside from y group by strategy),
b as (select *, sqrt(2 * ln(count(*) over ())) * stddev_samp(sr) over () as expected from a), c as (select *, (sr - expected) * sqrt(n - 1.0) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) as z from b), erf as (select *, {U} as u from c)
select strategy, round(sr, 7) as sharpe, round(expected, 7) as expected_best, round({PHI}, 6) as probability, round(1 - outside / nullif(inside, 0), 4) as degradation from erf"""),
    operator("market_impact", "bars", "K18 square-root impact of an order of a tenth of the bar, from 20 bars of volume and volatility", f"""
with x as (select symbol, ts, seq, close, volume, ln(close / lag(close) {S}) as r from bars), y as (select symbol, ts, seq, close, volume, avg(volume) over (partition by symbol order by ts rows between 20 preceding and 1 preceding) as adv, stddev_pop(r) over (partition by symbol order by ts rows between 20 preceding and 1 preceding) as sd from x)
select symbol, ts, round(sd * sqrt(.1 * volume / adv), 7) as impact, round(close * sd * sqrt(.1 * volume / adv), 5) as cost from y where seq >= 21 and adv > 0"""),
    operator("permanent_impact", "bars", "K19 permanent impact that decays by .9 a bar, summed over all orders of a symbol", f"""
with x as (select symbol, seq, volume, count(*) {ALL} as n, avg(volume) {ALL} as adv from bars)
select symbol, round(sum(.1 * sqrt(volume / adv) * power(.9, n - 1 - seq)), 7) as impact from x group by symbol"""),
    operator("walk_forward", "bars", "K20 best of four momentum lookbacks in each fold of 100 bars and its Sharpe in the next fold", f"""
with g as (select 5 as n union all select 10 union all select 20 union all select 40), x as (select symbol, ts, seq, close, lead(close) {S} / close - 1 as nxt, close / lag(close, 5) {S} - 1 as m5, close / lag(close, 10) {S} - 1 as m10, close / lag(close, 20) {S} - 1 as m20, close / lag(close, 40) {S} - 1 as m40 from bars),
p as (select symbol, cast(floor(seq / 100.0) as integer) as fold, n, case when case n when 5 then m5 when 10 then m10 when 20 then m20 else m40 end > 0 then nxt else 0.0 end as r from x cross join g where seq >= 40 and nxt is not null),
s as (select symbol, fold, n, round(avg(r) / nullif(stddev_samp(r), 0), 9) as sharpe from p group by symbol, fold, n), k as (select *, row_number() over (partition by symbol, fold order by sharpe desc, n) as place from s where sharpe is not null),
w as (select k.symbol, k.fold, k.n, k.sharpe as inside, s.sharpe as outside from k join s on k.symbol = s.symbol and k.n = s.n and s.fold = k.fold + 1 where k.place = 1)
select symbol, cast(count(*) as bigint) as folds, round(avg(inside), 6) as inside, round(avg(outside), 6) as outside, round(avg(outside) / nullif(avg(inside), 0), 3) as efficiency from w group by symbol"""),
    operator("short_rules", "bars", "K22 a short of each symbol from 60 bars ago: fill, mark, profit and first touch of a stop 5 % above or a target 10 % below", f"""
with x as (select symbol, ts, seq, open, high, low, close, count(*) {ALL} as n from bars), e as (select symbol, open * .999 as fill, ts as entered from x where seq = n - 60),
h as (select x.symbol, max(e.fill) as fill, max(case when x.seq = n - 1 then close end) as mark, min(case when high >= 1.05 * e.fill then x.ts end) as stopped, min(case when low <= .9 * e.fill then x.ts end) as hit from x join e on x.symbol = e.symbol where x.ts >= e.entered group by x.symbol)
select symbol, round(fill, 6) as fill, round(fill - mark, 6) as profit, case when stopped is not null and (hit is null or stopped <= hit) then 'stop' when hit is not null then 'target' else 'open' end as outcome, coalesce(least(stopped, hit), stopped, hit) as touched from h"""),
    operator("tear_sheet", "deals", "K21, K23 one row of headline figures for each strategy, the best first", f"""
with {DAILY}, a as (select strategy, count(*) as days, max(case when k = n then equity end) / 1000000 - 1 as total, avg(r) / nullif(stddev_samp(r), 0) * sqrt(252.0) as sharpe from j group by strategy),
b as (select strategy, count(*) as trades, avg(case when pnl > 0 then 1.0 else 0.0 end) as wins, max(pnl) as best, min(pnl) as worst from deals group by strategy)
select a.strategy, cast(trades as bigint) as trades, cast(days as bigint) as days, round(total, 6) as total, round(sharpe, 5) as sharpe, round(wins, 6) as win_rate, round(best, 4) as best, round(worst, 4) as worst from a join b on a.strategy = b.strategy order by total desc, a.strategy"""),
    operator("risk_radar", "bars trades interactions documents", "X1 six dimensions from 0 to 100 of each symbol, their weighted mean, its level, the worst dimension and whether one is above 80", f"""
with p as (select symbol, ts, seq, close, volume, high, low, close / lag(close) {S} - 1 as r, case when seq > 0 then greatest(high - low, abs(high - lag(close) {S}), abs(low - lag(close) {S})) / close end as tr, row_number() over (partition by symbol order by ts desc) as k from bars),
m as (select ts, avg(r) as rb from p where r is not null group by ts),
a as (select p.symbol, regr_slope(r, rb) as beta, corr(r, rb) as corr_b, stddev_samp(r) * sqrt(252.0) as vol, avg(case when k <= 14 then tr end) as atr, avg(volume) as volume, avg((high - low) / close) as spread from p join m on p.ts = m.ts where r is not null group by p.symbol having count(*) >= 20),
t as (select max(symbol) as top from bars), n as (select max(ts) as as_of from interactions), ev as (select event_id % top + 1 as symbol, min(DAYS(as_of, ts)) as days from interactions cross join t cross join n group by event_id % top + 1),
h as (select symbol, symbol % 11 as sector, sum(shares * price) as value from trades where side = 'buy' group by symbol), s as (select sector, sum(value) as value, count(*) as positions from h group by sector), w as (select sum(value) as value, sum(positions) as positions from s),
c as (select h.symbol, h.value / w.value as position, s.value / w.value as sector, w.positions from h join s on h.sector = s.sector cross join w),
news as (select doc_id % top + 1 as symbol, count(*) as articles, stddev_pop((n_chars % 100) / 100.0) as moves, avg((n_chars % 100) / 100.0) as sure from documents cross join t group by doc_id % top + 1),
d as (select a.symbol,
    .5 * greatest(0.0, least(100.0, (beta - .5) / 1.5 * 100)) + .5 * abs(corr_b) * 100 as market,
    .6 * greatest(0.0, least(100.0, (vol - .10) / .50 * 100)) + .4 * greatest(0.0, least(100.0, (atr - .005) / .045 * 100)) as volatility,
    .5 * greatest(0.0, least(100.0, (7 - ln(greatest(volume, 1.0)) / ln(10.0)) / 2 * 100)) + .5 * greatest(0.0, least(100.0, (spread - .0001) / .01 * 100)) as liquidity,
    20.0 + case when days <= 3 then 40 when days <= 7 then 25 when days <= 14 then 10 else 0 end as event,
    .4 * greatest(0.0, least(100.0, (coalesce(position, 0.0) - .02) / .23 * 100)) + .3 * greatest(0.0, least(100.0, (coalesce(sector, 0.0) - .10) / .40 * 100)) + .3 * least(100.0, greatest(20 - coalesce(positions, 0), 0) / 15.0 * 100) as concentration,
    .4 * least(100.0, 100 * coalesce(moves, 0.0)) + .4 * 100 * (1 - coalesce(sure, 0.0)) + .2 * least(100.0, greatest(50 - coalesce(articles, 0), 0) / 45.0 * 100) as sentiment
    from a left join ev on a.symbol = ev.symbol left join c on a.symbol = c.symbol left join news on a.symbol = news.symbol),
o as (select symbol, round(market, 4) as market, round(volatility, 4) as volatility, round(liquidity, 4) as liquidity, round(event, 4) as event, round(concentration, 4) as concentration, round(sentiment, 4) as sentiment,
    round(.20 * market + .25 * volatility + .10 * liquidity + .15 * event + .15 * concentration + .15 * sentiment, 4) as overall from d)
select *, case when overall < 25 then 'low' when overall < 45 then 'moderate' when overall < 65 then 'elevated' when overall < 80 then 'high' else 'critical' end as level,
    case greatest(market, volatility, liquidity, event, concentration, sentiment) when market then 'market' when volatility then 'volatility' when liquidity then 'liquidity' when event then 'event' when concentration then 'concentration' else 'sentiment' end as worst,
    greatest(market, volatility, liquidity, event, concentration, sentiment) > 80 as alert from o"""),
    operator("position_sizes", "bars", "X2, E14 shares at 2 % risk of 100,000 over a stop of two mean ranges, at most a tenth of the capital", f"""
with x as (select symbol, ts, seq, close, case when seq > 0 then greatest(high - low, abs(high - lag(close) {S}), abs(low - lag(close) {S})) end as tr, row_number() over (partition by symbol order by ts desc) as k from bars),
y as (select symbol, avg(case when k <= 14 then tr end) as tr, max(case when k = 1 then close end) as close from x group by symbol)
select symbol, round(2 * tr, 6) as stop_distance, cast(floor(round(least(2000 / (2 * tr), 10000 / close), 6)) as bigint) as shares from y where tr > 0"""),
    operator("portfolio_guard", "trades", "X5 reason to refuse one more position: exposure, concentration or the last day's loss", f"""
with {EQUITY}, e as (select symbol, pnl, equity, row_number() over (partition by symbol order by ts desc) as k from q), v as (select symbol, sum(case when side = 'buy' then shares * price else -shares * price end) as net from trades group by symbol),
w as (select v.symbol, abs(v.net) / nullif(sum(abs(v.net)) over (), 0) as share, e.pnl / e.equity as day, abs(v.net) / e.equity as gross from v join e on v.symbol = e.symbol where e.k = 1)
select symbol, round(share, 8) as share, round(day, 8) as day, case when gross > 100 then 'gross exposure' when share > .02 then 'concentration' when day < -.02 then 'daily loss' else 'allowed' end as verdict from w"""),
    operator("tax_summary", "deals", "X7 short and long gains and losses of each year at their rates, a deduction of at most 3,000 and the loss carried on", f"""
with x as (select symbol, cast(year(exit_date) as integer) as tax_year, pnl, DAYS(exit_date, entry_date) as days from deals),
y as (select symbol, tax_year, sum(case when days <= 365 then pnl else 0.0 end) as short_net, sum(case when days > 365 then pnl else 0.0 end) as long_net, sum(pnl) as net from x group by symbol, tax_year)
select symbol, tax_year, round(short_net, 3) as short_net, round(long_net, 3) as long_net, round(greatest(short_net, 0.0) * .35 + greatest(long_net, 0.0) * .15, 3) as tax, round(least(greatest(-net, 0.0), 3000.0), 3) as deduction, round(greatest(-net - 3000, 0.0), 3) as carried from y"""),
    operator("sale_impact", "trades", "X8 gain, days and tax of selling half of the open shares of each symbol, the oldest lots first", f"""
with {OPEN}, z as (select lots.*, mark, sum(shares) over (partition by lots.symbol) / 2 as wanted, sum(shares) over (partition by lots.symbol order by k) - shares as ahead, DAYS(as_of, ts) as days from lots join now on lots.symbol = now.symbol),
s as (select symbol, least(shares, wanted - ahead) as sold, mark, price, days from z where ahead < wanted)
select symbol, round(sum(sold), 4) as sold, round(sum(sold * (mark - price)), 3) as gain, round(sum(case when mark > price then sold * (mark - price) * {RATES} else 0.0 end), 3) as tax from s group by symbol"""),
    operator("wash_windows", "trades", "X10 windows of 30 days about each symbol's losses in the last year, the day from which buying is safe and whether one is open at the end", f"""
with n as (select max(ts) as as_of from trades), l as (select symbol, ts, pnl, as_of from trades cross join n where side = 'sell' and pnl < 0 and DAYS(as_of, ts) <= 365),
near as (select -1 as o union all select 0 union all select 1), b as (select distinct symbol, ts, floor(DAYS(ts, '1970-01-01') / 31.0) as bucket from trades where side = 'buy'),
d as (select distinct symbol, ts, floor(DAYS(ts, '1970-01-01') / 31.0) + o as bucket from l cross join near), h as (select d.symbol, d.ts from d join b on d.symbol = b.symbol and d.bucket = b.bucket and abs(DAYS(b.ts, d.ts)) <= 30 group by d.symbol, d.ts)
select l.symbol, cast(count(*) as bigint) as windows, round(sum(pnl), 1) as losses, cast(count(h.ts) as bigint) as triggered, min(DAYS(as_of, l.ts)) as days_since_last, min(DAYS(as_of, l.ts)) <= 30 as is_open, greatest(31 - min(DAYS(as_of, l.ts)), 0) as safe_in from l left join h on l.symbol = h.symbol and l.ts = h.ts group by l.symbol"""),
    operator("harvest", "trades", "X11 open lots with a loss of 100 and 5 % or more, what a sale saves in tax, with a priority: the top 50", f"""
with {OPEN}, x as (select lots.symbol, k, shares * (price - mark) as loss, 1 - mark / price as share, DAYS(as_of, ts) as days from lots join now on lots.symbol = now.symbol)
select symbol, cast(k as bigint) as buy_no, round(loss, 4) as loss, round(loss * {RATES}, 4) as saves, case when loss * {RATES} > 2000 then 'high' when loss * {RATES} > 500 then 'medium' else 'low' end as priority
from x where loss >= 100 and share >= .05 order by round(loss * {RATES}, 4) desc, symbol, k limit 50"""),
    operator("pnl_by_day", "trades", "D7, D5 best and worst trade of each of the last 30 days with trades, wins and profit", """
with d as (select distinct ts from trades order by ts desc limit 30), x as (select trades.ts, symbol, pnl, id, line, row_number() over (partition by trades.ts order by pnl desc, symbol, id, line) as top, row_number() over (partition by trades.ts order by pnl, symbol, id, line) as bottom from trades join d on trades.ts = d.ts)
select ts, cast(count(*) as bigint) as trades, cast(sum(case when pnl > 0 then 1 else 0 end) as bigint) as wins, round(sum(pnl), 1) as pnl, max(case when top = 1 then symbol end) as best, max(case when bottom = 1 then symbol end) as worst from x group by ts"""),
    operator("trades_beside_deals", "trades deals", "D6 trades of the last 30 days left joined with finished deals of their symbol: rows multiply by symbol, so they are counted", """
with n as (select max(ts) as as_of from trades), t as (select symbol, id, line, part from trades cross join n where DAYS(as_of, ts) <= 30), g as (select symbol, count(*) as deals, sum(pnl) as pnl from deals group by symbol)
select t.symbol, cast(count(*) * max(coalesce(g.deals, 0)) as bigint) as joined_rows, cast(count(*) as bigint) as trades, round(max(g.pnl), 2) as deals_pnl from t left join g on t.symbol = g.symbol group by t.symbol"""),
    operator("conviction_report", "deals", "D1, D4 deals, wins, profit and distinct symbols by strategy and conviction, and overall", """
with x as (select strategy, symbol, pnl, case when confidence > .5 then 'high' when confidence > .25 then 'moderate' else 'low' end as tier from deals)
select strategy, tier, cast(count(*) as bigint) as deals, cast(sum(case when pnl > 0 then 1 else 0 end) as bigint) as wins, cast(count(distinct symbol) as bigint) as symbols, round(sum(pnl), 1) as pnl from x group by grouping sets ((strategy, tier), (strategy), ())"""),
    operator("alert_accuracy", "deals", "B10, B11 accuracy of alerts by strategy and overall, those past 30 days without a result counted as expired", """
with x as (select strategy, pnl, case when DAYS(exit_date, entry_date) > 30 then 'expired' else 'done' end as status from deals)
select strategy, status, cast(count(*) as bigint) as alerts, round(avg(case when pnl > 0 then 1.0 else 0.0 end), 6) as accuracy from x group by rollup(strategy, status)"""),
]
