"""Adaptive statistics, returns and risk, and the market's regime."""

from ..functions.operator import operator

S = "over (partition by symbol order by ts)"
ALL = "over (partition by symbol)"
W60 = "over (partition by symbol order by ts rows between 59 preceding and current row)"
R = f"r as (select symbol, ts, seq, close, r, ts as t from (select symbol, ts, seq, close, close / lag(close) {S} - 1 as r from bars) z where r is not null)"
MARKET = f"{R}, m as (select ts, avg(r) as b from r group by ts)"

OPERATORS = [
    operator("returns", "bars", "R1 simple and log returns", f"""
with x as (select symbol, ts, close, lag(close) {S} as before from bars)
select symbol, ts, round(close / before - 1, 7) as simple, round(ln(close / before), 7) as log_return from x where before is not null"""),
    operator("z_score", "bars", "A1 mean, deviation, z-score (0 without spread) and outlier flag of closes", f"""
with x as (select symbol, ts, close, avg(close) {ALL} as m, stddev_samp(close) {ALL} as sd from bars)
select symbol, ts, round(case when sd > 0.0000001 then (close - m) / sd else 0.0 end, 5) as z, coalesce(round(abs(close - m) - 2 * sd, 9) > 0, false) as outlier from x"""),
    operator("percentile_rank", "bars", "A2 percentile rank, ties counting half", """
select symbol, ts, round((rank() over (partition by symbol order by volume) - 1 + 0.5 * count(*) over (partition by symbol, volume))
    / count(*) over (partition by symbol), 6) as percentile from bars"""),
    operator("percentile_value", "bars", "A3 nearest-rank 5th, 50th and 95th percentile", """
with x as (select symbol, close, row_number() over (partition by symbol order by close) - 1 as k, count(*) over (partition by symbol) - 1 as n from bars)
select symbol, round(max(case when k = floor(.05 * n + .5) then close end), 6) as p05, round(max(case when k = floor(.5 * n + .5) then close end), 6) as p50,
    round(max(case when k = floor(.95 * n + .5) then close end), 6) as p95 from x group by symbol"""),
    operator("sharpe", "bars", "R2, R5 annual Sharpe ratio and volatility, whole and over the last 60 bars", f"""
with {R}, y as (select symbol, ts, r, avg(r) {ALL} as m, stddev_samp(r) {ALL} as sd, avg(r) {W60} as m60, stddev_samp(r) {W60} as sd60,
    row_number() over (partition by symbol order by ts desc) as k, count(*) {ALL} as n from r)
select symbol, round((m * 252 - .045) / (sd * sqrt(252.0)), 5) as sharpe, round(sd * sqrt(252.0), 5) as volatility,
    round((m60 * 252 - .045) / (sd60 * sqrt(252.0)), 5) as sharpe60 from y where k = 1 and n >= 60"""),
    operator("sortino", "bars", "R3 Sortino ratio, capped at 99.99", f"""
with {R}, y as (select symbol, avg(r) as m, sum(power(least(r - .045 / 252, 0.0), 2)) as d, count(*) as n from r group by symbol)
select symbol, round(least(case when d > 0 then (m * 252 - .045) / (sqrt(d / (n - 1)) * sqrt(252.0)) else 99.99 end, 99.99), 5) as sortino from y where n > 1"""),
    operator("drawdown", "bars", "R4 largest and current drawdown", f"""
with x as (select symbol, ts, 1 - close / max(close) {S} as dd, row_number() over (partition by symbol order by ts desc) as k from bars)
select symbol, round(max(dd), 6) as max_drawdown, round(max(case when k = 1 then dd end), 6) as current_drawdown from x group by symbol"""),
    operator("beta", "bars", "R6, R24 beta, alpha, R squared and tracking error against the mean return of all symbols", f"""
with {MARKET}
select r.symbol, round(regr_slope(r.r, m.b), 5) as beta, round(regr_intercept(r.r, m.b) * 252, 5) as alpha, round(regr_r2(r.r, m.b), 5) as r2,
    round(stddev_samp(r.r - m.b) * sqrt(252.0), 5) as tracking_error from r join m on r.ts = m.ts group by r.symbol"""),
    operator("value_at_risk", "bars", "R7, R8, R9 historical VaR and expected shortfall at 5 %, Rachev ratio", f"""
with {R}, y as (select symbol, r, row_number() over (partition by symbol order by r) as k, count(*) {ALL} as n from r)
select symbol, round(-max(case when k = floor(.05 * n) + 1 then r end), 6) as var95, round(-avg(case when k <= ceil(.05 * n) then r end), 6) as cvar95,
    round(avg(case when k > n - ceil(.05 * n) then r end) / -avg(case when k <= ceil(.05 * n) then r end), 5) as rachev from y group by symbol"""),
    operator("omega", "bars", "R10, R15 omega ratio over an annual threshold of 2 % and Kelly fraction", f"""
with {R}, y as (select symbol, sum(greatest(r - .02 / 252, 0.0)) as up, sum(greatest(.02 / 252 - r, 0.0)) as down, avg(case when r > 0 then r end) as win, avg(case when r < 0 then -r end) as loss,
    avg(case when r > 0 then 1.0 else 0.0 end) as p from r group by symbol)
select symbol, round(case when down > 0 then up / down when up > 0 then 99.99 else 1.0 end, 5) as omega,
    round(case when win > 0 and loss > 0 then greatest(-1.0, least(1.0, p - (1 - p) / (win / loss))) else 0.0 end, 5) as kelly from y"""),
    operator("moments", "bars", "R11 population skewness and excess kurtosis", f"""
with {R}, y as (select symbol, r - avg(r) {ALL} as d from r), z as (select symbol, avg(d * d) as m2, avg(d * d * d) as m3, avg(d * d * d * d) as m4 from y group by symbol)
select symbol, round(m3 / power(m2, 1.5), 4) as skewness, round(m4 / (m2 * m2) - 3, 4) as kurtosis from z where m2 > 0"""),
    operator("autocorrelation", "bars", "R12 autocorrelation at lag 1 about the whole series' mean", f"""
with {R}, y as (select symbol, ts, r - avg(r) {ALL} as d from r), z as (select symbol, d, lag(d) {S} as d1 from y)
select symbol, round(sum(d * d1) / sum(d * d), 6) as autocorrelation from z group by symbol"""),
    operator("momentum", "bars", "R16 twelve-month less one-month return at the last bar", f"""
with x as (select symbol, ts, close, lag(close, 20) {S} as c20, lag(close, 251) {S} as c251, row_number() over (partition by symbol order by ts desc) as k from bars)
select symbol, round((close / c251 - 1) - (close / c20 - 1), 6) as momentum from x where k = 1 and c251 is not null"""),
    operator("half_life", "bars", "R17 half-life of the deviation from the 20-bar mean", f"""
with x as (select symbol, ts, seq, close - avg(close) over (partition by symbol order by ts rows between 19 preceding and current row) as d from bars),
y as (select symbol, d, lag(d) {S} as d1 from x where seq >= 19), z as (select symbol, sum(d * d1) / sum(case when d is not null then d1 * d1 end) as rho from y where d1 is not null group by symbol)
select symbol, round(rho, 6) as rho, case when rho > 0 and rho < 1 then round(-ln(2.0) / ln(rho), 4) end as half_life from z"""),
    operator("jumps", "bars", "R18 days beyond three population deviations, and their absolute returns over all days; 0 under 20 returns", f"""
with {R}, y as (select symbol, r, avg(r) {ALL} as m, stddev_pop(r) {ALL} as sd, count(*) {ALL} as n from r)
select symbol, cast(sum(case when n >= 20 and abs(r - m) > 3 * sd then 1 else 0 end) as bigint) as jumps,
    round(sum(case when n >= 20 and abs(r - m) > 3 * sd then abs(r) else 0.0 end) / max(n), 6) as intensity from y group by symbol"""),
    operator("momentum_win_rate", "bars", "R19 share of days on which the return keeps its sign, and on which the price comes back to its 10-bar mean", f"""
with {R}, y as (select symbol, r, lead(r) {S} as nxt, close - avg(close) over (partition by symbol order by ts rows between 9 preceding and current row) as off, row_number() {S} as k from r)
select symbol, round(avg(case when r * nxt > 0 then 1.0 else 0.0 end), 6) as win_rate, round(avg(case when k >= 10 then case when off * nxt < 0 then 1.0 else 0.0 end end), 6) as reversion_rate from y where nxt is not null group by symbol"""),
    operator("seasonality", "bars", "R20 mean daily return of each calendar month with its z-score", f"""
with {R}
select symbol, cast(month(ts) as integer) as month, round(avg(r), 7) as mean_return, round(avg(r) / (stddev_samp(r) / sqrt(count(*))), 4) as z, cast(count(*) as bigint) as days
from r group by symbol, month(ts) having count(*) > 2"""),
    operator("hurst_blocks", "bars", "R14 rescaled range over blocks of 8 to 128 returns and the Hurst exponent", f"""
with {R}, sizes as (select 8 as size union all select 16 union all select 32 union all select 64 union all select 128),
n as (select r.*, count(*) {ALL} as n, row_number() {S} - 1 as i from r),
b as (select symbol, ts, r, size, floor(i / cast(size as double)) as block from n cross join sizes where i < floor(n / cast(size as double)) * size),
d as (select symbol, size, block, ts, r - avg(r) over (partition by symbol, size, block) as d, stddev_pop(r) over (partition by symbol, size, block) as sd from b),
c as (select symbol, size, block, sd, sum(d) over (partition by symbol, size, block order by ts) as c from d),
q as (select symbol, size, block, (max(c) - min(c)) / max(sd) as rs from c where sd > 0 group by symbol, size, block),
e as (select symbol, size, avg(rs) as rs from q group by symbol, size)
select symbol, round(greatest(0.0, least(1.0, regr_slope(ln(rs), ln(cast(size as double))))), 5) as hurst from e where rs > 0 group by symbol having count(*) >= 2"""),
    operator("regime", "bars", "G1 regime with the highest of five scores from ATR, trend, deviation and range efficiency of a symbol's bars", f"""
with x as (select symbol, ts, seq, close, close / lag(close) {S} - 1 as r, abs(close - lag(close) {S}) as step, count(*) {ALL} as n,
    case when seq > 0 then greatest(high - low, abs(high - lag(close) {S}), abs(low - lag(close) {S})) end as tr, first_value(close) {S} as first_close from bars),
m as (select symbol, max(n) as n, 100 * avg(case when seq >= n - 14 then tr end) / max(case when seq = n - 1 then close end) as atr,
    regr_slope(case when seq >= n - 20 then close end, case when seq >= n - 20 then cast(seq as double) end) / avg(case when seq >= n - 20 then close end) as trend,
    stddev_pop(r) as sd, abs(max(case when seq = n - 1 then close end) - max(first_close)) / sum(step) as efficiency from x group by symbol),
s as (select *, case when trend > .01 and efficiency > .5 then 50 else 0 end as up, case when trend < -.01 and efficiency > .5 then 50 else 0 end as down,
    case when efficiency < .3 and sd < .025 then 40 else 0 end as ranging, case when sd > .03 then 40 else 0 end + case when atr > 3 then 20 else 0 end as wild,
    case when sd < .01 then 30 else 0 end + case when atr < 1 then 20 else 0 end as calm from m where n >= 50),
t as (select *, greatest(up, down, ranging, wild, calm) as top from s)
select symbol, case top when up then 'trending up' when down then 'trending down' when ranging then 'ranging' when wild then 'volatile' else 'calm' end as regime,
    round(top / 100.0, 2) as confidence, round(atr, 4) as atr, round(trend, 6) as trend, round(sd, 6) as deviation, round(efficiency, 6) as efficiency from t"""),
    operator("volatility_regime", "bars", "G4 regime of the last 20 returns by annual volatility over 30 % and under 12 %, and a size multiplier", f"""
with {R}, y as (select symbol, r, row_number() over (partition by symbol order by ts desc) as k from r),
v as (select symbol, stddev_samp(r) * sqrt(252.0) as v from y where k <= 20 group by symbol having count(*) >= 5)
select symbol, round(v, 6) as volatility, case when v > .30 then 'high' when v < .12 then 'low' else 'normal' end as regime,
    case when v > .30 then .5 when v < .12 then 1.2 else 1.0 end as size_multiplier from v"""),
    operator("ranking", "bars", "G10 ranks by 20-bar momentum and relative strength", f"""
with x as (select symbol, close / lag(close, 20) {S} - 1 as m, row_number() over (partition by symbol order by ts desc) as k from bars),
y as (select symbol, m, row_number() over (order by m desc, symbol) as place, count(*) over () as n from x where k = 1 and m is not null)
select symbol, round(m, 6) as momentum, cast(place as integer) as place, round(100 - (place - 1) * 100.0 / n, 4) as strength from y"""),
    operator("screen", "bars", "E5 to E8 quick metrics of each symbol's last bar, filtered and ranked", f"""
with x as (select symbol, ts, close, volume, seq, avg(close) over (partition by symbol order by ts rows between 19 preceding and current row) as sma20,
    avg(close) over (partition by symbol order by ts rows between 49 preceding and current row) as sma50, close / lag(close, 5) {S} - 1 as m5,
    avg(volume) over (partition by symbol order by ts rows between 4 preceding and current row) as v5,
    avg(volume) over (partition by symbol order by ts rows between 19 preceding and current row) as v20,
    stddev_pop(close) over (partition by symbol order by ts rows between 19 preceding and current row) as sd,
    1 - close / max(close) {S} as dd, row_number() over (partition by symbol order by ts desc) as k from bars),
y as (select symbol, close, 100 * (close / sma20 - 1) as to20, 100 * (close / sma50 - 1) as to50, 100 * m5 as m5, v5 / v20 as activity, sd / sma20 as spread, dd from x where k = 1 and seq >= 50 and sma20 > 0)
select symbol, round(close, 4) as close, round(to20, 4) as to_sma20, round(to50, 4) as to_sma50, round(m5, 4) as momentum5, round(activity, 4) as volume_ratio,
    round(dd, 4) as drawdown, round(.4 * to20 + .3 * to50 + .3 * m5, 4) as score from y where activity > .5 order by score desc, symbol limit 20"""),
]
