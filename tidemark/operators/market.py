"""Market-wide reports: regimes, sectors and flows, macro figures, factor models, correlations, screens and gates."""

from ..functions.operator import operator

S = "over (partition by symbol order by ts)"
ALL = "over (partition by symbol)"
Q = "over (partition by symbol order by fiscal_year, fiscal_quarter"


def last(n: int) -> str:
    return f"over (partition by symbol order by ts rows between {n - 1} preceding and current row)"


def rank_of(value: str, latest: str) -> str:
    return f"avg(case when {value} is null then null when {value} < {latest} then 1.0 when {value} = {latest} then .5 else 0.0 end)"


#: Returns beside the mean of all symbols, by day.
BESIDE = f"""p as (select symbol, ts, seq, close, volume, close / lag(close) {S} - 1 as r from bars), m as (select ts, avg(r) as rb from p where r is not null group by ts),
x as (select p.*, m.rb from p join m on p.ts = m.ts where p.r is not null)"""
#: Sectors are symbols modulo eleven; each one's mean changes over 1, 5 and 20 bars at the last bar.
SECTORS = f"""c as (select symbol, 100 * (close / lag(close, 1) {S} - 1) as d, 100 * (close / lag(close, 5) {S} - 1) as w, 100 * (close / lag(close, 20) {S} - 1) as mo, row_number() over (partition by symbol order by ts desc) as k from bars),
sectors as (select symbol % 11 as sector, round(avg(d), 6) as d, round(avg(w), 6) as w, round(avg(mo), 6) as mo from c where k = 1 and mo is not null group by symbol % 11)"""
#: Quick metrics of each symbol's last bar, for screens.
QUICK = f"""q as (select symbol, ts, seq, close, volume, 100 * (close / avg(close) {last(20)} - 1) as to20, 100 * (close / avg(close) {last(50)} - 1) as to50, 100 * (close / lag(close, 5) {S} - 1) as m5,
    avg(volume) {last(5)} / avg(volume) {last(20)} as activity, lag(close) {S} as before, row_number() over (partition by symbol order by ts desc) as k from bars),
g as (select symbol, avg(case when close > before then close - before else 0.0 end) as up, avg(case when close < before then before - close else 0.0 end) as down from q where k <= 14 and before is not null group by symbol),
quick as (select q.symbol, q.close, to20, to50, m5, activity, case when down > 0 then 100 - 100 / (1 + up / down) else 100.0 end as rsi from q join g on q.symbol = g.symbol where k = 1 and seq >= 50)"""

#: Quick metrics of every symbol, as the frame of screens.
QUICK_METRICS = operator("quick_metrics", "bars", "E5 quick metrics of each symbol's last bar", f"with {QUICK} select symbol, close, to20, to50, m5, activity, rsi from quick")

OPERATORS = [
    operator("regime_features", "bars", "G2 regime features with momentum and convergence of the means of 10 and 50 bars, and the regime of the highest score", f"""
with x as (select symbol, ts, seq, close, close / lag(close) {S} - 1 as r, close / lag(close, 20) {S} - 1 as m20, avg(close) {last(10)} as a10, avg(close) {last(50)} as a50, row_number() over (partition by symbol order by ts desc) as k from bars),
f as (select symbol, stddev_samp(case when k <= 20 then r end) as v, max(case when k = 1 then m20 end) as m20, max(case when k = 1 then a10 / a50 - 1 end) as convergence from x group by symbol having count(*) >= 50),
s as (select *, case when m20 > .05 then 2 else 0 end + case when convergence > .02 then 1 else 0 end as up, case when m20 < -.05 then 2 else 0 end + case when convergence < -.02 then 1 else 0 end as down, case when v > .03 then 2 else 0 end as wild, 1 as calm from f)
select symbol, round(v, 6) as volatility, round(m20, 6) as momentum, round(convergence, 6) as convergence, case when up >= greatest(down, wild, calm) then 'up' when down >= greatest(wild, calm) then 'down' when wild >= calm then 'volatile' else 'calm' end as regime from s"""),
    operator("benchmark_regime", "bars", "G3 label of the mean of all symbols by percentile of its 10-bar volatility ratio, 20-bar momentum and distance from 50 bars", f"""
with b as (select ts, avg(close) as close from bars group by ts), x as (select ts, close, close / lag(close) over (order by ts) - 1 as r, close / lag(close, 20) over (order by ts) - 1 as m20, close / avg(close) over (order by ts rows between 49 preceding and current row) - 1 as away, row_number() over (order by ts) as i from b),
v as (select *, stddev_samp(r) over (order by ts rows between 9 preceding and current row) / nullif(stddev_samp(r) over (order by ts rows between 59 preceding and current row), 0) as ratio from x),
w as (select *, round(ratio, 9) as q, first_value(round(ratio, 9)) over (order by ts desc) as latest from v where i >= 61), a as (select {rank_of("q", "latest")} as p from w), l as (select * from w order by ts desc limit 1)
select round(p, 6) as percentile, round(m20, 6) as momentum, round(away, 6) as distance, concat(case when p > .75 then 'high_vol' when p < .25 then 'low_vol' else 'normal' end, case when m20 > .02 and away > 0 then '_bull' when m20 < -.02 and away < 0 then '_bear' else '_sideways' end) as regime from l cross join a"""),
    operator("macro", "bars", "G6 market figures at the last day: 20-bar return and volatility of all symbols, of a defensive and of an aggressive group, and the appetite for risk", f"""
with b as (select ts, case when symbol % 11 < 3 then 'defensive' when symbol % 11 > 7 then 'aggressive' else 'rest' end as class, avg(close) as close from bars group by ts, case when symbol % 11 < 3 then 'defensive' when symbol % 11 > 7 then 'aggressive' else 'rest' end),
x as (select class, ts, close, close / lag(close) over (partition by class order by ts) - 1 as r, close / lag(close, 20) over (partition by class order by ts) - 1 as m20, avg(close) over (partition by class order by ts rows between 49 preceding and current row) as a50, row_number() over (partition by class order by ts desc) as k from b),
a as (select class, max(case when k = 1 then m20 end) as m20, stddev_pop(case when k <= 20 then r end) * sqrt(252.0) as v, max(case when k = 1 then close / a50 - 1 end) as away from x group by class)
select round(avg(m20), 6) as market_return, round(avg(v), 6) as volatility, round(max(case when class = 'aggressive' then m20 end) - max(case when class = 'defensive' then m20 end), 6) as appetite,
    case when max(case when class = 'aggressive' then m20 end) > max(case when class = 'defensive' then m20 end) then 'risk on' else 'risk off' end as label, round(avg(away), 6) as distance from a"""),
    operator("sector_flows", "bars", "G8 flows from the weaker to the stronger of every two sectors whose weekly changes differ by .5 or more, with confidence and intensity", f"""
with {SECTORS} select cast(a.sector as bigint) as source, cast(b.sector as bigint) as target, round(b.w - a.w, 5) as difference, round(.1 * (b.w - a.w), 6) as flow, round(least(1.0, (b.w - a.w) / 5), 5) as confidence,
    round(least(1.0, .1 * (b.w - a.w) / 2), 6) as intensity from sectors a join sectors b on b.w > a.w + .5 and a.sector <> b.sector"""),
    operator("net_flows", "bars", "G8 net flow of each sector", f"""
with {SECTORS}, f as (select a.sector as source, b.sector as target, .1 * (b.w - a.w) as x from sectors a join sectors b on b.w > a.w + .5), i as (select target as sector, sum(x) as x from f group by target), o as (select source as sector, sum(x) as x from f group by source)
select cast(coalesce(i.sector, o.sector) as bigint) as sector, round(coalesce(i.x, 0.0), 4) as inflow, round(coalesce(o.x, 0.0), 4) as outflow, round(coalesce(i.x, 0.0) - coalesce(o.x, 0.0), 4) as net from i full outer join o on i.sector = o.sector"""),
    operator("rotation", "bars", "G9 growth against value and cyclical against defensive sectors by weekly change, threshold 2, and the market's trend", f"""
with {SECTORS}, classes as (select 0 as sector, 'growth' as class union all select 1, 'growth' union all select 2, 'growth' union all select 3, 'value' union all select 4, 'value' union all select 5, 'cyclical' union all select 3, 'cyclical' union all select 6, 'cyclical' union all select 7, 'defensive' union all select 8, 'defensive' union all select 9, 'defensive'),
a as (select avg(case when class = 'growth' then w end) as growth, avg(case when class = 'value' then w end) as value, avg(case when class = 'cyclical' then w end) as cyclical, avg(case when class = 'defensive' then w end) as defensive from sectors join classes on sectors.sector = classes.sector), m as (select avg(w) as w from sectors)
select round(growth - value, 5) as growth_value, round(cyclical - defensive, 5) as cyclical_defensive, case when growth - value > 2 then 'to growth' when growth - value < -2 then 'to value' else 'none' end as style,
    case when cyclical - defensive > 2 then 'to cyclical' when cyclical - defensive < -2 then 'to defensive' else 'none' end as cycle, case when w > 1 then 'up' when w < -1 then 'down' else 'flat' end as market from a cross join m"""),
    operator("macro_sensitivity", "bars", "G11 beta, rate sensitivity of 50 betas within 100, and the phase of the cycle by momentum", f"""
with {BESIDE}, c as (select symbol, regr_slope(r, rb) as beta, max(ts) as ts from x group by symbol having count(*) >= 60), y as (select symbol, ts, 100 * (close / lag(close, 20) {S} - 1) as m20, 100 * (close / lag(close, 60) {S} - 1) as m60 from bars)
select c.symbol, round(beta, 5) as beta, round(greatest(-100.0, least(100.0, 50 * beta)), 4) as rate_sensitivity, case when m20 > 0 and m60 > 0 then 'expansion' when m20 > 0 then 'recovery' when m60 > 0 then 'slowdown' else 'contraction' end as phase from c join y on c.symbol = y.symbol and c.ts = y.ts"""),
    operator("metric_signals", "bars", "R22 rolling 30-bar return, volatility, downside and autocorrelation of each symbol ranked in their own past, as scores with a dead zone", f"""
with {BESIDE}, w as (select symbol, ts, seq, avg(r) {last(30)} as mean, stddev_samp(r) {last(30)} as sd, avg(least(r, 0.0)) {last(30)} as downside, corr(r, rb) {last(30)} as market from x),
v as (select symbol, ts, 'return' as metric, round(mean, 10) as v from w where seq >= 30 union all select symbol, ts, 'volatility', round(sd, 10) from w where seq >= 30 union all select symbol, ts, 'downside', round(downside, 10) from w where seq >= 30 union all select symbol, ts, 'market', round(market, 8) from w where seq >= 30),
l as (select symbol, metric, v, first_value(v) over (partition by symbol, metric order by ts desc) as latest from v), ranks as (select symbol, metric, max(latest) as latest, {rank_of("v", "latest")} as p from l group by symbol, metric having count(*) >= 10)
select symbol, metric, round(latest, 5) as latest, round(p, 5) as percentile, round(case when p between .4 and .6 then 0.0 when p > .6 then (p - .6) / .4 * 100 else (p - .4) / .4 * 100 end, 3) as score from ranks"""),
    operator("correlations", "bars", "R27 correlation of the daily returns of every two of a sector's symbols, with 60 common days or more", f"""
with r as (select symbol, symbol % 11 as sector, ts, close / lag(close) {S} - 1 as r from bars)
select a.symbol as one, b.symbol as two, cast(count(*) as bigint) as days, round(corr(a.r, b.r), 5) as correlation from r a join r b on a.ts = b.ts and a.sector = b.sector and a.symbol < b.symbol where a.r is not null and b.r is not null group by a.symbol, b.symbol having count(*) >= 60"""),
    operator("substitutes", "bars", "X12 up to three substitutes of each symbol from its sector, positively correlated over 60 common days or more and not its double, by correlation and calm", f"""
with r as (select symbol, symbol % 11 as sector, ts, close / lag(close) {S} - 1 as r from bars), v as (select symbol, stddev_samp(r) as sd from r group by symbol),
c as (select a.symbol, b.symbol as other, round(corr(a.r, b.r), 9) as k from r a join r b on a.ts = b.ts and a.sector = b.sector and a.symbol <> b.symbol where a.r is not null and b.r is not null group by a.symbol, b.symbol having count(*) >= 60),
s as (select c.symbol, other, k, round(.7 * k + .3 / (1 + v.sd), 9) as score from c join v on c.other = v.symbol where k > 0 and k < .99), p as (select *, row_number() over (partition by symbol order by score desc, other) as place from s)
select symbol, cast(place as integer) as place, other, round(k, 5) as correlation, round(score, 5) as score from p where place <= 3"""),
    operator("three_factors", "bars", "R23 least squares of the last 60 returns on market, size and value proxies: alpha, betas and R squared", f"""
with {BESIDE}, d as (select ts, avg(case when symbol % 3 = 0 then r end) - avg(case when symbol % 3 = 2 then r end) as f2, avg(case when symbol % 4 = 0 then r end) - avg(case when symbol % 4 = 3 then r end) as f3 from x group by ts),
y as (select x.symbol, x.r, x.rb as f1, d.f2, d.f3, row_number() over (partition by x.symbol order by x.ts desc) as k from x join d on x.ts = d.ts where d.f2 is not null and d.f3 is not null),
c as (select symbol, count(*) as n, avg(r) as mr, avg(f1) as m1, avg(f2) as m2, avg(f3) as m3, covar_pop(f1, f1) as a, covar_pop(f1, f2) as b, covar_pop(f1, f3) as c, covar_pop(f2, f2) as d, covar_pop(f2, f3) as e, covar_pop(f3, f3) as f,
    covar_pop(r, f1) as p, covar_pop(r, f2) as q, covar_pop(r, f3) as s, var_pop(r) as v from y where k <= 60 group by symbol having count(*) >= 30),
t as (select *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) as det from c),
z as (select *, (p * (d * f - e * e) + q * (c * e - b * f) + s * (b * e - c * d)) / det as b1, (p * (c * e - b * f) + q * (a * f - c * c) + s * (b * c - a * e)) / det as b2, (p * (b * e - c * d) + q * (b * c - a * e) + s * (a * d - b * b)) / det as b3 from t where det > 0)
select symbol, round(252 * (mr - b1 * m1 - b2 * m2 - b3 * m3), 4) as alpha, round(b1, 4) as market, round(b2, 4) as size, round(b3, 4) as value, round((b1 * p + b2 * q + b3 * s) / v, 5) as r2, round(sqrt(greatest(v - b1 * p - b2 * q - b3 * s, 0.0) * 252), 5) as residual from z"""),
    operator("filtered_screen", "bars", "E6, E7 a screen by a list of filters on quick metrics, sorted with a default for nulls: RSI between 20 and 80, activity over .6, within 20 % of the mean", f"""
with {QUICK} select symbol, round(close, 5) as close, round(rsi, 4) as rsi, round(to20, 4) as to20, round(m5, 4) as m5, round(activity, 5) as activity from quick where rsi >= 20 and rsi <= 80 and activity > .6 and to20 < 20 and to20 > -20 order by coalesce(round(m5, 6), -999.0) desc, symbol limit 50"""),
    operator("tags", "bars", "E5 tags of each symbol, score and confidence from quick metrics", f"""
with {QUICK}, s as (select *, round(50 + greatest(-20.0, least(20.0, to20)) + greatest(-15.0, least(15.0, m5)) + case when activity > 1.5 then 10 else 0 end - abs(rsi - 50) / 5, 6) as score from quick)
select symbol, concat(case when rsi < 30 then 'oversold ' else '' end, case when rsi > 70 then 'overbought ' else '' end, case when activity > 1.5 then 'active ' else '' end, case when to20 > 0 and to50 > 0 then 'uptrend ' else '' end, case when m5 > 5 then 'momentum ' else '' end) as tags, round(score, 3) as score,
    round(least(.95, .5 + abs(score - 50) / 100), 5) as confidence from s"""),
    operator("relevance", "bars interactions", "E11 relevance from 0 to 100 of symbols for every user, by signal, confidence, affinity, sector, event and return: the five best of each, 30 or more. A user who knows k symbols meets these and the first k + 5 of all and of the liked sector, which hold the five best", f"""
with {QUICK}, t as (select max(symbol) as top, max(ts) as as_of from (select max(symbol) as symbol, cast(null as timestamp) as ts from bars union all select cast(null as bigint) as symbol, max(ts) as ts from interactions) z),
i as (select user_id, event_id % top + 1 as symbol, action, DAYS(as_of, ts) as days from interactions cross join t),
ev as (select symbol, max(case action when 'purchase' then 100 when 'signup' then 50 else 25 end) as event from i where days <= 14 group by symbol),
b as (select q.symbol, q.symbol % 11 as sector, round(.25 * case when abs(m5) > 10 then 100 when abs(m5) > 3 then 75 else 25 end + 20 * least(.95, .5 + abs(to20) / 100) + .10 * coalesce(event, 0) + .10 * least(100.0, 5 * abs(m5)), 6) as base from quick q left join ev on q.symbol = ev.symbol),
w as (select user_id, symbol, sum(case action when 'purchase' then 5.0 when 'signup' then 3.0 when 'view' then 2.0 when 'click' then 1.0 else -2.0 end * power(.95, days)) as w from i where days <= 90 group by user_id, symbol),
f as (select user_id, symbol, symbol % 11 as sector, w / greatest(max(abs(w)) over (partition by user_id), 1.0) as affinity from w),
liking as (select user_id, sector, row_number() over (partition by user_id order by round(sum(affinity), 9) desc, sector) as place from f group by user_id, sector),
u as (select user_id, sector as liked from liking where place = 1), five as (select 1 as place union all select 2 union all select 3 union all select 4 union all select 5),
ranked as (select symbol, sector, row_number() over (order by base desc, symbol) as place, row_number() over (partition by sector order by base desc, symbol) as inside from b),
wanted as (select user_id, place from u cross join five union all select user_id, 5 + row_number() over (partition by user_id order by symbol) as place from f),
c as (select user_id, symbol from f union select wanted.user_id, ranked.symbol from wanted join ranked on wanted.place = ranked.place
    union select wanted.user_id, ranked.symbol from wanted join u on wanted.user_id = u.user_id join ranked on ranked.sector = u.liked and ranked.inside = wanted.place),
r as (select c.user_id, c.symbol, round(b.base + .20 * (coalesce(f.affinity, 0.0) + 1) * 50 + .15 * case when b.sector = u.liked then 100 else 50 end, 6) as relevance from c join u on c.user_id = u.user_id join b on c.symbol = b.symbol left join f on f.user_id = c.user_id and f.symbol = c.symbol),
k as (select user_id, symbol, relevance, row_number() over (partition by user_id order by relevance desc, symbol) as place from r where relevance >= 30)
select user_id, cast(place as integer) as place, symbol, round(relevance, 4) as relevance from k where place <= 5"""),
    operator("upcoming_events", "bars interactions", "E12 symbols near their 20-bar high with the nearest event of the next fourteen days", f"""
with n as (select max(ts) as as_of from interactions), x as (select symbol, ts, close, max(high) {last(20)} as top, row_number() over (partition by symbol order by ts desc) as k from bars), c as (select symbol, close / top as near from x where k = 1 and close >= .9 * top),
t as (select max(symbol) as top from bars), e as (select event_id % top + 1 as symbol, action as event, event_id, DAYS(as_of, ts) as days from interactions cross join n cross join t where DAYS(as_of, ts) between 0 and 14),
h as (select symbol, event, days, row_number() over (partition by symbol order by days, event_id) as j from e)
select c.symbol, round(near, 5) as near_high, event, days from c join h on c.symbol = h.symbol where j = 1"""),
    operator("trade_gate", "deals", "E17, E16 deals let through by a probability over the regime's threshold, by a strong signal or by calibrated confidence, with the reason", """
with x as (select strategy, symbol, id, line, part, confidence, .35 + .25 * (id % 1000) / 1000.0 as p, case when shares > 35 then 'volatile' when shares > 15 then 'normal' else 'calm' end as regime from deals),
y as (select *, case when p > case regime when 'volatile' then .6 when 'calm' then .45 else .5 end then 'probability' when p >= .45 and confidence >= .70 then 'signal' when confidence >= .65 and p >= .40 then 'calibrated' else 'refused' end as reason from x where confidence >= .05)
select strategy, regime, reason, cast(count(*) as bigint) as deals, round(avg(p), 6) as probability from y group by strategy, regime, reason"""),
    operator("inbox", "trades bars", "E18 symbols whose last bar moved 10 % or more, beside what is held, by priority", f"""
with x as (select symbol, close, 100 * (close / lag(close) {S} - 1) as move, row_number() over (partition by symbol order by ts desc) as k from bars), p as (select symbol, sum(case when side = 'buy' then shares else -shares end) as held, avg(case when side = 'buy' then price end) as cost from trades group by symbol)
select x.symbol, round(move, 4) as move, coalesce(held, 0.0) > 0 as is_held, round(held * (close - cost), 2) as profit, case when held > 0 and move < -20 then 1 when held > 0 then 2 when move > 20 then 3 else 4 end as priority from x left join p on x.symbol = p.symbol where k = 1 and abs(move) >= 10"""),
    operator("confidence_adjustments", "indicators", "E24 base confidence with adjustments for tone, guidance and trend, clamped", f"""
with x as (select symbol, rsi, adx, close / lag(close, 20) {S} - 1 as m20, row_number() over (partition by symbol order by ts desc) as k from indicators)
select symbol, round(greatest(.05, least(.95, .5 + .03 * sign(m20) * least(abs(m20) * 5, 1.0) + case when rsi > 60 then .02 when rsi < 40 then -.02 else 0.0 end + case when adx > 30 then .02 else 0.0 end)), 6) as confidence from x where k = 1 and m20 is not null"""),
    operator("ev_ebitda", "statements", "F10 value of a company at fifteen times earnings and its liabilities over operating income, beside the multiple that leverage implies", f"""
with x as (select symbol, fiscal_year, fiscal_quarter, sum(net_income) {Q} rows between 3 preceding and current row) as ni, sum(gross_profit) {Q} rows between 3 preceding and current row) as oi, total_liabilities as tl, total_assets - total_liabilities as equity from statements)
select symbol, fiscal_year, fiscal_quarter, round((15 * ni + tl) / oi, 5) as ev_ebitda, round(15 * .79 / (1 + .3 * tl / equity), 5) as implied from x where oi > 0 and equity > 0"""),
    operator("dcf", "statements", "F13 five years of operating cash flow grown by at most 15 % and discounted at 10 %, with a terminal value at 2.5 %", f"""
with x as (select symbol, fiscal_year, fiscal_quarter, sum(cash_flow_operating) {Q} rows between 3 preceding and current row) as fcf, greatest(-.05, least(.15, sum(revenue) {Q} rows between 3 preceding and current row) / nullif(sum(revenue) {Q} rows between 7 preceding and 4 preceding), 0) - 1)) as g from statements),
t as (select 1 as year union all select 2 union all select 3 union all select 4 union all select 5)
select symbol, fiscal_year, fiscal_quarter, round(max(g), 6) as growth, round((sum(fcf * power((1 + g) / 1.1, year)) + max(fcf * power((1 + g) / 1.1, 5) * 1.025 / (.1 - .025))) / 1000, 2) as value_thousand from x cross join t where fcf > 0 and g is not null group by symbol, fiscal_year, fiscal_quarter"""),
    operator("quality_score", "statements", "F14, F15 six flags of quality, a multiple that growth allows, and a blend of 70 % with the mean of all companies that quarter", f"""
with x as (select symbol, fiscal_year, fiscal_quarter, revenue, net_income, gross_profit, cash_flow_operating as ocf, total_assets as ta, total_liabilities as tl, lag(revenue, 4) {Q}) as ago from statements),
f as (select *, case when net_income > 0 then 1 else 0 end + case when ocf > 0 then 1 else 0 end + case when ocf > net_income then 1 else 0 end + case when tl < .5 * ta then 1 else 0 end + case when gross_profit > .4 * revenue then 1 else 0 end + case when revenue > ago then 1 else 0 end as flags, case when revenue / ago - 1 > .15 then 30 when revenue / ago - 1 > .05 then 20 else 15 end as cap from x where ago > 0),
b as (select *, avg(flags) over (partition by fiscal_year, fiscal_quarter) as peers from f)
select symbol, fiscal_year, fiscal_quarter, flags, cap, round(100 * flags / 6.0, 4) as score, round(.7 * 100 * flags / 6.0 + .3 * 100 * peers / 6.0, 4) as blended from b"""),
    operator("sector_of", "nation", "F16 sector of a name by substring rules, in order", """
select n_nationkey as symbol, n_name as name, case when contains(lower(n_name), 'united') or contains(lower(n_name), 'germany') then 'industrial' when contains(lower(n_name), 'ia') then 'energy' when contains(lower(n_name), 'an') then 'finance' when contains(lower(n_name), 'e') then 'technology' else 'other' end as sector from nation"""),
    operator("earnings_history", "statements", "F17 quarter on quarter changes of earnings, share of rising quarters and growth from the first to the last", f"""
with x as (select symbol, net_income, net_income - lag(net_income) {Q}) as change, row_number() {Q}) as i, count(*) over (partition by symbol) as n from statements)
select symbol, round(avg(case when change is null then null when change > 0 then 1.0 else 0.0 end), 6) as rising, round(avg(change), 2) as mean_change, round(max(case when i = n then net_income end) / nullif(max(case when i = 1 then net_income end), 0) - 1, 5) as growth from x group by symbol"""),
]
