"""Options chains, insiders and dividends, and the composites that use them."""

from ..functions.operator import operator

S = "over (partition by symbol order by ts)"
Q = "over (partition by symbol order by fiscal_year, fiscal_quarter"


def last(n: int) -> str:
    return f"over (partition by symbol order by ts rows between {n - 1} preceding and current row)"


CHAIN = "(select symbol, sum(case when kind = 'call' then oi end) as call_oi, sum(case when kind = 'put' then oi end) as put_oi, sum(case when kind = 'call' then volume end) as calls, sum(case when kind = 'put' then volume end) as puts, sum(oi) as oi, avg(iv) as iv, avg(case when kind = 'put' then iv end) - avg(case when kind = 'call' then iv end) as skew from chain group by symbol)"

OPERATORS = [
    operator("chain_rollup", "chain", "O1 put/call ratios, open interest, mean implied volatility and its rank among symbols, number of unusual contracts", f"""
with a as {CHAIN}, u as (select symbol, sum(case when volume > 2 * oi and volume > 100 then 1 else 0 end) as unusual from chain group by symbol)
select a.symbol, round(puts * 1.0 / calls, 6) as volume_ratio, round(put_oi * 1.0 / call_oi, 6) as oi_ratio, cast(oi as bigint) as oi, round(iv, 6) as iv, round(percent_rank() over (order by round(iv, 9)), 6) as iv_rank, cast(unusual as bigint) as unusual from a join u on a.symbol = u.symbol"""),
    operator("unusual_contracts", "chain", "O1 the ten contracts of each symbol with the highest volume over open interest, volume over 100 and over twice the interest", """
with x as (select *, row_number() over (partition by symbol order by volume * 1.0 / greatest(oi, 1) desc, id) as place from chain where volume > 2 * oi and volume > 100)
select symbol, cast(place as integer) as place, id, kind, strike, cast(volume as bigint) as volume, cast(oi as bigint) as oi from x where place <= 10"""),
    operator("max_pain", "chain", "O2 the strike at which contracts pay out least, the lowest on ties; what all strikes below and above pay comes from running sums of interest and interest x strike", """
with s as (select symbol, strike, sum(case when kind = 'call' then oi else 0 end) as calls, sum(case when kind = 'put' then oi else 0 end) as puts from chain group by symbol, strike),
w as (select *, sum(calls) over (partition by symbol order by strike) as c, sum(calls * strike) over (partition by symbol order by strike) as cs, sum(puts) over (partition by symbol order by strike desc) as p, sum(puts * strike) over (partition by symbol order by strike desc) as ps from s),
p as (select symbol, strike, strike * c - cs + ps - strike * p as pain from w),
k as (select *, row_number() over (partition by symbol order by pain, strike) as place from p)
select symbol, strike, round(pain, 3) as pain from k where place = 1"""),
    operator("options_signal", "chain", "E4 put/call interest ratio ranked among the strikes' own, skew of implied volatility, strike of most interest and the adjustments", f"""
with a as {CHAIN}, s as (select symbol, strike, round(sum(case when kind = 'put' then oi else 0 end) * 1.0 / nullif(sum(case when kind = 'call' then oi else 0 end), 0), 9) as ratio, sum(oi) as oi from chain group by symbol, strike),
r as (select s.symbol, avg(case when ratio < a.put_oi * 1.0 / a.call_oi then 1.0 when ratio = a.put_oi * 1.0 / a.call_oi then .5 else 0.0 end) as rank from s join a on s.symbol = a.symbol where ratio is not null group by s.symbol),
m as (select symbol, strike, row_number() over (partition by symbol order by oi desc, strike) as place from s)
select a.symbol, round(r.rank, 6) as ratio_rank, round(a.skew, 6) as skew, m.strike as max_oi_strike, round(case when r.rank < .15 then .03 when r.rank > .85 then -.03 else 0.0 end + case when a.skew > .05 then -.02 when a.skew < -.05 then .02 else 0.0 end, 4) as adjustment from a join r on a.symbol = r.symbol join m on a.symbol = m.symbol and m.place = 1"""),
    operator("insider_rollup", "insiders", "O5 counts, values and net of insiders' buys and sells, labelled by two to one", """
with g as (select symbol, sum(case when amount > 0 then 1 else 0 end) as buys, sum(case when amount < 0 then 1 else 0 end) as sells, sum(greatest(amount, 0.0)) as bought, sum(greatest(-amount, 0.0)) as sold from insiders group by symbol)
select symbol, cast(buys as bigint) as buys, cast(sells as bigint) as sells, round(bought, 2) as bought, round(sold, 2) as sold, round(bought - sold, 2) as net, case when buys >= 2 * sells then 'bullish' when sells >= 2 * buys then 'bearish' else 'neutral' end as label from g"""),
    operator("insider_signal", "insiders", "E19 insiders' net value over the symbol's mean traded value, executive buys and the adjustment", """
with g as (select symbol, sum(amount) as net, sum(case when amount > 0 and role = 'MACHINERY' then 1 else 0 end) as executives, avg(abs(amount)) * 20 as traded from insiders group by symbol)
select symbol, round(net / traded, 6) as share, cast(executives as bigint) as executives, round(case when net / traded > .005 then .04 when net / traded > .001 then .02 when net / traded < -.005 then -.03 else 0.0 end + case when executives >= 2 then .03 else 0.0 end, 4) as adjustment from g"""),
    operator("dividends", "statements", "O5, E20 latest dividend a year, growth from the oldest of five or more, z-score of the latest change, cuts and the adjustment", f"""
with x as (select symbol, fiscal_year, fiscal_quarter, round(cash_flow_operating / 1000000, 9) as amount from statements), y as (select *, amount / nullif(lag(amount) {Q}), 0) - 1 as change, row_number() {Q}) as i, count(*) over (partition by symbol) as n from x),
g as (select symbol, max(n) as n, max(case when i = n then amount end) as latest, max(case when i = 1 then amount end) as oldest, max(case when i = n then change end) as change, avg(change) as mean, stddev_samp(change) as sd from y group by symbol)
select symbol, round(4 * latest, 6) as yearly, round(case when n >= 5 then latest / nullif(oldest, 0) - 1 end, 5) as growth, round((change - mean) / nullif(sd, 0), 4) as z, change < 0 as is_cut,
    case when change < -.3 then -.05 when (change - mean) / nullif(sd, 0) > 1.5 then .02 else 0.0 end as adjustment from g"""),
    operator("smart_money", "bars", "E22 quiet accumulation: 10 over 10 bars of volume in the lowest fifth of the symbol's own ratios while the price holds, as an adjustment of .02 a deviation", f"""
with x as (select symbol, ts, seq, close, avg(volume) {last(10)} as now, avg(volume) over (partition by symbol order by ts rows between 19 preceding and 10 preceding) as before, close / lag(close, 10) {S} - 1 as m10 from bars),
y as (select *, round(now / before, 9) as ratio, first_value(round(now / before, 9)) over (partition by symbol order by ts desc) as latest, first_value(m10) over (partition by symbol order by ts desc) as move from x where seq >= 19),
g as (select symbol, max(latest) as ratio, max(move) as move, avg(case when ratio < latest then 1.0 when ratio = latest then .5 else 0.0 end) as rank, (max(latest) - avg(ratio)) / nullif(stddev_samp(ratio), 0) as z from y group by symbol)
select symbol, round(ratio, 6) as ratio, round(rank, 6) as rank, rank < .2 and abs(move) < .1 as quiet, round(.02 * least(abs(z), 3.0) * sign(z), 6) as adjustment from g"""),
    operator("squeeze_score", "bars", "O4 short-squeeze composite of six parts from range, volume, momentum, position and volatility", f"""
with x as (select symbol, ts, seq, close, avg(volume) {last(5)} / avg(volume) {last(20)} as activity, close / lag(close, 5) {S} - 1 as m5, close / lag(close, 20) {S} - 1 as m20, (close - min(low) {last(20)}) / nullif(max(high) {last(20)} - min(low) {last(20)}, 0) as place,
    stddev_pop(close) {last(20)} / avg(close) {last(20)} as width, close / avg(close) {last(50)} - 1 as away, row_number() over (partition by symbol order by ts desc) as k from bars)
select symbol, round(20 * least(activity / 2, 1.0) + 20 * greatest(0.0, least(m5 * 5, 1.0)) + 15 * greatest(0.0, least(m20 * 3, 1.0)) + 15 * place + 15 * least(width * 5, 1.0) + 15 * greatest(0.0, least(-away * 5, 1.0)), 4) as score from x where k = 1 and seq >= 50"""),
]
