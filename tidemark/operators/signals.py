"""Signals: bars with indicators to (symbol, name, weight, bullish), and what is made of signals.

An operator over `indicators` judges each symbol's last bar against the symbol's own history. Percentile ranks
count ties half; z-scores take the sample deviation and are 0 without spread.
"""

from ..functions.operator import operator

S = "over (partition by symbol order by ts)"
ALL = "over (partition by symbol)"


def last(n: int) -> str:
    return f"over (partition by symbol order by ts rows between {n - 1} preceding and current row)"


def rank_of(value: str, latest: str) -> str:
    """Percentile rank of a symbol's latest value among its values, as an aggregate."""
    return f"avg(case when {value} is null then null when {value} < {latest} then 1.0 when {value} = {latest} then .5 else 0.0 end)"


#: Bars with the distance from the end, and the columns that most signals are about.
X = f"""x as (select symbol, ts, seq, open, high, low, close, volume, round(rsi, 9) as rsi, ema12 - ema26 - signal as histogram, atr14, adx, plus_di, minus_di, ema20, atr10,
    row_number() over (partition by symbol order by ts desc) as k, count(*) {ALL} as n from indicators)"""


def divergence(value: str) -> str:
    """The two latest peaks of the close and of another series within the last 20 bars, told apart by direction."""
    return f"""with {X},
p as (select symbol, ts, close, {value} as v, k, lag(close) {S} as c0, lead(close) {S} as c1, lag({value}) {S} as v0, lead({value}) {S} as v1 from x where {value} is not null),
c as (select symbol, close, row_number() over (partition by symbol order by ts desc) as j from p where k between 2 and 19 and close > c0 and close > c1),
w as (select symbol, v, row_number() over (partition by symbol order by ts desc) as j from p where k between 2 and 19 and v > v0 and v > v1),
a as (select symbol, max(case when j = 1 then close end) as now, max(case when j = 2 then close end) as before from c where j <= 2 group by symbol),
b as (select symbol, max(case when j = 1 then v end) as now, max(case when j = 2 then v end) as before from w where j <= 2 group by symbol)
select a.symbol, round(a.now, 6) as price_peak, round(a.before, 6) as price_before, round(b.now, 6) as peak, round(b.before, 6) as peak_before,
    case when a.now > a.before and b.now < b.before then 'bearish' when a.now < a.before and b.now > b.before then 'bullish' end as divergence
from a join b on a.symbol = b.symbol where a.before is not null and b.before is not null"""


# fixed values: the score that each label stands for
LABELS = [("strong_buy", 100), ("buy", 60), ("weak_buy", 30), ("neutral", 0), ("weak_sell", -30), ("sell", -60)]


def label(score: str) -> str:
    """Of a score cut towards zero: -5 is neutral, and so is -5.9."""
    return f"case when {score} >= 70 then 'strong_buy' when {score} >= 30 then 'buy' when {score} >= 5 then 'weak_buy' when {score} > -6 then 'neutral' when {score} > -31 then 'weak_sell' when {score} > -71 then 'sell' else 'strong_sell' end"


#: T33 as rows of signals, one condition each on the last bar.
LEVELS = [
    ("rsi deeply oversold", 3, "true", "rsi_rank < .10"),
    ("rsi oversold", 2, "true", "rsi_rank >= .10 and rsi_rank < .20"),
    ("rsi overbought", 3, "false", "rsi_rank > .90"),
    ("macd cross up", 3, "true", "histogram > 0 and histogram1 <= 0"),
    ("macd cross down", 3, "false", "histogram < 0 and histogram1 >= 0"),
    ("below lower band", 2, "true", "close < mid - 2 * sd"),
    ("above upper band", 2, "false", "close > mid + 2 * sd"),
    ("stochastic low", 2, "true", "stochastic_rank < .15"),
    ("stochastic high", 2, "false", "stochastic_rank > .85"),
    ("strong trend up", 3, "true", "adx > 25 and plus_di > minus_di"),
    ("strong trend down", 3, "false", "adx > 25 and plus_di < minus_di"),
    ("near support", 2, "true", "close <= 1.02 * low20"),
    ("near resistance", 2, "false", "close >= .98 * high20"),
]
LEVEL_TEXT = f"""with {X},
y as (select *, lag(histogram) {S} as histogram1, avg(close) {last(20)} as mid, stddev_pop(close) {last(20)} as sd, min(low) {last(20)} as low20, max(high) {last(20)} as high20,
    round(case when seq >= 13 then case when max(high) {last(14)} > min(low) {last(14)} then 100 * (close - min(low) {last(14)}) / (max(high) {last(14)} - min(low) {last(14)}) else 50.0 end end, 9) as stochastic from x),
z as (select *, first_value(rsi) over (partition by symbol order by ts desc) as rsi_now, first_value(stochastic) over (partition by symbol order by ts desc) as stochastic_now from y),
r as (select symbol, {rank_of("rsi", "rsi_now")} as rsi_rank, {rank_of("stochastic", "stochastic_now")} as stochastic_rank from z group by symbol),
l as (select y.*, r.rsi_rank, r.stochastic_rank from y join r on y.symbol = r.symbol where y.k = 1 and y.n >= 50),
names as ({" union all ".join(f"select {i} as i, '{name}' as name, {w} as weight, {side} as bullish" for i, (name, w, side, _) in enumerate(LEVELS))}),
hits as (select symbol, n, name, weight, bullish from l cross join names where case i {" ".join(f"when {i} then {c}" for i, (_, _, _, c) in enumerate(LEVELS))} end)"""

OPERATORS = [
    operator("ema", "indicators", "T2 exponential moving average of 12 closes, null before", "select symbol, ts, round(ema12, 6) as ema from indicators"),
    operator("rsi", "indicators", "T3 Wilder's relative strength index of 14 bars", "select symbol, ts, round(rsi, 6) as rsi from indicators"),
    operator("macd", "indicators", "T4 MACD(12, 26, 9): line, signal and histogram", """
select symbol, ts, round(ema12 - ema26, 6) as line, round(signal, 6) as signal, round(ema12 - ema26 - signal, 6) as histogram from indicators where ema26 is not null"""),
    operator("atr", "indicators", "T7 Wilder's average true range of 14 bars", "select symbol, ts, round(atr14, 6) as atr from indicators where atr14 is not null"),
    operator("adx", "indicators", "T11 directional indicators and ADX of 14 bars by Wilder's sums", """
select symbol, ts, round(plus_di, 6) as plus_di, round(minus_di, 6) as minus_di, round(adx, 6) as adx from indicators where plus_di is not null"""),
    operator("keltner", "indicators", "T15 Keltner channels: average of 20 closes and two average ranges of 10 bars", """
select symbol, ts, round(ema20 - 2 * atr10, 6) as lower, round(ema20, 6) as middle, round(ema20 + 2 * atr10, 6) as upper from indicators where ema20 is not null"""),
    operator("rsi_divergence", "indicators", "T22 the two latest peaks of price and RSI within 20 bars", divergence("rsi")),
    operator("macd_divergence", "indicators", "T22 the two latest peaks of price and MACD histogram within 20 bars", divergence("histogram")),
    operator("bounce", "indicators", "T25 oversold bounce and overbought pullback: RSI rank, z-score of the 20-bar return, and the last three bars", f"""
with {X}, y as (select *, round(100 * (close / lag(close, 20) {S} - 1), 9) as r20, close > lag(close) {S} as rose from x),
z as (select *, first_value(rsi) over (partition by symbol order by ts desc) as rsi_now, first_value(r20) over (partition by symbol order by ts desc) as r20_now from y),
a as (select symbol, {rank_of("rsi", "rsi_now")} as rsi_rank, (max(r20_now) - avg(r20)) / nullif(stddev_samp(r20), 0) as z,
    max(case when k <= 2 and rose then 1 else 0 end) as recovery, sum(case when k <= 3 and close < open then 1 else 0 end) as selling from z group by symbol having count(r20) > 1)
select symbol, round(rsi_rank, 6) as rsi_rank, round(z, 5) as z, case when rsi_rank < .40 and z < -2 then case when recovery = 1 then 'oversold bounce' else 'deep oversold' end
    when rsi_rank > .60 and z > 2 and selling >= 2 then 'overbought pullback' else 'none' end as setup from a"""),
    operator("extension", "indicators", "T26 rank of ATR over its 20-bar mean, z-score of the distance from the 50-bar mean, slowing rates of change, rank of the 5-bar return", f"""
with {X}, y as (select symbol, ts, seq, k, close, round(case when seq >= 33 then atr14 / avg(atr14) {last(20)} end, 9) as ratio, case when seq >= 49 then 100 * (close / avg(close) {last(50)} - 1) end as away,
    round(100 * (close / lag(close, 5) {S} - 1), 9) as r5, 100 * (close / lag(close, 10) {S} - 1) as r10, 100 * (close / lag(close, 20) {S} - 1) as r20 from x),
z as (select *, first_value(ratio) over (partition by symbol order by ts desc) as ratio_now, first_value(away) over (partition by symbol order by ts desc) as away_now, first_value(r5) over (partition by symbol order by ts desc) as r5_now from y),
a as (select symbol, {rank_of("ratio", "ratio_now")} as ratio_rank, (max(away_now) - avg(away)) / nullif(stddev_samp(away), 0) as away_z, {rank_of("r5", "r5_now")} as r5_rank,
    max(case when k = 1 then r10 end) as r10, max(case when k = 1 then r20 end) as r20 from z group by symbol having count(away) > 1)
select symbol, round(ratio_rank, 6) as atr_rank, case when ratio_rank > .85 then 'expanding' when ratio_rank < .15 then 'contracting' else 'usual' end as volatility, round(away_z, 5) as away_z,
    case when away_z > 2 then 'far above' when away_z > 1.5 then 'above' when away_z < -2 then 'far below' when away_z < -1.5 then 'below' else 'near' end as extension,
    r20 > 0 and r10 < r20 / 2 as slowing, round(r5_rank, 6) as momentum_rank,
    case when r5_rank > .90 then 'very strong' when r5_rank > .75 then 'strong' when r5_rank < .10 then 'very weak' when r5_rank < .25 then 'weak' else 'usual' end as momentum from a"""),
    operator("squeeze", "indicators", "T29 Bollinger bands (20, 2) inside Keltner channels (20, 10, 2) of the same bar, and the nearest pivot level within 1 %", f"""
with {X}, y as (select symbol, ts, k, close, 4 * stddev_pop(close) {last(20)} as bands, 4 * atr10 as channels, (lag(high) {S} + lag(low) {S} + lag(close) {S}) / 3 as p, lag(high) {S} as h, lag(low) {S} as l, n from x)
select symbol, ts, round(bands, 6) as bands, round(channels, 6) as channels, bands < channels as squeeze,
    case when abs(close / p - 1) < .01 then 'pivot' when abs(close / (2 * p - l) - 1) < .01 then 'r1' when abs(close / (2 * p - h) - 1) < .01 then 's1' else 'none' end as near from y where k = 1 and n >= 20"""),
    operator("weekly_confluence", "indicators", "T30 regression trend of 20 weekly bars beside that of 20 daily ones", f"""
with {X}, w as (select symbol, date_trunc('week', ts) as week, max(high) as high, min(low) as low from x group by symbol, date_trunc('week', ts)),
v as (select symbol, week, high, low, row_number() over (partition by symbol order by week desc) as k, count(*) {ALL} as weeks from w),
slope as (select symbol, 'week' as grain, regr_slope(high, cast(-k as double)) as up, regr_slope(low, cast(-k as double)) as down, avg(high - low) as span from v where k <= 20 and weeks >= 20 group by symbol
    union all select symbol, 'day' as grain, regr_slope(high, cast(-k as double)) as up, regr_slope(low, cast(-k as double)) as down, avg(high - low) as span from x where k <= 20 and n >= 20 group by symbol),
t as (select symbol, grain, case when round((up + down) / 2 - .1 * span, 9) > 0 then 1 when round((up + down) / 2 + .1 * span, 9) < 0 then -1 else 0 end as trend from slope),
b as (select symbol, max(case when grain = 'week' then trend end) as weekly, max(case when grain = 'day' then trend end) as daily from t group by symbol)
select symbol, weekly, daily, case when weekly = 0 or daily = 0 then 'open' when weekly = daily then 'confirmed' else 'conflict' end as confluence from b where weekly is not null"""),
    operator("trend_strength", "indicators", "T32 mean of ADX over 50, alignment of the averages of 20 and 50 closes (1 up, 0 down, else half), and structure (1 rising, 0 falling, else left out)", f"""
with {X}, y as (select symbol, ts, k, n, close, adx, avg(close) {last(20)} as m20, avg(close) {last(50)} as m50, max(high) {last(20)} as top, max(high) over (partition by symbol order by ts rows between 39 preceding and 20 preceding) as top1,
    min(low) {last(20)} as bottom, min(low) over (partition by symbol order by ts rows between 39 preceding and 20 preceding) as bottom1 from x),
z as (select *, case when close > m20 and m20 > m50 then 1.0 when close < m20 and m20 < m50 then 0.0 else .5 end as alignment, case when top > top1 and bottom > bottom1 then 1.0 when top < top1 and bottom < bottom1 then 0.0 end as structure from y where k = 1 and n >= 50)
select symbol, round(adx, 5) as adx, alignment, structure, round((least(adx / 50, 1.0) + alignment + coalesce(structure, 0.0)) / case when structure is null then 2 else 3 end, 6) as strength from z"""),
    operator("level_signals", "indicators", "T33 signals of RSI and stochastic ranks, MACD crosses, bands, trend, support and resistance at the last bar", LEVEL_TEXT + """
select symbol, name, weight, bullish from hits"""),
    operator("signal_score", "indicators", "T31 signals to a score from -100 to 100, its label and confidence", LEVEL_TEXT + f""",
g as (select symbol, max(n) as n, count(*) as c, sum(weight) as total, sum(case when bullish then weight else -weight end) as net, sum(case when bullish then 1 else 0 end) as up from hits group by symbol),
s as (select symbol, cast(round(100.0 * net / total) as integer) as score, cast(c as bigint) as signals, .55 * greatest(up, c - up) / c + .30 * least(n / 200.0, 1.0) + .15 * least(c / 10.0, 1.0) as confidence from g)
select symbol, score, signals, {label("score")} as label, round(greatest(.15, least(.95, confidence)), 5) as confidence from s"""),
    operator("cloud_signals", "bars", "T34 side of the Ichimoku cloud and cross of its lines, nearest Fibonacci level, side of VWAP, strength against the market with new highs", f"""
with m as (select ts, avg(close) as bench from bars group by ts),
x as (select bars.symbol, bars.ts, seq, close, high, low, volume, close / bench as rs from bars join m on bars.ts = m.ts),
y as (select *, (max(high) {last(9)} + min(low) {last(9)}) / 2 as tenkan, (max(high) {last(26)} + min(low) {last(26)}) / 2 as kijun, (max(high) {last(52)} + min(low) {last(52)}) / 2 as wide,
    max(high) {last(50)} as hi, min(low) {last(50)} as lo, sum((high + low + close) / 3 * volume) {S} / nullif(sum(volume) {S}, 0) as vwap, max(rs) {last(20)} as rs_high, avg(rs) {last(20)} as rs_mean, row_number() over (partition by symbol order by ts desc) as k from x),
z as (select *, lag((tenkan + kijun) / 2, 25) {S} as a, lag(wide, 25) {S} as b, lag(tenkan) {S} as t1, lag(kijun) {S} as k1 from y)
select symbol, case when close > greatest(a, b) then 'above' when close < least(a, b) then 'below' else 'inside' end as cloud, case when tenkan > kijun and t1 <= k1 then 'bullish' when tenkan < kijun and t1 >= k1 then 'bearish' else 'none' end as cross_side,
    case when abs(close / (hi - .382 * (hi - lo)) - 1) < .02 then '38.2' when abs(close / (hi - .5 * (hi - lo)) - 1) < .02 then '50' when abs(close / (hi - .618 * (hi - lo)) - 1) < .02 then '61.8' else 'none' end as fibonacci,
    close > vwap as above_vwap, case when rs > 1.02 * rs_mean then 'stronger' when rs < .98 * rs_mean then 'weaker' else 'alike' end as strength, rs >= rs_high as strength_high from z where k = 1 and seq >= 77"""),
    operator("obv_trend", "bars", "T23 on-balance volume against its 20-bar mean beside the price's direction over 20 bars", f"""
with x as (select symbol, ts, seq, close, volume, lag(close) {S} as before, lag(close, 20) {S} as c20 from bars),
y as (select *, sum(case when before is null or close > before then volume when close < before then -volume else 0.0 end) {S} as obv from x),
z as (select *, avg(obv) {last(20)} as mean, row_number() over (partition by symbol order by ts desc) as k from y)
select symbol, obv, round(mean, 4) as mean, case when obv > mean and close < c20 then 'bullish divergence' when obv < mean and close > c20 then 'bearish divergence' when obv > mean then 'confirms up' else 'confirms down' end as signal from z where k = 1 and seq >= 20"""),
    operator("adaptive_signal", "bars", "A4 volume's percentile as a score with a dead zone from .4 to .6, its z-score as a weight of 1 to 4; ten values at least", f"""
with x as (select symbol, volume, first_value(volume) over (partition by symbol order by ts desc) as latest from bars),
y as (select symbol, max(latest) as latest, {rank_of("volume", "latest")} as p, (max(latest) - avg(volume)) / nullif(stddev_samp(volume), 0) as z from x group by symbol having count(*) >= 10)
select symbol, latest, round(p, 6) as percentile, round(case when p between .4 and .6 then 0.0 when p > .6 then (p - .6) / .4 * 100 else (p - .4) / .4 * 100 end, 5) as score,
    case when abs(coalesce(z, 0.0)) > 2.5 then 4 when abs(coalesce(z, 0.0)) > 1.5 then 3 when abs(coalesce(z, 0.0)) > 1 then 2 else 1 end as weight from y"""),
    operator("label_scores", "bars", "A5 a score of each symbol's last change as a label, and the label's score", f"""
with x as (select symbol, round(1000 * (close / lag(close) {S} - 1), 6) as score, row_number() over (partition by symbol order by ts desc) as k from bars), y as (select symbol, score, {label("score")} as label from x where k = 1 and score is not null)
select symbol, round(score, 4) as score, label, case label {" ".join(f"when '{name}' then {value}" for name, value in LABELS)} else -100 end as label_score from y"""),
    operator("ensemble", "indicators", "E1, E2 four engines' scores weighed by the symbol's volatility regime, less 30 % of their spread over 200, with a conviction tier", f"""
with {X}, y as (select symbol, ts, k, n, rsi, histogram, close, atr14, close / lag(close, 5) {S} - 1 as m5, close / lag(close, 20) {S} - 1 as m20, close / lag(close, 60) {S} - 1 as m60, avg(close) {last(50)} as m50, stddev_samp(close / 1.0) {last(20)} / avg(close) {last(20)} as spread from x),
e as (select symbol, case when spread > .1 then 'volatile' when m20 > .05 or m20 < -.05 then 'trending' else 'ranging' end as regime, greatest(-100.0, least(100.0, 4 * (50 - rsi))) as technical,
    greatest(-100.0, least(100.0, 300 * (close / m50 - 1))) as fundamental, greatest(-100.0, least(100.0, 400 * m20)) as quant, greatest(-100.0, least(100.0, 600 * m5)) as sentiment from y where k = 1 and n >= 61),
w as (select *, case regime when 'trending' then .35 when 'volatile' then .20 else .30 end as a, case regime when 'trending' then .20 when 'volatile' then .30 else .30 end as b,
    case regime when 'trending' then .25 when 'volatile' then .35 else .25 end as c, case regime when 'trending' then .20 when 'volatile' then .15 else .15 end as d from e),
s as (select symbol, regime, round((a * technical + b * fundamental + c * quant + d * sentiment) / (a + b + c + d), 6) as score, greatest(technical, fundamental, quant, sentiment) - least(technical, fundamental, quant, sentiment) as spread,
    greatest(case when technical >= 20 then 1 else 0 end + case when fundamental >= 20 then 1 else 0 end + case when quant >= 20 then 1 else 0 end + case when sentiment >= 20 then 1 else 0 end,
        case when technical <= -20 then 1 else 0 end + case when fundamental <= -20 then 1 else 0 end + case when quant <= -20 then 1 else 0 end + case when sentiment <= -20 then 1 else 0 end) as agree from w),
f as (select *, greatest(.05, round(.9 - .30 * spread / 200, 6)) as confidence from s)
select symbol, regime, cast(case when score >= 0 then floor(score) else ceil(score) end as integer) as score, {label("score")} as label, agree, round(confidence, 5) as confidence,
    case when agree >= 3 and confidence > .65 then 'high' when agree >= 2 and confidence > .5 then 'moderate' else 'low' end as conviction from f"""),
    operator("horizons", "indicators", "E3 short, medium and long horizon signals: 60 parts technical and 40 parts momentum", f"""
with {X}, y as (select symbol, k, n, rsi, close, close / lag(close, 5) {S} - 1 as m5, close / lag(close, 20) {S} - 1 as m20, close / lag(close, 60) {S} - 1 as m60, avg(close) {last(20)} as m20c, avg(close) {last(50)} as m50c from x),
h as (select symbol, 'short' as horizon, .6 * (50 - rsi) * 2 + .4 * greatest(-100.0, least(100.0, 600 * m5)) as score from y where k = 1 and n >= 61
    union all select symbol, 'medium' as horizon, .6 * greatest(-100.0, least(100.0, 400 * (close / m20c - 1))) + .4 * greatest(-100.0, least(100.0, 400 * m20)) as score from y where k = 1 and n >= 61
    union all select symbol, 'long' as horizon, .6 * greatest(-100.0, least(100.0, 300 * (close / m50c - 1))) + .4 * greatest(-100.0, least(100.0, 200 * m60)) as score from y where k = 1 and n >= 61)
select symbol, horizon, round(score, 4) as score, {label("round(score, 6)")} as label from h"""),
    operator("stops", "indicators", "E15 stop and target of a long and a short from the mean of 14 true ranges, by volatility regime", f"""
with {X}, y as (select symbol, k, n, close, case when seq > 0 then greatest(high - low, abs(high - lag(close) {S}), abs(low - lag(close) {S})) end as tr, stddev_samp(close / 1.0) {last(20)} / avg(close) {last(20)} as spread from x),
z as (select symbol, avg(case when k <= 14 then tr end) as tr, max(case when k = 1 then close end) as close, max(case when k = 1 then spread end) as spread from y group by symbol having count(tr) >= 14),
m as (select *, case when spread > .1 then 2.5 when spread < .03 then 1.5 else 2.0 end as a, case when spread > .1 then 3.5 when spread < .03 then 2.5 else 3.0 end as b from z)
select symbol, round(close - a * tr, 5) as long_stop, round(close + b * tr, 5) as long_target, round(close + a * tr, 5) as short_stop, round(close - b * tr, 5) as short_target from m"""),
    operator("training_signal", "indicators", "M10 rule-derived label of each bar from its averages, RSI and volatility", f"""
with {X}, y as (select symbol, ts, seq, rsi, avg(close) {last(20)} as m20, avg(close) {last(50)} as m50, close from x)
select symbol, ts, case when close > m20 and m20 > m50 and rsi < 70 then 1 when close < m20 and m20 < m50 and rsi > 30 then -1 else 0 end as label, round(rsi, 5) as rsi from y where seq >= 49"""),
]
