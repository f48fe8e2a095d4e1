"""Technical indicators and candlestick patterns: one row per bar, null until warm."""

from ..functions.operator import Operator, operator

_W = "over (partition by symbol order by ts rows between {} preceding and current row)"
S = "over (partition by symbol order by ts)"
ALL = "over (partition by symbol)"

def last(n: int) -> str:
    """The frame of a symbol's last n bars."""
    return _W.format(n - 1)


def sma(n: int = 20, column: str = "close") -> Operator:
    """T1 the mean of the last n values."""
    return operator("sma", "bars", "T1 simple moving average", f"""
select symbol, ts, round(case when seq >= {n - 1} then avg({column}) {last(n)} end, 6) as sma{n} from bars""")


def bollinger(n: int = 20, k: float = 2) -> Operator:
    """T5, T6 bands of k population deviations about the mean of n closes."""
    return operator("bollinger", "bars", "T5, T6 Bollinger bands (20, 2, population deviation), %B and band width", f"""
with x as (select symbol, ts, seq, close, avg(close) {last(n)} as mid, stddev_pop(close) {last(n)} as sd from bars)
select symbol, ts, round(mid - {k} * sd, 6) as lower, round(mid, 6) as middle, round(mid + {k} * sd, 6) as upper,
    round(case when sd > 0.000001 then (close - mid + {k} * sd) / ({2 * k} * sd) end, 5) as percent_b,
    round({2 * k} * sd / mid, 6) as width from x where seq >= {n - 1}""")


def atr_percent(n: int = 14) -> Operator:
    """T8 mean of n true ranges over the price."""
    return operator("atr_percent", "bars", "T7, T8 true range and its mean of 14 bars over the price", f"""
with x as (select symbol, ts, seq, close, case when seq = 0 then high - low
    else greatest(high - low, abs(high - lag(close) {S}), abs(low - lag(close) {S})) end as tr from bars)
select symbol, ts, round(tr, 9) as true_range, round(case when seq >= {n} then 100 * avg(tr) {last(n)} / close end, 6) as atr_percent from x""")


def stochastic(n: int = 14, m: int = 3) -> Operator:
    """T9 %K of n bars and its mean of m."""
    return operator("stochastic", "bars", "T9 stochastic %K(14) and %D(3); a flat range gives 50", f"""
with r as (select symbol, ts, seq, close, max(high) {last(n)} as hi, min(low) {last(n)} as lo from bars),
k as (select symbol, ts, seq, case when hi - lo > 0 then 100 * (close - lo) / (hi - lo) else 50.0 end as k from r where seq >= {n - 1})
select symbol, ts, round(k, 5) as k, round(case when seq >= {n + m - 2} then avg(k) {last(m)} end, 5) as d from k""")


def ichimoku(short: int = 9, middle: int = 26, long: int = 52) -> Operator:
    """T14 lines of the middle prices, spans shifted by middle - 1 and the close of `middle` bars on."""
    return operator("ichimoku", "bars", "T14 Ichimoku 9/26/52 with spans shifted by 25 and chikou by 26", f"""
with x as (select symbol, ts, seq, close, (max(high) {last(short)} + min(low) {last(short)}) / 2 as tenkan, (max(high) {last(middle)} + min(low) {last(middle)}) / 2 as kijun,
    (max(high) {last(long)} + min(low) {last(long)}) / 2 as wide from bars)
select symbol, ts, tenkan as tenkan, kijun as kijun, lag((tenkan + kijun) / 2, {middle - 1}) {S} as span_a,
    lag(case when seq >= {long - 1} then wide end, {middle - 1}) {S} as span_b, lead(close, {middle}) {S} as chikou from x""")


def trend_slopes(n: int = 20, share: float = 0.1) -> Operator:
    """T21 regression trend of n bars beyond a share of their mean range."""
    return operator("trend_slopes", "bars", "T21 the mean of the regression slopes of highs and lows over 20 bars against a tenth of their mean range", f"""
with x as (select symbol, ts, seq, regr_slope(high, cast(seq as double)) {last(n)} as up, regr_slope(low, cast(seq as double)) {last(n)} as down, avg(high - low) {last(n)} as span from bars)
select symbol, ts, round(up, 5) as high_slope, round(down, 5) as low_slope,
    case when round((up + down) / 2 - {share} * span, 9) > 0 then 'up' when round((up + down) / 2 + {share} * span, 9) < 0 then 'down' else 'sideways' end as trend
from x where seq >= {n - 1}""")


def crosses(fast: int = 20, slow: int = 50) -> Operator:
    """T24 crosses of two means."""
    return operator("crosses", "bars", "T24 golden and death crosses of the 20 and 50 bar means", f"""
with x as (select symbol, ts, seq, avg(close) {last(fast)} - avg(close) {last(slow)} as gap from bars),
y as (select symbol, ts, gap, lag(gap) {S} as before from x where seq >= {slow - 1})
select symbol, ts, case when gap > 0 then 'golden' else 'death' end as kind from y where (gap > 0.0000001 and before < -0.0000001) or (gap < -0.0000001 and before > 0.0000001)""")


def accumulation(n: int = 20) -> Operator:
    """T28 close-location value times volume over n bars."""
    return operator("accumulation", "bars", "T28 sum of close-location value times volume over 20 bars", f"""
select symbol, ts, round(sum(case when high > low then ((close - low) - (high - close)) / (high - low) * volume else 0.0 end) {last(n)}, 4) as clv from bars""")


def volume_profile(buckets: int = 20) -> Operator:
    """T27 volume by equal buckets of the price range."""
    return operator("volume_profile", "bars", "T27 volume in 20 equal buckets of the price range", f"""
with r as (select symbol, (high + low) / 2 as mid, volume, min(low) {ALL} as lo, max(high) {ALL} as hi from bars),
b as (select symbol, least(cast(floor((mid - lo) / (hi - lo) * {buckets}) as integer), {buckets - 1}) as bucket, volume from r where hi > lo)
select symbol, bucket, sum(volume) as volume, cast(count(*) as bigint) as bars from b group by symbol, bucket""")


def fibonacci(n: int = 50) -> Operator:
    """T17 retracement levels of the last n bars."""
    return operator("fibonacci", "bars", "T17 retracement levels of the last bars", f"""
with x as (select symbol, high, low, seq, count(*) over (partition by symbol) as n from bars),
r as (select symbol, max(high) as hi, min(low) as lo from x where seq >= n - {n} group by symbol)
select symbol, round(hi - .236 * (hi - lo), 8) as r236, round(hi - .382 * (hi - lo), 8) as r382, round(hi - .5 * (hi - lo), 8) as r500,
    round(hi - .618 * (hi - lo), 8) as r618, round(hi - .786 * (hi - lo), 8) as r786 from r""")


# the shapes of P1 to P3: pattern, side, strength, condition on the bar (o h l c) and the two before it
SMALL = "span > 0 and body < .3 * span"
SHAPES = [
    ("doji", "neutral", "1 - body / span", "span > 0 and body < .1 * span"),
    ("hammer", "bullish", "case when body > 0 then least(below / body, 5.0) / 5 else 1.0 end", f"{SMALL} and below > 2 * body and above < .5 * body"),
    ("inverted hammer", "bullish", "case when body > 0 then least(above / body, 5.0) / 5 else 1.0 end", f"{SMALL} and above > 2 * body and below < .5 * body"),
    ("shooting star", "bearish", "case when body > 0 then least(above / body, 5.0) / 5 else 1.0 end", f"{SMALL} and above > 2 * body and below < .5 * body"),
    ("bullish engulfing", "bullish", "least((c - o) / (o1 - c1), 2.0) / 2", "c1 < o1 and c > o and o <= c1 and c >= o1"),
    ("bearish engulfing", "bearish", "least((o - c) / (c1 - o1), 2.0) / 2", "c1 > o1 and c < o and o >= c1 and c <= o1"),
    ("piercing", "bullish", "least((c - c1) / (o1 - c1), 1.0)", "c1 < o1 and c > o and o < l1 and c > (o1 + c1) / 2 and c < o1"),
    ("dark cloud", "bearish", "least((c1 - c) / (c1 - o1), 1.0)", "c1 > o1 and c < o and o > h1 and c < (o1 + c1) / 2 and c > o1"),
    ("morning star", "bullish", ".8", "c2 < o2 and c > o and h2 > l2 and abs(c1 - o1) < .3 * (o2 - c2) and c > (o2 + c2) / 2"),
    ("evening star", "bearish", ".8", "c2 > o2 and c < o and h2 > l2 and abs(c1 - o1) < .3 * (c2 - o2) and c < (o2 + c2) / 2"),
    ("three white soldiers", "bullish", ".8", "c2 > o2 and c1 > o1 and c > o and c1 > c2 and c > c1 and o1 > o2 and o1 < c2 and o > o1 and o < c1"),
    ("three black crows", "bearish", ".8", "c2 < o2 and c1 < o1 and c < o and c1 < c2 and c < c1 and o1 < o2 and o1 > c2 and o < o1 and o > c1"),
]
# one pass over the bars: each has a column of strength for every shape, and the columns become rows
CANDLES = operator("candles", "bars", "P1 to P4 candlestick patterns as rows, with their strength", f"""
with x as (select symbol, ts, seq, open as o, high as h, low as l, close as c, abs(close - open) as body, high - low as span, least(open, close) - low as below, high - greatest(open, close) as above,
    lag(open) {S} as o1, lag(close) {S} as c1, lag(high) {S} as h1, lag(low) {S} as l1, lag(open, 2) {S} as o2, lag(close, 2) {S} as c2, lag(high, 2) {S} as h2, lag(low, 2) {S} as l2 from bars),
y as (select symbol, ts, seq, {", ".join(f"case when {hit} then {strength} end as p{i}" for i, (_, _, strength, hit) in enumerate(SHAPES))} from x),
shapes as ({" union all ".join(f"select {i} as i, '{name}' as pattern, '{side}' as side" for i, (name, side, _, _) in enumerate(SHAPES))}),
z as (select symbol, ts, seq, pattern, side, case i {" ".join(f"when {i} then p{i}" for i in range(len(SHAPES)))} end as strength from y cross join shapes)
select symbol, ts, seq, pattern, side, round(strength, 5) as strength from z where strength is not null""")

OPERATORS = [
    sma(),
    bollinger(),
    atr_percent(),
    stochastic(),
    operator("obv", "bars", "T10 on-balance volume, seeded with the first volume", f"""
with x as (select symbol, ts, volume, close, lag(close) {S} as before from bars)
select symbol, ts, sum(case when before is null or close > before then volume when close < before then -volume else 0.0 end) {S} as obv from x"""),
    operator("vwap", "bars", "T13 cumulative volume-weighted average price; typical price without volume", f"""
select symbol, ts, round(case when sum(volume) {S} > 0 then sum((high + low + close) / 3 * volume) {S} / sum(volume) {S}
    else (high + low + close) / 3 end, 5) as vwap from bars"""),
    ichimoku(),
    operator("support_resistance", "bars", "T16 nearest five-bar swing above and below the last close", f"""
with x as (select *, lag(high) {S} as h1, lag(high, 2) {S} as h2, lead(high) {S} as h3, lead(high, 2) {S} as h4,
    lag(low) {S} as l1, lag(low, 2) {S} as l2, lead(low) {S} as l3, lead(low, 2) {S} as l4, count(*) {ALL} as n from bars),
l as (select symbol, close as last_close from x where seq = n - 1)
select x.symbol, round(min(case when high > h1 and high > h2 and high > h3 and high > h4 and high > last_close then high end), 8) as resistance,
    round(max(case when low < l1 and low < l2 and low < l3 and low < l4 and low < last_close then low end), 8) as support
from x join l on x.symbol = l.symbol group by x.symbol"""),
    fibonacci(),
    operator("pivot_points", "bars", "T18 classic pivots of each bar", """
with x as (select symbol, ts, high, low, (high + low + close) / 3 as p from bars)
select symbol, ts, round(p, 8) as p, round(2 * p - low, 8) as r1, round(p + high - low, 8) as r2, round(high + 2 * (p - low), 8) as r3,
    round(2 * p - high, 8) as s1, round(p - (high - low), 8) as s2, round(low - 2 * (high - p), 8) as s3 from x"""),
    operator("market_structure", "bars", "T19 higher and lower highs and lows among three-bar swings", f"""
with x as (select symbol, ts, high, low, lag(high) {S} as h1, lead(high) {S} as h2, lag(low) {S} as l1, lead(low) {S} as l2 from bars),
h as (select symbol, high, lag(high) {S} as before from x where high > h1 and high > h2),
l as (select symbol, low, lag(low) {S} as before from x where low < l1 and low < l2),
hc as (select symbol, sum(case when high > before then 1 else 0 end) as hh, sum(case when high < before then 1 else 0 end) as lh from h group by symbol),
lc as (select symbol, sum(case when low > before then 1 else 0 end) as hl, sum(case when low < before then 1 else 0 end) as ll from l group by symbol)
select hc.symbol, cast(hh as bigint) as hh, cast(lh as bigint) as lh, cast(hl as bigint) as hl, cast(ll as bigint) as ll from hc join lc on hc.symbol = lc.symbol"""),
    trend_slopes(),
    operator("volume_spike", "bars", "T23 z-score of the volume in the symbol's history and its side", f"""
with x as (select symbol, ts, volume, close, open, avg(volume) {ALL} as m, stddev_samp(volume) {ALL} as sd from bars)
select symbol, ts, round((volume - m) / sd, 5) as z, case when (volume - m) / sd > 2 then case when close >= open then 'bullish' else 'bearish' end end as signal from x where sd > 0"""),
    crosses(),
    volume_profile(),
    accumulation(),
    CANDLES,
    operator("weekly_bars", "bars", "S12, S13 weekly bars by ISO week, stamped with the first and the last bar", """
with x as (select *, date_trunc('week', ts) as week from bars),
y as (select *, row_number() over (partition by symbol, week order by ts) as k, count(*) over (partition by symbol, week) as n from x)
select symbol, min(ts) as first_ts, max(ts) as last_ts, round(max(case when k = 1 then open end), 9) as open, round(max(high), 9) as high,
    round(min(low), 9) as low, round(max(case when k = n then close end), 9) as close, sum(volume) as volume from y group by symbol, week"""),
    operator("price_changes", "bars", "S16 change over 20 bars at the last one, from the first bar of a short history", f"""
with x as (select symbol, seq, close, coalesce(lag(close, 20) {S}, first_value(close) {S}) as base, count(*) {ALL} as n from bars)
select symbol, round(100 * (close / base - 1), 6) as change_percent from x where seq = n - 1 and n >= 2"""),
]
