"""Desk reports: timeframes, relative performance, data cleaning, risk halts, strategy weights, statements and news."""

from ..functions.operator import operator

S = "over (partition by symbol order by ts)"
Q = "over (partition by symbol order by fiscal_year, fiscal_quarter"


def last(n: int) -> str:
    return f"over (partition by symbol order by ts rows between {n - 1} preceding and current row)"


BACK = "order by ts desc, id desc, line desc, part desc, price desc, shares desc"
#: Returns of each symbol beside the mean return of all symbols that day.
BESIDE = f"""p as (select symbol, ts, seq, close / lag(close) {S} - 1 as r from bars), m as (select ts, avg(r) as rb from p where r is not null group by ts),
x as (select p.symbol, p.ts, p.seq, p.r, m.rb from p join m on p.ts = m.ts where p.r is not null)"""
EQUITY = "d as (select symbol, ts, sum(pnl) as pnl from trades group by symbol, ts), q as (select symbol, ts, pnl, 100000 + sum(pnl) over (partition by symbol order by ts) as equity from d)"

# fixed values: words that put an article into an event class, tried in this order, and the weight of the class
EVENTS = [
    ("acquisition", 2.5, ["acqui", "merger", "buyout", "takeover", "spinoff", "spin-off"]),
    ("regulatory", 2.0, ["fda", "sec ", "regulat", "approval", "antitrust", "compliance"]),
    ("analyst", 1.5, ["upgrade", "downgrade", "price target", "initiat", "analyst", "rating"]),
    ("management", 1.3, ["ceo", "cfo", "board", "executive", "resign", "appoint"]),
    ("product", 1.2, ["launch", "product", "recall", "patent", "innovation"]),
    ("legal", 1.5, ["lawsuit", "litigation", "settlement", "sued", "court", "indictment"]),
    ("macro", 0.8, ["fed ", "federal reserve", "interest rate", "inflation", "gdp", "unemployment"]),
]


def has(*words: str) -> str:
    return "(" + " or ".join(f"contains(t, '{w}')" for w in words) + ")"


EARNINGS = f"{has('earnings', 'quarterly', 'guidance', 'eps')} or contains(t, 'revenue') and {has('beat', 'miss', 'report')} or contains(t, 'profit') and contains(t, 'quarter')"
CLASS = f"case when {EARNINGS} then 'earnings' " + " ".join(f"when {has(*words)} then '{name}'" for name, _, words in EVENTS) + " else 'general' end"
WEIGHT = "case event when 'earnings' then 2.0 " + " ".join(f"when '{name}' then {w}" for name, w, _ in EVENTS) + " else 1.0 end"

OPERATORS = [
    operator("adx_mean", "bars", "T12 directional movement and its index by plain means of 14 bars", f"""
with x as (select symbol, ts, high, low, lag(high) {S} as h1, lag(low) {S} as l1, lag(close) {S} as c1 from bars),
d as (select symbol, ts, greatest(high - low, abs(high - c1), abs(low - c1)) as tr, case when high - h1 > l1 - low and high > h1 then high - h1 else 0.0 end as up,
    case when l1 - low > high - h1 and l1 > low then l1 - low else 0.0 end as dn from x where c1 is not null),
s as (select symbol, ts, row_number() {S} as k, sum(tr) {last(14)} as a, sum(up) {last(14)} as b, sum(dn) {last(14)} as c from d),
i as (select symbol, ts, row_number() {S} as j, 100 * b / a as plus, 100 * c / a as minus, case when b + c > 0 then 100 * abs(b - c) / (b + c) else 0.0 end as dx from s where k >= 14 and a > 0)
select symbol, ts, round(plus, 4) as plus_di, round(minus, 4) as minus_di, round(case when j >= 14 then avg(dx) {last(14)} end, 4) as adx from i"""),
    operator("relative_strength", "bars", "T20 close over the mean close of all symbols that day", """
with m as (select ts, avg(close) as bench from bars group by ts) select bars.symbol, bars.ts, round(bars.close / m.bench, 6) as strength from bars join m on bars.ts = m.ts"""),
    operator("timeframes", "bars", "G5 trend of 10 against 20 bars by day, week and month at the last bar", """
with c as (select symbol, 'day' as grain, cast(ts as date) as bar, ts, close from bars
    union all select symbol, 'week' as grain, cast(date_trunc('week', ts) as date) as bar, ts, close from bars union all select symbol, 'month' as grain, cast(date_trunc('month', ts) as date) as bar, ts, close from bars),
e as (select symbol, grain, bar, close, row_number() over (partition by symbol, grain, bar order by ts desc) as k from c),
w as (select symbol, grain, avg(close) over (partition by symbol, grain order by bar rows between 9 preceding and current row) as a, avg(close) over (partition by symbol, grain order by bar rows between 19 preceding and current row) as b,
    row_number() over (partition by symbol, grain order by bar desc) as back, count(*) over (partition by symbol, grain) as n from e where k = 1)
select symbol, grain, a > b as rising, round(abs(a / b - 1), 6) as strength from w where back = 1 and n >= 20"""),
    operator("group_momentum", "bars", "G7 change over 1, 5 and 20 bars and their momentum .1, .3, .6 at the last bar", f"""
with x as (select symbol, ts, 100 * (close / lag(close, 1) {S} - 1) as d, 100 * (close / lag(close, 5) {S} - 1) as w, 100 * (close / lag(close, 20) {S} - 1) as m, row_number() over (partition by symbol order by ts desc) as k from bars)
select symbol, round(d, 4) as change_1d, round(w, 4) as change_1w, round(m, 4) as change_1m, round(.1 * d + .3 * w + .6 * m, 4) as momentum from x where k = 1 and m is not null"""),
    operator("beta_shift", "bars", "R21 beta against the mean of all symbols in the first and the second half", f"""
with {BESIDE}, h as (select *, seq * 2 > max(seq) over (partition by symbol) as late from x)
select symbol, round(regr_slope(case when not late then r end, rb), 5) as early_beta, round(regr_slope(case when late then r end, rb), 5) as late_beta,
    round(regr_slope(case when late then r end, rb) - regr_slope(case when not late then r end, rb), 5) as shift from h group by symbol having count(*) >= 60"""),
    operator("benchmark_correlation", "bars", "R26 correlation with the mean return of all symbols, whole and over the last 30 bars", f"""
with {BESIDE}, k as (select *, row_number() over (partition by symbol order by ts desc) as back from x)
select symbol, round(corr(r, rb), 5) as whole, round(corr(case when back <= 30 then r end, rb), 5) as last30 from k group by symbol having count(*) >= 30"""),
    operator("volatility_proxy", "bars", "M9 annual volatility in percent of the last 22 bars", f"""
with x as (select symbol, close / lag(close) {S} - 1 as r, row_number() over (partition by symbol order by ts desc) as k from bars)
select symbol, round(stddev_pop(r) * sqrt(252) * 100, 4) as proxy from x where k <= 21 group by symbol having count(r) = 21"""),
    operator("volatility_rank", "bars", "O3 share of the 20-bar volatilities of a symbol below its latest", f"""
with x as (select symbol, ts, seq, ln(close / lag(close) {S}) as r from bars),
v as (select symbol, ts, round(stddev_samp(r) {last(20)}, 12) as hv from x where r is not null and seq >= 1),
n as (select symbol, hv, row_number() {S} as i, first_value(hv) over (partition by symbol order by ts desc) as latest from v)
select symbol, round(max(latest) * sqrt(252), 6) as volatility, round(avg(case when hv < latest then 1.0 else 0.0 end), 6) as rank from n where i >= 20 group by symbol"""),
    operator("clean_bars", "bars", "Q2 positive bars of symbols with 100 or more, within ten deviations of their 50-bar mean, with a mean price", f"""
with x as (select symbol, ts, high, low, close, avg(close) {last(50)} as m, stddev_samp(close) {last(50)} as sd, count(*) {last(50)} as held, count(*) over (partition by symbol) as n
    from bars where open > 0 and high > 0 and low > 0 and close > 0 and volume > 0)
select symbol, ts, close, (high + low + close) / 3 as vwap from x where n >= 100 and (held < 10 or abs(close - m) <= 10 * sd)"""),
    operator("winsorised", "bars", "Q5 volume cut at its 1st and 99th percentile and normalised, by symbol", """
with p as (select symbol, percentile_cont(0.01) within group (order by volume) as lo, percentile_cont(0.99) within group (order by volume) as hi from bars group by symbol),
w as (select bars.symbol, bars.ts, greatest(p.lo, least(p.hi, bars.volume)) as v from bars join p on bars.symbol = p.symbol)
select symbol, ts, round((v - avg(v) over (partition by symbol)) / (stddev_pop(v) over (partition by symbol) + 0.00000001), 5) as z from w"""),
    operator("opening_gap", "bars", "E21 opening gap of the last bar, its rank in the symbol's history and whether the day went against it", f"""
with x as (select symbol, ts, open, close, round(100 * (open / lag(close) {S} - 1), 9) as gap from bars),
y as (select *, first_value(gap) over (partition by symbol order by ts desc) as latest, row_number() over (partition by symbol order by ts desc) as k from x where gap is not null),
z as (select symbol, max(latest) as gap, avg(case when gap < latest then 1.0 when gap = latest then .5 else 0.0 end) as rank, max(case when k = 1 then close - open end) as move from y group by symbol)
select symbol, round(gap, 5) as gap, round(rank, 6) as rank, case when rank > .9 then 'up' when rank < .1 then 'down' else 'usual' end as label, gap * move < 0 as against from z"""),
    operator("relative_rank", "bars", "E23 20-bar return over that of all symbols, ranked in the symbol's own history", f"""
with {BESIDE}, s as (select symbol, ts, round(sum(r - rb) {last(20)}, 9) as over20, count(*) {last(20)} as n from x),
y as (select *, first_value(over20) over (partition by symbol order by ts desc) as latest from s where n = 20)
select symbol, round(max(latest), 6) as excess, round(avg(case when over20 < latest then 1.0 when over20 = latest then .5 else 0.0 end), 6) as rank from y group by symbol"""),
    operator("movers", "bars", "E13 top 20 movers of the last bars with a price of 5, a range of .5 % and 10 shares or more", f"""
with x as (select symbol, ts, close, high, low, volume, round(100 * (close / lag(close) {S} - 1), 5) as change, row_number() over (partition by symbol order by ts desc) as k from bars)
select symbol, change, round(100 * (high - low) / close, 5) as day_range, volume from x where k = 1 and close >= 5 and (high - low) / close >= .005 and volume >= 10 and change is not null order by abs(change) desc, symbol limit 20"""),
    operator("circuit_breakers", "trades", "X4 run of latest losses among 20 trades, loss of the last day and drawdown, with a halt", f"""
with t as (select symbol, pnl, row_number() over (partition by symbol {BACK}) as k from trades),
l as (select symbol, coalesce(min(case when pnl >= 0 then k end), count(*) + 1) - 1 as losses from t where k <= 20 group by symbol),
{EQUITY}, e as (select symbol, pnl, equity, max(equity) over (partition by symbol) as top, row_number() over (partition by symbol order by ts desc) as k from q)
select e.symbol, cast(l.losses as bigint) as losses, round(greatest(-e.pnl, 0.0) / (e.equity - e.pnl), 6) as day_loss, round(1 - e.equity / e.top, 6) as drawdown,
    l.losses >= 5 or -e.pnl / (e.equity - e.pnl) > .02 or 1 - e.equity / e.top > .1 as halt from e join l on e.symbol = l.symbol where e.k = 1"""),
    operator("kelly_sizes", "trades", "E14, K7 Kelly fraction of each symbol's trades, between 0 and .25, and half of it", """
with x as (select symbol, avg(case when pnl > 0 then 1.0 else 0.0 end) as p, avg(case when pnl > 0 then pnl end) as won, -avg(case when pnl < 0 then pnl end) as lost from trades group by symbol)
select symbol, round(p, 6) as win_rate, round(greatest(0.0, least(.25, p - (1 - p) * lost / won)), 6) as kelly, round(greatest(0.0, least(.25, p - (1 - p) * lost / won)) / 2, 6) as half_kelly from x where won is not null and lost is not null"""),
    operator("strategy_weights", "trades", "C12 wins and losses with a daily decay of .95 from a uniform prior, mean and 95 % bounds", """
with l as (select symbol, min(ts) as first_ts, max(ts) as last_ts from trades group by symbol),
d as (select trades.symbol, power(.95, DAYS(last_ts, first_ts)) as prior, case when pnl > 0 then 1.0 else 0.0 end as win, power(.95, DAYS(last_ts, ts)) as w from trades join l on trades.symbol = l.symbol),
s as (select symbol, max(prior) + sum(w * win) as a, max(prior) + sum(w * (1 - win)) as b from d group by symbol),
v as (select symbol, a / (a + b) as mean, sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as sd from s)
select symbol, round(mean, 6) as win_rate, round(greatest(0.0, mean - 1.96 * sd), 6) as low, round(least(1.0, mean + 1.96 * sd), 6) as high from v"""),
    operator("strategy_decay", "trades", "C9 latest monthly expectancy against its peak and mean, slope and months until it is gone", """
with m as (select symbol, date_trunc('month', ts) as month, avg(pnl) as v from trades group by symbol, date_trunc('month', ts)),
k as (select symbol, v, row_number() over (partition by symbol order by month) as i, first_value(v) over (partition by symbol order by month desc) as latest from m),
s as (select symbol, max(latest) as latest, max(v) as peak, avg(v) as mean, regr_slope(v, i) as slope from k group by symbol having count(*) >= 3)
select symbol, round(latest, 8) as latest, round(peak, 8) as peak, round(mean, 8) as mean, round(slope, 5) as slope, round(case when slope < 0 and latest > 0 then -latest / slope end, 3) as months_left from s"""),
    operator("pnl_report", "trades", "D1 trades, wins and profit by side, by symbol and overall in one pass", """
select side, symbol, cast(count(*) as bigint) as trades, cast(sum(case when pnl > 0 then 1 else 0 end) as bigint) as wins, round(sum(pnl), 2) as pnl from trades group by grouping sets ((side), (symbol), ())"""),
    operator("false_discovery", "trades", "K14 p-value of each symbol's mean profit with Bonferroni and Benjamini-Hochberg correction", """
with s as (select symbol, abs(avg(pnl)) / (stddev_samp(pnl) / sqrt(count(*))) as z from trades group by symbol having count(*) >= 3),
u as (select symbol, z, 1 / (1 + 0.3275911 * z / sqrt(2)) as t from s),
p as (select symbol, round(t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z / 2), 9) as p from u),
r as (select symbol, p, p * (count(*) over ()) / (row_number() over (order by p, symbol)) as q, least(1.0, p * (count(*) over ())) as b from p)
select symbol, round(p, 6) as p, round(b, 6) as bonferroni, round(least(1.0, min(q) over (order by p desc, symbol desc rows between unbounded preceding and current row)), 6) as bh from r"""),
    operator("rolling_performance", "trades", "B7 total return and that of the last 30, 90 and 252 days with trades", f"""
with {EQUITY}, x as (select symbol, equity, lag(equity, 30) {S} as a, lag(equity, 90) {S} as b, lag(equity, 252) {S} as c, row_number() over (partition by symbol order by ts desc) as k from q)
select symbol, round(equity / 100000 - 1, 6) as total, round(equity / a - 1, 6) as last30, round(equity / b - 1, 6) as last90, round(equity / c - 1, 6) as last252 from x where k = 1"""),
    operator("altman", "statements", "F7 Altman Z with estimated working capital and without a market value; gross profit stands for operating income", f"""
with x as (select symbol, fiscal_year, fiscal_quarter, total_assets as ta, total_liabilities as tl, sum(gross_profit) {Q} rows between 3 preceding and current row) as oi,
    sum(revenue) {Q} rows between 3 preceding and current row) as rev from statements),
z as (select *, 1.2 * greatest(.4 * ta - .3 * tl, 0.0) / ta + 1.4 * greatest(ta - tl, 0.0) / ta + 3.3 * oi / ta + rev / ta as z from x where ta > 0 and tl > 0)
select symbol, fiscal_year, fiscal_quarter, round(z, 5) as z, case when z > 2.99 then 'safe' when z > 1.81 then 'grey' else 'distress' end as zone from z"""),
    operator("accruals", "statements", "F11 accrual ratio of four quarters and turnover of the estimated working capital", f"""
with x as (select symbol, fiscal_year, fiscal_quarter, total_assets as ta, total_liabilities as tl, sum(net_income - cash_flow_operating) {Q} rows between 3 preceding and current row) as gap,
    sum(revenue) {Q} rows between 3 preceding and current row) as rev from statements)
select symbol, fiscal_year, fiscal_quarter, round(gap / ta, 6) as accrual_ratio, round(case when .4 * ta > .3 * tl then rev / (.4 * ta - .3 * tl) end, 6) as turnover from x where ta > 0"""),
    operator("beneish", "statements", "F12 partial Beneish M from the indices of gross margin and sales", f"""
with x as (select symbol, fiscal_year, fiscal_quarter, revenue, gross_profit, lag(revenue) {Q}) as rev1, lag(gross_profit) {Q}) as gp1 from statements),
m as (select symbol, fiscal_year, fiscal_quarter, -4.84 + .92 * (gp1 / rev1 / (gross_profit / revenue) - 1) + .528 * (revenue / rev1 - 1) as m from x where revenue > 0 and rev1 > 0 and gross_profit > 0)
select symbol, fiscal_year, fiscal_quarter, round(m, 5) as m, m > -2.22 as elevated from m"""),
    operator("news_events", "documents", "N3 event class of each text by ordered substring rules, and its weight", f"""
with x as (select doc_id, lower(coalesce(text, '')) as t from documents), c as (select doc_id, {CLASS} as event from x)
select doc_id, event, cast({WEIGHT} as double) as weight from c"""),
]
