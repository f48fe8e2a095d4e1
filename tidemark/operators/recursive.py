"""Recursive indicators: one pass over each symbol's bars in order.

Smoothing with a seed is a recursion that no window expresses, so a symbol's series goes through a Python loop in
one task, as a grouped map; time and memory are linear in the series. Rows come back with their bars, null until
an indicator is warm. Equal time stamps of one symbol keep the order of `seq`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

NAN = float("nan")


def ema_of(x, n: int) -> list[float]:
    """Exponential average with factor 2 / (n + 1), seeded with the mean of the first n values that are there."""
    out, k, held, last = [], 2.0 / (n + 1), [], None
    for v in x:
        if v != v:
            out.append(NAN)
        elif last is None:
            held.append(v)
            if len(held) == n:
                last = sum(held) / n
            out.append(NAN if last is None else last)
        else:
            last += k * (v - last)
            out.append(last)
    return out


def wilder_of(x, n: int) -> list[float]:
    """Wilder's average: seeded with the mean of the first n values that are there, then (n - 1) parts to one."""
    out, held, last = [], [], None
    for v in x:
        if v != v:
            out.append(NAN)
        elif last is None:
            held.append(v)
            if len(held) == n:
                last = sum(held) / n
            out.append(NAN if last is None else last)
        else:
            last = (last * (n - 1) + v) / n
            out.append(last)
    return out


def rsi_of(close, n: int) -> np.ndarray:
    """First value at change n + 1; without losses the ratio counts as 100."""
    change = np.diff(np.asarray(close, float), prepend=np.nan)
    up, down = (np.array(wilder_of(np.where(np.isnan(change), NAN, np.maximum(s * change, 0)), n)) for s in (1, -1))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 100 - 100 / (1 + np.where(down == 0, 100.0, up / down))
    out[: n + 1] = NAN
    out[np.isnan(up)] = NAN
    return out


def true_range(high, low, close) -> np.ndarray:
    before = np.r_[np.nan, close[:-1]]
    return np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))


def directional(high, low, close, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """+DI, -DI and ADX by Wilder's sums; the first sums already hold one update."""
    up, down = np.diff(high), -np.diff(low)
    plus = np.where((up > down) & (up > 0), up, 0.0)
    minus = np.where((down > up) & (down > 0), down, 0.0)
    tr = true_range(high, low, close)[1:]
    out = np.full((3, len(close)), NAN)
    if len(tr) > n:
        a, b, c = plus[:n].sum(), minus[:n].sum(), tr[:n].sum()
        dx = []
        for i in range(n, len(tr)):
            a, b, c = a - a / n + plus[i], b - b / n + minus[i], c - c / n + tr[i]
            p, m = (100 * a / c, 100 * b / c) if c > 0 else (0.0, 0.0)
            out[0, i + 1], out[1, i + 1] = p, m
            dx.append(100 * abs(p - m) / (p + m) if p + m > 0 else 0.0)
        out[2, n + 1 :] = wilder_of(dx, n)
    return out[0], out[1], out[2]


def per_symbol(bars: DataFrame, columns: list[str], names: list[str], f: Callable[[pd.DataFrame], list], key: str = "symbol", order: str = "ts") -> DataFrame:
    """key, order, columns and what f gives for a series in order, one array for each of names."""
    kept = bars.select(key, order, *columns)
    schema = StructType([*kept.schema.fields, *(StructField(n, DoubleType()) for n in names)])

    def run(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values(order, kind="stable").reset_index(drop=True)
        return series.assign(**dict(zip(names, f(series))))

    return kept.groupBy(key).applyInPandas(run, schema)


def ema(bars: DataFrame, n: int = 12, column: str = "close") -> DataFrame:
    """T2 exponential moving average, null before the n-th bar."""
    return per_symbol(bars, [column], ["ema"], lambda s: [ema_of(s[column], n)]).drop(column)


def rsi(bars: DataFrame, n: int = 14, column: str = "close") -> DataFrame:
    """T3 relative strength index with Wilder's smoothing."""
    return per_symbol(bars, [column], ["rsi"], lambda s: [rsi_of(s[column], n)]).drop(column)


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, column: str = "close") -> DataFrame:
    """T4 MACD line, its signal and histogram, the averages aligned by bar."""

    def f(s):
        line = np.array(ema_of(s[column], fast)) - np.array(ema_of(s[column], slow))
        smooth = np.array(ema_of(line, signal))
        return [line, smooth, line - smooth]

    return per_symbol(bars, [column], ["line", "signal", "histogram"], f).drop(column)


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """T7 average true range by Wilder, seeded with the mean of the first n ranges."""
    return per_symbol(bars, ["high", "low", "close"], ["atr"], lambda s: [wilder_of(true_range(*(s[c].to_numpy(float) for c in ("high", "low", "close"))), n)]).drop("high", "low", "close")


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    """T11 directional indicators and their index."""
    return per_symbol(bars, ["high", "low", "close"], ["plus_di", "minus_di", "adx"], lambda s: list(directional(*(s[c].to_numpy(float) for c in ("high", "low", "close")), n))).drop("high", "low", "close")


def keltner(bars: DataFrame, n: int = 20, atr_n: int = 10, times: float = 2.0) -> DataFrame:
    """T15 Keltner channels: an exponential average with `times` average true ranges of the same bar on either side."""

    def f(s):
        high, low, close = (s[c].to_numpy(float) for c in ("high", "low", "close"))
        middle, span = np.array(ema_of(close, n)), times * np.array(wilder_of(true_range(high, low, close), atr_n))
        return [middle - span, middle, middle + span]

    return per_symbol(bars, ["high", "low", "close"], ["lower", "middle", "upper"], f).drop("high", "low", "close")


def indicators(bars: DataFrame) -> DataFrame:
    """The bars with all recursive indicators at their usual periods, in one pass."""

    def f(s):
        high, low, close = (s[c].to_numpy(float) for c in ("high", "low", "close"))
        e12, e26, tr = np.array(ema_of(close, 12)), np.array(ema_of(close, 26)), true_range(high, low, close)
        signal = ema_of(e12 - e26, 9)
        return [e12, e26, ema_of(close, 20), signal, rsi_of(close, 14), wilder_of(tr, 14), wilder_of(tr, 10), *directional(high, low, close, 14)]

    names = ["ema12", "ema26", "ema20", "signal", "rsi", "atr14", "atr10", "plus_di", "minus_di", "adx"]
    return per_symbol(bars, ["seq", "open", "high", "low", "close", "volume"], names, f)


def garch(bars: DataFrame, omega: float = 1e-5, alpha: float = 0.1, beta: float = 0.85) -> DataFrame:
    """R13 GARCH(1,1) with fixed parameters, started at the mean square of all returns: annual volatility in percent
    that is forecast after the last return."""

    def run(s: pd.DataFrame) -> pd.DataFrame:
        close = s.sort_values("ts", kind="stable")["close"].to_numpy(float)
        r = close[1:] / close[:-1] - 1
        if not len(r):
            return pd.DataFrame({"symbol": s["symbol"].iloc[:0], "forecast": np.zeros(0)})
        v = float((r * r).mean())
        for x in r.tolist():
            v = omega + alpha * x * x + beta * v
        v = omega + alpha * r[-1] ** 2 + beta * v
        return pd.DataFrame({"symbol": s["symbol"].iloc[:1], "forecast": [100 * (252 * v) ** 0.5]})

    kept = bars.select("symbol", "ts", "close")
    return kept.groupBy("symbol").applyInPandas(run, StructType([kept.schema["symbol"], StructField("forecast", DoubleType())]))


def cusum(values: DataFrame, column: str = "value", slack: float = 0.5, threshold: float = 4.0, window: int = 20) -> DataFrame:
    """C6 two-sided CUSUM of values standardised by their first `window`: both sums and 1 or -1 where one passes the
    threshold, after which that one starts anew. Shorter series stay at 0."""

    def f(s):
        x = s[column].to_numpy(float)
        out = np.zeros((3, len(x)))
        if len(x) >= window:
            z = (x - x[:window].mean()) / max(x[:window].std(ddof=1), 0.001)
            up = down = 0.0
            for i in range(1, len(x)):
                up, down = max(up + z[i] - slack, 0.0), max(down - z[i] - slack, 0.0)
                out[2, i] = 1.0 if up > threshold else -1.0 if down > threshold else 0.0
                up, down = 0.0 if up > threshold else up, 0.0 if down > threshold else down
                out[0, i], out[1, i] = up, down
        return list(out)

    return per_symbol(values, [column], ["upper", "lower", "change"], f).drop(column)


def ewma_chart(values: DataFrame, column: str = "value", weight: float = 0.2, width: float = 3.0) -> DataFrame:
    """C7 exponentially weighted control chart about the series' mean, with limits that widen to their asymptote."""

    def f(s):
        x = s[column].to_numpy(float)
        mean, sd = x.mean(), x.std(ddof=1) if len(x) > 1 else 0.0
        now, out = mean, np.zeros((3, len(x)))
        for i, v in enumerate(x):
            now = weight * v + (1 - weight) * now
            half = width * sd * (weight / (2 - weight) * (1 - (1 - weight) ** (2 * (i + 1)))) ** 0.5
            out[:, i] = now, mean - half, mean + half
        return list(out)

    return per_symbol(values, [column], ["ewma", "low", "high"], f).drop(column)
