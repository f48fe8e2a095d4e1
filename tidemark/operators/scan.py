"""Linear recurrences x' = keep * x + b over long series, as a parallel scan of overlapping chunks.

The map of a run of steps is x -> keep**n * x + c, where c is a weighted sum, so that the state after a row is a running
sum of b * keep**-place, weighed back. A series is cut into chunks with the rows before a chunk as its halo: over a
halo of `forget` rows the past shrinks by e**-46, below what a double holds, so chunks need nothing else from one
another. A chunk is as long as its weights stay in a double's range. No window holds more than a chunk
and its halo, and a long series is spread over tasks wherever its rows are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Natural logarithms: of what is forgotten over a halo, and of the largest weight.
FORGET, LARGEST = 46.0, 600.0
#: (keep, b) by name of the column that holds the state.
Lanes = dict[str, tuple[float, Column]]


def lengths(keeps: list[float], rows: int | None = None) -> tuple[int, int]:
    """Rows of a halo and of a chunk for lanes that share them; `rows` shortens the chunk."""
    slow, fast = -math.log(max(keeps)), -math.log(min(keeps))
    halo = math.ceil(FORGET / slow)
    chunk = int(LARGEST / fast) - halo
    return halo, min(chunk, rows or chunk)


def groups(lanes: Lanes) -> list[list[str]]:
    """Names of lanes that can share chunks: what the slowest forgets in a halo must not be too much for the fastest."""
    out: list[list[str]] = []
    for n in sorted((n for n, (keep, _) in lanes.items() if keep > 0), key=lambda n: -lanes[n][0]):
        halo, chunk = lengths([lanes[m][0] for m in [*(out[-1] if out else []), n]])
        if out and chunk >= halo:
            out[-1].append(n)
        else:
            out.append([n])
    return out


def scan(rows: DataFrame, lanes: Lanes, key: str = "symbol", at: str = "seq", chunk: int | None = None) -> DataFrame:
    """rows with a column for each lane: the state after each row of x' = keep * x + b in the order of `at`, whole numbers from
    0 without gaps; the state before a series is 0, so a seed is the first b. 0 <= keep < 1, and b is not null.
    Columns of rows keep their values; names that begin with an underscore are taken. chunk: rows of a chunk, at most."""
    for n, (keep, _) in lanes.items():
        if not 0 <= keep < 1:
            raise ValueError(f"{n} keeps {keep} of itself")
    out = rows.withColumns({f"_b_{n}": b.cast("double") for n, (_, b) in lanes.items()})
    for names in groups(lanes):
        halo, size = lengths([lanes[n][0] for n in names], chunk)
        own = F.floor(F.col(at) / size)
        reach = F.floor((F.col(at) + halo) / size)  # the last chunk in whose halo the row is
        out = out.withColumn("_chunk", F.explode(F.sequence(own, reach)))
        place = F.col(at) - (F.col("_chunk") * size - halo)
        so_far = Window.partitionBy(key, "_chunk").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        weights = {n: F.pow(F.lit(lanes[n][0]), place) for n in names}
        out = out.withColumns({n: weights[n] * F.sum(F.col(f"_b_{n}") / weights[n]).over(so_far) for n in names})
        out = out.where(F.col("_chunk") == own).drop("_chunk")
    return out.withColumns({n: F.col(f"_b_{n}") for n, (keep, _) in lanes.items() if keep == 0}).select(*rows.columns, *lanes)


def by_symbol(key: str = "symbol", at: str = "seq"):
    return Window.partitionBy(key).orderBy(at)


def last(n: int, key: str = "symbol", at: str = "seq"):
    return by_symbol(key, at).rowsBetween(1 - n, 0)


def smoothed(value: Column, n: int, first: int, keep: float, seed: Column | None = None) -> tuple[float, Column]:
    """The lane of an average that keeps `keep` of itself: seeded at place `first`, by default with the mean of the last n
    values; 0 before."""
    seed = F.avg(value).over(last(n)) if seed is None else seed
    at = F.col("seq")
    return keep, F.when(at < first, 0.0).when(at == first, seed).otherwise((1 - keep) * value)


def warm(name: str, first: int) -> Column:
    return F.when(F.col("seq") >= first, F.col(name))


def ema_lane(value: Column, n: int, first: int | None = None) -> tuple[float, Column]:
    return smoothed(value, n, n - 1 if first is None else first, 1 - 2 / (n + 1))


def wilder_lane(value: Column, n: int, first: int) -> tuple[float, Column]:
    return smoothed(value, n, first, 1 - 1 / n)


def changes(bars: DataFrame) -> DataFrame:
    """Bars with the change of the close, the true range, and the moves up and down of high and low that count."""
    s = by_symbol()
    before, up, down = F.lag("close").over(s), F.col("high") - F.lag("high").over(s), F.lag("low").over(s) - F.col("low")
    range_ = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return bars.select(
        "*", F.greatest(F.col("close") - before, F.lit(0.0)).alias("_gain"), F.greatest(before - F.col("close"), F.lit(0.0)).alias("_loss"), F.when(F.col("seq") > 0, range_).alias("_range"),
        F.when((up > down) & (up > 0), up).otherwise(0.0).alias("_up"), F.when((down > up) & (down > 0), down).otherwise(0.0).alias("_down"),
    )


def rsi_value(gain: Column, loss: Column) -> Column:
    """Without losses the ratio counts as 100."""
    return 100 - 100 / (1 + F.when(loss == 0, F.lit(100.0)).otherwise(gain / loss))


def _without(df: DataFrame, *names: str) -> DataFrame:
    return df.drop("_gain", "_loss", "_range", "_up", "_down", *names)


def ema(bars: DataFrame, n: int = 12, column: str = "close", chunk: int | None = None) -> DataFrame:
    """T2 exponential moving average seeded with the mean of the first n bars, null before the n-th."""
    rows = bars.select("symbol", "ts", "seq", F.col(column).alias("_v"))
    return scan(rows, {"ema": ema_lane(F.col("_v"), n)}, chunk=chunk).select("symbol", "ts", "seq", warm("ema", n - 1).alias("ema"))


def rsi(bars: DataFrame, n: int = 14, chunk: int | None = None) -> DataFrame:
    """T3 relative strength index with Wilder's smoothing, from change n + 1 on."""
    rows = changes(bars).select("symbol", "ts", "seq", "_gain", "_loss")
    x = scan(rows, {"g": wilder_lane(F.col("_gain"), n, n), "l": wilder_lane(F.col("_loss"), n, n)}, chunk=chunk)
    return x.select("symbol", "ts", "seq", F.when(F.col("seq") > n, rsi_value(F.col("g"), F.col("l"))).alias("rsi"))


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, chunk: int | None = None) -> DataFrame:
    """T4 MACD line, its signal and histogram, the averages aligned by bar."""
    x = scan(bars.select("symbol", "ts", "seq", "close"), {"f": ema_lane(F.col("close"), fast), "s": ema_lane(F.col("close"), slow)}, chunk=chunk)
    first = max(fast, slow) - 1
    x = x.select("symbol", "ts", "seq", F.when(F.col("seq") >= first, F.col("f") - F.col("s")).alias("line"))
    x = scan(x, {"signal": ema_lane(F.col("line"), signal, first + signal - 1)}, chunk=chunk)
    return x.select("symbol", "ts", "seq", "line", warm("signal", first + signal - 1).alias("signal")).withColumn("histogram", F.col("line") - F.col("signal"))


def atr(bars: DataFrame, n: int = 14, chunk: int | None = None) -> DataFrame:
    """T7 average true range by Wilder, seeded with the mean of the first n ranges."""
    rows = changes(bars).select("symbol", "ts", "seq", "_range")
    return scan(rows, {"atr": wilder_lane(F.col("_range"), n, n)}, chunk=chunk).select("symbol", "ts", "seq", warm("atr", n).alias("atr"))


def keltner(bars: DataFrame, n: int = 20, atr_n: int = 10, times: float = 2.0, chunk: int | None = None) -> DataFrame:
    """T15 Keltner channels: an exponential average with `times` average true ranges of the same bar on either side."""
    rows = changes(bars).select("symbol", "ts", "seq", "close", "_range")
    x = scan(rows, {"e": ema_lane(F.col("close"), n), "r": wilder_lane(F.col("_range"), atr_n, atr_n)}, chunk=chunk)
    span = times * warm("r", atr_n)
    return x.select("symbol", "ts", "seq", (warm("e", n - 1) - span).alias("lower"), warm("e", n - 1).alias("middle"), (warm("e", n - 1) + span).alias("upper"))


def _sum_lane(value: Column, n: int) -> tuple[float, Column]:
    """Wilder's sum: that of the first n values holds one update at once."""
    earlier = F.sum(value).over(by_symbol().rowsBetween(-n, -1))
    return smoothed(n * value, n, n + 1, 1 - 1 / n, earlier * (1 - 1 / n) + value)


def _directional(n: int) -> Lanes:
    return {"_sp": _sum_lane(F.col("_up"), n), "_sm": _sum_lane(F.col("_down"), n), "_sr": _sum_lane(F.col("_range"), n)}


def _lines(n: int) -> dict[str, Column]:
    """+DI, -DI and their index from the sums, null before place n + 1."""
    part = lambda c: F.when(F.col("seq") > n, F.when(F.col("_sr") > 0, 100 * F.col(c) / F.col("_sr")).otherwise(0.0))
    plus, minus = part("_sp"), part("_sm")
    return {"plus_di": plus, "minus_di": minus, "_dx": F.when(plus + minus > 0, 100 * F.abs(plus - minus) / (plus + minus)).otherwise(0.0)}


def adx(bars: DataFrame, n: int = 14, chunk: int | None = None) -> DataFrame:
    """T11 directional indicators and the index of their difference."""
    x = scan(changes(bars).select("symbol", "ts", "seq", "_up", "_down", "_range"), _directional(n), chunk=chunk)
    x = x.select("symbol", "ts", "seq", *[c.alias(k) for k, c in _lines(n).items()])
    return scan(x, {"adx": wilder_lane(F.col("_dx"), n, 2 * n)}, chunk=chunk).select("symbol", "ts", "seq", "plus_di", "minus_di", warm("adx", 2 * n).alias("adx"))


def indicators(bars: DataFrame, chunk: int | None = None) -> DataFrame:
    """The bars with all recursive indicators at their usual periods, by two scans."""
    close, r = F.col("close"), F.col("_range")
    lanes = {"ema12": ema_lane(close, 12), "ema26": ema_lane(close, 26), "ema20": ema_lane(close, 20), "_g": wilder_lane(F.col("_gain"), 14, 14), "_l": wilder_lane(F.col("_loss"), 14, 14)}
    lanes |= {"atr14": wilder_lane(r, 14, 14), "atr10": wilder_lane(r, 10, 10)} | _directional(14)
    own = ["symbol", "ts", "seq", "open", "high", "low", "close", "volume"]
    x = scan(changes(bars.select(own)), lanes, chunk=chunk)
    # what a lane holds of the first bars is no value
    x = x.select(*own, "ema12", "ema26", "ema20", "_g", "_l", "atr14", "atr10", (F.col("ema12") - F.col("ema26")).alias("_line"), *[c.alias(k) for k, c in _lines(14).items()])
    x = scan(x, {"signal": ema_lane(F.col("_line"), 9, 33), "adx": wilder_lane(F.col("_dx"), 14, 28)}, chunk=chunk)
    starts = {"ema12": 11, "ema26": 25, "ema20": 19, "signal": 33, "atr14": 14, "atr10": 10}
    out = x.withColumns({n: warm(n, k) for n, k in starts.items()} | {"rsi": F.when(F.col("seq") > 14, rsi_value(F.col("_g"), F.col("_l"))), "adx": warm("adx", 28)})
    return out.select(*own, "ema12", "ema26", "ema20", "signal", "rsi", "atr14", "atr10", "plus_di", "minus_di", "adx")


def garch(bars: DataFrame, omega: float = 1e-5, alpha: float = 0.1, beta: float = 0.85, chunk: int = 1024) -> DataFrame:
    """R13 GARCH(1,1) with fixed parameters, started at the mean square of all returns: annual volatility in percent
    that is forecast after the last return. Chunks give their weighted sums, of which a symbol adds up one each."""
    rows = bars.select("symbol", "seq", (F.col("close") / F.lag("close").over(by_symbol()) - 1).alias("_r")).where("_r is not null")
    at = F.col("seq") - 1  # the first return's place is 0
    own = F.floor(at / chunk)
    weight = F.pow(F.lit(beta), chunk - 1 - at % chunk)  # as if every chunk were full
    chunks = rows.groupBy("symbol", own.alias("_chunk")).agg(
        F.sum((omega + alpha * F.col("_r") * F.col("_r")) * weight).alias("_c"), F.sum(F.col("_r") * F.col("_r")).alias("_s"), F.count("*").alias("_n"), F.max_by("_r", "seq").alias("_last")
    )
    of = Window.partitionBy("symbol")
    chunks = chunks.withColumns({"_rows": F.sum("_n").over(of), "_end": F.max("_chunk").over(of)})
    # what a chunk lies before the last return, in steps; the last chunk counts from its own end
    steps = F.col("_rows") - (F.col("_chunk") + 1) * chunk
    x = chunks.groupBy("symbol").agg(
        F.sum(F.col("_c") * F.pow(F.lit(beta), steps)).alias("_v"), (F.sum("_s") / F.sum("_n") * F.pow(F.lit(beta), F.sum("_n"))).alias("_v0"), F.max_by("_last", "_chunk").alias("_r")
    )
    v = omega + alpha * F.col("_r") * F.col("_r") + beta * (F.col("_v") + F.col("_v0"))
    return x.select("symbol", (100 * F.sqrt(252 * v)).alias("forecast"))


def ewma_chart(values: DataFrame, column: str = "value", weight: float = 0.2, width: float = 3.0, chunk: int | None = None) -> DataFrame:
    """C7 exponentially weighted control chart about the series' mean, with limits that widen to their asymptote."""
    rows = values.select("symbol", "ts", F.col(column).alias("_v"))
    of = Window.partitionBy("symbol")
    rows = rows.withColumns({"seq": (F.row_number().over(of.orderBy("ts")) - 1).cast("int"), "_mean": F.avg("_v").over(of), "_sd": F.coalesce(F.stddev_samp("_v").over(of), F.lit(0.0))})
    b = weight * F.col("_v") + F.when(F.col("seq") == 0, (1 - weight) * F.col("_mean")).otherwise(0.0)
    x = scan(rows, {"ewma": (1 - weight, b)}, chunk=chunk)
    half = width * F.col("_sd") * F.sqrt(weight / (2 - weight) * (1 - F.pow(F.lit(1 - weight), 2 * (F.col("seq") + 1))))
    return x.select("symbol", "ts", "ewma", (F.col("_mean") - half).alias("low"), (F.col("_mean") + half).alias("high"))
