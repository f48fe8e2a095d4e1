"""Live bars and sessions with Structured Streaming; event time in `ts`, late rows dropped past the watermark."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..sources import quarantine


def tumbling_bars(ticks: DataFrame, grain: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """W1, S1 bars per symbol and window from (symbol, ts, price, size); stream or batch."""
    order = F.struct("ts", "price", "size")
    return (
        ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", grain).alias("w"))
        .agg(
            F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", order).alias("close"), F.sum("size").alias("volume"),
            (F.sum(F.col("price") * F.col("size")) / F.sum("size")).alias("vwap"),
        )
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "vwap")
    )


def sliding_volume(ticks: DataFrame, window: str = "1 day", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """W2 volume and deviation of the price over sliding windows."""
    w = F.window("ts", window, step).alias("w")
    out = ticks.withWatermark("ts", late).groupBy("symbol", w).agg(F.sum("size").alias("volume"), F.stddev_samp("price").alias("deviation"), F.count("*").alias("ticks"))
    return out.select("symbol", F.col("w.start").alias("ts"), "volume", "deviation", "ticks")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """W3 sessions of each user, closed by a gap."""
    out = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def once(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """W7 the first of the rows that repeat a key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def feed(lines: DataFrame, column: str = "value") -> DataFrame:
    """S11 trades (T) and quotes (Q) of a live feed from lines of JSON; what quarantine.judge_feed refuses is left out."""
    return quarantine.accepted(quarantine.judge_feed(lines, column)).select("kind", "symbol", "ts", "price", "size")


def latest_quotes(quotes: DataFrame) -> DataFrame:
    """W4 the last price of each symbol; update or complete mode."""
    return quotes.groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("price", F.struct("ts", "price")).alias("price"))


def strategy_statistics(outcomes: DataFrame) -> DataFrame:
    """W6 running wins, losses, profit and profit factor of each strategy; update or complete mode."""
    won, lost = F.sum(F.greatest("pnl", F.lit(0.0))), F.sum(F.greatest(-F.col("pnl"), F.lit(0.0)))
    return outcomes.groupBy("strategy").agg(F.count_if(F.col("pnl") > 0).alias("wins"), F.count_if(F.col("pnl") < 0).alias("losses"), F.sum("pnl").alias("pnl"), F.try_divide(won, lost).alias("profit_factor"))


def news_before_moves(quotes: DataFrame, news: DataFrame, hours: int = 6, late: str = "1 hour") -> DataFrame:
    """W8 quotes (symbol, ts, change) beside the news (symbol, published, id) of the hours before them."""
    q, n = quotes.withWatermark("ts", late).alias("q"), news.withWatermark("published", late).alias("n")
    near = F.expr(f"q.symbol = n.symbol and published <= ts and published >= ts - interval {hours} hours")
    return q.join(n, near).select("q.symbol", "ts", "change", "published", "id")


def stops(prices: DataFrame, trail: float = 0.1) -> DataFrame:
    """W5 each symbol's highest price so far, its trailing stop and whether the price has fallen below it: one row per
    symbol and batch, from state that holds two numbers a symbol."""

    def step(key, frames, state):
        high, hit = state.get if state.exists else (0.0, False)
        for frame in frames:
            for price in frame.sort_values("ts")["price"]:
                high = max(high, price)
                hit = hit or price < high * (1 - trail)
        state.update((high, hit))
        yield pd.DataFrame({"symbol": [key[0]], "high": [high], "stop": [high * (1 - trail)], "hit": [hit]})

    return prices.groupBy("symbol").applyInPandasWithState(step, "symbol string, high double, stop double, hit boolean", "high double, hit boolean", "update", GroupStateTimeout.NoTimeout)


def alerts(stream: DataFrame, path: str, checkpoint: str, threshold: float):
    """W9 rows above the threshold, appended to a table; a batch that is run again writes its own folder anew."""

    def put(batch: DataFrame, number: int) -> None:
        batch.where(F.col("value") > threshold).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
