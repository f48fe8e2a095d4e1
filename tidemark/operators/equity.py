"""Reports over daily equity whose sums do not depend on the order in which rows meet.

Profits have four decimals and equity is rounded to three, so that the last bit of a sum decides ties. Here sums of doubles are exact
but for their last rounding: each value is cut at a multiple of 2^-20, and neither part's sum loses a bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID = float(1 << 20)
START = 100_000.0


def rounded(x: Column, digits: int) -> Column:
    """x times a power of ten, to the nearest whole number, halves away from zero, and back: arithmetic of doubles as the SQL has it,
    where Spark's round goes by the shortest decimal that reads as x. What is under zero stays under zero, as -0.0."""
    y = x * 10.0**digits
    near = F.rint(y)
    return F.when((y > 0) & (y - near == 0.5), near + 1).when((y < 0) & (y - near == -0.5), near - 1).otherwise(near) / 10.0**digits


def daily_equity(trades: DataFrame) -> DataFrame:
    """(symbol, ts, equity) at the end of every day with a trade."""
    coarse = F.rint(F.col("pnl") * GRID) / GRID
    days = trades.select("symbol", "ts", coarse.alias("coarse"), (F.col("pnl") - coarse).alias("fine")).groupBy("symbol", "ts").agg(F.sum("coarse").alias("coarse"), F.sum("fine").alias("fine"))
    by = Window.partitionBy("symbol").orderBy("ts")
    return days.select("symbol", "ts", rounded(START + (F.sum("coarse").over(by) + F.sum("fine").over(by)), 3).alias("equity"))


def drawdown_events(trades: DataFrame) -> DataFrame:
    """K3 drawdowns of each equity curve: peak, last day, depth and length."""
    by = Window.partitionBy("symbol").orderBy("ts")
    high = daily_equity(trades).withColumn("top", F.max("equity").over(by))
    islands = high.withColumn("island", F.count_if(F.col("equity") >= F.col("top")).over(by))
    events = islands.groupBy("symbol", "island").agg(F.min("ts").alias("peak"), F.max("ts").alias("last_ts"), F.max(1 - F.col("equity") / F.col("top")).alias("depth"), F.count("*").alias("bars"))
    return events.where(F.col("depth") > 0.000001).select("symbol", "peak", "last_ts", rounded(F.col("depth"), 6).alias("depth"), "bars")


def monthly_returns(trades: DataFrame) -> DataFrame:
    """R25, K4 return of each month from its last equity to the one before."""
    months = daily_equity(trades).groupBy("symbol", F.date_trunc("month", "ts").alias("at")).agg(F.max_by("equity", "ts").alias("equity"))
    before = F.lag("equity").over(Window.partitionBy("symbol").orderBy("at"))
    change = F.col("equity") / F.coalesce(before, F.lit(START)) - 1
    return months.select("symbol", (F.year("at") * 100 + F.month("at")).cast("int").alias("month"), rounded(change, 5).alias("month_return"))
