"""All structural breaks of a series, and windows of a series as arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: F beyond which a split counts as a break.
THRESHOLD = 10.0
#: A step up or down is larger than this.
NEUTRAL = 0.001


def split_strength(values: DataFrame, segment: int = 10) -> DataFrame:
    """(symbol, split, f): how much two means explain over one at every split of (symbol, i, value), i from 0 without holes, that leaves
    `segment` values before it and more behind. f is infinite where the two parts do not vary, null where the whole does not."""
    by, up_to = Window.partitionBy("symbol"), Window.partitionBy("symbol").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    x = values.withColumns({"_n": F.count("*").over(by), "_v": F.col("value") - F.avg("value").over(by)})
    x = x.withColumns({"_a": F.sum("_v").over(up_to), "_q": F.sum(F.col("_v") * F.col("_v")).over(up_to), "_ta": F.sum("_v").over(by), "_tq": F.sum(F.col("_v") * F.col("_v")).over(by)})
    x = x.where((F.col("i") >= segment) & (F.col("i") < F.col("_n") - segment))
    left = F.greatest(F.col("_q") - F.col("_a") ** 2 / F.col("i"), F.lit(0.0))
    right = F.greatest(F.col("_tq") - F.col("_q") - (F.col("_ta") - F.col("_a")) ** 2 / (F.col("_n") - F.col("i")), F.lit(0.0))
    x = x.select("symbol", "i", "_n", (F.col("_tq") - F.col("_ta") ** 2 / F.col("_n")).alias("_whole"), (left + right).alias("_parts"))
    gain = (F.col("_whole") - F.col("_parts")) / 2
    f = F.when(F.col("_parts") > 0, F.try_divide(gain * (F.col("_n") - 4), F.col("_parts"))).when(F.col("_whole") > 0, F.lit(float("inf")))
    return x.select("symbol", F.col("i").alias("split"), F.round(f, 6).alias("f"))


def breaks(values: DataFrame, segment: int = 10) -> DataFrame:
    """C8 (symbol, split): every break of each series: splits with f over the threshold, in order, each at least `segment` behind the one
    before. Splits beside one another become runs first, so that a symbol's fold passes over its runs, not over its rows."""
    strong = split_strength(values, segment).where(F.col("f") > THRESHOLD)
    placed = strong.withColumn("_run", F.col("split") - F.row_number().over(Window.partitionBy("symbol").orderBy("split")))
    runs = placed.groupBy("symbol", "_run").agg(F.min("split").cast("int").alias("low"), F.max("split").cast("int").alias("high"))
    ordered = F.array_sort(F.collect_list(F.struct("low", "high")))

    def step(state, r):
        first = F.greatest(r["low"], state["next"])
        picked = F.when(first <= r["high"], F.sequence(first, r["high"], F.lit(segment))).otherwise(F.array().cast("array<int>"))
        after = F.when(first <= r["high"], F.element_at(picked, -1) + segment).otherwise(state["next"])
        return F.struct(after.alias("next"), F.concat(state["picked"], picked).alias("picked"))

    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("picked"))
    folded = runs.groupBy("symbol").agg(ordered.alias("runs")).select("symbol", F.aggregate("runs", start, step, lambda s: s["picked"]).alias("picked"))
    return folded.select("symbol", F.explode("picked").alias("split"))


def sequences(bars: DataFrame, context: int = 20, horizon: int = 5, stride: int = 1) -> DataFrame:
    """M3 (symbol, ts, context, target, direction): for every `stride`-th bar of a symbol, that bar and those after it as an array of
    `context` bars, the `horizon` closes that follow, and whether each of them is up, down or neutral at .1 % beside the close before it.
    Only full windows; ts is the first bar's. bars have their 0-based place in seq; a null close makes its step neutral."""
    order = Window.partitionBy("symbol").orderBy("seq")
    bar = F.struct("open", "high", "low", "close", "volume")
    closes = F.transform(F.collect_list(F.struct("close")).over(order.rowsBetween(context - 1, context + horizon - 1)), lambda c: c["close"])
    x = bars.select("symbol", "ts", "seq", F.collect_list(bar).over(order.rowsBetween(0, context - 1)).alias("context"), closes.alias("_c"))
    x = x.where((F.col("seq") % stride == 0) & (F.size("_c") == horizon + 1))
    before, target = F.slice("_c", 1, horizon), F.slice("_c", 2, horizon)

    def direction(a, b):
        change = (b - a) / (a + F.lit(1e-8))
        return F.when(change > NEUTRAL, "up").when(change < -NEUTRAL, "down").otherwise("neutral")

    return x.select("symbol", "ts", "context", target.alias("target"), F.zip_with(before, target, direction).alias("direction"))
