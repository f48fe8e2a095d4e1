"""Reviews of series: alignment of timeframes, correlations with benchmarks, the deepest drawdowns, and taxes of a year by jurisdiction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAINS = ("day", "week", "month")
# fixed values: jurisdiction, days from which a lot is long-term, short and long rate, most losses that a year deducts (null: no limit)
TAXES = (("US", 365, 0.37, 0.20, 3000.0), ("UK", 0, 0.20, 0.20, None), ("Canada", 0, 0.25, 0.25, None), ("Australia", 365, 0.45, 0.225, None), ("Germany", 0, 0.26375, 0.26375, None))


def alignment(bars: DataFrame, grains: tuple[str, ...] = GRAINS) -> DataFrame:
    """G5 (symbol, grains, rising, alignment, trend, signal, confidence, best_grain) of bars (symbol, ts, close): a grain rises if its last mean of 10 closes
    is above that of 20; grains of fewer than 20 bars do not count. The trend is buy above 60 % of rising grains and sell below 40 %; the
    signal follows it if the first grain agrees, with .7 + .3 x alignment, is neutral with .3 against it and with .5 without a trend.
    The best grain has the widest gap of both means beside its close; of equals the first, none if no gap is above 0."""
    each = bars.select("symbol", "ts", "close", F.explode(F.array(*[F.struct(F.lit(i).alias("g"), F.date_trunc(g, "ts").alias("bar")) for i, g in enumerate(grains)])).alias("x"))
    closes = each.groupBy("symbol", "x.g", "x.bar").agg(F.max_by("close", "ts").alias("close"))
    back = Window.partitionBy("symbol", "g").orderBy(F.desc("bar"))
    last = closes.withColumn("k", F.row_number().over(back)).where("k <= 20").groupBy("symbol", "g").agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("k") <= 10, F.col("close"))).alias("a"), F.avg("close").alias("b"), F.max(F.when(F.col("k") == 1, F.col("close"))).alias("now")
    )
    full = F.col("n") == 20
    gap = F.when(full, F.abs(F.try_divide(F.col("a") - F.col("b"), "now")))
    s = last.groupBy("symbol").agg(
        F.count_if(full).alias("grains"), F.count_if(full & (F.col("a") > F.col("b"))).alias("rising"), F.coalesce(F.max(F.when(F.col("g") == 0, full & (F.col("a") > F.col("b")))), F.lit(False)).alias("first"),
        F.max(F.when(gap > 0, F.struct(gap.alias("gap"), (-F.col("g")).alias("g")))).alias("best"),
    )
    share = F.try_divide("rising", "grains")
    trend = F.when(share > 0.6, "buy").when(share < 0.4, "sell").otherwise("neutral")
    s = s.withColumns({"alignment": F.coalesce(F.abs(share - 0.5) * 2, F.lit(0.0)), "trend": trend})
    follows = ((F.col("trend") == "buy") & F.col("first")) | ((F.col("trend") == "sell") & ~F.col("first"))
    sure = F.when(F.col("trend") == "neutral", 0.5).when(follows, 0.7 + F.col("alignment") * 0.3).otherwise(0.3)
    name = F.when(F.col("best").isNotNull(), F.element_at(F.array(*[F.lit(g) for g in grains]), (1 - F.col("best.g")).cast("int")))
    return s.select("symbol", "grains", "rising", "alignment", "trend", F.when(follows, F.col("trend")).otherwise("neutral").alias("signal"), sure.alias("confidence"), name.alias("best_grain"))


def _beside(returns: DataFrame, benchmarks: DataFrame) -> DataFrame:
    return returns.select("symbol", "ts", "r").join(benchmarks.select("benchmark", "ts", F.col("r").alias("b")).hint("shuffle_hash"), "ts").where("r is not null and b is not null")


def _corr(over=None) -> Column:
    """Pearson's, null where a side is flat, which corr takes for an error."""
    sums = [f if over is None else f.over(over) for f in (F.covar_pop("r", "b"), F.stddev_pop("r"), F.stddev_pop("b"))]
    return F.try_divide(sums[0], sums[1] * sums[2])


def diversification(returns: DataFrame, benchmarks: DataFrame, days: int = 90) -> DataFrame:
    """R26 (symbol, benchmarks, highest, highest_correlation, lowest, lowest_correlation, diversification) of returns (symbol, ts, r) and benchmarks (benchmark,
    ts, r): correlations over days that both have, from `days` before the symbol's last one on, to three digits. Highest and lowest go by size
    without sign (ties: the benchmark's name); the score is 100 x (1 - the mean size). Benchmarks without a correlation do not count; without any
    the score is 50 and the rest null."""
    x = _beside(returns, benchmarks).withColumn("end", F.max("ts").over(Window.partitionBy("symbol")))
    c = x.where(F.datediff("end", "ts") <= days).groupBy("symbol", "benchmark").agg((F.round(_corr(), 3) + 0.0).alias("c"))
    size, ranked = F.abs("c"), F.col("c").isNotNull()
    up, down = F.when(ranked, F.struct(-size, "benchmark")), F.when(ranked, F.struct(size, "benchmark"))
    return c.groupBy("symbol").agg(
        F.count("c").alias("benchmarks"), F.min_by("benchmark", up).alias("highest"), F.min_by("c", up).alias("highest_correlation"), F.min_by("benchmark", down).alias("lowest"), F.min_by("c", down).alias("lowest_correlation"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - F.coalesce(F.avg(size), F.lit(0.5))) * 100)).alias("diversification"),
    )


def rolling_correlation(returns: DataFrame, benchmarks: DataFrame, bars: int = 30) -> DataFrame:
    """R26 (symbol, benchmark, ts, correlation) over the last `bars` common days, from the first whole window on; null where one side is flat."""
    by = Window.partitionBy("symbol", "benchmark").orderBy("ts")
    w = by.rowsBetween(1 - bars, 0)
    x = _beside(returns, benchmarks).withColumns({"correlation": _corr(w), "n": F.count("*").over(w)})
    return x.where(F.col("n") == bars).select("symbol", "benchmark", "ts", "correlation")


def deepest_drawdowns(curve: DataFrame, top: int = 5) -> DataFrame:
    """K3 (symbol, rank, start, trough, recovery, depth, days_down, days_up) of equity curves (symbol, ts, equity): the `top` deepest drawdowns, of
    equals the earlier one. Start is the last day at the peak, trough the first day at the low, recovery the first day back at the peak (null
    while it lasts). Days without equity do not count."""
    by = Window.partitionBy("symbol").orderBy("ts")
    x = curve.where("equity is not null").withColumn("peak", F.max("equity").over(by))
    x = x.withColumn("event", F.sum(F.when(F.col("equity") >= F.col("peak"), 1).otherwise(0)).over(by))
    g = x.groupBy("symbol", "event").agg(F.min("ts").alias("start"), F.max("peak").alias("peak"), F.min("equity").alias("low"), F.min_by("ts", F.struct("equity", "ts")).alias("trough"))
    g = g.withColumn("recovery", F.lead("start").over(Window.partitionBy("symbol").orderBy("event"))).where("low < peak")
    g = g.withColumn("depth", F.try_divide(F.col("peak") - F.col("low"), "peak") * 100)
    g = g.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("depth"), "start"))).where(F.col("rank") <= top)
    return g.select("symbol", "rank", "start", "trough", "recovery", "depth", F.datediff("trough", "start").alias("days_down"), F.datediff("recovery", "trough").alias("days_up"))


def year_end(lots: DataFrame, rules: tuple = TAXES) -> DataFrame:
    """X7 (symbol, tax_year, jurisdiction, four sums of gains and losses, net, tax, carried) of closed lots (symbol, entry_date, exit_date,
    proceeds, basis, adjustment): the adjustment of a wash sale, 0 where null, raises the basis. A net gain pays on each side that is above 0; a
    net loss saves the short rate of what the limit lets through, as a negative tax, and what is above the limit is carried on. Lots without a sale or
    basis do not count. Lots are summed up by the classes of their days first, so that rules meet sums only."""
    bounds = sorted({r[1] for r in rules})
    days = F.datediff("exit_date", "entry_date")
    held = F.lit(0)
    for b in bounds:
        held = held + F.when(days >= b, 1).otherwise(0)
    gain = F.col("proceeds") - F.col("basis") - F.coalesce("adjustment", F.lit(0.0))
    sums = (
        lots.select("symbol", F.year("exit_date").alias("tax_year"), held.alias("held"), gain.alias("gain")).where("tax_year is not null and gain is not null")
        .groupBy("symbol", "tax_year", "held").agg(F.sum(F.greatest("gain", F.lit(0.0))).alias("gains"), F.sum(F.greatest(-F.col("gain"), F.lit(0.0))).alias("losses"))
    )
    rule = F.array(*[F.struct(F.lit(j).alias("jurisdiction"), F.lit(bounds.index(d) + 1).alias("from"), F.lit(s).alias("short"), F.lit(g).alias("long"), F.lit(m).cast("double").alias("most")) for j, d, s, g, m in rules])
    x = sums.withColumn("x", F.explode(rule)).select("*", "x.*")
    far = F.col("held") >= F.col("from")

    def total(column: str, side: Column, name: str) -> Column:
        return F.sum(F.when(side, F.col(column)).otherwise(0.0)).alias(name)

    y = x.groupBy("symbol", "tax_year", "jurisdiction").agg(
        total("gains", ~far, "short_gains"), total("losses", ~far, "short_losses"), total("gains", far, "long_gains"), total("losses", far, "long_losses"), F.max("short").alias("short"), F.max("long").alias("long"), F.max("most").alias("most")
    )
    short, long = F.col("short_gains") - F.col("short_losses"), F.col("long_gains") - F.col("long_losses")
    lost = F.greatest(-(short + long), F.lit(0.0))
    tax = F.when(short + long >= 0, F.greatest(short, F.lit(0.0)) * F.col("short") + F.greatest(long, F.lit(0.0)) * F.col("long")).otherwise(-F.least(lost, F.coalesce("most", lost)) * F.col("short"))
    return y.select("symbol", "tax_year", "jurisdiction", "short_gains", "short_losses", "long_gains", "long_losses", (short + long).alias("net"), tax.alias("tax"), F.greatest(lost - F.coalesce("most", lost), F.lit(0.0)).alias("carried"))
