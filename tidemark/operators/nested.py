"""Reports from and to nested JSON: arrays of names by outcome, snapshots of a day, tear sheets as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The document of a tear sheet.
TEAR_SHEET = """strategy string, summary struct<trades: bigint, pnl: double, win_rate: double, profit_factor: double>,
    extremes struct<best: double, worst: double>, months array<struct<month: string, trades: bigint, pnl: double>>"""


def names(column: str) -> Column:
    """The names of a JSON array of texts such as "flow (+3)", without what follows the bracket; null where the text is no array."""
    return F.transform(F.from_json(column, "array<string>"), lambda a: F.trim(F.substring_index(a, "(", 1)))


def adjustment_outcomes(contexts: DataFrame) -> DataFrame:
    """D3 (adjustment, total, wins, win_rate) from (outcome, signal_adjustments): every name of an array counts, repeats too. Rows that
    are pending or rejected, or whose text is null or no JSON array, have none."""
    done = contexts.where("outcome is not null and outcome <> 'rejected'")
    every = done.select("outcome", F.explode(names("signal_adjustments")).alias("adjustment")).where("adjustment is not null")
    counted = every.groupBy("adjustment").agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "win").alias("wins"))
    return counted.withColumn("win_rate", F.col("wins") / F.col("total"))


def _counts(rows: DataFrame, name: str) -> DataFrame:
    """(day, name): a JSON object of counts, its keys in order. Rows are counted before they are put together."""
    each = rows.groupBy("day", "key").agg(F.count("*").alias("n"))
    return each.groupBy("day").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n"))))).alias(name))


def daily_snapshot(contexts: DataFrame) -> DataFrame:
    """D7 a row a day from (day, symbol, pnl, outcome, tier, signal_adjustments): the best and the worst finished trade, and how often
    each tier (unknown where null) and each adjustment came, as JSON objects. Ties: best to the larger symbol, worst to the smaller."""
    done = F.col("outcome").isNotNull() & (F.col("outcome") != "rejected")
    trade = F.when(done & F.col("pnl").isNotNull(), F.struct("pnl", "symbol"))
    days = contexts.groupBy("day").agg(F.max(trade).alias("best"), F.min(trade).alias("worst"), F.count("*").alias("signals"))
    tiers = _counts(contexts.select("day", F.coalesce("tier", F.lit("UNKNOWN")).alias("key")), "tiers")
    used = _counts(contexts.select("day", F.explode(names("signal_adjustments")).alias("key")).where("key is not null"), "adjustments")
    best = [F.col(f"{end}.{c}").alias(f"{end}_{c}") for end in ("best", "worst") for c in ("symbol", "pnl")]
    return days.join(tiers.hint("merge"), "day", "left").join(used.hint("merge"), "day", "left").select("day", "signals", *best, "tiers", "adjustments")


def tear_sheets(deals: DataFrame) -> DataFrame:
    """K21 (strategy, document): the tear sheet of each strategy as one JSON document of nested parts, from (strategy, exit_date, pnl).
    Months are summed up first, so that a strategy's group holds its months only."""
    month = F.date_format("exit_date", "yyyy-MM").alias("month")
    gains, losses = F.sum(F.greatest("pnl", F.lit(0.0))), F.sum(F.greatest(-F.col("pnl"), F.lit(0.0)))
    months = deals.groupBy("strategy", month).agg(
        F.count("*").alias("trades"), F.sum("pnl").alias("pnl"), F.count_if(F.col("pnl") > 0).alias("wins"),
        gains.alias("gains"), losses.alias("losses"), F.max("pnl").alias("best"), F.min("pnl").alias("worst"),
    )
    whole = months.groupBy("strategy").agg(
        F.struct(
            F.sum("trades").alias("trades"), F.sum("pnl").alias("pnl"), (F.sum("wins") / F.sum("trades")).alias("win_rate"),
            F.try_divide(F.sum("gains"), F.sum("losses")).alias("profit_factor"),
        ).alias("summary"),
        F.struct(F.max("best").alias("best"), F.min("worst").alias("worst")).alias("extremes"),
        F.array_sort(F.collect_list(F.struct("month", "trades", "pnl"))).alias("months"),
    )
    return whole.select("strategy", F.to_json(F.struct("strategy", "summary", "extremes", "months")).alias("document"))


def read_tear_sheets(documents: DataFrame) -> DataFrame:
    """A row for each month of each document, beside the summary."""
    x = documents.select(F.from_json("document", TEAR_SHEET).alias("x")).select("x.strategy", "x.summary", "x.extremes", F.explode("x.months").alias("m"))
    return x.select("strategy", "summary.*", "extremes.*", F.col("m.month").alias("month"), F.col("m.trades").alias("month_trades"), F.col("m.pnl").alias("month_pnl"))
