"""Fitted and random operators: calibration curves and models with Spark ML, bootstrap and Thompson draws by hash."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Bucketizer, HashingTF, Tokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store


def bootstrap(values: DataFrame, samples: int = 200, seed: int = 7) -> DataFrame:
    """K13 intervals of 95 % of the Sharpe ratio, win rate and profit factor of each key's values.

    A Poisson bootstrap: in every sample each row counts as often as a Poisson variable of mean 1 says, drawn from a
    hash of the sample and the row, so that no row is looked up by place and reruns agree. The sums of a sample are
    added up where the rows are; only one row per key and sample is shuffled.
    """
    row = F.xxhash64(*[c for c in values.columns])
    draw = values.select("key", "value", row.alias("row")).withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    u = F.pmod(F.xxhash64("row", "sample", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    edges = np.cumsum([np.exp(-1) / np.prod(range(1, k + 1)) for k in range(9)])
    count = sum((u >= float(e)).cast("int") for e in edges)
    w = draw.withColumn("n", count).where("n > 0")
    sums = w.groupBy("key", "sample").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("value")).alias("s"), F.sum(F.col("n") * F.col("value") * F.col("value")).alias("q"),
        F.sum(F.when(F.col("value") > 0, F.col("n")).otherwise(0)).alias("wins"),
        F.sum(F.when(F.col("value") > 0, F.col("n") * F.col("value")).otherwise(0.0)).alias("won"), F.sum(F.when(F.col("value") < 0, -F.col("n") * F.col("value")).otherwise(0.0)).alias("lost"),
    )
    mean = F.col("s") / F.col("n")
    each = sums.select("key", (mean / F.sqrt(F.col("q") / F.col("n") - mean * mean)).alias("sharpe"), (F.col("wins") / F.col("n")).alias("win_rate"), F.try_divide("won", "lost").alias("profit_factor"))
    bounds = [F.percentile(c, F.lit(p)).alias(f"{c}_{name}") for c in ("sharpe", "win_rate", "profit_factor") for name, p in (("low", 0.025), ("high", 0.975))]
    return each.groupBy("key").agg(*bounds)


def platt(predictions: DataFrame) -> DataFrame:
    """C2 Platt scaling: slope and intercept of a logistic regression of the outcome on the confidence's logit."""
    p = F.greatest(F.least(F.col("confidence"), F.lit(0.99)), F.lit(0.01))
    rows = predictions.where("outcome is not null").select(F.log(p / (1 - p)).alias("logit"), F.col("outcome").cast("double").alias("label"))
    if rows.isEmpty():
        return predictions.sparkSession.createDataFrame([], "slope double, intercept double")
    model = LogisticRegression().fit(VectorAssembler(inputCols=["logit"], outputCol="features").transform(rows))
    return predictions.sparkSession.createDataFrame([(round(float(model.coefficients[0]), 6), round(float(model.intercept), 6))], "slope double, intercept double")


def isotonic(predictions: DataFrame) -> DataFrame:
    """C3 each prediction's confidence and its value on the isotonic curve of outcomes."""
    rows = predictions.where("outcome is not null").select("id", "source", "confidence", F.col("outcome").cast("double").alias("label"))
    model = IsotonicRegression(featuresCol="confidence", predictionCol="calibrated").fit(rows)
    return model.transform(rows).select("id", "source", "confidence", F.round("calibrated", 6).alias("calibrated"))


def thompson(trades: DataFrame, seed: int = 7) -> DataFrame:
    """C13 a draw from the beta posterior of each symbol's wins, and the pick: the largest draw. Draws depend on the seed and the symbol."""
    counts = trades.groupBy("symbol").agg(F.count_if(F.col("pnl") > 0).alias("wins"), F.count_if(F.col("pnl") <= 0).alias("losses"))

    @F.pandas_udf("double")
    def beta(symbol: pd.Series, wins: pd.Series, losses: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, int(s)]).beta(1 + a, 1 + b) for s, a, b in zip(symbol, wins, losses)])

    drawn = counts.withColumn("draw", beta("symbol", "wins", "losses"))
    best = drawn.agg(F.max_by("symbol", F.struct("draw", "symbol")).alias("best"))  # one row
    return drawn.crossJoin(F.broadcast(best)).select("symbol", "wins", "losses", "draw", (F.col("symbol") == F.col("best")).alias("picked"))


def _key(x):
    """A whole number that keeps the order of x, by steps of a thousandth of it; what is missing comes first."""
    size = F.floor(F.log1p(F.least(F.abs(x), F.lit(1e300)) * float(1 << 20)) * 1024.0).cast("int")
    return F.coalesce(F.when(x.isNotNull() & ~F.isnan(x), F.when(x < 0, -size).otherwise(size)), F.lit(-(1 << 30)))


def _cuts(keys: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Sorted keys behind which a bin ends: every key, or else those at which the shares of rows are nearest to k / bins."""
    if len(keys) <= bins:
        return keys[:-1]
    sums = counts.cumsum()
    want = sums[-1] * np.arange(1, bins) / bins
    after = np.searchsorted(sums, want)
    before = np.maximum(after - 1, 0)
    return np.setdiff1d(keys[np.where(want - sums[before] < sums[after] - want, before, after)], keys[-1:])


def _binned(rows: DataFrame, names: list[str], bins: int) -> DataFrame:
    """Rows with their cell: the bins of the named keys, equal shares of the rows to learn from, as the digits of one number."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("k")) for i, c in enumerate(names)])).alias("x")
    counts = rows.where("learn").select(each).groupBy("x.i", "x.k").count().toPandas().sort_values("k")  # steps of keys, not rows
    bounds = []
    for i in range(len(names)):
        own = counts[counts["i"] == i]
        cuts = _cuts(own["k"].to_numpy(), own["count"].to_numpy(), bins)
        bounds.append([-np.inf, *(cuts + 0.5 if len(cuts) else [0.5]), np.inf])
    put = Bucketizer(splitsArray=bounds, inputCols=names, outputCols=[f"_{c}" for c in names])
    cell = sum(F.col(f"_{c}") * float(bins ** (len(names) - 1 - i)) for i, c in enumerate(names))
    return put.transform(rows).withColumn("cell", cell.cast("int"))


def boosted(cells: DataFrame, names: list[str], bins: int, trees: int) -> DataFrame:
    """(cell, probability) of every cell there can be, by boosted trees fitted on (cell, label, weight)."""
    digits = {c: (F.col("cell") / float(bins ** (len(names) - 1 - i))).cast("int") % bins for i, c in enumerate(names)}
    at = lambda df: VectorAssembler(inputCols=names, outputCol="features").transform(df.withColumns(digits))
    most = int(np.ceil(np.sqrt(2 * bins ** len(names))))  # with so many bins Spark looks for cuts in all rows, not in a sample of them
    model = GBTClassifier(maxIter=trees, maxDepth=4, seed=7, maxBins=max(bins, most), weightCol="weight").fit(at(cells))
    grid = cells.sparkSession.range(0, bins ** len(names), 1, 1).select(F.col("id").cast("int").alias("cell"))
    return model.transform(at(grid)).select("cell", F.round(vector_to_array("probability")[1], 6).alias("probability"))


def direction_model(bars: DataFrame, trees: int = 10, forward: int = 5) -> DataFrame:
    """M8 boosted trees that tell whether a symbol's close rises over the next bars, fitted on the first 80 % of each
    series: probability and label of every later row.

    Trees only ask for the bin of a feature. So they are fitted on how many rows of each label all cells of bins have, at most 65,536 counts
    for a table of any length. The bars are made once; what is asked of them later is stored.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    mean = lambda c, n: F.avg(c).over(w.rowsBetween(1 - n, 0))
    names, bins, spark = ["a", "b", "c"], 32, bars.sparkSession
    x = bars.select(
        "symbol", "ts", "seq", F.count("*").over(Window.partitionBy("symbol")).alias("n"), (F.lead("close", forward).over(w) > F.col("close")).cast("double").alias("label"),
        (F.col("close") / mean("close", 20) - 1).alias("a"), (F.col("close") / F.lag("close", 5).over(w) - 1).alias("b"), (F.col("volume") / mean("volume", 20)).alias("c"),
    ).where("label is not null and seq >= 20")
    learn = F.expr("seq < 0.8 * n")
    later = [F.when(~learn, F.col(c)).alias(c) for c in ("symbol", "ts")]
    path = store.scratch(spark, "direction")
    x.select(learn.alias("learn"), *later, F.col("label").cast("int").alias("label"), *[_key(F.col(c)).alias(c) for c in names]).write.parquet(path)
    rows = _binned(spark.read.parquet(path), names, bins)
    cells = rows.where("learn").groupBy("cell", F.col("label").cast("double").alias("label")).agg(F.count("*").cast("double").alias("weight")).toArrow()
    if not cells.num_rows:
        return rows.select("symbol", "ts", "label", F.lit(0.0).alias("probability")).limit(0)
    known = spark.createDataFrame(cells.sort_by([("cell", "ascending"), ("label", "ascending")])).coalesce(1)
    scored = rows.where("not learn").join(F.broadcast(boosted(known, names, bins, trees)), "cell")
    return scored.select("symbol", "ts", "label", "probability")


def text_model(documents: DataFrame, labels: DataFrame, features: int = 4096) -> DataFrame:
    """N13 a logistic model of hashed words, fitted on the labelled texts whose hash is not 0 modulo 5: probability and
    sentiment score from -100 to 100 of every text."""
    words = Tokenizer(inputCol="text", outputCol="words").transform(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    x = HashingTF(inputCol="words", outputCol="features", numFeatures=features, binary=True).transform(words).select("doc_id", "features")
    y = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    learn = x.join(y, "doc_id").where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) != 0)
    model = LogisticRegression(regParam=0.01, maxIter=30).fit(learn)
    p = vector_to_array("probability")[1]
    return model.transform(x).select("doc_id", F.round(p, 6).alias("probability"), F.round(200 * p - 100, 3).alias("score"))
