"""Opinions of several engines as one signal, at every bar: ensemble, conviction, tradable signals and a gate.

Opinions come as a table (symbol, ts, regime, engine, score, confidence), a row for each engine that has one; scores are whole numbers
from -100 to 100. Opinions of one bar are summed up before they are shuffled, so a symbol with many bars is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: weights of the engines by regime, in percent; `unknown` holds for all other regimes
WEIGHTS = {
    "high_vol_bear": {"technical": 15, "fundamental": 30, "quantitative": 35, "sentiment": 20},
    "high_vol_bull": {"technical": 25, "fundamental": 25, "quantitative": 30, "sentiment": 20},
    "high_vol_sideways": {"technical": 15, "fundamental": 30, "quantitative": 35, "sentiment": 20},
    "low_vol_bull": {"technical": 30, "fundamental": 30, "quantitative": 15, "sentiment": 25},
    "low_vol_bear": {"technical": 20, "fundamental": 40, "quantitative": 20, "sentiment": 20},
    "low_vol_sideways": {"technical": 25, "fundamental": 35, "quantitative": 20, "sentiment": 20},
    "normal_bull": {"technical": 25, "fundamental": 35, "quantitative": 15, "sentiment": 25},
    "normal_bear": {"technical": 20, "fundamental": 35, "quantitative": 25, "sentiment": 20},
    "normal_sideways": {"technical": 20, "fundamental": 40, "quantitative": 15, "sentiment": 25},
    "unknown": {"technical": 20, "fundamental": 40, "quantitative": 15, "sentiment": 25},
}
POINT_IN_TIME = {"unknown": {"technical": 60, "quantitative": 40}}
# fixed values: least score of each label; below the last one it is strong_sell
LABELS = (("strong_buy", 70), ("buy", 30), ("weak_buy", 5), ("neutral", -5), ("weak_sell", -30), ("sell", -70))


def label(score: Column) -> Column:
    """The label of a whole score, null for null."""
    out = F.when(score >= LABELS[0][1], LABELS[0][0])
    for name, least in LABELS[1:]:
        out = out.when(score >= least, name)
    return out.when(score.isNotNull(), "strong_sell")


def _weight(weights: dict[str, dict[str, int]]) -> Column:
    """Of regime and engine; null for engines without one."""
    table = F.create_map(*[F.lit(x) for r, of in weights.items() for e, w in of.items() for x in (f"{r}/{e}", w)])
    known = F.col("regime").isin(*weights)
    regime = F.when(known, F.col("regime")).otherwise("unknown")
    return table[F.concat(regime, F.lit("/"), F.col("engine"))]


def ensemble(opinions: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, learned: str | None = None, conflict: float = 0.30, least: float = 0.05) -> DataFrame:
    """E1, E2 (symbol, ts, regime, engines, score, label, confidence, conviction): the weighted mean score, cut towards zero, and the weighted sum of
    confidences less `conflict` of the scores' spread over 200 where one engine is at 30 or above and another at -30 or below, but `least`.
    `learned` names a column of shares from 0 to 1 that replace the weights where not null. Conviction is HIGH for three engines on
    one side of 20 with a mean confidence above .65, MODERATE for two above .5. Opinions without score or confidence, and of engines
    without a weight, take no part; a bar without any has no row. Of different regimes of one bar the greatest name counts."""
    w = _weight(weights)
    if learned:
        w = F.coalesce((F.col(learned) * 100).cast("int"), w)
    x = opinions.select("symbol", "ts", "regime", F.col("score").cast("int").alias("_s"), F.col("confidence").cast("double").alias("_c"), w.alias("_w"))
    x = x.where("_s is not null and _c is not null and not isnan(_c) and _w is not null")
    g = x.groupBy("symbol", "ts").agg(
        F.max("regime").alias("regime"), F.count("*").alias("engines"), F.sum(F.col("_s") * F.col("_w")).alias("s"), F.sum("_w").alias("w"), F.sum(F.col("_c") * F.col("_w") / 100).alias("c"),
        F.max("_s").alias("high"), F.min("_s").alias("low"), F.avg("_c").alias("mean"), F.greatest(F.count_if(F.col("_s") >= 20), F.count_if(F.col("_s") <= -20)).alias("agree"),
    )
    score = F.when(F.col("w") > 0, (F.col("s") / F.nullif("w", F.lit(0))).cast("int")).otherwise(0)
    penalty = F.when((F.col("high") >= 30) & (F.col("low") <= -30), (F.col("high") - F.col("low")) / 200 * conflict).otherwise(0.0)
    tier = F.when((F.col("agree") >= 3) & (F.col("mean") > 0.65), "HIGH").when((F.col("agree") >= 2) & (F.col("mean") > 0.5), "MODERATE").otherwise("LOW")
    return g.select("symbol", "ts", "regime", "engines", score.alias("score"), label(score).alias("label"), F.greatest(F.col("c") - penalty, F.lit(least)).alias("confidence"), tier.alias("conviction"))


def point_in_time(opinions: DataFrame) -> DataFrame:
    """E16 the ensemble of what bars up to the day tell: technical and quantitative opinions, 60 to 40, without a penalty for conflict."""
    return ensemble(opinions, POINT_IN_TIME, conflict=0.0, least=0.0)


def side(name: str | Column) -> Column:
    """BUY or SELL of a label, null for neutral."""
    c = F.col(name) if isinstance(name, str) else name
    return F.when(c.endswith("buy"), "BUY").when(c.endswith("sell"), "SELL")


def tradable(signals: DataFrame, least: float = 0.5) -> DataFrame:
    """E16 signals that have a side and a confidence of `least` or more, with `side`, the adjusted `confidence` and `adjustments`, the
    names of what moved it, in this order. Any of these columns may be missing or null: smart_money (above .3 +.05, below -.3 -.05), iv_percentile
    (a buy above 80: -.03), put_call_ratio (a buy above 1.5: -.03), gap (up and a buy, down and a sell: +.02). Each step keeps
    within .05 and .98."""
    rows = signals.withColumn("side", side("label")).where((F.col("side").isNotNull()) & (F.col("confidence") >= least))
    buy, has = F.col("side") == "BUY", set(signals.columns)
    steps = [
        ("smart_money", "smart money", F.col("smart_money") > 0.3, 0.05), ("smart_money", "smart money against", F.col("smart_money") < -0.3, -0.05), ("iv_percentile", "high volatility", buy & (F.col("iv_percentile") > 80), -0.03),
        ("put_call_ratio", "high put call ratio", buy & (F.col("put_call_ratio") > 1.5), -0.03), ("gap", "gap", (buy & (F.col("gap") == "up")) | (~buy & (F.col("gap") == "down")), 0.02),
    ]
    confidence, named = F.col("confidence"), []
    for column, name, holds, by in steps:
        if column in has:
            moved = F.least(confidence + by, F.lit(0.98)) if by > 0 else F.greatest(confidence + by, F.lit(0.05))
            confidence = F.when(holds, moved).otherwise(confidence)
            named.append(F.when(holds, name))
    names = F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")
    return rows.withColumns({"adjustments": names, "confidence": confidence})


def _regime(high: float, calm: float, other: float) -> Column:
    r = F.coalesce("regime", F.lit("normal"))
    return F.when(r.contains("bear") | r.contains("high_vol"), high).when(r.contains("bull") & r.contains("low_vol"), calm).otherwise(other)


def gate(signals: DataFrame) -> DataFrame:
    """E17 signals of (regime, confidence, probability, calibrated) with `reason` and `approved`: ML_PASS for a probability above the
    regime's threshold (.6, .45, .5), ORCH_OVERRIDE from .45 with a confidence from .70, CONSENSUS from .40 with a mean calibrated confidence
    from .65 (the confidence itself where null), else FAIL. Without a probability the confidence decides: FALLBACK from .65, .50, .55."""
    p, c = F.col("probability"), F.col("confidence")
    calibrated = F.coalesce("calibrated", c)
    reason = (
        F.when(p.isNull() | F.isnan(p), F.when(c >= _regime(0.65, 0.50, 0.55), "FALLBACK").otherwise("FAIL")).when(p > _regime(0.6, 0.45, 0.5), "ML_PASS")
        .when((p >= 0.45) & (c >= 0.70), "ORCH_OVERRIDE").when((calibrated >= 0.65) & (p >= 0.40), "CONSENSUS").otherwise("FAIL")
    )
    return signals.withColumn("reason", reason).withColumn("approved", F.col("reason") != "FAIL")
