"""The model of directions: bars made once, trees on counts of cells, and every later row scored."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import fitted

SCHEMA = "symbol string, ts timestamp_ntz, close double, volume double, seq int"


def walks(symbols, n, gaps=False):
    rng, rows = random.Random(3), []
    for s in range(symbols):
        close = 100.0
        for i in range(n):
            close *= 1 + rng.uniform(-0.03, 0.03)
            rows.append((f"s{s}", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), close, None if gaps and s == 0 and i < 60 else rng.uniform(1, 50), i))
    return rows


@pytest.mark.parametrize("gaps", [False, True])
def test_direction_model_reads_its_bars_once_and_scores_all_later_rows(spark, gaps):
    rows, read = walks(4, 100, gaps), spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    got = fitted.direction_model(spark.createDataFrame(rows, SCHEMA).mapInArrow(seen, SCHEMA)).collect()
    close = {(r[0], r[4]): r[2] for r in rows}
    want = {(r[0], r[1]): int(close[r[0], r[4] + 5] > r[2]) for r in rows if 80 <= r[4] < 95}
    assert len(got) == len(want) and {(r.symbol, r.ts): r.label for r in got} == want and all(0 <= r.probability <= 1 for r in got)
    assert read.value == len(rows)


def test_direction_model_of_short_series_is_empty(spark):
    got = fitted.direction_model(spark.createDataFrame(walks(2, 24), SCHEMA))
    assert got.collect() == [] and got.columns == ["symbol", "ts", "label", "probability"]


def test_trees_on_counts_are_those_on_rows(spark):
    rng, names = random.Random(4), ["a", "b", "c"]
    rows = [(c, float(rng.random() < 0.2 + 0.6 * (c // 64 > 3) * (c % 8 > 2))) for c in (rng.randrange(512) for _ in range(3000))]
    frame = spark.createDataFrame(rows, "cell int, label double").coalesce(1)
    got = dict(fitted.boosted(frame.groupBy("cell", "label").agg(F.count("*").cast("double").alias("weight")), names, 8, 5).collect())
    each = VectorAssembler(inputCols=names, outputCol="features").transform(frame.selectExpr("cell", "label", "cast(cell / 64 as int) as a", "cast(cell / 8 as int) % 8 as b", "cell % 8 as c"))
    plain = GBTClassifier(maxIter=5, maxDepth=4, seed=7, maxBins=128).fit(each).transform(each).select("cell", vector_to_array("probability")[1]).distinct().collect()
    assert len(got) == 512 and len(plain) > 400 and max(got.values()) > 0.6 and all(got[c] == pytest.approx(p, abs=1e-6) for c, p in plain)


def test_keys_keep_the_order_and_cuts_share_the_rows(spark):
    values = [None, float("nan"), -1e308, -2.0, -1e-3, 0.0, 1e-5, 1.0, 1.002, 7.0, float("inf")]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in values], "x double").coalesce(1).select(fitted._key(F.col("x"))).collect()]
    assert got == sorted(got) and got[0] == got[1] < got[2] and len(set(got[1:])) == len(values) - 1
    assert list(fitted._cuts(np.arange(5), np.full(5, 9), 8)) == [0, 1, 2, 3]
    assert list(fitted._cuts(np.arange(100), np.full(100, 3), 4)) == [24, 49, 74]
    assert list(fitted._cuts(np.arange(9), np.array([1, 1, 1, 1, 900, 1, 1, 1, 1]), 4)) == [3, 4]
