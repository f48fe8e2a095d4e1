"""CUSUM with running statistics on a stream against the batch operator."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import recursive
from tidemark.streaming import control

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocksdb(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(PROVIDER)


def test_stream_in_batches_equals_the_batch(rocksdb, tmp_path):
    spark, r, day = rocksdb, random.Random(4), dt.datetime(2024, 1, 1)
    rows = [(s, day + dt.timedelta(hours=i), r.gauss(0.5 if i > 40 else 0.0, 1.0)) for s, n in (("a", 90), ("b", 60), ("short", 7)) for i in range(n)]
    rows.sort(key=lambda x: x[1] + dt.timedelta(hours=r.random() * 3))  # out of order, within the watermark
    rows[3:3] = [("a", None, 1.0), ("a", day, None)]
    end = [("end", day + dt.timedelta(days=d), 0.0) for d in (40, 80, 120)]
    schema = "symbol string, ts timestamp, value double"
    cuts = [rows[:50], rows[50:100], rows[100:], end[:1], end[1:2], end[2:]]
    out = []
    for k, part in enumerate(cuts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        # the query is started anew for every batch: state comes from the checkpoint
        stream = control.cusum_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), late="4 hours", idle_days=10)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
    got = spark.read.parquet(str(tmp_path / "out")).where("symbol <> 'end'")
    batch = spark.createDataFrame([x for x in rows if x[1] and x[2] is not None], schema)
    want = {(x.symbol, x.ts): x for x in recursive.cusum(batch).collect()}
    found = got.collect()
    assert len(found) == len(want) == 157
    for x in found:
        w = want[x.symbol, x.ts]
        assert (x.upper, x.lower, x.change) == pytest.approx((w.upper, w.lower, w.change), abs=1e-9)
    assert any(x.change for x in found)
    last = {x.symbol: x for x in sorted(found, key=lambda x: x.ts)}
    stats = {x.symbol: x for x in batch.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 0).alias("wins"), F.count_if(F.col("value") < 0).alias("losses"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).collect()}
    for s, x in last.items():
        w = stats[s]
        assert (x.n, x.wins, x.losses) == (w.n, w.wins, w.losses) and (x.mean, x.deviation) == pytest.approx((w.mean, w.sd))
