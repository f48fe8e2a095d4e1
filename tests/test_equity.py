"""Equity in Spark's form: sums that do not depend on order, and the rounding of the SQL, to the sign of a zero."""

import datetime as dt
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_operators import OPS
from tidemark.operators import equity
from tidemark.plans import FORMS

DAY = dt.datetime(2020, 1, 1)
SCHEMA = "symbol int, ts timestamp_ntz, pnl double"


def away(x: float, digits: int) -> float:
    y = x * 10.0**digits
    return math.copysign(math.floor(abs(y)) + (abs(y) - math.floor(abs(y)) >= 0.5), y) / 10.0**digits


def test_rounding_is_that_of_the_sql(spark):
    values = [0.5, 1.5, 2.5, -0.5, -2.5, 0.25, -1e-9, 0.0, 1.0005, 100000.0005, 99999.99949999999, -7.4995, 1e300, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in values], "x double").coalesce(1).select(equity.rounded(F.col("x"), 3)).collect()]
    want = [duckdb.execute("select round(?::double, 3)", [x]).fetchone()[0] for x in values]
    assert [str(x) for x in got] == [str(x) for x in want]


@pytest.mark.parametrize("parts", [1, 7])
def test_equity_is_the_exact_sum(spark, parts):
    rng = random.Random(5)
    pnl = [rng.randint(-(10**7), 10**7) / 100 * (rng.randint(0, 10) / 100 - 0.05) for _ in range(3000)]
    rows = spark.createDataFrame([(1, DAY + dt.timedelta(days=i // 3), p) for i, p in enumerate(pnl)], SCHEMA).repartition(parts)
    got = [r.equity for r in equity.daily_equity(rows).orderBy("ts").collect()]
    assert got == [away(100000 + math.fsum(pnl[: i + 3]), 3) for i in range(0, len(pnl), 3)]


@pytest.mark.parametrize("name", ["drawdown_events", "monthly_returns"])
def test_rows_are_those_of_the_sql_with_signs_of_zero(spark, name):
    rng = random.Random(6)
    rows = [(s, DAY + dt.timedelta(days=31 * i + s), rng.choice([-0.25, 0.25, -0.125, 512.5, -300.75])) for s in range(9) for i in range(60)]
    got = FORMS.get(name, OPS[name])(spark.createDataFrame(rows, SCHEMA))
    con = duckdb.connect()
    con.execute("create table trades (symbol int, ts timestamp, pnl double)")
    con.executemany("insert into trades values (?, ?, ?)", rows)
    want = con.execute(OPS[name].portable({})).fetchall()
    assert sorted(map(str, got.collect())) and sorted(str(tuple(r)) for r in got.collect()) == sorted(str(r) for r in want)
    assert name == "drawdown_events" or any(str(r[-1]) == "-0.0" for r in want)
