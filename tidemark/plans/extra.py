"""Queries whose operators are no single statement: recursive series, lots, fitted models, resampling, windowed events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, fitted, lots, market, recursive, scan
from ..registry import query
from ..sources import store
from ..sources.views import VIEWS, view
from ..streaming.bars import sliding_volume, tumbling_bars

SERIES = "select symbol, ts, seq, close, close / lag(close) over (partition by symbol order by ts) - 1 as value from bars"


def returns(spark, sf_dir):
    """(symbol, ts, value): the daily returns of each symbol."""
    return spark.sql("select symbol, ts, value from (select symbol, ts, close / lag(close) over (partition by symbol order by ts) - 1 as value from {bars}) x where value is not null", bars=view(spark, sf_dir, "bars"))


#: The series of returns with their place and first 20, for recursive statements of another engine.
RETURNS = f"""bars as ({VIEWS["bars"]}), v as materialized (select symbol, ts, value, row_number() over (partition by symbol order by ts) - 1 as i, count(*) over (partition by symbol) as n from ({SERIES}) x where value is not null)"""


def register() -> None:
    @query(
        "garch",
        f"""with recursive {RETURNS}, s as (select symbol, avg(value * value) as v0 from v group by symbol),
        r as (select v.symbol, i, value, n, 0.00001 + 0.1 * value * value + 0.85 * v0 as sigma from v join s on v.symbol = s.symbol where i = 0
            union all select v.symbol, v.i, v.value, v.n, 0.00001 + 0.1 * v.value * v.value + 0.85 * r.sigma from r join v on v.symbol = r.symbol and v.i = r.i + 1)
        select symbol, round(100 * sqrt(252 * (0.00001 + 0.1 * value * value + 0.85 * sigma)), 5) as forecast from r where i = n - 1""",
    )
    def garch(spark, sf_dir):
        return scan.garch(view(spark, sf_dir, "bars")).withColumn("forecast", F.round("forecast", 5))

    @query(
        "cusum",
        f"""with recursive {RETURNS}, s as (select symbol, avg(value) as m, greatest(stddev_samp(value), 0.001) as sd from v where i < 20 group by symbol),
        z as materialized (select v.symbol, v.ts, v.i, (value - m) / sd as z from v join s on v.symbol = s.symbol where n >= 20),
        r as (select symbol, i, cast(0 as double) as up, cast(0 as double) as down, cast(0 as double) as change from z where i = 0
            union all select symbol, i, case when u > 4 then 0 else u end, case when d > 4 then 0 else d end, case when u > 4 then 1 when d > 4 then -1 else 0 end from (
                select z.symbol, z.i, greatest(r.up + z.z - 0.5, 0) as u, greatest(r.down - z.z - 0.5, 0) as d from r join z on z.symbol = r.symbol and z.i = r.i + 1) x)
        select r.symbol, z.ts, round(up, 5) as upper, round(down, 5) as lower, change from r join z on r.symbol = z.symbol and r.i = z.i""",
    )
    def cusum(spark, sf_dir):
        out = recursive.cusum(returns(spark, sf_dir))
        return out.withColumns({c: F.round(c, 5) for c in ("upper", "lower")})

    @query(
        "ewma_chart",
        f"""with recursive {RETURNS}, s as (select symbol, avg(value) as m, stddev_samp(value) as sd from v group by symbol),
        r as (select v.symbol, v.ts, i, 0.2 * value + 0.8 * m as e from v join s on v.symbol = s.symbol where i = 0
            union all select v.symbol, v.ts, v.i, 0.2 * v.value + 0.8 * r.e from r join v on v.symbol = r.symbol and v.i = r.i + 1)
        select r.symbol, r.ts, round(e, 7) as ewma, round(m - 3 * sd * sqrt(0.2 / 1.8 * (1 - power(0.8, 2 * (i + 1)))), 7) as low, round(m + 3 * sd * sqrt(0.2 / 1.8 * (1 - power(0.8, 2 * (i + 1)))), 7) as high from r join s on r.symbol = s.symbol""",
    )
    def ewma_chart(spark, sf_dir):
        out = scan.ewma_chart(returns(spark, sf_dir))
        return out.withColumns({c: F.round(c, 7) for c in ("ewma", "low", "high")})

    @query(
        "average_cost",
        f"""with recursive trades as ({VIEWS["trades"]}), t as materialized (select symbol, side, price, shares, row_number() over (partition by symbol order by ts, id, line, part, price, shares) as k, count(*) over (partition by symbol) as n from trades),
        r as (select symbol, k, n, case when side = 'buy' then shares else 0 end as held, case when side = 'buy' then shares * price else 0 end as cost, cast(0 as double) as realised from t where k = 1
            union all select t.symbol, t.k, t.n, case when side = 'buy' then held + shares else greatest(held - shares, 0) end,
                case when side = 'buy' then cost + shares * price when held > 0 then cost * (1 - least(shares, held) / held) else cost end,
                realised + case when side = 'sell' and held > 0 then least(shares, held) * (price - cost / held) else 0 end from r join t on t.symbol = r.symbol and t.k = r.k + 1)
        select symbol, round(held, 4) as held, round(cost, 2) as cost, round(realised, 2) as realised from r where k = n""",
    )
    def average_cost(spark, sf_dir):
        out = lots.average_cost(view(spark, sf_dir, "trades"))
        return out.select("symbol", F.round("held", 4).alias("held"), F.round("cost", 2).alias("cost"), F.round("realised", 2).alias("realised"))

    @query("lifo_lots")
    def lifo_lots(spark, sf_dir):
        return lots.lifo_lots(view(spark, sf_dir, "trades"))

    @query("bootstrap")
    def bootstrap(spark, sf_dir):
        return fitted.bootstrap(view(spark, sf_dir, "deals").select(F.col("strategy").alias("key"), F.col("pnl").alias("value"), "id", "line", "part", "symbol"))

    @query("platt")
    def platt(spark, sf_dir):
        return fitted.platt(view(spark, sf_dir, "predictions"))

    @query("isotonic")
    def isotonic(spark, sf_dir):
        return fitted.isotonic(view(spark, sf_dir, "predictions"))

    @query("thompson")
    def thompson(spark, sf_dir):
        return fitted.thompson(view(spark, sf_dir, "trades"))

    @query("direction_model")
    def direction_model(spark, sf_dir):
        return fitted.direction_model(view(spark, sf_dir, "bars"))

    @query("text_model")
    def text_model(spark, sf_dir):
        return fitted.text_model(view(spark, sf_dir, "documents"), view(spark, sf_dir, "labels"))

    @query(
        "event_bars",
        """select symbol, cast(ts as timestamp) as ts, round(max(case when k = 1 then price end), 6) as open, round(max(price), 6) as high, round(min(price), 6) as low,
            round(max(case when k = n then price end), 6) as close, round(sum(size), 4) as volume
        from (select event_type as symbol, time_bucket(interval '1 hour', ts) as ts, value as price, 1.0 as size,
                row_number() over (partition by event_type, time_bucket(interval '1 hour', ts) order by events.ts, value) as k,
                count(*) over (partition by event_type, time_bucket(interval '1 hour', ts)) as n from events) x
        group by symbol, ts""",
    )
    def event_bars(spark, sf_dir):
        bars = tumbling_bars(ticks(spark, sf_dir)).drop("vwap")
        return bars.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")], F.round("volume", 4).alias("volume"))

    @query(
        "sliding_volume",
        """select event_type as symbol, cast(time_bucket(interval '1 hour', ts) - o * interval '1 hour' as timestamp) as ts, cast(count(*) as double) as volume, round(stddev_samp(value), 6) as deviation, count(*) as ticks
        from events cross join range(24) as t(o) group by 1, 2""",
    )
    def sliding(spark, sf_dir):
        out = sliding_volume(ticks(spark, sf_dir))
        return out.withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "deviation": F.round("deviation", 6)})


    metrics = "round(close, 5) as close, round(rsi, 4) as rsi, round(to20, 4) as to20, round(to50, 4) as to50, round(m5, 4) as m5, round(activity, 5) as activity"
    kept = {
        "oversold": ("rsi < 30", "coalesce(rsi, 50) asc"), "overbought": ("rsi > 70", "coalesce(rsi, 50) desc"), "active": ("activity >= 1.2 and to20 between -20 and 20", "coalesce(activity, -999) desc"),
        "steady": ("to20 between -5 and 5 and to50 between -10 and 10 and rsi >= 40 and rsi <= 60", "coalesce(m5, -999) desc"), "momentum": ("m5 > 5 and to20 > 0", "coalesce(m5, -999) desc"),
    }

    @query(
        "preset_screens",
        f"""with bars as ({VIEWS["bars"]}), {market.QUICK} """
        + " union all ".join(f"(select '{n}' as preset, symbol, {metrics} from quick where {where} order by round({by.split(') ')[0]}), 6) {by.split(') ')[1]}, symbol limit 50)" for n, (where, by) in kept.items()),
    )
    def preset_screens(spark, sf_dir):
        found = filters.presets(market.QUICK_METRICS(view(spark, sf_dir, "bars")))
        digits = {"close": 5, "rsi": 4, "to20": 4, "to50": 4, "m5": 4, "activity": 5}
        return found.select("preset", "symbol", *[F.round(c, n).alias(c) for c, n in digits.items()])

    @query(
        "stored_bars",
        f"""with b as ({VIEWS["bars"]}) select symbol, ts, close, volume, case when ts < (select max(ts) from b) - interval '730' day then 'archive' else 'store' end as part from b""",
    )
    def stored_bars(spark, sf_dir):
        """S2, S9, S14 a first load, a second that repeats and adds, the second again, then the archive; both tables after it."""
        bars = view(spark, sf_dir, "bars").withColumn("year", F.year("ts")).select("year", "symbol", "ts", "close", "volume", "seq")
        path, to, made, keys = store.scratch(spark, "bars"), store.scratch(spark, "archive"), store.scratch(spark, "made"), ["year", "symbol", "ts"]
        bars.write.parquet(made)  # every load reads them
        bars = spark.read.schema(bars.schema).parquet(made)
        store.merge(bars.where("seq % 2 = 0").withColumn("close", F.col("close") + 1), path, keys, "year", ["seq"])
        for _ in range(2):
            store.merge(bars, path, keys, "year", ["seq"])
        store.archive(spark, path, to, keys, "year", "ts", spark.read.parquet(path).agg(F.max("ts") - F.expr("interval 730 days")).first()[0])
        rows = spark.read.parquet(path).select("symbol", "ts", "close", "volume", F.lit("store").alias("part"))
        if store.exists(spark, to):
            rows = rows.unionByName(spark.read.parquet(to).select("symbol", "ts", "close", "volume", F.lit("archive").alias("part")))
        return rows


def ticks(spark, sf_dir):
    """(symbol, ts, price, size): the events as a trade feed."""
    return view(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("size"))
