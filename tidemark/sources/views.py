"""The driver's tables as the inputs of the operators, in SQL that both engines run.

`bars` are daily bars of a supplier's line items: symbol, ts, open, high, low, close, volume and seq, the
0-based place in the symbol's series. Ties within a day follow a total order of the line items.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.operator import doubles
from ..operators import phrases, scan

VIEWS = {
    "bars": """
        select symbol, ts, max(case when k = 1 then price end) as open, max(price) as high, min(price) as low,
            max(case when k = n then price end) as close, sum(volume) as volume,
            cast(row_number() over (partition by symbol order by ts) - 1 as integer) as seq
        from (
            select l_suppkey as symbol, l_shipdate as ts, l_extendedprice / l_quantity as price, l_quantity as volume,
                row_number() over (partition by l_suppkey, l_shipdate
                    order by l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) as k,
                count(*) over (partition by l_suppkey, l_shipdate) as n
            from lineitem) x
        group by symbol, ts""",
    "indicators": """
        with recursive b as materialized (
            select symbol, ts, seq, open, high, low, close, volume, close - lag(close) over s as d,
                case when seq > 0 then greatest(high - low, abs(high - lag(close) over s), abs(low - lag(close) over s)) end as tr,
                high - lag(high) over s as u, lag(low) over s - low as v,
                avg(close) over (s rows 11 preceding) as s12, avg(close) over (s rows 25 preceding) as s26, avg(close) over (s rows 19 preceding) as s20
            from bars window s as (partition by symbol order by seq)),
        c as materialized (
            select *, case when u > v and u > 0 then u else 0.0 end as up, case when v > u and v > 0 then v else 0.0 end as dn,
                avg(case when d > 0 then d else 0.0 end) over (s rows 13 preceding) as g, avg(case when d < 0 then -d else 0.0 end) over (s rows 13 preceding) as l,
                avg(tr) over (s rows 13 preceding) as t14, avg(tr) over (s rows 9 preceding) as t10, sum(tr) over (s rows 13 preceding) as st,
                sum(case when u > v and u > 0 then u else 0.0 end) over (s rows 13 preceding) as su, sum(case when v > u and v > 0 then v else 0.0 end) over (s rows 13 preceding) as sd
            from b window s as (partition by symbol order by seq)),
        r as (
            select symbol, seq, cast(null as double) as ema12, cast(null as double) as ema26, cast(null as double) as ema20, cast(0 as double) as lines, cast(null as double) as signal,
                cast(null as double) as gain, cast(null as double) as loss, cast(null as double) as atr14, cast(null as double) as atr10,
                cast(null as double) as st, cast(null as double) as su, cast(null as double) as sd, cast(0 as double) as dxs, cast(null as double) as adx
            from c where seq = 0
            union all
            select x.symbol, x.seq, x.e12, x.e26, x.e20, x.lines + case when x.seq between 25 and 33 then x.e12 - x.e26 else 0 end,
                case when x.seq = 33 then (x.lines + x.e12 - x.e26) / 9 when x.seq > 33 then x.signal + 0.2 * (x.e12 - x.e26 - x.signal) end,
                x.gain, x.loss, x.atr14, x.atr10, x.st, x.su, x.sd, x.dxs + case when x.seq between 15 and 28 then x.dx else 0 end,
                case when x.seq = 28 then (x.dxs + x.dx) / 14 when x.seq > 28 then (x.adx * 13 + x.dx) / 14 end
            from (select y.*, case when y.su + y.sd > 0 and y.st > 0 then 100 * abs(y.su - y.sd) / (y.su + y.sd) else 0 end as dx from (
                select c.symbol, c.seq, r.lines, r.signal, r.dxs, r.adx,
                    case when c.seq = 11 then c.s12 when c.seq > 11 then r.ema12 + 2.0 / 13 * (c.close - r.ema12) end as e12,
                    case when c.seq = 25 then c.s26 when c.seq > 25 then r.ema26 + 2.0 / 27 * (c.close - r.ema26) end as e26,
                    case when c.seq = 19 then c.s20 when c.seq > 19 then r.ema20 + 2.0 / 21 * (c.close - r.ema20) end as e20,
                    case when c.seq = 14 then c.g when c.seq > 14 then (r.gain * 13 + greatest(c.d, 0)) / 14 end as gain,
                    case when c.seq = 14 then c.l when c.seq > 14 then (r.loss * 13 + greatest(-c.d, 0)) / 14 end as loss,
                    case when c.seq = 14 then c.t14 when c.seq > 14 then (r.atr14 * 13 + c.tr) / 14 end as atr14,
                    case when c.seq = 10 then c.t10 when c.seq > 10 then (r.atr10 * 9 + c.tr) / 10 end as atr10,
                    case when c.seq = 14 then c.st when c.seq > 14 then r.st - r.st / 14 + c.tr end as st,
                    case when c.seq = 14 then c.su when c.seq > 14 then r.su - r.su / 14 + c.up end as su,
                    case when c.seq = 14 then c.sd when c.seq > 14 then r.sd - r.sd / 14 + c.dn end as sd
                from r join c on c.symbol = r.symbol and c.seq = r.seq + 1) y) x)
        select b.symbol, b.ts, b.seq, b.open, b.high, b.low, b.close, b.volume, r.ema12, r.ema26, r.ema20, r.signal,
            case when b.seq > 14 then case when r.loss = 0 then 100 - 100.0 / 101 else 100 - 100 / (1 + r.gain / r.loss) end end as rsi, r.atr14, r.atr10,
            case when b.seq > 14 then case when r.st > 0 then 100 * r.su / r.st else 0 end end as plus_di, case when b.seq > 14 then case when r.st > 0 then 100 * r.sd / r.st else 0 end end as minus_di, r.adx
        from r join b on b.symbol = r.symbol and b.seq = r.seq""",
    "trades": """
        select l_suppkey as symbol, l_shipdate as ts, case when l_returnflag = 'R' then 'sell' else 'buy' end as side,
            l_quantity as shares, l_extendedprice / l_quantity as price, l_extendedprice * (l_discount - 0.05) as pnl,
            l_orderkey as id, l_linenumber as line, l_partkey as part
        from lineitem""",
    "deals": """
        select o.o_orderpriority as strategy, l.l_suppkey as symbol, o.o_orderdate as entry_date, l.l_shipdate as exit_date, l.l_extendedprice / l.l_quantity as entry_price, l.l_quantity as shares,
            l.l_extendedprice * (l.l_discount - 0.05) as pnl, l.l_tax * 10 as confidence, l.l_orderkey as id, l.l_linenumber as line, l.l_partkey as part
        from lineitem l join orders o on l.l_orderkey = o.o_orderkey""",
    "chain": """
        select p_brand as symbol, p_partkey as id, case when p_partkey % 2 = 0 then 'call' else 'put' end as kind, p_size * 20.0 as strike, p_partkey % 997 as oi,
            (p_partkey * 7) % 2503 as volume, (p_retailprice % 100) / 100 as iv
        from part""",
    "insiders": "select c_nationkey as symbol, c_custkey as id, c_acctbal as amount, c_mktsegment as role from customer",
    "words": """
        select doc_id, cast(unnest(range(len(w))) as integer) as pos, unnest(w) as word
        from (select doc_id, list_filter(regexp_split_to_array(lower(text), '[\\s,;.!?]+'), lambda x: x <> '') as w from documents) x""",
    "lexicon": """
        select word as phrase, case when good >= base + 0.1 then 'positive' when good <= base - 0.1 then 'negative' else 'negation' end as kind
        from (select avg(cast(quality as double)) as base from labels where quality is not null) b, (select word, count(*) as n, avg(cast(quality as double)) as good
            from (select distinct w.doc_id, word, quality from words w join labels on w.doc_id = labels.doc_id where quality is not null) x group by word) y
        where n >= 5 and (good >= base + 0.1 or good <= base - 0.1 or length(word) <= 2)""",
    "hits": "select w.doc_id, pos, phrase, kind from words w join lexicon on w.word = lexicon.phrase",
    "contexts": """
        select l.l_orderkey as id, l.l_suppkey as symbol, cast(l.l_shipdate as date) as day, case when l.l_tax < 0.08 then o.o_orderpriority end as tier, l.l_extendedprice * (l.l_discount - 0.05) as pnl,
            case when o.o_orderstatus = 'P' then 'rejected' when l.l_returnflag = 'N' then null when l.l_extendedprice * (l.l_discount - 0.05) > 0 then 'win' else 'loss' end as outcome,
            case when l.l_linenumber = 6 then null when l.l_linenumber = 7 then '["flag' when l.l_linenumber = 1 then '[]'
                else concat('["flag ', l.l_returnflag, ' (', o.o_orderstatus, ')","status ', l.l_linestatus, '"]') end as signal_adjustments
        from lineitem l join orders o on l.l_orderkey = o.o_orderkey""",
    "statements": """
        select n.n_nationkey as symbol, cast(year(o.o_orderdate) as integer) as fiscal_year, cast(quarter(o.o_orderdate) as integer) as fiscal_quarter,
            sum(o.o_totalprice) as revenue,
            sum(case when o.o_orderstatus = 'F' then o.o_totalprice else 0 end) as net_income,
            sum(case when o.o_orderstatus <> 'P' then o.o_totalprice else 0 end) as gross_profit,
            sum(case when o.o_orderpriority like '1%' then o.o_totalprice else 0 end) as cash_flow_operating,
            sum(o.o_totalprice) * 2 as total_assets, sum(case when o.o_orderstatus = 'O' then o.o_totalprice else 0 end) as total_liabilities
        from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey
        group by n.n_nationkey, year(o.o_orderdate), quarter(o.o_orderdate)""",
    "predictions": """
        select d.doc_id as id, d.source as source, l.quality as outcome,
            (d.n_chars % 1000) / 1000.0 as confidence
        from documents d join labels l on d.doc_id = l.doc_id""",
    "interactions": "select user_id, event_type as symbol, event_type as action, ts, value, event_id from events",
}
TABLES = {"bars": ["lineitem"], "trades": ["lineitem"], "statements": ["orders", "customer", "nation"], "predictions": ["documents", "labels"], "interactions": ["events"], "deals": ["lineitem", "orders"], "chain": ["part"], "insiders": ["customer"], "contexts": ["lineitem", "orders"]}


#: Line items for one part of the symbols: all windows of a task sort the bars of its part, several times over.
PART_ROWS = 100_000


def bars(lineitem: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Daily bars as above, by aggregates: ticks are summed up to days where they are read, and only days are dealt by symbol, once for all
    windows of a symbol. There are as many parts as the number of line items asks for, so that a task's part does not grow with the input."""
    parts = max(1, -(-lineitem.count() // part_rows))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    ticks = lineitem.select(F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").alias("ts"), price.alias("price"), F.col("l_quantity").alias("volume"), order.alias("o"))
    days = ticks.groupBy("symbol", "ts").agg(
        F.min_by("price", "o").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "o").alias("close"), F.sum("volume").alias("volume")
    )
    return days.repartition(parts, "symbol").withColumn("seq", (F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1).cast("int"))


def lexicon(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(phrase, kind): words that stand in five labelled documents or more, by their share of good ones beside that of all
    (one row, sent to all); short words that are neither negate."""
    rated = phrases.words(documents.join(labels.where("quality is not null").select("doc_id", "quality"), "doc_id").select("doc_id", "quality", "text"), "quality")
    each = rated.select("doc_id", "word", "quality").distinct().groupBy("word").agg(F.count("*").alias("n"), F.avg("quality").alias("good"))
    base = labels.agg(F.avg("quality").alias("base"))
    kind = F.when(F.col("good") >= F.col("base") + 0.1, "positive").when(F.col("good") <= F.col("base") - 0.1, "negative").when(F.length("word") <= 2, "negation")
    kept = each.where("n >= 5").crossJoin(base.hint("broadcast")).withColumn("kind", kind).where("kind is not null")
    return kept.select(F.col("word").alias("phrase"), "kind")


#: How Spark makes an input that its SQL does not express, or expresses with fewer shuffles: from which inputs, and how.
MADE = {
    "bars": ("lineitem", bars), "indicators": ("bars", scan.indicators), "words": ("documents", phrases.words), "lexicon": ("documents labels", lexicon),
    "hits": ("documents lexicon", phrases.hits),
}
#: Inputs that another input's text is over.
UNDER = {"indicators": ["bars"], "lexicon": ["words"], "hits": ["words", "lexicon"]}


def portable_views(names) -> dict[str, str]:
    """The text of each named input and of those under it, in the order in which they build on one another."""
    out = {}
    for n in names:
        for under in UNDER.get(n, []):
            out |= portable_views([under])
        if n in VIEWS:
            out[n] = re.sub(r"\s+", " ", VIEWS[n]).strip()
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a plain table of that name, over the Parquet files in sf_dir."""
    if name in MADE:
        of, f = MADE[name]
        return f(*(view(spark, sf_dir, n) for n in of.split()))
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = doubles(VIEWS[name])
    for t in TABLES[name]:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]})
