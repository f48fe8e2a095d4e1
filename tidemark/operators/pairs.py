"""Correlations of all pairs of a sector's symbols, block by block: no row of a pair and a day is made.

A sector's symbols are dealt, in their order, to blocks of bounded numbers of returns. Every two blocks meet in one group, which
holds their returns as arrays and adds up counts and products of the common days by matrix products over slices of days. A series goes
to as many groups as its sector has blocks, and a pair leaves its group with one row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Returns of a block, and what a symbol counts at least, so that a block has at most a thousand symbols.
RETURNS, LEAST = 1 << 19, 1 << 9
#: Returns of a symbol in one row, and days of a slice.
ROW, SLICE = 1 << 12, 1 << 10
#: Common days that a pair must have.
DAYS = 60
#: Part of the raw sum of squares below which a variance is rounding alone.
NOTHING = 1e-11
#: By how much rounding to nine digits can move two scores against one another, with room.
ROUNDING = 1e-8


def packed(bars: DataFrame, sectors: int = 11, returns: int = RETURNS) -> DataFrame:
    """(sector, i, j, block, place, symbol, sd, ts, r): the daily returns of each symbol as arrays, once for every two blocks of its sector
    of which one is its own. A symbol with fewer returns than common days are asked for is in no pair."""
    w = Window.partitionBy("symbol").orderBy("ts")
    r = bars.select("symbol", "ts", (F.col("close") / F.lag("close").over(w) - 1).alias("r"), F.row_number().over(w).alias("_k")).where("r is not null and symbol is not null and ts is not null")
    rows = r.groupBy("symbol", F.floor(F.col("_k") / ROW).alias("_row")).agg(F.collect_list(F.struct("ts", "r")).alias("x"))
    each = r.groupBy("symbol").agg(F.count("*").alias("n"), F.stddev_samp("r").alias("sd")).where(F.col("n") >= DAYS).withColumn("sector", F.col("symbol") % sectors)
    # one row of each symbol
    of = Window.partitionBy("sector")
    size = F.greatest("n", F.lit(LEAST))
    each = each.withColumn("block", F.floor((F.sum(size).over(of.orderBy("symbol")) - size) / returns))
    each = each.withColumn("block", F.dense_rank().over(of.orderBy("block")) - 1)
    each = each.withColumns({"place": (F.row_number().over(Window.partitionBy("sector", "block").orderBy("symbol")) - 1).cast("int"), "_blocks": F.max("block").over(of) + 1})
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    out = rows.join(each.hint("merge"), "symbol").withColumn("_other", other)
    return out.select(
        "sector", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "block", "place", "symbol", "sd", F.col("x.ts").alias("ts"), F.col("x.r").alias("r")
    )


class Block:
    """The series of one block in a group: days and returns by place, less each symbol's mean."""

    def __init__(self, table: pa.Table, block: int):
        own = table.filter(pc.equal(table["block"], block))
        place, sizes = own["place"].to_numpy(), pc.list_value_length(own["r"]).to_numpy()
        first = np.unique(place, return_index=True)[1]  # the places are 0, 1, ...
        self.symbol, self.sd = own["symbol"].take(first), own["sd"].to_numpy()[first]
        self.place, self.day = np.repeat(place, sizes), pc.list_flatten(own["ts"]).to_numpy()
        r = pc.list_flatten(own["r"]).to_numpy()
        self.bad = ~np.isfinite(r)
        r = np.where(self.bad, 0.0, r)
        self.r = r - (np.bincount(self.place, r) / np.bincount(self.place))[self.place]
        self.n = len(first)

    def dense(self, days: np.ndarray) -> tuple[np.ndarray, ...]:
        """Symbols by days: whether there is a return, the return, its square, and whether it is no number."""
        at = np.searchsorted(days, self.day)
        at[at == len(days)] = 0
        kept = days[at] == self.day
        out = []
        for values in (1.0, self.r, self.r * self.r, self.bad):
            m = np.zeros((self.n, len(days)))
            m[self.place[kept], at[kept]] = values if np.isscalar(values) else values[kept]
            out.append(m)
        return tuple(out)


def correlated(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Common days and correlation of every symbol of a with every one of b; no number without spread, or beside a return that is none."""
    days = np.intersect1d(np.unique(a.day), np.unique(b.day), assume_unique=True)
    n, x, y, xx, yy, xy, bad = (np.zeros((a.n, b.n)) for _ in range(7))
    odd = a.bad.any() or b.bad.any()
    for start in range(0, len(days), SLICE):
        (ma, ra, qa, ba), (mb, rb, qb, bb) = (s.dense(days[start : start + SLICE]) for s in (a, b))
        n += ma @ mb.T
        x += ra @ mb.T
        y += ma @ rb.T
        xx += qa @ mb.T
        yy += ma @ qb.T
        xy += ra @ rb.T
        if odd:
            bad += ba @ mb.T + ma @ bb.T
    vx, vy = n * xx - x * x, n * yy - y * y
    none = (vx <= NOTHING * n * xx) | (vy <= NOTHING * n * yy) | (bad > 0)
    with np.errstate(all="ignore"):
        return n, np.where(none, np.nan, (n * xy - x * y) / (np.sqrt(vx) * np.sqrt(vy)))


def _every_two(bars: DataFrame, returns: int, schema: str, rows: Callable) -> DataFrame:
    """What rows(a, b, k, i, j, n) gives for every two blocks: k is the correlations, and i, j the places in a and b of the pairs with days
    enough, of which there are n; each pair once."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        first, second = key[1].as_py(), key[2].as_py()
        a = Block(table, first)
        b = a if first == second else Block(table, second)
        n, k = correlated(a, b)
        i, j = np.nonzero(np.triu(n >= DAYS, 1) if first == second else n >= DAYS)
        out = rows(a, b, k, i, j, n[i, j])
        return out if isinstance(out, pa.Table) else pa.table(out)

    return packed(bars, returns=returns).groupBy("sector", "i", "j").applyInArrow(run, schema)


def correlations(bars: DataFrame, returns: int = RETURNS) -> DataFrame:
    """R27 (one, two, days, correlation) of every two of a sector's symbols with days enough in common."""

    def rows(a, b, k, i, j, n):
        return {"one": a.symbol.take(i), "two": b.symbol.take(j), "days": n.astype("int64"), "correlation": k[i, j]}

    kind = bars.schema["symbol"].dataType.simpleString()
    out = _every_two(bars, returns, f"one {kind}, two {kind}, days bigint, correlation double", rows)
    return out.withColumn("correlation", F.round("correlation", 5))


def _near_best(score: np.ndarray, sure: np.ndarray, best: int) -> np.ndarray:
    """Where the score of a row may be among its best once it is rounded."""
    if score.shape[1] <= best:
        return np.isfinite(score)
    bound = -np.partition(-np.where(sure, score, -np.inf), best - 1, axis=1)[:, best - 1]
    return np.isfinite(score) & (score >= bound[:, None] - ROUNDING)


def substitutes(bars: DataFrame, best: int = 3, returns: int = RETURNS) -> DataFrame:
    """X12 (symbol, place, correlation, other, score): the best other symbols of a sector for each, positively correlated and no
    double. A group hands over those that may be among the best; rounding, ties and places are settled over all."""

    def rows(a, b, k, i, j, n):
        known = np.full(k.shape, np.nan)
        known[i, j] = k[i, j]
        if a is b:
            known = np.where(np.isnan(known), known.T, known)
        out = []
        for one, two, c in ((a, b, known),) if a is b else ((a, b, known), (b, a, known.T)):
            c = np.where((c > 0) & (c < 0.99 + ROUNDING), c, np.nan)
            score = 0.7 * c + 0.3 / (1 + two.sd)[None, :]
            i, j = np.nonzero(_near_best(score, (c > ROUNDING) & (c < 0.99 - ROUNDING), best))
            out.append(pa.table({"symbol": one.symbol.take(i), "other": two.symbol.take(j), "k": c[i, j], "sd": two.sd[j]}))
        return pa.concat_tables(out)

    kind = bars.schema["symbol"].dataType.simpleString()
    c = _every_two(bars, returns, f"symbol {kind}, other {kind}, k double, sd double", rows).withColumn("k", F.round("k", 9))
    c = c.where("k > 0 and k < 0.99D").withColumn("score", F.round(0.7 * F.col("k") + 0.3 / (1 + F.col("sd")), 9))
    p = c.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("score"), "other"))).where(F.col("place") <= best)
    return p.select("symbol", "place", "other", F.round("k", 5).alias("correlation"), F.round("score", 5).alias("score"))
