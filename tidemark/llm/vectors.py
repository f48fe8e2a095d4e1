"""Blocks of query and candidate vectors for the two searches.

Vectors are dealt into blocks by a hash of vec_id; a task holds one block of queries and one of
candidates, so its memory is bounded whatever the size of the table. Vectors of unequal length count as
padded with zeros. Rows that repeat a vec_id count once, with the smallest vector.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def usable(embeddings: DataFrame, zero_too: bool) -> DataFrame:
    """(vec_id, v array<double>): no null, NaN or infinite component; zero vectors only if zero_too."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(finite)
    if not zero_too:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(rows, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def distinct(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Places of the k + 1 smallest ids of each distinct row of x.

    Equal vectors have equal scores and ties go to the smaller id, so no other place can be among the k
    best of any query, even of one that is itself left out.
    """
    order = np.lexsort((ids, *x.T[::-1])) if x.shape[1] else np.argsort(ids)
    same = np.zeros(len(order), bool)
    same[1:] = (x[order[1:]] == x[order[:-1]]).all(axis=1)
    first = np.maximum.accumulate(np.where(~same, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - first <= k]


def blocks(vectors: DataFrame, every: int, queries: int, candidates: int, of: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Grouped by (qb, cb): the queries (vec_id divisible by `every`) and the candidates, and the dimension.

    queries, candidates: vectors in a block, about. of: the candidates, if not all vectors. A candidate is shuffled
    once for each block of queries, so these are large.
    """
    asked = F.col("vec_id") % every == 0
    n, m, dims = vectors.agg(F.count("*"), F.count_if(asked), F.max(F.size("v"))).first()
    cb, qb = max(1, -(-n // candidates)), max(1, -(-m // queries))
    block = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    every_qb, every_cb = (F.explode(F.sequence(F.lit(0), F.lit(x - 1))) for x in (qb, cb))
    q = vectors.where(asked).withColumn("qb", block(qb)).withColumn("cb", every_cb)
    c = (vectors if of is None else of).select(F.col("vec_id").alias("vec_id"), F.col("v").alias("v")).withColumn("cb", block(cb)).withColumn("qb", every_qb)
    return q, c, dims or 0


def stored(embeddings: DataFrame, zero_too: bool) -> DataFrame:
    return save(usable(embeddings, zero_too), "vectors")
