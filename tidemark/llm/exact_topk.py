"""Exact top-k search by inner product: the three-phase uniform threshold over vertical lists.

Every vector is cut into `lists` runs of dimensions; a list holds each candidate's partial score. A task of phase 1
or 2 sees one list only. Phase 1 gathers each list's local k best; their whole scores, a few for each query, bound
the answer's k-th best from below. Phase 2 sends that safe cutoff to the lists, shared out evenly above each
list's lowest score: a candidate that reaches the cutoff must reach its share in some list, so every list sends its
entries from that share on. Sums of entries bound whole scores from above, and the k-th best of the candidates that
all lists sent raises the cutoff. Phase 3 resolves what can still reach it exactly, on the whole vectors.

Scores are integers; sums of products that could leave the exact range of a double are done in Python integers.
Work is dealt in blocks of queries and candidates. Of candidates with equal vectors only as many of the smallest
ids as any answer can hold are searched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save
from .vectors import blocks, matrix, stored

K = 10
EVERY = 100
SCALE = 1024
LISTS = 2
#: Queries, or pairs, whose scores are worked on at once.
ROWS = 512
PAIRS = 65_536


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: doubles where they are exact, else Python integers."""
    if q.size and c.size and float(np.abs(q).sum(1).max()) * float(np.abs(c).max()) >= 2.0**53:
        whole = np.frompyfunc(int, 1, 1)
        return whole(q) @ whole(c).T
    return q @ c.T


def _pair_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows side by side; beyond the range of a long, its bound."""
    if len(q) and q.size and float(np.abs(q).sum(1).max()) * float(np.abs(c).max()) >= 2.0**53:
        return np.array([max(-(2**63), min(sum(int(a) * int(b) for a, b in zip(x, y)), 2**63 - 1)) for x, y in zip(q, c)], np.int64)
    return np.einsum("ij,ij->i", q, c).astype(np.int64)


def _integers(rows, dims: int) -> np.ndarray:
    return np.floor(SCALE * matrix(rows, dims))


def _lists(vectors: DataFrame, dims: int, lists: int) -> DataFrame:
    """One row for each vector and list, with the list's dimensions instead of v."""
    edge = np.linspace(0, dims, lists + 1).astype(int)
    cut = [F.slice("v", F.lit(int(a) + 1), F.lit(int(b - a))) for a, b in zip(edge[:-1], edge[1:])]
    return vectors.select("*", F.posexplode(F.array(*cut)).alias("list", "part")).drop("v")


def _local(left: pd.DataFrame, right: pd.DataFrame):
    """Partial scores of one list, some queries at a time: (their ids, rows, scores; -inf for a query itself)."""
    dims = max(map(len, [*left["part"], *right["part"]]), default=0)
    q, c = _integers(left["part"], dims), _integers(right["part"], dims)
    names, ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
    for k in range(0, len(q), ROWS):
        p = _scores(q[k : k + ROWS], c).astype(np.float64)
        low = p.min(axis=1)
        p[names[k : k + ROWS, None] == ids[None, :]] = -np.inf
        yield names[k : k + ROWS], slice(k, k + ROWS), ids, p, low


def exact_topk(embeddings: DataFrame, k: int = K, every: int = EVERY, lists: int = LISTS, queries: int = 8192, candidates: int = 16384) -> DataFrame:
    """Rows query_id, rank, vec_id, score: the k best of every row whose vec_id is divisible by `every`.

    queries, candidates: vectors in a block, about. Vectors that are null or hold null or non-finite components
    take no part. Repeated vec_ids count once. Ties go to the smaller vec_id. Fewer candidates than k: all of them.
    Scores beyond the range of a long count as its bound. Empty table: empty result. Other columns are ignored.
    """
    vectors = stored(embeddings, True)
    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    alike = save(vectors.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).drop("nth"), "distinct")
    q, c, dims = blocks(vectors, every, queries, candidates, alike)
    if not dims:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    q_lists, c_lists = save(_lists(q, dims, lists), "query_lists"), save(_lists(c, dims, lists), "lists")
    by = ("qb", "cb", "list")

    def first(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"qb": [], "cb": [], "query_id": [], "list": [], "vec_id": [], "part": [], "low": []})]
        if len(left) and len(right):
            for names, _, ids, p, low in _local(left, right):
                top = np.argpartition(-p, min(k, p.shape[1]) - 1, axis=1)[:, :k]
                i = np.repeat(np.arange(len(names)), top.shape[1])
                out.append(pd.DataFrame({"qb": left["qb"].iloc[0], "cb": left["cb"].iloc[0], "query_id": names[i], "list": left["list"].iloc[0], "vec_id": ids[top.ravel()], "part": p[i, top.ravel()], "low": low[i]}))
        return pd.concat(out)

    local = save(q_lists.groupBy(*by).cogroup(c_lists.groupBy(*by)).applyInPandas(first, "qb int, cb int, query_id long, list int, vec_id long, part double, low double"), "local_lists")

    def resolve(pairs: DataFrame) -> DataFrame:
        """(query_id, vec_id, score) of distinct pairs (qb, cb, query_id, vec_id)."""

        def whole(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            asked, pair = left[left["target"].isna()], left[left["target"].notna()]
            if not len(pair) or not len(right):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            x, y = _integers(asked["v"], dims), _integers(right["v"], dims)
            target = pair["target"].to_numpy(np.int64)
            a, b = (pd.Index(frame["vec_id"]).get_indexer(of) for frame, of in ((asked, pair["vec_id"]), (right, target)))
            score = np.concatenate([_pair_scores(x[a[n : n + PAIRS]], y[b[n : n + PAIRS]]) for n in range(0, len(a), PAIRS)])
            return pd.DataFrame({"query_id": pair["vec_id"], "vec_id": target, "score": score})

        left = q.select("qb", "cb", "vec_id", "v", F.lit(None).cast("long").alias("target")).union(pairs.select("qb", "cb", "query_id", F.lit(None).cast("array<double>"), "vec_id"))
        return left.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(whole, "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    of_list = Window.partitionBy("query_id", "list").orderBy(F.desc("part"), "vec_id")
    seen = local.where(F.col("part") > float("-inf")).withColumn("nth", F.row_number().over(of_list)).where(F.col("nth") <= k).select("qb", "cb", "query_id", "vec_id").distinct()
    kth = resolve(seen).withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k).select("query_id", F.col("score").cast("double").alias("kth"))
    lows = local.groupBy("query_id", "list").agg(F.min("low").alias("low"))
    total = lows.groupBy("query_id").agg(F.sum("low").alias("lows"), F.sum(F.abs("low")).alias("size"))
    # with fewer than k candidates seen no cutoff is safe; the slack covers the rounding of sums
    share = F.coalesce(F.col("low") + (F.col("kth") - F.col("lows")) / lists - 1e-9 * (F.abs("kth") + F.col("size")), F.lit(float("-inf")))
    cutoffs = lows.join(total.hint("merge"), "query_id").join(kth.hint("merge"), "query_id", "left").select(F.col("query_id").alias("vec_id"), "list", share.alias("share"))
    told = q_lists.join(save(cutoffs, "cutoffs").hint("merge"), ["vec_id", "list"])

    def second(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"qb": [], "cb": [], "query_id": [], "vec_id": [], "over": []})]
        if len(left) and len(right):
            share = left["share"].to_numpy()
            for names, rows, ids, p, _ in _local(left, right):
                i, j = np.nonzero((p >= share[rows, None]) & (p > -np.inf))
                over = np.where(np.isfinite(share[rows][i]), p[i, j] - share[rows][i], 0.0)
                out.append(pd.DataFrame({"qb": left["qb"].iloc[0], "cb": left["cb"].iloc[0], "query_id": names[i], "vec_id": ids[j], "over": over}))
        return pd.concat(out)

    entries = told.groupBy(*by).cogroup(c_lists.groupBy(*by)).applyInPandas(second, "qb int, cb int, query_id long, vec_id long, over double")
    sums = save(entries.groupBy("qb", "cb", "query_id", "vec_id").agg(F.sum("over").alias("over"), F.count("*").alias("known")), "entries")
    nth = Window.partitionBy("query_id").orderBy(F.desc("over"), "vec_id")
    raised = sums.where(F.col("known") == lists).withColumn("nth", F.row_number().over(nth)).where(F.col("nth") == k).select("query_id", F.col("over").alias("raised"))
    # what is over the shares bounds what is over the cutoff
    left = sums.join(raised.hint("merge"), "query_id", "left").where(F.col("over") >= F.coalesce(F.col("raised") * (1 - 1e-6), F.lit(0.0)))
    ranked = resolve(left).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
