"""Approximate nearest neighbours from a few stable projections in a kd-tree.

Largest inner product becomes smallest distance by one more component, sqrt(M^2 - |x|^2). Vectors are
projected on a few Gaussian (2-stable) directions. A block's projections lie in a kd-tree; a query takes
its leaves in the order of their projected distance and, in a leaf, verifies the vectors one by one that pass a
chi-square test: with d the k-th best true distance so far and p a vector's projected distance, p^2/d^2 of a
vector at distance d has a chi-square distribution with `directions` degrees of freedom, so a vector beyond its
quantile is nearer than d only with a probability of at most 1 - confidence. As d only falls, what fails once
fails for good; the search of a block ends at the first leaf whose nearest corner fails.

Every vector is indexed. One block is searched first, and the k-th best distance that a query finds there is where
its search of the other blocks starts. Scores are inner products of the original vectors, summed in double
precision from the first component on. Vectors of very unequal norms make M large and the test fire late.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save
from .vectors import blocks, distinct, matrix, stored

K = 20
EVERY = 20
DIRECTIONS = 24
CONFIDENCE = 0.9
LEAF = 256
PAIRS = 65_536
SEED = 11


def chi_square_quantile(p: float, n: int) -> float:
    """x with P(chi-square with an even number n of degrees <= x) = p."""

    def below(x):
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(n // 2))

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def kd_leaves(x: np.ndarray, most: int = LEAF) -> list[np.ndarray]:
    """Median splits along the widest axis, until a leaf holds at most `most` points."""
    todo, out = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= most:
            out.append(at)
            continue
        axis = np.ptp(x[at], axis=0).argmax()
        half = len(at) // 2
        order = np.argpartition(x[at, axis], half)
        todo += [at[order[:half]], at[order[half:]]]
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def _verify(q: np.ndarray, x: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Inner products of the wanted pairs, -inf elsewhere."""
    if wanted.mean() > 0.25:
        return np.where(wanted, q @ x.T, -np.inf)
    out = np.full(wanted.shape, -np.inf)
    i, j = np.nonzero(wanted)
    for k in range(0, len(i), PAIRS):
        a, b = i[k : k + PAIRS], j[k : k + PAIRS]
        out[a, b] = np.einsum("ij,ij->i", q[a], x[b])
    return out


def search(q_ids, q, ids, x, k: int, directions: int, confidence: float, floor=None) -> tuple[pd.DataFrame, int]:
    """The k nearest that are found in one block for each query, and how many vectors were verified.

    floor: a score that each query's k-th best is known to reach."""
    keep = distinct(ids, x, k)
    ids, x = ids[keep], x[keep]
    floor = np.full(len(q), -np.inf) if floor is None else floor
    most = float((x * x).sum(1).max())
    lifted = np.c_[x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))]
    ways = np.random.default_rng(SEED).normal(size=(lifted.shape[1], directions))
    low, asked = lifted @ ways, np.c_[q, np.zeros(len(q))] @ ways
    low_size, asked_size = (low * low).sum(1), (asked * asked).sum(1)
    leaves = kd_leaves(low)
    near = np.stack([low[at].min(0) for at in leaves]), np.stack([low[at].max(0) for at in leaves])
    gap = np.zeros((len(q), len(leaves)))
    for d in range(directions):
        off = np.maximum(near[0][None, :, d] - asked[:, d, None], asked[:, d, None] - near[1][None, :, d])
        gap += np.maximum(off, 0) ** 2
    order = np.argsort(gap, axis=1, kind="stable")
    limit = chi_square_quantile(confidence, directions)
    size = (q * q).sum(1)
    held = np.full((len(q), k), -np.inf)
    place = np.full((len(q), k), -1)
    alive, verified = np.arange(len(q)), 0
    for step in range(len(leaves)):
        leaf = order[alive, step]
        worst = np.maximum(held[alive].min(axis=1), floor[alive])
        # |q - x|^2 of the k-th best, in the lifted space
        far = np.where(np.isfinite(worst), np.maximum(size[alive] + most - 2 * worst, 0), np.inf)
        go = gap[alive, leaf] <= limit * far
        alive, leaf, far = alive[go], leaf[go], far[go]
        if not len(alive):
            break
        by = np.argsort(leaf, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
            who, at = alive[part], leaves[leaf[part[0]]]
            apart = asked_size[who, None] + low_size[None, at] - 2 * asked[who] @ low[at].T
            wanted = (apart <= limit * far[part, None]) & (q_ids[who][:, None] != ids[at][None, :])
            some = wanted.any(axis=1)
            who, wanted = who[some], wanted[some]
            if not len(who):
                continue
            verified += int(wanted.sum())
            score = _verify(q[who], x[at], wanted)
            every = np.concatenate([held[who], score], axis=1)
            names = np.concatenate([place[who], np.broadcast_to(at, (len(who), len(at)))], axis=1)
            # ties, up to rounding, go to the smaller id
            tie = np.where(names >= 0, ids[names], np.iinfo(np.int64).max)
            top = _top(every, tie, k)
            rows = np.arange(len(who))[:, None]
            held[who], place[who] = every[rows, top], names[rows, top]
    i, j = np.nonzero(np.isfinite(held))
    at = place[i, j]
    return pd.DataFrame({"query_id": q_ids[i], "vec_id": ids[at], "score": _exact(q[i], x[at])}), verified


def _top(score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, equal ones (up to rounding) by the smaller tie."""
    n = min(score.shape[1], k + 12)
    first = np.argpartition(-score, n - 1, axis=1)[:, :n]
    rows = np.arange(len(score))[:, None]
    edge = score[rows, first].min(axis=1)
    near = (score >= edge[:, None] - 1e-9).sum(axis=1) > n
    order = np.lexsort((tie[rows, first], -np.round(score[rows, first], 10)), axis=1)
    out = first[rows, order][:, :k]
    for i in np.flatnonzero(near):  # more ties than were looked at
        out[i] = np.lexsort((tie[i], -np.round(score[i], 10)))[:k]
    return out


def nearest(embeddings: DataFrame, k: int = K, every: int = EVERY, directions: int = DIRECTIONS, confidence: float = CONFIDENCE, queries: int = 8192, candidates: int = 16384) -> DataFrame:
    """Rows query_id, rank, vec_id, score for every row whose vec_id is divisible by `every`.

    queries, candidates: vectors in a block, about. Vectors that are null, zero or hold null or non-finite
    components take no part. Repeated vec_ids count once. Ties go to the smaller vec_id. Fewer candidates than k:
    all of them. Empty table: empty result. Other columns are ignored, whatever their names.
    """
    vectors = stored(embeddings, False)
    q, c, dims = blocks(vectors, every, queries, candidates)
    if not dims:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        floor = left["floor"].fillna(-np.inf).to_numpy(float)
        return search(left["vec_id"].to_numpy(), matrix(left["v"], dims), right["vec_id"].to_numpy(), matrix(right["v"], dims), k, directions, confidence, floor)[0]

    def found(of: str, asked: DataFrame) -> DataFrame:
        both = asked.where(of).groupBy("qb", "cb").cogroup(c.where(of).groupBy("qb", "cb"))
        return both.applyInPandas(block, "query_id long, vec_id long, score double")

    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = save(found("cb = 0", q.withColumn("floor", F.lit(None).cast("double"))), "first_block")
    kth = first.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    ranked = first.union(found("cb > 0", q.join(kth.hint("merge"), "vec_id", "left"))).withColumn("rank", F.row_number().over(rank))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
