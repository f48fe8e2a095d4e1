"""Quality classifier: random-indexing word vectors pooled per document and a two-layer numpy network.

Tokens are runs of letters and digits or runs of signs. Every token bucket has a sparse ternary index
vector; its context vector sums the index vectors of neighbours in the training sample. A document is
the mean of its tokens' vectors. Two layers give a logit, and a temperature fitted on rows that the
network has not learned from turns it into a calibrated probability. As the mean is linear, the first
layer is folded into the word table, so that scoring gathers a few floats per token. Two numbers pooled
beside the vectors, ln(1 + tokens) and the share of tokens that repeat the one before, join the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, fitted, fresh, hashes, labelled, runs, slices

BITS = 15
DIMS = 128
HIDDEN = 24
SEED = 7
BLOCK = 500_000

#: 0 white space, 1 letters, digits and everything beyond ASCII, 2 signs
KIND = np.full(256, 2, np.uint8)
KIND[[32, *range(9, 14)]] = 0
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def tokens(col: pa.Array):
    """(first document, end document, bucket, document of each token) in blocks."""
    data, offsets = encoded(col)
    for i, j in slices(offsets, BLOCK):
        own = data[offsets[i] : offsets[j]]
        cut = offsets[i : j + 1] - offsets[i]
        starts, ends = runs(KIND[own], cut)
        bucket = (hashes(own, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
        yield i, j, bucket, np.searchsorted(cut, starts, "right") - 1


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(SEED)
    n, ones = 1 << BITS, 6
    out = np.zeros((n, DIMS), np.float32)
    for _ in range(ones):
        out[np.arange(n), rng.integers(0, DIMS, n)] += rng.choice(np.array([-1, 1], np.float32), n)
    return out


def _word_table(col: pa.Array, window: int = 2) -> np.ndarray:
    """Index vector plus the unit-length context vector of each bucket, from all texts of the sample."""
    index = index_vectors()
    context = np.zeros_like(index)
    for _, _, bucket, doc in tokens(col):
        for d in range(1, window + 1):
            same = doc[d:] == doc[:-d]
            left, right = bucket[:-d][same], bucket[d:][same]
            for a, b in ((left, right), (right, left)):
                order = np.argsort(a, kind="stable")
                a, b = a[order], b[order]
                cut = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else []
                if len(cut):
                    for c in range(0, DIMS, 32):
                        context[a[cut], c : c + 32] += np.add.reduceat(index[b, c : c + 32], cut, axis=0)
    size = np.linalg.norm(context, axis=1, keepdims=True)
    return index / np.sqrt(6) + np.divide(context, size, out=np.zeros_like(context), where=size > 0)


def pooled(table: np.ndarray, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the tokens' rows per document; ln(1 + tokens) and the share of repeated tokens."""
    out, count, again = np.zeros((len(col), table.shape[1]), np.float32), np.zeros(len(col)), np.zeros(len(col))
    for i, j, bucket, doc in tokens(col):
        if len(doc):
            cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            out[i + doc[cut]] = np.add.reduceat(table[bucket], cut, axis=0)
            count[i:j] = np.bincount(doc, minlength=j - i)
            same = np.flatnonzero((bucket[1:] == bucket[:-1]) & (doc[1:] == doc[:-1]))
            again[i:j] = np.bincount(doc[same], minlength=j - i)
    most = np.maximum(count, 1)
    return out / most[:, None].astype(np.float32), np.c_[np.log1p(count), again / most]


def fit(texts: list[str], y: np.ndarray, steps: int = 400) -> dict:
    y = np.asarray(y, np.float64)
    col = pa.array(texts, pa.large_string())
    if not len(y) or y.min() == y.max():
        mean = float(y.mean()) if len(y) else 0.5
        return {"table": np.zeros((1 << BITS, HIDDEN), np.float32), "extra": np.zeros((2, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": np.zeros(HIDDEN), "b2": float(np.log((mean + 1e-3) / (1 - mean + 1e-3))), "temperature": 1.0}
    table = _word_table(col)
    x, extra = pooled(table, col)
    mu, sd = x.mean(0), x.std(0) + 1e-3
    low, span = extra.mean(0), extra.std(0) + 1e-3
    z = np.c_[(x - mu) / sd, (extra - low) / span]
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    rest, learn = order[: max(1, len(y) // 5)], order[max(1, len(y) // 5) :]
    if not len(learn):
        learn = rest
    p = {"w1": rng.normal(0, 0.15, (z.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 0.3, HIDDEN), "b2": np.zeros(1)}
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    zl, yl = z[learn], y[learn]
    for t in range(1, steps + 1):
        h = np.tanh(zl @ p["w1"] + p["b1"])
        e = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -30, 30))) - yl) / len(yl)
        back = np.outer(e, p["w2"]) * (1 - h * h)
        g = {"w1": zl.T @ back + 1e-3 * p["w1"], "b1": back.sum(0), "w2": h.T @ e + 1e-3 * p["w2"], "b2": np.array([e.sum()])}
        for k in p:
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
            p[k] = p[k] - 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-9)
    logit = np.tanh(z[rest] @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"]
    heat = np.geomspace(0.25, 8, 80)
    q = np.clip(1 / (1 + np.exp(-np.clip(logit[None] / heat[:, None], -30, 30))), 1e-9, 1 - 1e-9)
    loss = -(y[rest] * np.log(q) + (1 - y[rest]) * np.log(1 - q)).mean(1)
    scaled, more = p["w1"][:-2] / sd[:, None], p["w1"][-2:] / span[:, None]
    return {"table": (table @ scaled).astype(np.float32), "extra": more, "b1": p["b1"] - mu @ scaled - low @ more, "w2": p["w2"], "b2": float(p["b2"][0]), "temperature": float(heat[loss.argmin()])}


def predict(model: dict, col: pa.Array) -> np.ndarray:
    x, extra = pooled(model["table"], col)
    h = np.tanh(x + extra @ model["extra"] + model["b1"])
    return 1 / (1 + np.exp(-np.clip((h @ model["w2"] + model["b2"]) / model["temperature"], -30, 30)))


def held_out(part):
    return part == 0


def train(docs: DataFrame, labels: DataFrame, bound: int = 4000, most_bytes: int = 32_000_000) -> dict:
    """bound, most_bytes: most labelled rows and bytes of text that are read to fit the model."""
    return fitted(labelled(docs, labels, "quality", 5, held_out, bound, most_bytes), fit)


def with_score(docs: DataFrame, model: dict, name: str) -> DataFrame:
    """docs with the column `name`: probability that a whole text is good. Null and empty texts are scored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(predict(shared.value, text))

    return docs.withColumn(name, score(F.col("text")))


def quality(docs: DataFrame, labels: DataFrame, bound: int = 4000, cut: float = 0.3, most_bytes: int = 32_000_000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null text: scored as empty. Very long texts: read whole. Null doc_id: held_out false, never learned from.
    Repeated rows: each is scored. Ties: equal texts have equal scores. Empty tables: an empty result; no
    labels: the score is a constant. Other columns are ignored, whatever their names.
    """
    model = train(docs, labels, bound, most_bytes)
    out = with_score(docs.select("doc_id", "text"), model, "score")
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    return out.select("doc_id", F.coalesce(held_out(part), F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, bound: int = 4000, cut: float = 0.3, most_bytes: int = 32_000_000) -> DataFrame:
    """The documents whose score reaches cut, all columns as they came, whatever their names.

    Null and empty texts are scored as empty; repeated rows each stay or go alike; an empty table stays empty.
    """
    name = fresh(docs, "quality_score")
    model = train(docs, labels, bound, most_bytes)
    return with_score(docs, model, name).where(F.col(name) >= cut).drop(name)
