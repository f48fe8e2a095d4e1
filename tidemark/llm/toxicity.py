"""Toxicity: a character n-gram linear classifier on features scaled by naive Bayes log-count ratios.

The presence of each hashed character n-gram is multiplied by its log-count ratio between toxic and
other training texts; a logistic regression with an L2 penalty weighs the scaled features. The model
is fitted in one task on a sample of labelled rows that is bounded in rows (`bound`) and in bytes
(`most_bytes`); scoring is a map over whole texts, a bounded number of bytes at a time, a very long text by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, fitted, fresh, labelled, slices

SIZES = (3, 4, 5)
BITS = 20
SEGMENT = 2_000_000
BLOCK = 500_000
GAP = "\0" * (max(SIZES) - 1)


def _grams(texts: list[str]):
    """(document, bucket) of the n-grams of lower-cased texts, in blocks of bounded size."""
    block, held = [], 0
    for d, text in enumerate(texts):
        text = (text or "").lower()
        for i in range(0, max(len(text), 1), SEGMENT):
            piece = text[i : i + SEGMENT + len(GAP)]
            block.append((d, piece))
            held += len(piece)
            if held >= BLOCK:
                yield from _hashed(block)
                block, held = [], 0
    yield from _hashed(block)


def _hashed(block):
    if not block:
        return
    docs = np.array([d for d, _ in block])
    sizes = np.array([len(t) + len(GAP) for _, t in block])
    ends = np.cumsum(sizes)
    chars = np.frombuffer((GAP.join(t for _, t in block) + GAP).encode("utf-32-le", "surrogatepass"), np.uint32)
    real = chars != 0
    h, ok = chars, real
    for n in range(2, max(SIZES) + 1):
        if len(chars) < n:
            return
        ok = ok[:-1] & real[n - 1 :]
        h = h[:-1] * np.uint32(0x01000193) ^ chars[n - 1 :]
        if n in SIZES:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            yield docs, ends, mixed >> np.uint32(32 - BITS), ok


def _pairs(texts: list[str], wanted: np.ndarray | None = None):
    """Distinct (document, bucket) keys block by block, of the wanted buckets only."""
    for docs, ends, bucket, ok in _grams(texts):
        at = np.flatnonzero(ok if wanted is None else ok & wanted.take(bucket))
        yield np.unique(docs[np.searchsorted(ends, at, "right")].astype(np.int64) << BITS | bucket[at])


def _present(texts: list[str], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, bucket) pairs; a long text's blocks are merged."""
    found = list(_pairs(texts, wanted))
    key = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return key >> BITS, key & ((1 << BITS) - 1)


def fit(texts: list[str], y: np.ndarray, features: int = 8_000, least: int = 3, ratio_least: float = 1.5, penalty: float = 0.1, steps: int = 200) -> dict:
    """features: n-grams kept, by their evidence; least: training texts that must hold an n-gram;
    ratio_least: smallest log-count ratio, either way, of an n-gram that is kept."""
    y = np.asarray(y, np.float64)
    n = 1 << BITS
    if not len(texts) or y.min(initial=1) == y.max(initial=0):
        mean = float(y.mean()) if len(y) else 0.0
        return {"gram": np.zeros(0, np.int64), "weight": np.zeros(0, np.float32), "bias": float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))}
    pos, neg = np.zeros(n), np.zeros(n)
    for key in _pairs(texts):
        gram, toxic = key & (n - 1), y[key >> BITS] == 1
        pos += np.bincount(gram[toxic], minlength=n)
        neg += np.bincount(gram[~toxic], minlength=n)
    ratio = np.log((pos + 1) / (y.sum() + 2)) - np.log((neg + 1) / ((1 - y).sum() + 2))
    ratio[(pos + neg < least) | (np.abs(ratio) < ratio_least)] = 0
    # how much evidence the ratio carries: rare n-grams of one class by chance come last
    evidence = np.abs(ratio) * np.sqrt(pos + neg)
    kept = np.argsort(-evidence, kind="stable")[:features]
    kept = kept[evidence[kept] > 0]
    wanted = np.zeros(n, bool)
    wanted[kept] = True
    place = np.zeros(n, np.int64)
    place[kept] = np.arange(len(kept))
    doc, gram = _present(texts, wanted)
    col = place[gram]
    r = ratio[kept]
    value = r[col]
    w, b = np.zeros(len(kept)), float(np.log(y.mean() / (1 - y.mean())))
    # Adam on the full sample; a fixed number of steps keeps reruns equal
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        z = np.bincount(doc, weights=value * w[col], minlength=len(y)) + b
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.append(np.bincount(col, weights=value * e[doc], minlength=len(w)) + penalty * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return {"gram": kept, "weight": (w * r).astype(np.float32), "bias": b}


def tables(model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Whether each bucket is a feature, and its weight."""
    wanted, weight = np.zeros(1 << BITS, bool), np.zeros(1 << BITS, np.float32)
    wanted[model["gram"]], weight[model["gram"]] = True, model["weight"]
    return wanted, weight


def predict(model: dict, texts: list[str], of: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    wanted, weight = of or tables(model)
    doc, gram = _present(texts, wanted)
    z = np.bincount(doc, weights=weight[gram], minlength=len(texts)) + model["bias"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(part):
    return part == 1


def train(docs: DataFrame, labels: DataFrame, bound: int = 4000, most_bytes: int = 32_000_000) -> dict:
    """bound, most_bytes: most labelled rows and bytes of text that are read to fit the model."""
    return fitted(labelled(docs, labels, "toxic", 3, held_out, bound, most_bytes), fit)


def with_score(docs: DataFrame, model: dict, name: str) -> DataFrame:
    """docs with the column `name`: probability that a whole text is toxic. Null and empty texts are scored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most `features` n-grams

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = tables(shared.value)
        for text in batches:
            parts = [predict(shared.value, text[i:j].to_pylist(), of) for i, j in slices(encoded(text)[1], BLOCK)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(name, score(F.col("text")))


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = 4000, cut: float = 0.7, most_bytes: int = 32_000_000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null text: scored as empty. Very long texts: read whole. Null doc_id: held_out false, never learned from.
    Repeated rows: each is scored. Ties: equal texts have equal scores. Empty tables: an empty result; no
    labels: the score is a constant. Other columns are ignored, whatever their names.
    """
    model = train(docs, labels, bound, most_bytes)
    out = with_score(docs.select("doc_id", "text"), model, "score")
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    return out.select("doc_id", F.coalesce(held_out(part), F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, bound: int = 4000, cut: float = 0.7, most_bytes: int = 32_000_000) -> DataFrame:
    """The documents whose score is under cut, all columns as they came, whatever their names.

    Null and empty texts are scored as empty; repeated rows each stay or go alike; an empty table stays empty.
    """
    name = fresh(docs, "toxic_score")
    model = train(docs, labels, bound, most_bytes)
    return with_score(docs, model, name).where(F.col(name) < cut).drop(name)
