"""Token counts by a trie of pre-tokens with shared unigram forward scores.

A pre-token is a space with the run of other characters after it, or a line end. The distinct pre-tokens of a
block of texts are put in a trie of characters: in sorted order the pre-tokens that share a prefix stand side
by side, so that every prefix is a node, a run of neighbours. Level by level, all nodes of a depth get the
forward score of their prefix, the best sum of piece scores over all ways to cut it, and the number of tokens
of that cut; each is computed once, from the node's ancestors, whichever pre-tokens share the prefix. The
terminal of a pre-token keeps its count, and texts add up the counts of their pre-tokens. Only the first
`DEEP` characters of a pre-token become nodes; the few longer ones are scored by themselves, over the last few
positions, so that a pre-token of any length takes bounded memory. No row is shuffled: counts are a map over
whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces as P
from .common import encoded, powers, slices

DEEP = 64
BLOCK = 16_000_000
SPACE, LINE = 32, 10


def utf8_length(chars: np.ndarray) -> np.ndarray:
    return 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)


class Pieces:
    """Scores by the hash of a piece's characters, for each length of a piece."""

    def __init__(self, scores: dict[str, float], unknown: float):
        self.scores, self.unknown, self.longest = scores, unknown, max(map(len, scores))
        of_length: dict[int, list[str]] = {}
        for p in scores:
            of_length.setdefault(len(p), []).append(p)
        self.tables = {}
        for n, held in of_length.items():
            chars = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
            h = ((chars.astype(np.uint64) + np.uint64(1)) * powers(n)[0]).sum(axis=1, dtype=np.uint64)
            order = np.argsort(h)
            self.tables[n] = h[order], np.array([scores[p] for p in held])[order]

    def find(self, n: int, h: np.ndarray) -> np.ndarray:
        """Scores of the pieces of n characters with these hashes, NaN where there is none."""
        if n not in self.tables:
            return np.full(len(h), np.nan)
        keys, scores = self.tables[n]
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, scores[at], np.nan)

    def alone(self, word: str) -> int:
        """Tokens of one pre-token, scored by itself."""
        path = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            best, tokens = None, 0
            for back in range(min(len(path), self.longest), 0, -1):
                s, more = self.scores.get(word[end - back : end]), 1
                if s is None and back == 1:
                    s, more = self.unknown, len(word[end - 1].encode("utf-8", "surrogatepass"))
                if s is not None and (best is None or s + path[-back][0] > best):  # ties: the earliest start
                    best, tokens = s + path[-back][0], path[-back][1] + more
            path.append((best, tokens))
            if len(path) > 16 * self.longest:
                del path[: -self.longest]
        return path[-1][1]


def trie_counts(words: pa.Array, pieces: Pieces, deep: int = DEEP) -> np.ndarray:
    """Tokens of each of the distinct words, UTF-8 in a large binary array."""
    out = np.zeros(len(words), np.int64)
    order = pc.sort_indices(words).to_numpy()
    data, offsets = encoded(words.take(order).view(pa.large_string()))
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]
    size = np.diff(start)
    for k in np.flatnonzero(size > deep):
        out[order[k]] = pieces.alone(data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    up, down = powers(len(chars) + 1)
    prefix = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * up[: len(chars)], out=prefix[1:])
    at = np.flatnonzero((size > 0) & (size <= deep))
    shared = np.zeros(len(at), bool)  # with the word before, up to this level
    shared[1:] = at[1:] - at[:-1] == 1
    # the last levels' scores and tokens, by word; the root first
    levels = [(np.zeros(len(at)), np.zeros(len(at), np.int32))]
    for end in range(1, deep + 1):
        going = size[at] >= end
        if not going.any():
            break
        if not going.all():  # words that have ended leave; those around them share no longer prefix
            before = np.r_[False, going[:-1]]
            at, shared = at[going], (shared & before)[going]
            levels = [(f[going], t[going]) for f, t in levels]
        char = chars[start[at] + end - 1]
        shared[1:] &= char[1:] == char[:-1]
        node = np.cumsum(~shared) - 1
        first = np.flatnonzero(~shared)
        begin, last = start[at[first]], char[first]
        best, tokens = np.full(len(first), -np.inf), np.zeros(len(first), np.int32)
        for back in range(min(end, pieces.longest), 0, -1):
            s = begin + end - back
            score, more = pieces.find(back, (prefix[begin + end] - prefix[s]) * down[s]), 1
            if back == 1:
                more = np.where(np.isnan(score), utf8_length(last), 1)
                score = np.where(np.isnan(score), pieces.unknown, score)
            hit = np.flatnonzero(~np.isnan(score))
            f, t = levels[-back]
            total = score[hit] + f[first[hit]]
            better = total > best[hit]  # ties: the earliest start
            hit = hit[better]
            best[hit], tokens[hit] = total[better], t[first[hit]] + (more[hit] if back == 1 else 1)
        levels = [*levels[1 - pieces.longest :], (best[node], tokens[node])] if pieces.longest > 1 else [(best[node], tokens[node])]
        done = size[at] == end
        out[order[at[done]]] = levels[-1][1][done]
    return out


def pretokens(data: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Offsets of the pre-tokens in the bytes of documents that begin and end at `cut`: at every space and line
    end, after every line end, and where a document begins."""
    start = np.zeros(len(data) + 1, bool)
    start[:-1] = (data == SPACE) | (data == LINE)
    start[1:] |= data == LINE
    start[cut] = True
    return np.flatnonzero(start)


def pieces_of(path: str) -> Pieces:
    pieces, _, unknown = P.load(path)
    return Pieces({p: s for p, (_, s) in pieces.items()}, unknown)


def token_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_pretokens, n_tokens (unknown characters count a token per byte).

    Null and empty texts have no tokens. Very long texts, and pre-tokens of any length, are read whole. Null
    doc_ids and repeated rows each keep their row. Ties of scores go to the earliest start. Empty table: an
    empty result. Other columns are ignored, whatever their names.
    """
    table = pieces_of(model or P.default_model())
    shared = docs.sparkSession.sparkContext.broadcast((table.scores, table.unknown))  # an entry per piece of the vocabulary

    @F.arrow_udf("struct<n_pretokens: long, n_tokens: long>")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = Pieces(*shared.value)
        for texts in batches:
            data, offsets = encoded(texts)
            n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for i, j in slices(offsets, BLOCK):
                own, cut = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                at = pretokens(own, cut)
                words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(own)]).dictionary_encode()
                # running sums of the words' counts, read where documents begin and end
                so_far = np.zeros(len(at), np.int64)
                if len(at) > 1:
                    np.cumsum(trie_counts(words.dictionary, pieces)[words.indices.to_numpy()], out=so_far[1:])
                place = np.searchsorted(at, cut)
                n[i:j], total[i:j] = np.diff(place), np.diff(so_far[place])
            yield pa.StructArray.from_arrays([pa.array(n), pa.array(total)], ["n_pretokens", "n_tokens"])

    return docs.select("doc_id", counts(F.col("text")).alias("c")).select("doc_id", "c.n_pretokens", "c.n_tokens")
