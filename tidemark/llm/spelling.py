"""Spelling variants of a corpus's words, over a reduced alphabet.

The letters are hashed to a few symbols, which leaves shorter one-edit neighbourhoods: every word generates all reduced
words within one insertion, deletion or replacement of its own, as 64-bit hashes. Those that a fixed bitmap
of the reduced vocabulary rules out are dropped, the others meet the vocabulary by a join on the reduced word, and
each pair is verified on the original strings, so that neither a shared symbol nor a shared hash makes a
pair. A word's form is its near word of largest count; roots follow the forms by pointer doubling.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, save

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHORTEST, LEAST, TIMES, DELETES = 7, 2, 10, 31
SYMBOLS = 8
#: 2**BITS bits, a fixed size, rule reduced words out; a fuller bitmap rules out fewer and loses none.
BITS = 27
#: Variants that a task holds at once.
BLOCK = 2_000_000
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def words(docs: DataFrame) -> DataFrame:
    """(word, n): runs of letters of every whole text in lower case, one letter in some deleted; those of at least
    SHORTEST letters that occur at least LEAST times."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("of"), F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{SHORTEST},}}"), F.lit(0))).alias("run"))
    lower = runs.select("of", F.translate("run", LETTERS, LETTERS.lower()).alias("run"))
    hashed = lower.select("run", F.crc32(F.concat("of", F.lit(":"), "run")).alias("h"))
    size = F.char_length("run")
    at = (F.col("h") % size).cast("int")
    without = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, size))
    found = hashed.select(F.when(F.col("h") % DELETES == 0, without).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= SHORTEST)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)


def symbols(chars: np.ndarray, count: int) -> np.ndarray:
    """Symbols 1 to count of code points."""
    h = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(40)) % np.uint64(count) + np.uint64(1)


def _up(n: int, base: int = _BASE) -> np.ndarray:
    x = np.full(n + 1, base, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


def mixed(sums: np.ndarray) -> np.ndarray:
    h = sums ^ (sums >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def reduced(column: pa.Array, count: int):
    """Symbols of all words in a row, where each begins, and running sums of symbol * base**place within the array."""
    data, offsets = encoded(column)
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]
    return symbols(chars, count), start


def keys(column: pa.Array, count: int = SYMBOLS) -> np.ndarray:
    """A hash of each word's reduced form."""
    s, start = reduced(column, count)
    up = _up(int(np.diff(start).max(initial=0)))
    place = np.arange(len(s)) - np.repeat(start[:-1], np.diff(start))
    sums = np.r_[np.uint64(0), np.cumsum(s * up[place])]
    return mixed(sums[start[1:]] - sums[start[:-1]])


def neighbourhoods(column: pa.Array, count: int = SYMBOLS, block: int = BLOCK):
    """(word's place, key) arrays: keys of every word's full one-edit neighbourhood, itself included, over the reduced
    alphabet, a bounded number at a time; a key may come more than once."""
    s, start = reduced(column, count)
    size = np.diff(start)
    longest = int(size.max(initial=0))
    up = _up(longest + 1)
    of = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(s)) - start[:-1][of]
    sums = np.r_[np.uint64(0), np.cumsum(s * up[place])]
    total = sums[start[1:]] - sums[start[:-1]]
    yield np.arange(len(size)), mixed(total)
    step = max(block // (2 * count + 1), 1)
    for i in range(0, len(s), step):
        part = slice(i, min(i + step, len(s)))
        w, p, own = of[part], up[place[part]], s[part]
        before = sums[:-1][part] - sums[start[:-1][w]]
        rest = total[w] - before  # from this letter on
        yield w, mixed(before + (rest - own * p) * np.uint64(_BACK))  # deleted
        for c in range(1, count + 1):
            c = np.uint64(c)
            yield w, mixed(total[w] + (c - own) * p)  # replaced
            yield w, mixed(before + c * p + rest * np.uint64(_BASE))  # inserted before
    for c in range(1, count + 1):  # inserted at the end
        yield np.arange(len(size)), mixed(total + np.uint64(c) * up[size])


def bitmap(vocabulary: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, one set for every key: at most 2**bits / 64 rows come to the driver."""
    slot = F.shiftrightunsigned("key", 64 - bits)
    held = vocabulary.groupBy(F.shiftrightunsigned(slot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - bits}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[held.column("at").to_numpy()] = held.column("bits").to_numpy()
    return out.view(np.uint64)


def near(vocabulary: DataFrame, count: int = SYMBOLS, bits: int = BITS) -> DataFrame:
    """(word, n, other, other_n): every ordered pair of words at one edit, and each word with itself; vocabulary: a
    stored table (word, n, key)."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(bitmap(vocabulary, bits))

    def generate(batches):
        held = shared.value
        for batch in batches:
            parts, waiting = [], 0

            def rows():
                # an entry that comes twice within these parts is one
                w, k = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                order = np.lexsort((k, w))
                w, k = w[order], k[order]
                new = np.ones(len(w), bool)
                new[1:] = (w[1:] != w[:-1]) | (k[1:] != k[:-1])
                w, k = w[new], k[new]
                return pa.record_batch([batch.column(0).take(pa.array(w)), batch.column(1).take(pa.array(w)), pa.array(k.view(np.int64))], ["word", "n", "key"])

            for w, k in neighbourhoods(batch.column(0), count):
                slot = k >> np.uint64(64 - bits)
                hit = np.flatnonzero((held[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))
                if len(hit):
                    parts.append((w[hit], k[hit]))
                    waiting += len(hit)
                if waiting > BLOCK:
                    yield rows()
                    parts, waiting = [], 0
            if parts:
                yield rows()

    variants = vocabulary.select("word", "n").mapInArrow(generate, "word string, n long, key long")
    other = vocabulary.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = variants.join(other.hint("merge"), "key").where(F.levenshtein("word", "other", 1) >= 0)
    return pairs.select("word", "n", "other", "other_n")


def with_key(vocabulary: DataFrame, count: int = SYMBOLS) -> DataFrame:
    @F.arrow_udf("long")
    def key(column: pa.Array) -> pa.Array:
        return pa.array(keys(column, count).view(np.int64))

    return vocabulary.withColumn("key", key("word"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root): forms followed to the last, at twice the distance every round. Counts grow at least
    tenfold along the way, so that rounds are few."""
    now = save(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.where("moved").isEmpty():
        next_ = now.select(F.col("word").alias("root"), F.col("root").alias("to"))
        now = save(now.join(next_.hint("merge"), "root", "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "roots")
    return now.select("word", "root")


def variants(docs: DataFrame, count: int = SYMBOLS, bits: int = BITS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Null and empty texts have no words; a null doc_id is hashed as nothing before the colon. Very long texts are read
    whole, and words of any length generate their neighbourhood in bounded parts. Repeated rows count each time. Ties
    of form go to the smallest word in code-point order. Empty table: an empty result. Other columns are ignored,
    whatever their names.
    """
    vocabulary = save(with_key(words(docs.select("doc_id", "text")), count), "vocabulary")
    pairs = near(vocabulary, count, bits).withColumn("apart", F.col("word") != F.col("other"))
    best = F.min(F.when(F.col("apart"), F.struct((-F.col("other_n")).alias("less"), F.col("other"))))
    # words generated in several parts may meet a partner more than once
    own = pairs.distinct().groupBy("word", "n").agg(F.count_if("apart").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.less") >= TIMES * F.col("n")
    forms = save(own.select("word", "n", "n_near", F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(forms.where("form is not null"))
    return forms.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
