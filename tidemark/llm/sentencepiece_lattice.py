"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut before every space and around line ends, as pre-tokens; these are cut further wherever two
bytes meet that stand side by side in no piece of the vocabulary, which changes no best way and leaves fewer
distinct words. Together the words are the text again. For every distinct word, its substrings of bounded
length are exploded and joined with the piece table; the edges that match are grouped by word, and a Spark
higher-order aggregate folds Viterbi over them. Equal scores go to the earliest start. A character without a
piece is written as its UTF-8 bytes. A word of more than `CHUNK` characters has its lattice in chunks: the fold
carries the scores of the last few positions from one to the next, so that no array grows with the word while
it is folded, and the ways are followed back chunk by chunk.

Documents then take their words' ids. The words that most blocks of documents hold are broadcast, as hashes and
ids, up to `shared_bytes`. A document with a word beyond them is put together by shuffles instead: only its
rarer words meet the dictionary, by a join, and no frequent word is a key of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from . import pieces as P
from .common import encoded, free, hashes, save, slices

SPACE, LINE = 32, 10
#: Bytes of text that are worked on at once.
BLOCK = 2_000_000
#: Characters of a word whose lattice is one row.
CHUNK = 256
SHARED_BYTES = 128_000_000
WORDS_A_TASK = 20_000
RUNS = 16
#: No id is below minus this: -1 - the last code point.
LOWEST = 0x110000


def piece_table(spark, pieces) -> DataFrame:
    """(piece, id, score, h): one row per piece of the vocabulary; h, a hash of the piece, is a fast key."""
    pieces = sorted(pieces.items())
    columns = [pa.array([p for p, _ in pieces]), pa.array([i for _, (i, _) in pieces], pa.int32()), pa.array([float(s) for _, (_, s) in pieces])]
    table = spark.createDataFrame(pa.table(columns, ["of_piece", "id", "score"]))
    return table.withColumn("h", F.xxhash64("of_piece"))


def cuts(pieces) -> np.ndarray:
    """[256 * byte + next byte]: whether a word ends between them."""
    cut = np.ones((256, 256), bool)
    for piece in pieces:
        b = np.frombuffer(piece.encode("utf-8", "surrogatepass"), np.uint8)
        cut[b[:-1], b[1:]] = False
    cut[:, [SPACE, LINE]] = cut[LINE] = True  # pre-tokens start at spaces and line ends, and end with the latter
    cut[:, 128:192] = False  # the bytes of one character
    return cut.ravel()


def _words(texts: pa.Array, cut: np.ndarray):
    """(first document, end document, words of these documents, word at which each document begins), in blocks."""
    data, offsets = encoded(texts)
    for i, j in slices(offsets, BLOCK):
        own, ends = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        start = np.ones(len(own) + 1, bool)
        if len(own):
            start[1:-1] = cut[own[:-1].astype(np.uint16) << 8 | own[1:]]
            start[ends] = True
        at = np.flatnonzero(start)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(own)])
        yield i, j, words, np.searchsorted(at, ends)
    pa.default_memory_pool().release_unused()


def _strings(words: pa.Array) -> pa.Array:
    return words.cast(pa.binary()).view(pa.string())


def distinct_words(docs: DataFrame, cut: np.ndarray) -> DataFrame:
    """(word, n): every word once, and how many blocks of documents hold it."""

    def words(batches):
        for batch in batches:
            for _, _, found, _ in _words(batch.column(0), cut):
                yield pa.record_batch([_strings(found.unique())], ["word"])

    return docs.select("text").mapInArrow(words, "word string").groupBy("word").agg(F.count("*").alias("n"))


def encode_words(words: DataFrame, model: str, parts: int) -> DataFrame:
    """Distinct (wid, word, n) -> with ids, the best cut of each word into pieces; folded in `parts` tasks, about."""
    pieces, of_byte, unknown = P.load(model)
    table = F.broadcast(piece_table(words.sparkSession, pieces))  # bounded by the vocabulary
    longest = max(map(len, pieces))
    words = words.where("word <> ''").repartition(parts, "wid")

    def lattice(chunks: DataFrame) -> DataFrame:
        """Edges by wid and chunk. Positions count from `base`; a chunk has the edges that end in it."""
        ends = chunks.select("wid", "chunk", "base", "part", F.explode(F.expr(f"sequence(chunk * {CHUNK} - base + 1, char_length(part))")).alias("e"))
        spans = ends.select("wid", "chunk", "base", "e", "part", F.explode(F.expr(f"sequence(greatest(e - {longest}, 0), e - 1)")).alias("s"))
        spans = spans.select("wid", "chunk", "base", "e", "s", F.expr("substring(part, s + 1, e - s)").alias("piece")).withColumn("h", F.xxhash64("piece"))
        edges = spans.join(table, (spans["h"] == table["h"]) & (F.col("piece") == F.col("of_piece")), "left").where("id is not null or e = s + 1")
        # the id of a character without a piece is -1 - code point; its bytes are written at the end
        edge = F.struct("e", "s", F.coalesce("score", F.lit(float(unknown))).alias("score"), F.coalesce("id", -1 - F.ascii("piece")).alias("id"))
        return edges.groupBy("wid", "chunk", "base").agg(F.sort_array(F.collect_list(edge)).alias("edges"))

    short = lattice(words.where(f"char_length(word) <= {CHUNK}").select("wid", F.lit(0).alias("chunk"), F.lit(0).alias("base"), F.col("word").alias("part")))
    short = short.select("wid", F.array(F.struct("chunk", "base", "edges")).alias("chunks"))
    long = words.where(f"char_length(word) > {CHUNK}").select("wid", "word", F.explode(F.expr(f"sequence(0, cast((char_length(word) - 1) div {CHUNK} as int))")).alias("chunk"))
    long = long.withColumn("base", F.expr(f"greatest(chunk * {CHUNK} - {longest}, 0)"))
    long = lattice(long.select("wid", "chunk", "base", F.expr(f"substring(word, base + 1, (chunk + 1) * {CHUNK} - base)").alias("part")))
    long = long.groupBy("wid").agg(F.sort_array(F.collect_list(F.struct("chunk", "base", "edges"))).alias("chunks"))
    # the fold of a chunk: f has the best score to each position from base on and w the last edge to each end, its
    # start and id in one long. Edges come by end and then by start; the best to the current end stays apart in
    # b and v until the next end comes
    way = f"x.s * 4294967296L + x.id + {LOWEST}"
    inner = f"""aggregate(c.edges,
        struct(t.tail as f, cast(array() as array<bigint>) as w, double('-Infinity') as b, 0L as v),
        (a, x) -> if(size(a.f) = x.e,
            if(a.f[x.s] + x.score > a.b, struct(a.f as f, a.w as w, a.f[x.s] + x.score as b, {way} as v), a),
            struct(array_append(a.f, a.b) as f, array_append(a.w, a.v) as w,
                if(x.s = size(a.f), a.b, a.f[x.s]) + x.score as b, {way} as v)),
        a -> struct(array_append(a.f, a.b) as f, array_append(a.w, a.v) as w))"""
    fold = f"""aggregate(chunks, struct(array(0D) as tail, cast(array() as array<array<bigint>>) as ways),
        (t, c) -> transform(array({inner}), r -> struct(
            slice(r.f, -least(size(r.f), {longest + 1}), least(size(r.f), {longest + 1})) as tail,
            array_append(t.ways, r.w) as ways))[0], t -> t.ways)"""
    # from the end of the word back, chunk by chunk
    back = f"""aggregate(sequence(size(ways) - 1, 0), struct(cast((size(ways) - 1) * {CHUNK} + size(ways[size(ways) - 1]) as bigint) as at, cast(array() as array<array<int>>) as ids),
        (b, k) -> transform(array(aggregate(ways[k], struct(b.at as at, cast(array() as array<int>) as ids),
            (u, ignored) -> if(u.at <= k * {CHUNK}L, u, struct(
                shiftright(ways[k][cast(u.at - k * {CHUNK}L - 1 as int)], 32) + greatest(k * {CHUNK}L - {longest}, 0L) as at,
                array_prepend(u.ids, cast((ways[k][cast(u.at - k * {CHUNK}L - 1 as int)] & 4294967295L) - {LOWEST} as int)) as ids)))),
            u -> struct(u.at as at, array_prepend(b.ids, u.ids) as ids))[0],
        b -> flatten(b.ids))"""
    # UTF-8 of a code point, a byte each
    spelled = """transform(
        case when (-1 - i) < 128 then array(-1 - i)
             when (-1 - i) < 2048 then array(192 + shiftright(-1 - i, 6), 128 + ((-1 - i) & 63))
             when (-1 - i) < 65536 then array(224 + shiftright(-1 - i, 12), 128 + (shiftright(-1 - i, 6) & 63), 128 + ((-1 - i) & 63))
             else array(240 + shiftright(-1 - i, 18), 128 + (shiftright(-1 - i, 12) & 63), 128 + (shiftright(-1 - i, 6) & 63), 128 + ((-1 - i) & 63)) end,
        b -> OF_BYTE[b])""".replace("OF_BYTE", f"array({','.join(map(str, of_byte))})")
    followed = short.union(long).select("wid", F.expr(f"transform(array({fold}), ways -> {back})[0]").alias("ids"))
    ids = followed.select("wid", F.expr(f"if(exists(ids, i -> i < 0), flatten(transform(ids, i -> if(i >= 0, array(i), {spelled}))), ids)").alias("ids"))
    return words.join(ids.hint("merge"), "wid")


@F.arrow_udf(LongType())
def word_hash(word: pa.Array) -> pa.Array:
    data, offsets = encoded(word)
    return pa.array(hashes(data, offsets[:-1], offsets[1:]).view(np.int64))


def _shared(words: DataFrame) -> list:
    """The dictionary as broadcast runs of ascending hashes. Executors pack a run; the driver passes one on at a
    time and keeps none. Words that share a hash are left out; they count as rare."""

    def pack(batches):
        h, sizes, flat = [], [], []
        for batch in batches:
            h.append(batch.column(0).to_numpy())
            ids = batch.column(1)
            sizes.append(np.diff(ids.offsets.to_numpy()))
            flat.append(ids.flatten().to_numpy())
        if h:
            h, sizes, flat = np.concatenate(h), np.concatenate(sizes), np.concatenate(flat)
            same = np.zeros(len(h), bool)
            same[1:] = h[1:] == h[:-1]
            same[:-1] |= same[1:]
            flat, h, sizes = flat[~np.repeat(same, sizes)], h[~same], sizes[~same]
            small = np.uint16 if flat.max(initial=0) < 1 << 16 else np.uint32
            head = np.array([len(h), np.dtype(small).itemsize], np.int64).tobytes()
            ends = np.r_[0, np.cumsum(sizes)].astype(np.uint32)
            if len(h):
                yield pa.record_batch([pa.array([head + h.tobytes() + ends.tobytes() + flat.astype(small).tobytes()], pa.binary())], ["run"])

    runs = words.select(word_hash("word").alias("h"), "ids").repartitionByRange(RUNS, "h").sortWithinPartitions("h").mapInArrow(pack, "run binary")
    return [words.sparkSession.sparkContext.broadcast(bytes(row.run)) for row in save(runs, "runs").toLocalIterator()]


class Dictionary:
    """Ids of words by their hashes, read where the broadcast runs lie."""

    def __init__(self, shared: list):
        self.runs = []
        for b in shared:
            n, width = (int(x) for x in np.frombuffer(b.value, np.int64, 2))
            keys, ends = np.frombuffer(b.value, np.int64, n, 16), np.frombuffer(b.value, np.uint32, n + 1, 16 + 8 * n)
            self.runs.append((keys, ends, np.frombuffer(b.value, np.uint16 if width == 2 else np.uint32, int(ends[-1]), 20 + 12 * n)))
        self.runs.sort(key=lambda run: run[0][0])
        self.least = np.array([keys[0] for keys, _, _ in self.runs], np.int64)

    def places(self, words: pa.Array):
        """For each run the words that it knows and their places in it."""
        data, offsets = encoded(words.view(pa.large_string()))
        h = hashes(data, offsets[:-1], offsets[1:]).view(np.int64)
        run = np.searchsorted(self.least, h, "right") - 1
        for k, (keys, ends, flat) in enumerate(self.runs):
            at = np.flatnonzero(run == k)
            place = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
            hit = keys[place] == h[at]
            yield at[hit], place[hit], ends, flat

    def rare(self, words: pa.Array) -> np.ndarray:
        """Whether a word is not here."""
        out = np.ones(len(words), bool)
        for at, *_ in self.places(words):
            out[at] = False
        return out

    def of(self, words: pa.Array) -> pa.Array:
        """List of ids for each word, null where it is not here."""
        size, found, known = np.zeros(len(words), np.int64), [], np.zeros(len(words), bool)
        for at, place, ends, flat in self.places(words):
            start = ends[place].astype(np.int64)
            known[at], size[at] = True, ends[place + 1] - start
            found.append((at, start, flat))
        edge = np.r_[0, np.cumsum(size)]
        out = np.zeros(edge[-1], np.int32)
        for at, start, flat in found:
            n = size[at]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(edge[at], n) + within] = flat[np.repeat(start, n) + within]
        return pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(out), mask=pa.array(~known))


def encode(docs: DataFrame, model: str | None = None, shared_bytes: int = SHARED_BYTES, decoded: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (array of int) of the whole text.

    shared_bytes: most bytes of the broadcast part of the dictionary. decoded: also `text`, decoded from the ids
    by the worker that has just put them together, a block at a time: Spark would pass them on to `decode` in batches
    of up to 10,000 whole documents or 64 MB, which its own memory and another worker's both hold. Null and empty texts have no tokens. Very
    long texts and words are encoded whole; a word without a cut takes memory in proportion to its length in one
    task. Null doc_ids and repeated rows each keep their row. Ties of scores go to the earliest start. Empty
    table: an empty result. Other columns are ignored, whatever their names.
    """
    model = model or P.default_model()
    cut = cuts(P.load(model)[0])
    words = save(distinct_words(docs, cut).withColumn("wid", F.monotonically_increasing_id()), "words")
    parts = max(1, -(-words.count() // WORDS_A_TASK))
    words = save(encode_words(words, model, parts), "dictionary")
    # a row per number of blocks: which words, by that number, are frequent enough to be shared
    held = words.groupBy("n").agg(F.sum(12 + 2 * F.size("ids")).alias("bytes")).orderBy(F.desc("n")).toLocalIterator()
    total, least = 0, None
    for row in held:
        total += row.bytes
        if total > shared_bytes:
            least = row.n + 1
            break
    shared = _shared(words if least is None else words.where(F.col("n") >= least))

    def has_rare(rare: np.ndarray, first: np.ndarray) -> np.ndarray:
        so_far = np.r_[0, np.cumsum(rare)]
        return so_far[first[1:]] > so_far[first[:-1]]

    def with_rare(batches):
        known = Dictionary(shared)
        for batch in batches:
            for i, j, found, first in _words(batch.column(1), cut):
                coded = found.dictionary_encode()
                which = has_rare(known.rare(coded.dictionary)[coded.indices.to_numpy()], first)
                yield pa.RecordBatch.from_arrays([c[i:j].filter(pa.array(which)) for c in batch.columns], ["doc_id", "text"])

    def look_up(batches):
        known = Dictionary(shared)
        spelled = speller(shared_spelling.value) if decoded else None
        for batch in batches:
            for i, j, found, first in _words(batch.column(1), cut):
                coded = found.dictionary_encode()
                ids = known.of(coded.dictionary)
                which = has_rare(ids.is_null().to_numpy(zero_copy_only=False)[coded.indices.to_numpy()], first)
                taken = ids.take(coded.indices)
                whole = pa.ListArray.from_arrays(pa.array(taken.offsets.to_numpy()[first]), taken.values)
                doc, whole = (c.filter(pa.array(~which)) for c in (batch.column(0)[i:j], whole))
                yield pa.record_batch({"doc_id": doc, "ids": whole} | ({"text": spelled(whole)} if decoded else {}))

    rows, doc_id = docs.select("doc_id", "text"), docs.schema["doc_id"]
    shared_spelling = docs.sparkSession.sparkContext.broadcast(spelling(model)) if decoded else None
    text = [StructField("text", StringType())] * decoded
    told = rows.mapInArrow(look_up, StructType([doc_id, StructField("ids", ArrayType(IntegerType())), *text]))
    # nothing is stored but the texts with rare words; a document is looked up twice instead
    rare = save(rows.mapInArrow(with_rare, StructType([doc_id, StructField("text", StringType())])), "rare")
    if not rare.isEmpty():
        joined = _by_join(rare, words, shared, cut)
        told = told.union(decode(joined, model) if decoded else joined)
    free(docs.sparkSession)
    return told.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), *told.columns[1:])


def _by_join(docs: DataFrame, words: DataFrame, shared: list, cut: np.ndarray) -> DataFrame:
    """(doc_id, ids) of documents with rare words: runs of shared words come with their ids, each rare word meets
    the dictionary by shuffle, and a document's parts are put together in their order."""
    rows = save(docs.select("doc_id", "text", F.expr("uuid()").alias("row")), "rows")

    def parts(batches):
        known = Dictionary(shared)
        for batch in batches:
            for i, j, found, first in _words(batch.column(1), cut):
                coded = found.dictionary_encode()
                ids = known.of(coded.dictionary)
                rare = ids.is_null().to_numpy(zero_copy_only=False)[coded.indices.to_numpy()]
                # a part is one rare word, or the shared words between two of them, within a document
                start = np.ones(len(found) + 1, bool)
                start[1:-1] = rare[1:] | rare[:-1]
                start[first] = True
                at = np.flatnonzero(start)
                if len(at) < 2:
                    continue
                taken = ids.take(coded.indices)
                one = pa.array(rare[at[:-1]])
                run = pa.ListArray.from_arrays(pa.array(taken.offsets.to_numpy()[at]), taken.values, mask=one)
                word = pa.array(np.where(rare[at[:-1]], at[:-1], -1), mask=~rare[at[:-1]])
                of = np.searchsorted(first, at[:-1], "right") - 1
                yield pa.record_batch([batch.column(0).take(pa.array(i + of)), pa.array(at[:-1]), _strings(found.take(word)), run], ["row", "pos", "word", "run"])

    placed = save(rows.select("row", "text").mapInArrow(parts, "row string, pos long, word string, run array<int>"), "parts")
    found = placed.where("word is not null").drop("run").join(words.select("word", "ids").hint("merge"), "word").select("row", "pos", "ids")
    every = placed.where("word is null").select("row", "pos", F.col("run").alias("ids")).union(found)
    ids = every.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("w")).select("row", F.flatten("w.ids").alias("ids"))
    return rows.join(ids.hint("merge"), "row", "left").select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def spelling(model: str) -> dict[int, bytes]:
    """The bytes that each id stands for."""
    pieces, of_byte, _ = P.load(model)
    return {i: p.encode("utf-8", "surrogatepass") for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(of_byte)}


def speller(of_id: dict[int, bytes]):
    """A function from lists of ids to the texts that they spell. Null ids: null. Unknown ids: an error."""
    size = np.zeros(max(of_id) + 1, np.int64)
    for i, b in of_id.items():
        size[i] = len(b)
    start = np.r_[0, np.cumsum(size)]
    letters = np.frombuffer(b"".join(of_id.get(i, b"") for i in range(len(size))), np.uint8)

    def text(ids: pa.ListArray) -> pa.Array:
        out = [pa.array([], pa.string())]
        offsets = ids.offsets.to_numpy().astype(np.int64)
        for i, j in slices(offsets, BLOCK // 16):
            own = ids.values.to_numpy()[offsets[i] : offsets[j]] if offsets[j] > offsets[i] else np.zeros(0, np.int32)
            n = size[own]
            if (n == 0).any():
                raise ValueError("an id that the vocabulary does not have")
            ends = np.r_[0, np.cumsum(n)]
            data = letters[np.arange(ends[-1]) - np.repeat(ends[:-1] - start[own], n)]
            at = ends[offsets[i : j + 1] - offsets[i]].astype(np.int32)
            null = ids[i:j].is_null().to_numpy(zero_copy_only=False)
            valid = pa.py_buffer(np.packbits(~null, bitorder="little"))
            out.append(pa.StringArray.from_buffers(j - i, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data)), valid))
        return pa.concat_arrays(out)

    return text


def decode(tokens: DataFrame, model: str | None = None, column: str = "ids") -> DataFrame:
    """tokens with the column `text` that its ids spell. Null ids: null. Unknown ids: an error."""
    shared = tokens.sparkSession.sparkContext.broadcast(spelling(model or P.default_model()))

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        spelled = speller(shared.value)
        for ids in batches:
            yield spelled(ids)

    return tokens.withColumn("text", text(F.col(column)))
