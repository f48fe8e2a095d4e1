"""Token ids in a compact binary file: canonical, length-limited Huffman codes of ids from global counts.

Texts are encoded by a public tokenizer, each distinct word once while a worker keeps it. Ids are counted over the whole corpus;
the counts, one per id of the vocabulary, give code lengths of at most `LIMIT` bits by merging packages, and the
lengths alone give the canonical codes. The documents, in ascending order of doc_id, are dealt out by ranges, and every
range writes a file of blocks. A block can be decoded by itself: it holds whole documents, their numbers of ids, the
bits, and the bit offset of every `STEP`-th id as a checkpoint. A decoder looks `longest` bits up in a table, and
does so at all checkpoints of a block at once.

A folder of the format holds three Parquet tables, which Spark's committer writes and reads in any store:

    blocks  file int, block int, doc_ids array<long>, n_ids array<int>, checkpoints array<long>, bits binary
    codes   id int, length int: canonical order is (length, id), the first code is all zeros
    files   file int, ids long, first long: ids in a file and in all files before it
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import encoded, save, shared_dir, slices

END = 1
LIMIT = 20
#: Ids between two checkpoints.
STEP = 128
#: A block is closed at so many ids; a longer document has a block of its own.
BLOCK_IDS = 1 << 17
#: Bytes of text that are encoded at once.
BLOCK = 2_000_000
#: Words whose ids a worker keeps.
KEPT = 400_000
SPACES = np.isin(np.arange(256), [9, 10, 13, 32])
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
LETTERS = UPPER | (np.arange(256) >= 97) & (np.arange(256) <= 122)
#: ASCII characters that part from letters on either side; an apostrophe keeps what follows it.
OTHERS = (np.arange(256) < 128) & ~LETTERS
BEFORE = OTHERS & (np.arange(256) != 39)
SMALL = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
RUN = re.compile(f"[{SMALL}]+").fullmatch


def default_tokenizer() -> str:
    return os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers") + "/word_bpe_49k.json"


class Encoder:
    """Ids of texts by a tokenizer that folds case, drops white space and parts letters from other characters.

    Texts are cut at ASCII white space and between ASCII letters and other ASCII characters, where no token and no
    normalisation crosses, capitals before another ASCII character are folded first, and each distinct word is
    encoded once while it is among the `KEPT` that a worker holds: a run of small letters, which such a tokenizer leaves together, by its model alone.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        probe = "abcdefghijklmnopqrstuvwxyz"
        parts = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(f"{probe} {probe}!?{probe}9")]
        normal = self.tokenizer.normalizer
        if normal is None or normal.normalize_str(probe.upper()) != probe or parts != [probe, probe, "!?", probe, "9"]:
            raise ValueError(f"{path} does not part words as assumed here")
        # what the pre-tokenizer makes of each small letter of Latin-1, for runs of which nothing else is to be done
        self.known: dict[bytes, int] = {}
        self.ids, self.first = array("i"), array("q", [0])
        self.written = str.maketrans({c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in SMALL})

    def places(self, words: list[bytes]) -> np.ndarray:
        """Where the words stand among those kept, after encoding those that are not; a full store starts anew."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KEPT:
            self.known, self.ids, self.first, new = {}, array("i"), array("q", [0]), words
        model, texts = self.tokenizer.model, [w.decode("utf-8", "replace") for w in new]
        out = [[t.id for t in model.tokenize(w.translate(self.written))] if RUN(w) else None for w in texts]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for k in range(0, len(rest), 2_000):
            part = rest[k : k + 2_000]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([texts[i] for i in part], add_special_tokens=False)):
                out[i] = e.ids
        for w, ids in zip(new, out):
            self.known[w] = len(self.known)
            self.ids.extend(ids)
            self.first.append(len(self.ids))
        return np.fromiter((self.known[w] for w in words), np.int64, len(words))

    def texts(self, data: np.ndarray, ends: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents data[ends[i]:ends[i + 1]], each followed by `end`, and where each begins."""
        start = np.zeros(len(data) + 1, bool)
        space = SPACES[data]
        start[1:-1] = space[:-1] | LETTERS[data[:-1]] & OTHERS[data[1:]] | BEFORE[data[:-1]] & LETTERS[data[1:]]
        start[ends] = True
        kept = ~space
        to = np.r_[0, np.cumsum(kept)]  # places without white space
        own = data[kept]
        at = np.r_[to[np.flatnonzero(start)], len(own)]
        at = at[np.r_[True, at[1:] != at[:-1]]]
        fold = np.flatnonzero(UPPER[own])
        own[fold[np.r_[own, 0][fold + 1] < 128]] |= 32
        cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(own)]).dictionary_encode()
        places, of = self.places(cut.dictionary.to_pylist()), cut.indices.to_numpy()
        first = np.array(self.first)
        size, first = np.diff(first)[places], first[places]
        n = size[of]
        so_far = np.r_[0, np.cumsum(n)]
        out = np.array(self.ids, np.int32)[np.repeat(first[of] - so_far[:-1], n) + np.arange(so_far[-1])]
        place = so_far[np.searchsorted(at, to[ends])]
        return np.insert(out, place[1:], end), place + np.arange(len(ends))


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """A worker's encoder; its words outlive a task."""
    return Encoder(path)


def width_of(path: str) -> int:
    """Bytes in which an id of the tokenizer fits."""
    return 2 if encoder_of(path).tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def token_ids(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(doc_id, tie, ids): the ids of every whole text, `end` appended, as little-endian numbers of width_of(path) bytes; tie, a
    hash of the text, orders rows of one doc_id."""
    width = width_of(path)

    def ids(batches):
        encoder = encoder_of(path)
        for batch in batches:
            data, offsets = encoded(batch.column(2))
            for i, j in slices(offsets, BLOCK):
                values, place = encoder.texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end)
                column = pa.BinaryArray.from_buffers(pa.binary(), len(place) - 1, [None, pa.py_buffer((width * place).astype(np.int32)), pa.py_buffer(values.astype(f"<u{width}"))])
                yield pa.record_batch([batch.column(0)[i:j], batch.column(1)[i:j], column], ["doc_id", "tie", "ids"])
            pa.default_memory_pool().release_unused()

    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(ids, "doc_id long, tie long, ids binary")


def numbers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column without nulls, in a row, and where each value begins."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(column) and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return data.view(f"<u{width}"), (ends - ends[0]) // width if len(column) else np.zeros(1, np.int64)


def counts_of(tokens: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their counts in all documents; an entry per id of the vocabulary comes to the driver."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(numbers(batch.column(0), width)[0], minlength=len(total))
            n[: len(total)] += total
            total = n
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held, pa.int32()), pa.array(total[held])], ["id", "n"])

    found = tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow().sort_by("id")
    return found.column("id").to_numpy(), found.column("n").to_numpy()


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths, at most `limit`, of the shortest prefix code for these counts, by merging packages: on every level the
    items are the symbols and pairs of the cheapest items of the level below; a symbol's length is the number of levels on
    which it is among those taken."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    limit = max(limit, int(n - 1).bit_length())
    order = np.argsort(counts, kind="stable")
    own = counts[order].astype(np.int64)
    level, symbols = own, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([own, pairs])
        by = np.argsort(both, kind="stable")
        level = both[by]
        symbols.append(by < n)
    length, take = np.zeros(n, np.int64), 2 * n - 2
    for held in reversed(symbols):
        own_taken = int(held[:take].sum())
        length[:own_taken] += 1
        take = 2 * (take - own_taken)
    out = np.empty(n, np.int64)
    out[order] = length
    return out


class Code:
    """The canonical code of ids with these lengths."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.longest = int(self.lengths[-1]) if len(ids) else 1
        span = np.int64(1) << (self.longest - self.lengths)  # of the table's entries
        first = np.cumsum(span) - span
        top = int(self.ids.max()) + 1 if len(ids) else 0
        self.code_of, self.length_of = np.zeros(top, np.int64), np.zeros(top, np.int64)
        self.code_of[self.ids], self.length_of[self.ids] = first >> (self.longest - self.lengths), self.lengths
        self.span = span

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and length by the next `longest` bits."""
        left = (1 << self.longest) - int(self.span.sum())
        return np.r_[np.repeat(self.ids, self.span), np.zeros(left, np.int64)].astype(np.int32), np.r_[np.repeat(self.lengths, self.span), np.ones(left, np.int64)].astype(np.uint8)

    def pack(self, ids: np.ndarray, step: int = STEP) -> tuple[np.ndarray, bytes]:
        """Checkpoints, the bit offset of every step-th id, and the bits, the highest of a byte first."""
        size, code = self.length_of[ids], self.code_of[ids]
        ends = np.cumsum(size)
        at = ends - size
        window = code << (40 - size - (at & 7))  # 40 bits from the byte in which the code begins
        byte = at >> 3
        n = int(ends[-1] + 7) // 8 if len(ids) else 0
        out = np.zeros(n + 5)
        for k in range(5):  # codes share no bit, so sums are unions
            out += np.bincount(byte + k, (window >> (32 - 8 * k)) & 255, n + 5)
        return at[::step], out[:n].astype(np.uint8).tobytes()


def unpack(bits: bytes, checkpoints: np.ndarray, n: int, code: Code, tables, step: int = STEP) -> np.ndarray:
    """The n ids of a block, all checkpoints one id further at a time."""
    symbol, length = tables
    raw = np.concatenate([np.frombuffer(bits, np.uint8), np.zeros(5, np.uint8)]).astype(np.int64)
    window = sum(raw[k : len(raw) - 4 + k] << (32 - 8 * k) for k in range(5))
    at, out, mask, last = checkpoints.astype(np.int64), np.empty((len(checkpoints), step), np.int32), (1 << code.longest) - 1, len(window) - 1
    for k in range(step):
        entry = (window[np.minimum(at >> 3, last)] >> (40 - code.longest - (at & 7))) & mask
        out[:, k] = symbol[entry]
        at = at + length[entry]
    return out.ravel()[:n]


def _blocks(code: Code, block_ids: int, width: int):
    """Rows (doc_id, ids) of a sorted partition to rows of `blocks`."""
    names = ["file", "block", "doc_ids", "n_ids", "checkpoints", "bits"]
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]

    def run(batches):
        file, block, docs, held, waiting = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            checkpoints, bits = code.pack(np.concatenate(held))
            values = file, block, docs, [len(h) for h in held], checkpoints, bits
            return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds)], names)

        for batch in batches:
            flat, ends = numbers(batch.column(1), width)
            for k, doc in enumerate(batch.column(0).to_pylist()):
                own = flat[ends[k] : ends[k + 1]]
                if waiting and waiting + len(own) > block_ids:
                    yield row()
                    block, docs, held, waiting = block + 1, [], [], 0
                docs.append(doc)
                held.append(own.copy())
                waiting += len(own)
        if held:
            yield row()

    return run


def write(tokens: DataFrame, path: str, width: int, limit: int = LIMIT, block_ids: int = BLOCK_IDS) -> None:
    """Write (doc_id, tie, ids) in the format above to the folder `path`; ids: numbers of `width` bytes. tokens is read three times, so it is best a stored
    table. Rows of one doc_id stand in the order of tie; a range is never one key's, as the place of a row breaks ties."""
    spark = tokens.sparkSession
    ids, n = counts_of(tokens, width)
    lengths = code_lengths(n, limit)
    code = Code(ids, lengths)
    table = pa.table([pa.array(code.ids, pa.int32()), pa.array(code.lengths, pa.int32())], ["id", "length"])
    spark.createDataFrame(table, "id int, length int").coalesce(1).write.parquet(f"{path}/codes")
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("place")]
    rows = tokens.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    blocks = rows.mapInArrow(_blocks(code, block_ids, width), "file int, block int, doc_ids array<long>, n_ids array<int>, checkpoints array<long>, bits binary")
    # small row groups bound what a reader holds; coded bits do not shrink further
    blocks.write.option("compression", "none").option("parquet.block.size", 8 << 20).option("parquet.enable.dictionary", "false").parquet(f"{path}/blocks")
    of_file = F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, x: a + x)
    files = spark.read.parquet(f"{path}/blocks").groupBy("file").agg(F.sum(of_file).alias("ids"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files.withColumn("first", F.coalesce(F.sum("ids").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/files")


def _documents(spark, path: str, schema: str, columns_of, step: int = STEP) -> DataFrame:
    """A row per document of a folder: file, block and what columns_of(doc_ids, before, ids) gives for a block's documents;
    ids: all ids of the block, those of a document between its `before` and the next."""
    blocks = spark.read.parquet(f"{path}/blocks")
    codes = spark.read.parquet(f"{path}/codes").toArrow()  # a row per id of the vocabulary
    shared = spark.sparkContext.broadcast((codes.column("id").to_numpy(), codes.column("length").to_numpy()))
    names = [c.split()[0] for c in schema.split(", ")]

    def documents(batches: Iterator[pa.RecordBatch]):
        code = Code(*shared.value)
        tables = code.tables()
        for batch in batches:
            for k in range(batch.num_rows):
                file, block, docs, n, checkpoints, bits = (batch.column(c)[k] for c in range(6))
                n = n.values.to_numpy()
                ends = np.r_[0, np.cumsum(n, dtype=np.int64)]
                ids = unpack(bits.as_py(), checkpoints.values.to_numpy(), int(ends[-1]), code, tables, step)
                same = [pa.array(np.full(len(n), v.as_py(), np.int32)) for v in (file, block)]
                yield pa.record_batch([*same, *columns_of(docs.values, ends, ids)], names)
            pa.default_memory_pool().release_unused()

    return blocks.select("file", "block", "doc_ids", "n_ids", "checkpoints", "bits").mapInArrow(documents, schema)


def read(spark, path: str, step: int = STEP) -> DataFrame:
    """(file, block, doc_id, before, ids): every document of a folder; before: ids of earlier documents in its block."""

    def columns(docs, ends, ids):
        return docs, pa.array(ends[:-1]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))

    return _documents(spark, path, "file int, block int, doc_id long, before long, ids array<int>", columns, step)


def digests(spark, path: str, step: int = STEP) -> DataFrame:
    """(file, block, doc_id, before, n_tokens, ids_crc32): the ids of every document as their number and crc32, told where
    they are decoded."""

    def columns(docs, ends, ids):
        data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        return docs, pa.array(ends[:-1]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())

    return _documents(spark, path, "file int, block int, doc_id long, before long, n_tokens long, ids_crc32 long", columns, step)


def block_starts(spark, path: str) -> DataFrame:
    """(file, block, start): the ids of all documents before a block, from running sums in each file."""
    of_block = F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, x: a + x)
    blocks = spark.read.parquet(f"{path}/blocks").select("file", "block", of_block.alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = spark.read.parquet(f"{path}/files").select("file", "first")
    own = blocks.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("own"))
    return own.join(F.broadcast(files), "file").select("file", "block", (F.col("first") + F.col("own")).alias("start"))  # files: a row per file


def token_files(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """One row per document, from the files read back: doc_id, start, n_tokens, ids_crc32.

    path: the folder to write; without one, a new folder in the shared one. Null and empty texts have the end id only.
    Very long texts are encoded whole and stand in one block. Null doc_ids come first. Rows of one doc_id stand in the order
    of a hash of their texts; repeated rows each keep their place. Ties of counts: the smaller id has the earlier code.
    Empty table: empty files and an empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token_files-{uuid.uuid4().hex}"
    tokenizer = tokenizer or default_tokenizer()
    write(save(token_ids(docs, tokenizer), "ids"), path, width_of(tokenizer))
    starts = save(block_starts(spark, path), "starts")

    rows = digests(spark, path)
    return rows.join(starts.hint("merge"), ["file", "block"]).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
