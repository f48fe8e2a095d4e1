"""Token files, the Merkle manifest and spelling variants against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import huffman_ids, merkle, spelling

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n", "a", "a", "Wort für WORT", "x" * 3000, "zwei  Leer\tzeichen \n", "ein ▁ Zeichen 😀 ́", "Don't <|endoftext|> ÀÇ é"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, [None, "de", "en"][i % 3], None if i % 3 == 0 else "s", None if i == 4 else i) for i, t in enumerate(ODD)]
    rows += [(None, "kein Name", None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (1, "other TEXT", "en", "s", 0)]
    return spark.createDataFrame(rows, DOC).withColumn("n", F.lit(1)).withColumn("tree", F.lit(2)).withColumn("id", F.lit(3)).withColumn("word", F.lit(4)).withColumn("ids", F.lit(5))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def first(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=str)


# 11 token files


def plain_files(rows):
    """doc_id, start, n_tokens, ids_crc32 by the library alone, rows in the order of doc_id and the tie's hash."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(huffman_ids.default_tokenizer())
    t.encode_special_tokens = True
    start, out = 0, []
    for doc, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def ordered(docs):
    return [(r.doc_id, r.text) for r in docs.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64(F.coalesce("text", F.lit("")))).collect()]


def test_token_files_hold_what_the_library_gives(spark, odd, none):
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet").repartition(5)):
        got = huffman_ids.token_files(docs)
        assert first(got.collect(), *got.columns) == sorted(plain_files(ordered(docs)), key=str)
    assert huffman_ids.token_files(none).count() == 0


def test_encoder_cuts_no_token(monkeypatch):
    import random

    r = random.Random(5)
    parts = [*"aZkK'09!(\u0301\u0331 \n\t\x0b\x1c\x85\xa0\u3000éßΣİſK中😀<|>_", "'s", "'RE", "don't", "H\u0331", "e\u0301", "<|endoftext|>", "ABC", "xyz", "\U000e0001", "한", "\u1100\u1161"]
    texts = ["".join(r.choices(parts, k=r.randrange(0, 40))) for _ in range(1500)] + ["", "'", "a", "A"]
    monkeypatch.setattr(huffman_ids, "KEPT", 900)
    encoder = huffman_ids.Encoder(huffman_ids.default_tokenizer())
    encoder.texts(*huffman_ids.encoded(pa.array(texts[::3])), 1)
    data, ends = huffman_ids.encoded(pa.array(texts))
    ids, place = encoder.texts(data, ends, 1)
    for k, text in enumerate(texts):
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert ids[place[k] : place[k + 1]].tolist() == [*want, 1], repr(text)
    with pytest.raises(ValueError):
        huffman_ids.Encoder(huffman_ids.default_tokenizer().replace("word_bpe_49k", "byte_bpe_50k"))


def test_token_files_in_small_blocks_and_ids_read_back(spark, odd, tmp_path):
    tokens = huffman_ids.save(huffman_ids.token_ids(odd, huffman_ids.default_tokenizer()), "ids")
    huffman_ids.write(tokens, str(tmp_path / "f"), 2, block_ids=20)
    assert spark.read.parquet(str(tmp_path / "f/blocks")).count() > 3
    back = huffman_ids.read(spark, str(tmp_path / "f"))
    given = [(r.doc_id, np.frombuffer(bytes(r.ids), "<u2").tolist()) for r in tokens.collect()]
    assert first(back.collect(), "doc_id", "ids") == sorted(given, key=str)
    starts = {(r.file, r.block): r.start for r in huffman_ids.block_starts(spark, str(tmp_path / "f")).collect()}
    spans = sorted((starts[r.file, r.block] + r.before, len(r.ids)) for r in back.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0


def plain_lengths(counts):
    """Total bits of an unlimited Huffman code, by a heap."""
    import heapq

    heap, total = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    return total


@pytest.mark.parametrize("seed", range(6))
def test_code_lengths(seed):
    r = np.random.default_rng(seed)
    counts = (r.pareto(0.5, r.integers(2, 400)) * 3).astype(np.int64) + 1
    free = huffman_ids.code_lengths(counts, 60)
    assert (free * counts).sum() == plain_lengths(counts.tolist()) and (2.0**-free).sum() == 1
    for limit in (9, 12):
        held = huffman_ids.code_lengths(counts, limit)
        assert held.max() <= limit and (2.0**-held).sum() <= 1 and (held * counts).sum() >= (free * counts).sum()
    assert huffman_ids.code_lengths(np.array([5])).tolist() == [1] and huffman_ids.code_lengths(np.zeros(0, np.int64)).tolist() == []
    fib = np.array([1, 1, 2, 3, 5, 8, 13, 21])  # the best limited code, found by trying all lengths
    best = min(sum(a * b for a, b in zip(fib, ls)) for ls in np.ndindex(*[4] * 8) if sum(2.0 ** -(x + 1) for x in ls) <= 1 for ls in [[x + 1 for x in ls]])
    assert (huffman_ids.code_lengths(fib, 4) * fib).sum() == best


def test_codes_are_canonical_and_unpack_at_checkpoints():
    r = np.random.default_rng(1)
    ids = np.unique(r.integers(0, 60_000, 900))
    code = huffman_ids.Code(ids, huffman_ids.code_lengths(r.integers(1, 10**6, len(ids)), 15))
    words = [(n, i, format(code.code_of[i], f"0{n}b")) for n, i in zip(code.lengths, code.ids)]
    assert words == sorted(words) and [w for *_, w in words] == sorted(w for *_, w in words) and set(words[0][2]) == {"0"}
    seq = r.choice(ids, 1000).astype(np.int32)
    at, bits = code.pack(seq)
    text = "".join(format(code.code_of[i], f"0{code.length_of[i]}b") for i in seq)
    assert bits == int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")
    assert (huffman_ids.unpack(bits, at, len(seq), code, code.tables()) == seq).all()
    assert (huffman_ids.unpack(bits, at[3:], len(seq) - 3 * huffman_ids.STEP, code, code.tables()) == seq[3 * huffman_ids.STEP :]).all()


# 12 Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """{(doc_id, leaf): row} and the root, by a loop; rows of one doc_id in the order of their leaves."""

    def leaf(r, text):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))

    def tree(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def way(levels, i):
        for level in levels[:-1]:
            run = i // 8 * 8
            yield level[run:i], level[i + 1 : run + 8]
            i //= 8

    by_lang = {}
    for r in rows:
        by_lang.setdefault(r.lang, []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for x in langs:
        by_lang[x].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees.append(tree([leaf(r, r.text) for r in by_lang[x]]))
    top, out = tree([t[-1][0] for t in trees]), []
    for k, (x, t) in enumerate(zip(langs, trees)):
        for i, r in enumerate(by_lang[x]):
            steps = [*way(t, i), *way(top, k)]
            touched = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None
            fold = leaf(r, re.sub("[A-Z]", lambda m: m[0].lower(), r.text)) if touched else t[0][i]
            for left, right in steps:
                fold = h(*left, fold, *right)
            out.append((r.doc_id, t[0][i], t[-1][0], top[-1][0], h(*(d for s in steps for part in s for d in part)), fold, fold == top[-1][0]))
    return out


def test_manifest_against_a_loop(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    cases = [odd, docs, odd.limit(1), docs.where("doc_id <= 8").withColumn("lang", F.lit("x")), docs.withColumn("lang", F.concat("lang", (F.col("doc_id") % 70).cast("string")))]
    for rows in cases:
        got = merkle.manifest(rows)
        assert first(got.collect(), "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified") == sorted(plain_manifest(rows.collect()), key=str)
    assert merkle.manifest(none).count() == 0


def test_manifest_joins_without_broadcast(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(plain_manifest(docs.collect()), key=str)
    monkeypatch.setattr(merkle, "SHARED_BYTES", 0)
    got = merkle.manifest(docs)
    assert first(got.collect(), "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified") == want
    assert all(r.verified for r in got.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 0).collect()) and not all(r.verified for r in got.collect())


# 13 spelling variants


def plain_words(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            c = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: c % len(run)] + run[c % len(run) + 1 :] if c % 31 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_variants(n):
    """By comparing all words of like length."""
    near = {w: [] for w in n}
    ws = sorted(n, key=len)
    for i, a in enumerate(ws):
        for b in ws[i + 1 :]:
            if len(b) > len(a) + 1:
                break
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def test_variants_against_all_pairs(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for rows in (docs, odd):
        n = plain_words([(r.doc_id, r.text) for r in rows.collect()])
        got = spelling.variants(rows)
        assert first(got.collect(), "word", "form", "root", "n", "n_near", "form_n") == sorted(plain_variants(n), key=str)
    assert spelling.variants(none).count() == 0


@pytest.mark.parametrize("count, bits, block", [(2, 8, 50), (8, 27, 2_000_000), (40, 12, 7)])
def test_variants_follow_forms_and_keep_long_words(spark, monkeypatch, count, bits, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    long = "a" * 5000
    n = {"strasse": 1000, "strassx": 100, "strassxy": 10, "strassen": 1000, "trassen": 2, "strässe": 100, "aaaaaaa": 40, "aaaaaaaa": 4, "aaaaaaab": 40, long: 30, long[1:]: 3, long[1:] + "b": 30, "bcdefgh": 2}
    texts = [" ".join([w] * k) for w, k in n.items()]
    docs = spark.createDataFrame([(next(i for i in range(1000 * k, 10**6) if all(zlib.crc32(f"{i}:{w}".encode()) % 31 for w in t.split())), t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = spelling.variants(docs, count, bits)
    rows = got.collect()
    assert first(rows, "word", "form", "root", "n", "n_near", "form_n") == sorted(plain_variants({w: k for w, k in n.items()}), key=str)
    assert {r.word: r.root for r in rows}["strassxy"] == "strasse"


def test_reduced_words_are_looked_up_by_every_neighbour():
    r = np.random.default_rng(3)
    ws = ["".join(r.choice(list("abcdef"), r.integers(1, 9))) for _ in range(60)]
    key = dict(zip(ws, spelling.keys(pa.array(ws))))
    for k, w in enumerate(ws):
        found = np.concatenate([keys[of == k] for of, keys in spelling.neighbourhoods(pa.array(ws))])
        assert all(key[v] in found for v in ws if v == w or one_edit(v, w))


# identity and attributes


def test_attributes_are_read_one_by_one():
    from tidemark.llm.html_text import main_text

    text = "<p>Real article text here.</p>"
    for attrs in ('title="not hidden text"', 'data-x="see id=menu now"', "alt='a class=footer' id=a", "data-tip=\"is hidden now\" class='body'", 'title="a > b" x', "title='role=\"menu\"'"):
        assert main_text(f"<div {attrs}>{text}</div>") == "Real article text here.", attrs
        assert main_text(f"<article>{text}<div {attrs}><p>More.</p></div></article>") == "Real article text here.\nMore.", attrs
    for attrs in ('class="footer"', "x=1 id=menu", "hidden", 'hidden=""', "aria-hidden=true", 'data-a="b" role="navigation"'):
        assert main_text(f"<div>{text}</div><div {attrs}><p>Cut</p></div>") == "Real article text here.", attrs
    assert main_text('<div class="footer"><p>Copyright only</p></div>') == ""


def test_texts_that_meet_in_one_hash_are_kept_apart(spark):
    from tidemark.llm import simhash

    docs = spark.createDataFrame([(i, f"word{i} alone{i} here{i} with{i} five{i} more{i}") for i in range(40)] + [(50, "word3 alone3 here3 with3 five3 more3")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs, bits=3).collect()}
    assert got == {i: i for i in range(40)} | {50: 3}


def test_mixed_tells_rows_apart_by_all_their_columns(spark):
    from tidemark.llm import mixing

    rows = [(i, "one two three", "s", x) for i in range(30) for x in (None, "", "c1", '"')]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other string")
    got = mixing.mixed(docs).groupBy("doc_id", "other").count().collect()
    assert len(got) == 120 and sum(r["count"] for r in got) == pytest.approx(180, abs=1)
