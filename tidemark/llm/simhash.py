"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most `radius` bits share a variant within half the radius of each.
Whole 64-bit balls of radius 2 hold 2,081 variants, too many to shuffle for every document of a large
corpus, so the radius is first split over the two 32-bit halves: in one half the two differ in at most
two bits, so they share one of its 33 variants within one bit. Every distinct fingerprint emits these
66 keys; they are shuffled, and colliding pairs are deduplicated and verified on all 64 bits. A key that
more than `dense` fingerprints share would give too many pairs. Its members first emit their 64-bit
variants within one bit: members of one variant are all linked, so each of them needs one edge, to the
smallest. Only what a key holds outside its largest cluster is then compared with the key's members; a
key with much of that emits whole balls. No link is lost, and no group is expanded into all its pairs.

The pipeline removes by another rule: texts whose sets of five-word shingles have a Jaccard similarity of
0.8 or more. Two such texts differ in some 10 of 64 bits, which no ball covers, so the links above only
find the closest. Keys of 24 bands of four minimum hashes find the others: a pair at 0.8 shares none of
them with a probability of 3e-6. Every link, of either kind, is verified on the shingles themselves.
"""

from __future__ import annotations

from itertools import combinations, count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructType

from .common import fresh, save
from .components import components

#: The digest of op7_simhash.
WORDS = 4
RADIUS = 4
#: The pipeline's rule, and the bands of minimum hashes that find what the digest does not.
STAGE_WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 4
#: Tasks over which a crowded key is dealt; most members and shingles of a block, about.
SALTS = 32
BLOCK_ROWS = 256
BLOCK_SHINGLES = 250_000
_SEEDS = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)


def shingles(text: str | None, words: int):
    """Hashes of the runs of words in a text, in blocks; a shorter text is one run."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return
    whole = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    if len(parts) <= words:
        starts, ends = [0], [len(whole)]
    else:
        starts, ends = np.r_[0, ends[: -words] + 1].tolist(), ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), 65536):
        yield np.array([digest(whole[a:b], 42) for a, b in zip(starts[i : i + 65536], ends[i : i + 65536])], np.uint64)


def _folded(blocks) -> int:
    total, n = np.zeros(64, np.int64), 0
    for h in blocks:
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint_of(text: str | None, words: int = WORDS) -> int:
    """Fingerprint of one text as a signed 64-bit integer; zero without words."""
    return _folded(shingles(text, words))


def shingle_set(text: str | None, words: int = STAGE_WORDS) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingles(text, words)]))


def bands_of(of_text: np.ndarray) -> list[int]:
    """One key for each band of minimum hashes of a text's shingles; none without shingles."""
    if not len(of_text):
        return []
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(of_text), 4096):
        np.minimum(least, ((of_text[i : i + 4096, None] ^ _SEEDS[0]) * (_SEEDS[1] | np.uint64(1))).min(0), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64).tolist()


@F.arrow_udf(StructType().add("node", LongType()).add("words", BinaryType()).add("fp", LongType()).add("size", IntegerType()).add("bands", ArrayType(LongType())))
def sketch(text: pa.Array, seed: pa.Array, bits: pa.Array) -> pa.Array:
    """What the pipeline's stage needs of a text; node is a hash of its words, of so many bits, and words a 256-bit
    digest that tells whether a node is one text's."""
    import hashlib

    import xxhash

    seed, bits = (a[0].as_py() if len(a) else 0 for a in (seed, bits))
    rows = []
    for t in text:
        t = t.as_py() or ""
        blocks = list(shingles(t, STAGE_WORDS))
        of_text = np.unique(np.concatenate([np.zeros(0, np.uint64), *blocks]))
        words = b" ".join(t.encode("utf-8", "surrogatepass").lower().split())
        node = xxhash.xxh64_intdigest(words, seed) >> (64 - bits)
        rows.append({"node": node - (1 << 63), "words": hashlib.sha256(words).digest(), "fp": _folded(blocks), "size": len(of_text), "bands": bands_of(of_text)})
    return pa.array(rows, pa.struct([("node", pa.int64()), ("words", pa.binary()), ("fp", pa.int64()), ("size", pa.int32()), ("bands", pa.list_(pa.int64()))]))


@F.arrow_udf(DoubleType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Jaccard similarity of the shingle sets; 1 for two texts without words."""
    out = []
    for x, y in zip(a, b):
        x, y = shingle_set(x.as_py()), shingle_set(y.as_py())
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0)
    return pa.array(out, pa.float64())


@F.arrow_udf(LongType())
def fingerprint(text: pa.Array) -> pa.Array:
    return pa.array([fingerprint_of(t.as_py()) for t in text], pa.int64())


def _half_masks() -> list[int]:
    return [0] + [1 << i for i in range(32)]


def _ball_masks() -> list[int]:
    bits = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    return [0] + bits + [a ^ b for a, b in combinations(bits, 2)]


def _longs(values: list[int]):
    return F.expr("array(" + ",".join(f"{v}L" if v != -(1 << 63) else "cast(-9223372036854775808 as bigint)" for v in values) + ")")


def links(prints: DataFrame, dense: int = 32, few_more: int = 256) -> DataFrame:
    """Distinct (node, fp) -> edges (u, v) whose components are those of all links within RADIUS bits."""
    sides = F.explode(
        F.concat(
            F.transform(_longs(_half_masks()), lambda m: F.shiftrightunsigned("fp", 32).bitwiseXOR(m) * 2),
            F.transform(_longs(_half_masks()), lambda m: F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(m) * 2 + 1),
        )
    )
    keys = prints.select("node", "fp", sides.alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    hits = save(keys.join(shared.hint("merge"), "key"), "hits")
    few = hits.where(F.col("c") <= dense).groupBy("key").agg(F.collect_list(F.struct("node", "fp")).alias("m"))
    pairs = F.expr(f"""filter(flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)),
        y -> struct(x.node as u, y.node as v, bit_count(x.fp ^ y.fp) as d)))), e -> e.d <= {RADIUS})""")
    light = few.select(F.explode(pairs).alias("e")).select("e.u", "e.v")
    return light.union(_crowded(hits.where(F.col("c") > dense), few_more)).distinct()


def _star(prints: DataFrame, masks: list[int]) -> DataFrame:
    """An edge from every fingerprint to the smallest that shares one of its variants."""
    balls = prints.select("node", F.explode(F.transform(_longs(masks), lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    least = balls.groupBy("variant").agg(F.min("node").alias("v"), F.count("*").alias("c")).where("c > 1").drop("c")
    return balls.join(least.hint("merge"), "variant").where("node <> v").select(F.col("node").alias("u"), "v")


def _crowded(hits: DataFrame, few_more: int) -> DataFrame:
    """Edges for keys with many members. Variants within one bit link most of them into clusters; what a
    key holds beyond its largest cluster is compared with all its members, and if that is more than
    few_more, the key's members emit their whole balls."""
    hits = save(hits, "crowded")
    if hits.isEmpty():
        return hits.select(F.col("node").alias("u"), F.col("node").alias("v"))
    near = save(_star(hits.select("node", "fp").distinct(), _ball_masks()[:65]).distinct(), "near_edges")
    clusters = components(near).withColumnRenamed("component", "cluster")
    inside = save(hits.join(clusters, "node", "left").withColumn("cluster", F.coalesce("cluster", "node")), "clusters")
    sizes = inside.groupBy("key", "cluster").agg(F.count("*").alias("n"))
    keys = sizes.groupBy("key").agg(F.max_by("cluster", F.struct("n", "cluster")).alias("main"), (F.sum("n") - F.max("n")).alias("rest"))
    mixed = save(inside.join(keys.where("rest > 0"), "key"), "mixed")
    rest = mixed.where(f"cluster <> main and rest <= {few_more}").select("key", F.col("node").alias("u"), F.col("fp").alias("fu"))
    # a key's members are dealt over many tasks, to each of which go its few others
    rest = rest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    members = mixed.select("key", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt"), F.col("node").alias("v"), F.col("fp").alias("fv"))
    pairs = members.join(rest.hint("merge"), ["key", "salt"])
    across = pairs.where(f"u <> v and bit_count(fu ^ fv) <= {RADIUS}").select("u", "v")
    whole = _star(mixed.where(f"rest > {few_more}").select("node", "fp").distinct(), _ball_masks())
    return near.union(across).union(whole)


def near_duplicates(docs: DataFrame, dense: int = 32) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero and are linked like any other. Very long texts are read
    whole. Repeated rows each keep a row. A null doc_id is no id: its row gets its group's smallest doc_id, or null if it has none.
    Empty table: empty result. Other columns are ignored.
    """
    marks = save(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")), "fingerprints")
    # one node per distinct fingerprint; equal texts never meet as pairs
    prints = save(marks.groupBy("fp").agg(F.min("doc_id").cast("long").alias("node")).where("node is not null"), "prints")
    found = components(links(prints, dense))
    names = prints.join(found.hint("merge"), "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = marks.join(names.hint("merge"), "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _verified(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts are similar."""
    pairs = save(pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    texts = save(marks.select("node", "text").join(ends.hint("merge"), "node", "left_semi").dropDuplicates(["node"]), "texts")
    one, two = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "uv")
    both = pairs.join(one.hint("merge"), "u").join(two.hint("merge"), "v")
    return save(both.where(similarity("text_u", "text_v") >= SIMILAR).select("u", "v"), "similar")


def _fits(x: str, y: str) -> str:
    """Whether two sketches are of different clusters and their sizes allow the similarity."""
    return f"least({x}.size, {y}.size) >= {SIMILAR}D * greatest({x}.size, {y}.size) and {x}.cluster <> {y}.cluster"


def _mixed(hits: DataFrame, dense: int) -> DataFrame:
    """The members of crowded keys that hold more than one cluster, with the key's largest one as main."""
    crowded = hits.where(F.col("c") > dense)
    counts = crowded.groupBy("key", "cluster").agg(F.count("*").alias("n"))
    keys = counts.groupBy("key").agg(F.max_by("cluster", F.struct("n", "cluster")).alias("main"), (F.sum("n") - F.max("n")).alias("rest"))
    return save(crowded.join(keys.where("rest > 0").hint("merge"), "key"), "mixed_bands")


def _between(hits: DataFrame, dense: int) -> DataFrame:
    """Pairs of one uncrowded key and different clusters whose sizes allow the similarity."""
    light = hits.where(F.col("c") <= dense).groupBy("key").agg(F.collect_list(F.struct("node", "size", "cluster")).alias("m"))
    pairs = F.expr(f"""flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), y -> {_fits("x", "y")}),
        y -> struct(x.node as u, y.node as v))))""")
    return light.select(F.explode(pairs).alias("e")).select("e.u", "e.v")


@F.arrow_udf(ArrayType(LongType()))
def shingle_list(text: pa.Array) -> pa.Array:
    return pa.array([shingle_set(t.as_py()).view(np.int64) for t in text], pa.list_(pa.int64()))


def _compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The similar pairs between two blocks of one key's members: of different clusters, in the first key that
    the two share, and once where both may stand on either side."""
    none = pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
    if not len(left) or not len(right):
        return none
    key = left["key"].iloc[0]
    x_bands, y_bands = np.stack(left["bands"]), np.stack(right["bands"])
    x_node, y_node, x_size, y_size = (f[c].to_numpy() for c in ("node", "size") for f in (left, right))
    y_cluster, y_main = right["cluster"].to_numpy(), right["main"].to_numpy()
    sets = [np.asarray(a).view(np.uint64) for a in right["shingles"]]
    every, starts = np.concatenate(sets), np.r_[0, np.cumsum(y_size)[:-1]]
    out = []
    for i, (of_x, cluster) in enumerate(zip(left["shingles"], left["cluster"])):
        first = (x_bands[i] == y_bands).argmax(axis=1)
        ok = (x_bands[i][first] == key) & (y_cluster != cluster) & ((y_cluster == y_main) | (x_node[i] < y_node))
        ok &= np.minimum(x_size[i], y_size) >= SIMILAR * np.maximum(x_size[i], y_size)
        if ok.any():
            of_x = np.asarray(of_x).view(np.uint64)
            at = np.minimum(np.searchsorted(of_x, every), len(of_x) - 1)
            both = np.add.reduceat((of_x[at] == every).astype(np.int64), starts)
            hit = ok & (both >= SIMILAR * (x_size[i] + y_size - both))
            out.append(pd.DataFrame({"u": x_node[i], "v": y_node[hit]}))
    return pd.concat(out) if out else none


def _crowd_links(mixed: DataFrame, marks: DataFrame) -> DataFrame:
    """Similar pairs of a crowded key: what it holds beyond its largest cluster against all its members, in
    blocks of bounded size; only the links leave a block."""
    nodes = mixed.select("node").distinct()
    sets = marks.select("node", "text", "bands").join(nodes.hint("merge"), "node", "left_semi").dropDuplicates(["node"])
    sets = save(sets.select("node", "bands", shingle_list("text").alias("shingles")), "sets")
    outside = F.col("cluster") != F.col("main")
    sized = mixed.groupBy("key").agg(*(F.greatest(F.ceil(F.count_if(w) / BLOCK_ROWS), F.ceil(F.sum(F.when(w, F.col("size"))) / BLOCK_SHINGLES)).cast("int").alias(n) for n, w in (("xs", outside), ("ys", F.lit(True)))))
    dealt = save(mixed.join(sized.hint("merge"), "key").join(sets.hint("merge"), "node"), "crowds")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = dealt.where(outside).withColumn("xb", block("xs")).withColumn("yb", every("ys"))
    y = dealt.withColumn("yb", block("ys")).withColumn("xb", every("xs"))
    by = ("key", "xb", "yb")
    return x.groupBy(*by).cogroup(y.groupBy(*by)).applyInPandas(_compare, "u long, v long")


def _sketches(docs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Stored sketches and one of each node. If two texts of different words meet in a node, all are hashed anew with
    another seed and whole 64 bits, so that a node is one text's."""
    for seed in count(7):
        named = docs.where("doc_id is not null").select("doc_id", "text", sketch(F.col("text"), F.lit(seed), F.lit(bits)).alias("s"))
        marks = save(named.select("doc_id", "text", "s.*"), "sketches")
        prints = save(marks.groupBy("node").agg(*(F.first(c).alias(c) for c in ("fp", "size", "bands")), (F.min("words") != F.max("words")).alias("shared")), "prints")
        if prints.where("shared").isEmpty():
            return marks, prints.drop("shared")
        bits = 64


def similar_documents(docs: DataFrame, dense: int = 32, bits: int = 64) -> DataFrame:
    """(doc_id, component_id) of every row with a doc_id: documents that are linked, directly or through
    others, by a Jaccard similarity of SIMILAR or more get the smallest doc_id among them.

    Crowds are drawn together first: every member of a crowded key is compared with one member picked for that
    key. Only what is outside the key's largest cluster then meets all the members, in blocks, so that no link
    is lost and a group of copies is not expanded into its pairs. Null and empty texts are alike. Very long texts
    are read whole. Repeated rows each keep a row. Empty table: an empty result. Other columns are ignored. bits: of the
    hash by which equal texts are found first; texts that meet in one are told apart.
    """
    marks, prints = _sketches(docs, bits)
    keys = save(prints.select("node", "size", F.explode("bands").alias("key")), "bands")
    shared = keys.groupBy("key").agg(F.count("*").alias("c"), F.min_by("node", F.xxhash64("node", "key")).alias("hub")).where("c > 1")
    hits = save(keys.join(shared.hint("merge"), "key"), "band_hits")
    # the closest first, so that crowds are single clusters when the other pairs are made
    of_print = save(prints.groupBy("fp").agg(F.min("node").alias("node")), "of_print")
    same = prints.join(of_print.withColumnRenamed("node", "v").hint("merge"), "fp").select(F.col("node").alias("u"), "v")
    stars = hits.where(F.col("c") > dense).select(F.col("node").alias("u"), F.col("hub").alias("v"))
    near = _verified(links(of_print, dense).union(same).union(stars), marks)
    clusters = save(components(near).withColumnRenamed("component", "cluster"), "clusters_of_bands")
    inside = save(hits.join(clusters.hint("merge"), "node", "left").withColumn("cluster", F.coalesce("cluster", "node")), "band_clusters")
    # what is found now links whole clusters, so only those are walked once more
    more = _verified(_between(inside, dense), marks).union(_crowd_links(_mixed(inside, dense), marks))
    for end in "uv":
        of = clusters.select(F.col("node").alias(end), F.col("cluster").alias("of"))
        more = more.join(of.hint("merge"), end, "left").withColumn(end, F.coalesce("of", end)).drop("of")
    found = components(more).withColumnRenamed("node", "cluster")
    rows = marks.select("doc_id", "node").join(clusters.hint("merge"), "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    rows = rows.join(found.hint("merge"), "cluster", "left").select("doc_id", F.coalesce("component", "cluster").alias("group"))
    rows = save(rows, "groups")
    names = rows.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return rows.join(names.hint("merge"), "group").select("doc_id", "component_id")


def keep_one(docs: DataFrame, dense: int = 32) -> DataFrame:
    """One document of each group of similar_documents: the row of its smallest doc_id, all columns as they came.

    Of rows that repeat that doc_id one stays; rows without a doc_id stay. Null and empty texts are alike: one
    of them stays. An empty table stays empty.
    """
    again = fresh(docs, "again")
    ids = similar_documents(docs, dense).where("doc_id = component_id").groupBy("doc_id").agg((F.count("*") > 1).alias(again))
    stay = docs.join(ids.hint("merge"), "doc_id")
    once = stay.where(~F.col(again)).unionByName(stay.where(F.col(again)).dropDuplicates(["doc_id"]))
    return once.select(docs.columns).unionByName(docs.where("doc_id is null"))
