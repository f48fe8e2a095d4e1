"""A Merkle manifest of a dataset: a tree of eights per language, a tree over their roots, and a proof per row.

Rows are placed by one distributed sort; eight neighbours become the node above them, level by level, each level an
eighth of the one below. Proofs come by pointer jumping: every inner node holds the id of an ancestor and the
segment of siblings on the way to it, at first its parent and the others of its run; a self-join of the nodes
appends the ancestor's segment and takes its ancestor, which doubles the distance, until all pointers end at
the root. Leaves are an eighth as many runs, which take the finished segments of their parents by one more join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

WIDE = 8
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of a join's side that may be broadcast.
SHARED_BYTES = 16_000_000
TOP = -1


def framed(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def hashed(*fields: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[framed(f) for f in fields]), 256))


def text_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def joined(left: DataFrame, right: DataFrame, on, row_bytes: int, how: str = "left") -> DataFrame:
    """A join with the stored table `right`, broadcast only if its rows, of about row_bytes, are proven few."""
    few = right.limit(SHARED_BYTES // row_bytes + 1).count() <= SHARED_BYTES // row_bytes
    return left.join(right.hint("broadcast" if few else "merge"), on, how)


def placed(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Stored rows to (rows with part and id, runs): each group's rows are sorted over all partitions. A run is what a
    partition holds of a group: group, part, least (its first id), before (the group's rows in earlier
    partitions) and n (the group's rows); a row's place is id - least + before. Rows that tie in all columns of
    order follow their place in the stored table, so that no key is too large for a partition."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)] + [F.col("tie")]
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = save(rows.drop("tie").withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.shiftright("id", 33).cast("int")), "placed")
    runs = rows.groupBy(group, "part").agg(F.min("id").alias("least"), F.count("*").alias("own"))
    of = Window.partitionBy(group)
    earlier = of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, runs.select(group, "part", "least", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("before"), F.sum("own").over(of).alias("n"))


def gathered(nodes: DataFrame, *carried: str) -> DataFrame:
    """Nodes (tree, pos, n, digest) to their runs of eight: tree, up (the parent's place), n, size_up, kids, every (all
    digests) and digest, the parent's. The only node of a tree is its own parent."""
    kids = F.sort_array(F.collect_list(F.struct("pos", "digest", *carried)))
    runs = nodes.groupBy("tree", F.floor(F.col("pos") / WIDE).alias("up"), "n").agg(kids.alias("kids"))
    every = F.array_join(F.transform("kids", lambda k: F.lower(F.hex(k.digest))), "")
    runs = runs.withColumn("hex", every).withColumn("size_up", F.ceil(F.col("n") / WIDE))
    digest = F.when(F.col("n") == 1, F.col("kids")[0].digest).otherwise(F.unhex(F.sha2("hex", 256)))
    return runs.select("tree", "up", "n", "size_up", "kids", F.unhex("hex").alias("every"), digest.alias("digest"))


def segment(nth: Column) -> Column:
    """The siblings left and right of a run's nth child, as an array of one; none for a tree of one node."""
    left, right = F.col("every").substr(F.lit(1), 32 * nth), F.col("every").substr(32 * nth + 33, F.lit(32 * WIDE))
    return F.when(F.col("n") > 1, F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(F.expr("cast(array() as array<struct<left: binary, right: binary>>)"))


def linked(runs: DataFrame, level: int, height: int) -> DataFrame:
    """Pointers of the children in runs: (id, up) as structs of tree, level and place, height, segment, and subroot where
    the parent is one. The only node of a language's tree is the leaf of the top tree with the language's number."""
    up = F.struct(F.col("tree"), F.lit(level + 1).alias("level"), F.col("up").alias("pos"))
    top = F.struct(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("pos"))
    last = (F.col("tree") != TOP) & (F.col("size_up") == 1)
    rows = runs.select("*", F.posexplode("kids").alias("nth", "kid"))
    return rows.select(
        F.struct(F.col("tree"), F.lit(level).alias("level"), F.col("kid.pos").alias("pos")).alias("id"), F.when(last, top).otherwise(up).alias("up"), F.lit(height).alias("height"),
        segment(F.col("nth")).alias("segment"), F.when(last, F.col("digest")).alias("subroot"),
    )


def parents(runs: DataFrame) -> DataFrame:
    return runs.select("tree", F.col("up").alias("pos"), F.col("size_up").alias("n"), "digest")


def deep(n: int) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // WIDE), levels + 1
    return levels


def jumped(links: DataFrame, depth: int, row_bytes: int = 32 * WIDE) -> DataFrame:
    """Pointers of all inner nodes, brought to the root by doubling. A round at distance d joins only nodes above
    height d, some 8**d times fewer."""
    links, distance = save(links, "links"), 1
    while distance < depth:
        far = links.where(F.col("height") > distance).select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("segment").alias("more"), F.col("subroot").alias("sub"))
        found = joined(links, far, "up", row_bytes * distance)
        links = save(
            found.select(
                "id", F.coalesce("next", "up").alias("up"), "height", F.when(F.col("more").isNull(), F.col("segment")).otherwise(F.concat("segment", "more")).alias("segment"),
                F.coalesce("subroot", "sub").alias("subroot"),
            ), "links",
        )
        distance *= 2
    return links


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Null fields count as `-`, a null lang as a language before all others, null doc_ids come first. Very long texts
    are hashed whole. Rows of one doc_id and lang stand in the order of their leaves; repeated rows each have a
    leaf. A row with a null doc_id is not tampered with. A single row is leaf, subroot and root, its proof the hash
    of nothing. Empty table: an empty result. Other columns are ignored, whatever their names.
    """
    own = docs.select("doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = hashed(*fields, F.translate("text", LETTERS, LETTERS.lower()))
    touched = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaves = save(own.select("doc_id", "lang", hashed(*fields, F.col("text")).alias("digest"), F.when(touched, lowered).alias("tampered")), "leaves")
    languages = save(leaves.groupBy("lang").agg(F.count("*").alias("rows")).withColumn("one", F.lit(0)), "languages")
    most, n = languages.agg(F.max("rows"), F.count("*")).first()
    own_levels, top_levels = deep(most or 0), deep(n)

    ranked, runs = placed(languages, "one", ["lang"])
    numbers = joined(ranked, save(runs, "runs"), ["one", "part"], 64, "inner").select("lang", (F.col("id") - F.col("least") + F.col("before")).alias("tree"))
    rows, runs = placed(leaves, "lang", ["doc_id", "digest"])
    of = numbers.withColumnRenamed("lang", "of")
    runs = save(runs.join(of.hint("merge"), F.col("lang").eqNullSafe(F.col("of"))).select(F.col("lang").alias("of"), F.col("part").alias("in_part"), "tree", "least", "before", "n"), "runs")
    same = F.col("lang").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part"))
    nodes = joined(rows, runs, same, 64, "inner").select("tree", (F.col("id") - F.col("least") + F.col("before")).alias("pos"), "n", "digest", "doc_id", "tampered")

    lowest = save(gathered(nodes, "doc_id", "tampered"), "level")
    level, links, tops = lowest, [], []
    for k in range(1, max(own_levels, 1)):
        tops.append(level)
        level = save(gathered(parents(level).where("n > 1")), "level")
        links.append(linked(level, k, k))
    tops.append(level)
    subroots = [parents(t).where("n = 1") for t in tops]
    top = subroots[0]
    for t in subroots[1:]:
        top = top.unionByName(t)
    top = top.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n).cast("long").alias("n"), "digest")
    for k in range(top_levels):
        level = save(gathered(top), "level")
        links.append(linked(level, k, max(own_levels, 1) + k))
        top = parents(level)
    root = [bytes(r.digest) for r in top.select("digest").take(1)]  # one digest
    root = F.lit(root[0].hex() if root else None)

    every = linked(lowest, 0, 0).limit(0) if not links else links[0]
    for t in links[1:]:
        every = every.unionByName(t)
    ways = jumped(every, max(own_levels - 1, 0) + top_levels).select(F.col("id").alias("at"), F.col("segment").alias("more"), F.col("subroot").alias("sub"))
    last = F.col("size_up") == 1
    at = F.when(last, F.struct(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("pos"))).otherwise(
        F.struct(F.col("tree"), F.lit(1).alias("level"), F.col("up").alias("pos"))
    )
    found = lowest.withColumn("at", at).join(ways.hint("merge"), "at", "left")
    found = found.select("*", F.when(last, F.col("digest")).otherwise(F.col("sub")).alias("subroot"), F.posexplode("kids").alias("nth", "kid"))
    own_segment = segment(F.col("nth"))
    way = F.when(F.col("more").isNull(), own_segment).otherwise(F.concat(own_segment, F.col("more")))
    rows = found.select("kid.doc_id", "kid.digest", "kid.tampered", "subroot", way.alias("way"))
    proof = F.array_join(F.transform("way", lambda s: F.concat(text_of(s.left), text_of(s.right))), "")
    start = text_of(F.coalesce("tampered", "digest"))
    folded = F.aggregate("way", start, lambda so_far, s: F.sha2(F.concat(text_of(s.left), so_far, text_of(s.right)), 256))
    out = rows.select("doc_id", text_of(F.col("digest")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), root.alias("root"), F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
