"""Mixing sources to target weights with DataFrame operations only.

Every document gets a hash-random key. Documents are range-sorted by key within their source: the key
space is cut into fixed ranges, which the hash fills evenly, so that a source with a third of all rows
spreads over as many tasks as any other rows. Distributed prefix sums are a running sum within a range
plus the sum of the ranges before it. Each source is cut at its exact budget, over repeated epochs if
the budget is above its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free, fresh, save

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Copies of one row that one task makes.
COPIES = 10_000


def word_count(text="text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source_key, source, source_size) -> with target: SHARE of all sizes by weight, at most `most`
    times the source's own size; what is above is reshared by weight until none is above.

    The reshared level is found in closed form: in the order of size over weight, sources are full up to
    one point and share the rest by weight beyond it. One row per source reaches the windows here.
    """
    every = Window.partitionBy()
    named = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    weigh = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    t = named.withColumn("weight", weigh.cast("double")).withColumn("cap", F.col("source_size").cast("double") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumns({
        "full": F.sum("cap").over(so_far),
        "weighed": F.sum("weight").over(so_far),
        "all": F.sum("source_size").over(every) * F.lit(share),
        "weights": F.sum("weight").over(every),
    })
    # a source is full if the level that would empty the budget over it and the sources after it reaches its cap
    level = (F.col("all") - (F.col("full") - F.col("cap"))) / (F.col("weights") - (F.col("weighed") - F.col("weight")))
    t = t.withColumn("level", level).withColumn("is_full", F.col("cap") <= F.col("weight") * F.col("level"))
    t = t.withColumn("at", F.max(F.when(~F.col("is_full"), F.col("level"))).over(every))
    # beyond the first source that is not full the levels only fall; the largest is the common one
    return t.withColumn("target", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("at")))).select("source_key", "source_size", "target")


def _sized(docs: DataFrame, row) -> DataFrame:
    """Documents with their size, hash-random key and `row`, which tells rows of one key apart; rows alike in all
    of this are one row with their number."""
    rows = docs.select(
        "doc_id", "source",
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("source_key"),
        word_count().alias("size"), F.xxhash64("doc_id", F.crc32("text")).alias("key"), row.alias("row"),
    )
    return rows.groupBy("doc_id", "source", "source_key", "size", "key", "row").agg(F.count("*").alias("same")).withColumn("range", F.shiftright("key", 55))


def _placed(docs: DataFrame, row, share: float, most: int) -> DataFrame:
    """The rows of _sized with source_size, target, epochs, and `over`: the words that are left to the row and its
    repeats, together, in the source's last epoch."""
    rows = save(_sized(docs, row), "sizes")
    weight = F.col("size") * F.col("same")
    ranges = rows.groupBy("source_key", "range").agg(F.sum(weight).alias("held"), F.first("source").alias("source"))
    sources = ranges.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("held").alias("source_size"))
    before = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    cut = ranges.withColumn("offset", F.coalesce(F.sum("held").over(before), F.lit(0))).select("source_key", "range", "offset")
    cut = cut.join(targets(sources, share, most).hint("merge"), "source_key")
    within = Window.partitionBy("source_key", "range").orderBy("key", "row", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.join(cut.hint("merge"), ["source_key", "range"]).withColumn("ahead", F.col("offset") + F.sum(weight).over(within) - weight)
    budget = F.floor("target")
    placed = placed.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0))
    return placed.withColumn("over", F.greatest(F.lit(0), F.least(weight, budget - F.col("epochs") * F.col("source_size") - F.col("ahead"))))


def mix(docs: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    Null text: size 0, nothing taken. Very long texts are counted whole. Null source: a source of its own, the
    last. Null doc_id: ordered by its hash like any other. Repeated rows are separate documents, each with its own
    part of what they are given together. Ties of the key go by doc_id and size. Empty table, or no word in any
    text: targets 0. `taken` over a source sums to the whole part of its target. Other columns are ignored.
    """
    placed = _placed(docs, F.lit(0), share, most)
    # a row that repeats is one row until here: blocks of its copies first, so that no task makes them all
    blocks = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("same") - 1) / COPIES).cast("int"))))
    many = F.col("same") > COPIES
    spread = blocks.where(~many).unionByName(blocks.where(many).repartition("key", "block"))
    first = F.col("block").cast("long") * COPIES
    every = spread.withColumn("nth", F.explode(F.sequence(first, F.least(first + COPIES, F.col("same")) - 1)))
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("over") - F.col("nth") * F.col("size")))
    return every.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: every document as often as it is taken, all columns as they came.

    The one document of a source in which the budget ends stays whole. Rows that are alike in all columns are
    interchangeable, so one of them stands for what they are given together. Texts without words are not taken.
    Null sources and doc_ids, very long texts, ties and clashing names: as in mix(). An empty table stays empty.
    """
    # 256 bits tell rows apart; fields that are null are left out of the object, others are quoted
    row = F.unhex(F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(docs.columns)])), 256))
    name, copies, block = (fresh(docs, c) for c in ("mix_key", "copies", "block"))
    n = _placed(docs, row, share, most).where("size > 0").withColumn("n", F.col("epochs") * F.col("same") + F.ceil(F.col("over") / F.col("size")))
    n = n.groupBy(F.col("row").alias(name)).agg(F.sum("n").alias(copies), (F.sum("same") > 1).alias(block)).where(F.col(copies) > 0)
    # written, so that the join's plan is small, and it has the branches for repeated rows and many copies only where there are such
    n = save(n, "taken")
    repeated, most_copies = n.agg(F.max(block), F.max(copies)).first()
    free(docs.sparkSession)
    once = docs.withColumn(name, row).join(n.hint("merge"), name)
    if repeated:
        once = once.where(~F.col(block)).unionByName(once.where(F.col(block)).dropDuplicates([name]))
    spread = once.withColumn(block, F.explode(F.sequence(F.lit(0), F.floor((F.col(copies) - 1) / COPIES).cast("int"))))
    if most_copies and most_copies > COPIES:
        many = F.col(copies) > COPIES
        spread = spread.where(~many).unionByName(spread.where(many).repartition(name, block))
    own = F.least(F.lit(COPIES), F.col(copies) - F.col(block) * COPIES).cast("int")
    return spread.withColumn(copies, F.explode(F.array_repeat(F.lit(1), own))).select(docs.columns)
