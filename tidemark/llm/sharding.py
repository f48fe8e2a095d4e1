"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots; bytes are summed per slot; a versioned table maps slots
to shards. The first version deals the slots out in turn; rebalancing edits the map, so that only the slots it
names move, and appends the edit as the next version. The law is `bytes`: shards hold nearly equal bytes. Rows
that repeat a record hash to slots of their own, so that no record is too heavy to share out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, shared_dir

SLOTS = 8192
SHARDS = 24
#: Copies of one record that one task makes.
COPIES = 10_000


def records(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, same): the distinct records and how often each occurs."""
    crc = F.crc32(F.coalesce("text", F.lit("")))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    return docs.select("doc_id", size.alias("size"), crc.alias("text_crc32")).groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("same"))


def slot_of(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot), a row per document; the slot depends on doc_id, text and, where a record
    repeats, on the number of the copy."""
    held = records(docs)
    blocks = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("same") - 1) / COPIES).cast("int"))))
    many = F.col("same") > COPIES
    spread = blocks.where(~many).unionByName(blocks.where(many).repartition("doc_id", "text_crc32", "block"))
    first = F.col("block").cast("long") * COPIES
    every = spread.withColumn("nth", F.explode(F.sequence(first, F.least(first + COPIES, F.col("same")) - 1)))
    slot = F.pmod(F.xxhash64("doc_id", "text_crc32", "nth"), F.lit(slots)).cast("int")
    return every.select("doc_id", "size", "text_crc32", slot.alias("vslot"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(slots: int = SLOTS, shards: int = SHARDS) -> list[tuple[int, int, int]]:
    """Version 1 of the map, [(version, slot, shard)]: the slots in turn."""
    return [(1, s, s % shards) for s in range(slots)]


def store_map(spark, path: str, entries: list[tuple[int, int, int]]) -> None:
    """Append a version to the map's table; earlier versions stay."""
    spark.createDataFrame(entries, "version int, vslot int, shard int").coalesce(1).write.partitionBy("version").mode("append").parquet(path)


def load_map(spark, path: str, version: int | None = None) -> list[tuple[int, int, int]]:
    """A version of the map, the latest unless one is named: one row per slot, a fixed number."""
    rows = spark.read.schema("version int, vslot int, shard int").parquet(path)
    version = version or rows.agg(F.max("version")).first()[0]
    return [tuple(r) for r in rows.where(F.col("version") == version).select("version", "vslot", "shard").collect()]


def rebalanced(current: list[tuple[int, int, int]], held: dict[int, int], shards: int) -> list[tuple[int, int, int]]:
    """The next version: slots of overfull or vanished shards go to the lightest ones, others stay."""
    version = max((v for v, _, _ in current), default=0) + 1
    live = {slot: shard for v, slot, shard in current if v == version - 1}
    goal = sum(held.values()) / shards
    load = dict.fromkeys(range(shards), 0)
    moving = []
    for slot in sorted(live, key=lambda s: (-held.get(s, 0), s)):
        size, shard = held.get(slot, 0), live[slot]
        if shard < shards and load[shard] + size <= goal:
            load[shard] += size
        else:
            moving.append(slot)
    for slot in moving:
        live[slot] = min(load, key=lambda s: (load[s], s))
        load[live[slot]] += held.get(slot, 0)
    return [(version, slot, shard) for slot, shard in sorted(live.items())]


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    path: the table of the slot map; its latest version is rebalanced for these documents and stored as the next.
    Without one the map is a new table in the shared folder. `slot` is the row's place in its shard, from 0
    without gaps. Null text: no bytes, crc32 of nothing. Very long texts weigh what they hold. Null doc_id: the
    slot follows from the text. Repeated rows are spread over slots. Equal texts of different doc_ids are separate
    records and not kept together, as a group of them may weigh more than a shard. Ties in a slot's order are
    rows alike. Empty table: empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = save(slot_of(docs, slots), "slots")
    held = {r.vslot: r for r in slot_bytes(rows).collect()}  # one row per virtual slot, a fixed number
    if path is None:
        path = f"{shared_dir(spark)}/slot_map-{uuid.uuid4().hex}"
        store_map(spark, path, first_map(slots, shards))
    version = rebalanced(load_map(spark, path), {s: r.bytes for s, r in held.items()}, shards)
    store_map(spark, path, version)
    start, so_far = [], dict.fromkeys(range(shards), 0)
    for _, slot, of in version:
        start.append((slot, of, so_far[of]))
        so_far[of] += held[slot].rows if slot in held else 0
    places = save(spark.createDataFrame(start, "vslot int, shard int, start long").coalesce(1), "places")
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("nth", F.row_number().over(within) - 1).join(F.broadcast(places), "vslot")  # a row per slot
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
