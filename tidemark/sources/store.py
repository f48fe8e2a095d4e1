"""Keyed stores of partitioned Parquet: idempotent merges, and an archive that takes what is older than a cutoff.

Only partitions in which a row is new or changed are written anew, by Spark's dynamic partition overwrite, so that a load that
is run again, also after a lost driver, ends in the same store.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Partitions that a list of them may name in a plan.
MOST_PARTS = 100_000
#: Up to so many partitions are written by all tasks, without a shuffle that would leave each to a single one.
FEW_PARTS = 64


@dataclass(frozen=True)
class Counts:
    inserted: int
    updated: int
    same: int


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the one that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/tidemark_scratch"
    return f"{base}/{label}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _folder(spark, path)
    return fs.exists(at)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the last by `order`; rows that tie in it are told apart by all their columns."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in rest]))
    picked = rows.groupBy(*keys).agg(best.alias("_best"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_best._{c}").alias(c) for c in rows.columns])


def _parts(rows: DataFrame, by: str) -> list:
    found = [r[0] for r in rows.select(by).distinct().limit(MOST_PARTS + 1).collect()]
    if len(found) > MOST_PARTS:
        raise ValueError(f"a load touches more than {MOST_PARTS} partitions of {by}")
    return found


def _among(by: str, parts: list):
    """Whether a row is of one of the partitions, null being one too."""
    known = F.col(by).isin([p for p in parts if p is not None])
    return (known | F.col(by).isNull()) if None in parts else known


def _write(rows: DataFrame, path: str, by: str, parts: int) -> None:
    """Replace the partitions of `by` that rows have; parts: how many these are."""
    dealt = rows if parts <= FEW_PARTS else rows.repartition(by)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def _judged(rows: DataFrame, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of every key of the load and of the store, with its _kind: inserted, updated, same, or kept where the load has none.
    Both are shuffled once, together."""
    rest = order + [c for c in rows.columns if c not in keys + order]
    row = F.struct(*[F.col(c) for c in rest])
    both = rows.select(*keys, row.alias("_new"))
    none = F.lit(None).cast(both.schema["_new"].dataType)
    both = both.withColumn("_old", none)
    if exists(rows.sparkSession, path):
        stored = rows.sparkSession.read.schema(rows.schema).parquet(path).select(rows.columns)
        both = both.unionByName(stored.select(*keys, none.alias("_new"), row.alias("_old")))
    met = both.repartition(*keys).groupBy(*keys).agg(F.max("_new").alias("_new"), F.max("_old").alias("_old"))
    kind = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("updated")
    best = met.select(*keys, F.coalesce("_new", "_old").alias("_best"), kind.alias("_kind"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in rows.columns], "_kind")


def merge(rows: DataFrame, path: str, keys: list[str], by: str, order: list[str]) -> Counts:
    """S2, S4, S9 put rows into the store at `path`: the latest row of a key wins over the others of the load and over the
    stored one. by: the partition column, one of the keys, so that a key never moves."""
    if by not in keys:
        raise ValueError(f"{by} must be one of the keys {keys}")
    spark = rows.sparkSession
    staged = f"{path}.load-{uuid.uuid4().hex}"
    judged = _judged(rows, path, keys, order)
    judged.write.parquet(staged)
    judged = spark.read.schema(judged.schema).parquet(staged)
    n = {r._kind: r["count"] for r in judged.groupBy("_kind").count().collect()}
    touched = _parts(judged.where("_kind in ('inserted', 'updated')"), by)
    if touched or not exists(spark, path):
        _write(judged.where(_among(by, touched)).drop("_kind"), path, by, len(touched))
    fs, at = _folder(spark, staged)
    fs.delete(at, True)
    return Counts(n.get("inserted", 0), n.get("updated", 0), n.get("same", 0))


def archive(spark: SparkSession, path: str, to: str, keys: list[str], by: str, time: str, cutoff) -> Counts:
    """S14 move rows of the store before the cutoff to the archive, then purge them. The archive is merged first, so
    that a run that is broken off and run again loses no row and keeps none twice."""
    stored = spark.read.parquet(path)
    old = stored.where(F.col(time) < F.lit(cutoff))
    touched = _parts(old, by)
    if not touched:
        return Counts(0, 0, 0)
    if exists(spark, to):
        done = merge(old, to, keys, by, [time])
    else:  # a store has one row of a key, so there is nothing to choose from
        _write(old, to, by, len(touched))
        done = Counts(spark.read.parquet(to).count(), 0, 0)
    kept = stored.where(F.col(by).isin(touched) & (F.col(time) >= F.lit(cutoff)))
    staying = _parts(kept, by)
    if staying:
        _write(kept, path, by, len(staying))
    for part in set(touched) - set(staying):
        fs, at = _folder(spark, f"{path}/{by}={part}")
        fs.delete(at, True)
    return done
