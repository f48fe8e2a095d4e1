"""Shared helpers: tables in the shared folder, word kernels and training samples."""

from __future__ import annotations

import gc
import io
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Folders written by save() in this process, so that a job can remove those it no longer needs.
SAVED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a folder beside the warehouse's tables,
    which executors share too."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return base or f"{spark.conf.get('spark.sql.warehouse.dir')}/tidemark_scratch"


def save(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: it cuts the lineage, survives lost executors
    and gives the optimizer a true size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    SAVED.append(path)
    trim(spark)
    return spark.read.schema(df.schema).parquet(path)


def remove_saved(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Delete the folders saved after the first `since`, but for the last `keep` of them, and free what the driver holds
    of plans and broadcasts that are no longer used."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in SAVED[since : len(SAVED) - keep]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    del SAVED[since : len(SAVED) - keep]
    free(spark)


def free(spark: SparkSession) -> None:
    """Free what the driver holds of plans, their compiled classes and broadcasts that are no longer used."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> str | None:
    """Give back what malloc keeps of the native memory that the driver's JVM has freed, as `jcmd PID System.trim_native_heap`
    does: compiling the code of many plans leaves some 150 MB. What the JVM says of it; None where it has no such command."""
    jvm = spark._jvm
    try:
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not use."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def encoded(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and len+1 offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(col) else data[:0], offsets - offsets[0]


def runs(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal non-zero kind; a run ends with its document."""
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.ones(n + 1, bool)
    cut[1:n] = kind[1:] != kind[:-1]
    cut[offsets] = True
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    keep = kind[starts] != 0
    return starts[keep], ends[keep]


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        m = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each data[start:end], from one prefix sum."""
    up, down = powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def slices(offsets: np.ndarray, limit: int):
    """Ranges of whole documents with about limit bytes each; one document may be more."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held, bound: int, most_bytes: int) -> DataFrame:
    """The sample to learn from: (h, text, y), at most `bound` documents with together at most `most_bytes`
    bytes of text, in the order of h, a hash of doc_id.

    held(remainder) tells the held-out rows by crc32(doc_id as text) mod modulus. A document labelled twice
    counts with its smallest label; of rows that repeat a doc_id the smallest text counts, once. A text of
    more than a sixteenth of most_bytes is not learned from. At most `bound` rows meet in one task.
    """
    part = F.crc32(F.col("doc_id").cast("string")) % modulus
    y = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(~held(part))
    y = y.groupBy("doc_id").agg(F.min(label).alias("y"))
    y = y.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(bound)  # the join's small side: bound rows
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= most_bytes // 16)
    rows = own.join(F.broadcast(y), "doc_id").groupBy("doc_id", "h", "y").agg(F.min("text").alias("text"))
    so_far = Window.orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("so_far", F.sum(F.octet_length("text")).over(so_far)).where(F.col("so_far") <= most_bytes).select("h", "text", "y")


def fitted(rows: DataFrame, fit) -> dict:
    """The model, a dict of numpy values, that fit(texts, y) gives for a bounded sample. It is fitted in one
    task of an executor; only the model comes to the driver. An empty sample is fitted on the driver."""

    def learn(batches):
        texts, y = [], []
        for batch in batches:
            texts += batch.column(1).to_pylist()
            y += batch.column(2).to_pylist()
        if texts:
            out = io.BytesIO()
            np.savez_compressed(out, **fit(texts, np.array(y)))
            yield pa.record_batch([pa.array([out.getvalue()], pa.binary())], ["model"])

    found = rows.coalesce(1).sortWithinPartitions("h").mapInArrow(learn, "model binary").collect()
    if not found:
        return fit([], np.zeros(0))
    with np.load(io.BytesIO(bytes(found[0].model))) as stored:
        return {k: stored[k] if stored[k].ndim else stored[k].item() for k in stored.files}
