"""Shared pieces: tables, the shared scratch folder, byte-level word hashing, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables in the folder the cluster names in spark.checkpoint.dir; these cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, label: str):
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.gettempdir()
        self.spark, self.root, self.n = spark, f"{base.rstrip('/')}/tessera-{label}-{uuid.uuid4().hex[:12]}", 0

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def save(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing lazy still reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            for f in {x.rpartition("/")[0] for x in df.inputFiles() if self.root.split("://")[-1].split(":", 1)[-1] in x}:
                p = jvm.org.apache.hadoop.fs.Path(f)
                p.getFileSystem(conf).delete(p, True)

    def clear(self) -> None:
        """Delete all tables of this scratch: for callers, once the results that read them are written."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def release(self) -> None:
        """Let Spark's cleaner delete shuffle files of finished, unreferenced plans."""
        gc.collect()
        self.spark._jvm.System.gc()


# ---------------------------------------------------------------- word hashing on raw UTF-8 bytes

_M = (1 << 64) - 1
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
_BYTES[SPACE] = 0
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_P = 0x2545F4914F6CDD1D
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 4096), _P, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


def word_hashes(buf: np.ndarray, cuts: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of concatenated texts, and word_at: text i has words word_at[i]:word_at[i + 1].

    buf: UTF-8 bytes; cuts: byte offsets of the texts, first 0, last len(buf). Words are runs of bytes other than
    ASCII white space; lower maps A-Z to a-z.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(cuts), np.int64)
    word = ~SPACE[buf]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(word[:-1], out=first[1:])
    first[cuts[:-1][cuts[:-1] < n]] = True
    starts = np.flatnonzero(first & word)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(cuts), np.int64)
    lens = np.diff(starts, append=n)
    at = np.arange(n, dtype=np.int64)
    at[starts[0]:] -= np.repeat(starts, lens)
    h = (_LOWER if lower else _BYTES)[buf]
    h *= powers(int(at.max()) + 1)[at]
    return mix(np.add.reduceat(h, starts) + np.uint64(0x9E3779B97F4A7C15)), np.searchsorted(starts, cuts)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive elements: sum of h[i + j] * Q**j; one shorter by k - 1."""
    out, have, q, p, rest, qp = None, 0, h, 0x9E3779B97F4A7C15, k, 1
    width = 1
    while rest:
        if rest & 1:
            m = len(h) - have - width + 1
            part = q[have:have + m] if m > 0 else q[:0]
            out = part.copy() if out is None else out[:max(m, 0)] + part * np.uint64(qp)
            have += width
            qp = qp * p & _M
        rest >>= 1
        if rest:
            q = q[:max(len(q) - width, 0)] + q[width:] * np.uint64(p)
            p = p * p & _M
            width *= 2
    return mix(out)


def text_batches(batches, column: str = "text", most: int = 1 << 20):
    """Slices of Arrow batches of about `most` bytes of text: (batch, bytes, cuts). A null text counts as empty."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(column)
        if col.null_count:
            col = col.fill_null("")
        size = np.frombuffer(col.cast(pa.large_string()).buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
        i = 0
        while i < len(col):
            j = max(i + 1, int(np.searchsorted(size, size[i] + most, "right")) - 1)
            part = pa.array(col.slice(i, j - i)).cast(pa.large_string())
            off = np.frombuffer(part.buffers()[1], np.int64)[part.offset:part.offset + len(part) + 1]
            data = part.buffers()[2]
            buf = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
            yield b.slice(i, j - i), buf, off - off[0]
            i = j
    b = col = part = data = buf = None
    trim()


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node reachable over edges (u, v); nodes without an edge to another are absent.

    Alternates two star contractions, each an aggregation for a node's smallest neighbour and a join back on the
    node; Spark splits skewed joins. A round's edges go to the shared folder. Ends when all that is left is stars.
    """
    e = scratch.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), "m").unionByName(low).where("u <> m").distinct()
        new = scratch.save(small.select("u", F.col("m").alias("v")))
        scratch.drop(e)
        e = new
        edges_, leaves = e.agg(F.count("*"), F.countDistinct("u")).first()
        if edges_ == leaves and e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def trim() -> None:
    """Return freed memory of this process to the system: a worker's between tasks, the driver's after training."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def give_back() -> None:
    gc.collect()
    trim()


# ---------------------------------------------------------------- labelled samples for classifiers


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, where=None, most_chars: int = 16_000_000) -> list[tuple[str, int]]:
    """(text, 0 or 1) of labelled documents, the same at every run: of each class those with the lowest hashes of doc_id,
    at most `most` and at most most_chars / 2 characters together; texts over most_chars / 32 are not learned from.

    A label that is null is left out; of several labels of a document the largest counts, of several texts of a doc_id
    the least. So what reaches the driver is bounded in rows and characters, whatever the tables hold.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    rows = rows.where(where) if where is not None else rows
    rows = rows.groupBy("doc_id").agg(F.max(label).alias("_y"))
    picked = [rows.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= most_chars // 32).join(F.broadcast(ids), "doc_id")  # 2 * most ids at most
    one = texts.groupBy("doc_id", "_y").agg(F.min("text").alias("text")).withColumn("k", F.xxhash64("doc_id"))
    upto = F.sum(F.length("text")).over(Window.partitionBy("_y").orderBy("k", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return [(r["text"], r["_y"]) for r in one.withColumn("_upto", upto).where(F.col("_upto") <= most_chars // 2).select("k", "doc_id", "text", "_y").orderBy("k", "doc_id").collect()]


def as_batch(texts: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["row", "text"])
