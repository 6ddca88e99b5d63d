"""Shared pieces: lineage cuts, Arrow text chunks, word hashes, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of text that a Python worker holds as numpy arrays at a time.
CHUNK_BYTES = 1 << 19

U64 = np.uint64


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the cluster's shared checkpoint folder.

    The folder is the session's spark.checkpoint.dir; only where that is unset
    and all runs on one machine (tests) a temporary one is made.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def cut_in_loop(df: DataFrame) -> DataFrame:
    """cut(df), without the optimizer's estimate of its size.

    A checkpoint keeps the estimate of the plan before it, which multiplies the sizes
    of what is joined. Where each round joins the last one's rows twice, that number
    has four times the digits after each, until planning alone fills the driver.
    """
    done, spark = cut(df)._jdf, df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().analyzed().rdd(), done.schema(), False), spark)


def checkpoint_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="waymark-"))
    return sc.getCheckpointDir()


def release(spark: SparkSession) -> None:
    """Removes what this session left in the checkpoint folder, once no DataFrame made by it is needed any more.

    Spark gives each session a folder of its own in there. (Sessions started with
    spark.cleaner.referenceTracking.cleanCheckpoints drop checkpoints by themselves.)
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint_folder(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(path, True)
    fs.mkdirs(path)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder, read again."""
    folder = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df; from now on its session sends at most rows rows at a time to Python, since texts can be long.

    The setting is read when a plan starts, long after an operator has returned
    its DataFrame, so it stays; a lower one is left alone.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return df


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def broadcast_sized(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """df, to be broadcast if its checked number of rows is limit at most; beyond, joins shuffle or sort as usual."""
    return F.broadcast(df) if rows <= limit else df


def shipped(spark: SparkSession, model):
    """A dataclass object broadcast as a dict of plain values, which executors without this package can read."""
    return spark.sparkContext.broadcast(dict(model.__dict__))


def id_bucket(col: str, modulus: int) -> Column:
    """crc32 of the id as text, mod modulus: the fold a row belongs to."""
    return F.crc32(F.col(col).cast("string")) % F.lit(modulus)


def bounded_share(df: DataFrame, key: str, bound: int) -> DataFrame:
    """About bound rows of df at most, chosen by a hash of key; all of them if there are fewer."""
    n = df.count()
    if n <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(1 << 30)) < F.lit(int((1 << 30) * bound / n)))


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Nulls as empty strings, in one plain chunk."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a large_string array without nulls, and each row's start (and the end)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with at most size bytes of text (or one row), and their texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = text_array(batch.column(column))
        _, starts = text_bytes(texts)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + size, "right")) - 1)
            yield batch.slice(at, to - at), texts.slice(at, to - at)
            at = to


def kept(key, make):
    """make() once in this Python worker: later tasks of the process find it again.

    What is large has a tuple as key, by whose first part tasks keep it (see lean()).
    """
    held = worker()
    if key not in held:
        held[key] = make()
    return held[key]


def worker() -> dict:
    """What this Python process keeps from task to task."""
    return sys.modules.setdefault("waymark_worker", types.ModuleType("waymark_worker")).__dict__


def give_back() -> None:
    """Memory that arrow and malloc (glibc's) hold free goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(keeps: str | None = None) -> Callable:
    """Wraps a task's generator, so that its Python worker holds little for it after its end.

    Workers live on from one operator's tasks to the next one's, and while an operator
    works in the JVM alone, beside a heap that may be full. What arrow and malloc hold
    free after a task can be more than all that is in use. Large objects kept for
    other tasks, all but those named keeps, go before the task.
    """

    def wrap(task: Callable) -> Callable:
        @functools.wraps(task)
        def run(*args, **named):
            held = worker()
            for key in [k for k in held if isinstance(k, tuple) and k[0] != keeps]:
                del held[key]
            try:
                yield from task(*args, **named)
            finally:
                give_back()

        return run

    return wrap


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class Words:
    """Hashes and places of the words of texts, between gaps (bytes; by default \\x20 and \\x09-\\x0D), A-Z lower-cased.

    A word's hash starts from its length and takes in eight bytes at a time
    through mix(), all words at once: words of up to eight bytes of one length
    never collide, others as 64 random bits do. Words over LONG bytes are hashed
    by blake2b. Memory is about four bytes for each byte of the texts given, and
    sixteen for each word, so a chunk of CHUNK_BYTES or its one longer text sets it.
    """

    LONG = 1024

    def __init__(self, gaps: bytes = b" \t\n\v\f\r") -> None:
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.space = np.zeros(256, bool)
        self.space[list(gaps)] = True
        self.masks = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start byte and end byte of each word, and each row's first word (and the end)."""
        data, rows = text_bytes(texts)
        if not len(data):
            none = np.zeros(0, np.int64)
            return np.zeros(0, U64), none, none, np.zeros(len(rows), np.int64)
        gap = self.space[data]
        begins = np.zeros(len(data) + 1, bool)
        begins[rows] = True
        starts = np.flatnonzero(~gap & (begins[:-1] | np.concatenate([[True], gap[:-1]])))
        ends = np.flatnonzero(~gap & (begins[1:] | np.concatenate([gap[1:], [True]]))) + 1
        self.low = np.zeros(len(data) + 8, np.uint8)
        self.low[:-8] = self.lower[data]
        #: the eight bytes from each byte on
        self.eight = np.ndarray((len(data) + 1,), "<u8", self.low, strides=(1,))
        return self.hashed(starts, ends), starts, ends, np.searchsorted(starts, rows)

    def hashed(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        length = ends - starts
        hashes = mix(length.astype(U64) + U64(0x9E3779B97F4A7C15))
        live = np.arange(len(length))
        for at in range(0, min(self.LONG, int(length.max(initial=0))), 8):
            if at:
                live = live[length[live] > at]
            block = self.eight[starts[live] + at] & self.masks[np.minimum(length[live] - at, 8)]
            hashes[live] = mix(hashes[live] ^ block)
        for i in np.flatnonzero(length > self.LONG):
            hashes[i] = int.from_bytes(hashlib.blake2b(self.low[starts[i] : ends[i]], digest_size=8).digest(), "little")
        return hashes

    def beginnings(self, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the first n bytes, eight at most, of each word of the texts called last (of all of a shorter word)."""
        return mix(self.eight[starts] & self.masks[np.minimum(ends - starts, n)] ^ U64(0xC2B2AE3D27D4EB4F))

    def shingles(self, texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of k words, in order, and each row's first (and the end).

        A row of fewer words has one, of all its words; a row without words none.
        """
        hashes, _, _, first = self(texts)
        counts = np.diff(first)
        made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
        out = np.concatenate([[0], np.cumsum(made)])
        row = np.repeat(np.arange(len(counts)), made)
        at = first[row] + np.arange(out[-1]) - out[row]
        length = np.minimum(counts[row], k)
        total = np.zeros(len(at), U64)
        with np.errstate(over="ignore"):
            for j in range(k):
                own = j < length
                total[own] = mix(total[own] * U64(0xD6E8FEB86659FD93) + hashes[at[own] + j] + U64(j + 1))
        return total, out


def apart(name: str) -> Column:
    """The same number as an expression of its own.

    A side of a join that was aggregated by its key would be used as it lies, and
    AQE could not split the other side's hot keys. This makes Spark deal both anew.
    """
    return F.col(name).bitwiseXOR(F.lit(0).cast("long"))


def star(edges: DataFrame) -> DataFrame:
    """The connected components of edges (u long, v long): rows (node, root), root the smallest node.

    Alternates the large-star and small-star steps until nothing changes. Each
    step is a minimum by node, summed before the shuffle, and an equi-join whose
    skew AQE splits; a round's edges are kept in the checkpoint folder, and plans
    stay of one size however many rounds there are.
    """
    e = cut_in_loop(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(apart("u").alias("u"), "m")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least.select(apart("u").alias("u"), "m"), "u")
        e = cut_in_loop(small.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
