"""Helpers shared by the operators of this subpackage.

Rows with a null text count as empty documents.  Only the identifier and text
columns are read, by exact name, so any further columns (whatever their names)
cannot clash with the operators' own.
"""

from __future__ import annotations

import ctypes
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_G = U64(0x9E3779B97F4A7C15)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, matched case-sensitively and by position, so that an extra
    column differing only in case is no ambiguity."""
    places = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(n) for i, n in zip(places, names, strict=True)])


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(doc_id long, text string) with null texts as empty, and the columns of `more` as they are."""
    some = exact_columns(df, id_col, text_col, *more).toDF("doc_id", "text", *more)
    return some.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def n_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder of spark.checkpoint.dir."""
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint()
    spark.sparkContext._jvm.System.gc()  # Spark deletes the shuffles of the lineage that was cut when the driver's memory is cleared
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Where that setting is absent, a local session (tests)
    gets a folder of its own; a cluster is refused, as its machines would not share one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        chosen = sc.getConf().get("spark.checkpoint.dir")
        if chosen is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(chosen or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, element by element."""
    x = x ^ (x >> U64(30))
    x = x * _M1
    x = x ^ (x >> U64(27))
    x = x * _M2
    return x ^ (x >> U64(31))


_caches: dict = {}
try:  # hands back what a worker has freed; other C libraries do without
    _libc = ctypes.CDLL("libc.so.6")
except OSError:
    _libc = None


def remembers(owner: str, clear) -> None:
    """Register what an operator keeps in a worker from task to task."""
    _caches[owner] = clear


def only(owner: str = "") -> None:
    """Called as a task begins: a worker keeps one operator's memory, not that of all it has served."""
    for name, clear in _caches.items():
        if name != owner:
            clear()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembering a bounded number of words of a bounded length."""

    limit, longest = 150_000, 64

    def __missing__(self, word):
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive entries, built from runs of powers of two."""
    if len(h) < n:
        return h[:0]
    out, width, run, run_width, left = None, 0, h, 1, n
    while left:
        if left & 1:
            if out is None:
                out, width = run, run_width
            else:
                m = len(h) - width - run_width + 1
                out, width = mix(out[:m] * _M1 + run[width:width + m] + _G), width + run_width
        left >>= 1
        if left:
            m = len(h) - 2 * run_width + 1
            run, run_width = mix(run[:m] * _M2 + run[run_width:run_width + m] + _G), 2 * run_width
    return out[: len(h) - n + 1]


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted uint64 values as gaps of the fewest whole bytes that hold the largest gap."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=U64(0))
    first, gaps[0] = int(gaps[0]), 0
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    body = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + first.to_bytes(8, "little") + np.ascontiguousarray(body).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, U64)
    width, first = data[0], int.from_bytes(data[1:9], "little")
    body = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    full = np.zeros((len(body), 8), np.uint8)
    full[:, :width] = body
    return np.cumsum(full.view("<u8").ravel(), dtype=U64) + U64(first)


def slices(batches, size: int = 4_000_000):
    """Batches cut so that the texts of a slice have about `size` bytes, or one row. What a slice leaves
    unused in Arrow's pool is handed back before the next one."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)))
            yield batch.slice(at, stop - at)
            pa.default_memory_pool().release_unused()
            at = stop


def crc_of_id(df_col="doc_id"):
    """crc32 of the identifier written as text; null identifiers count as the empty text."""
    return F.crc32(F.coalesce(F.col(df_col).cast("string"), F.lit("")).cast("binary"))
