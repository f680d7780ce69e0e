"""Helpers that the training-data operators share.

A word is a run of bytes other than space and 0x09-0x0D, which is what ``bytes.split()`` yields on UTF-8.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one step of a Python function holds at once; a single longer text forms a step of its own.
STEP_BYTES = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch between the JVM and Python, where the session has Spark's default of 64 MB.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", str(4 << 20))


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batch size, on which memory depends but no result, unless the caller has set it."""
    key, default, size = BATCH
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, size)


def tidied(run: Callable) -> Callable:
    """An Arrow function that gives the memory it freed back to the system at its end: workers live on between tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes in column ``text``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def per_text(df: DataFrame, id_col: str, text_col: str, out: T.StructType, make: Callable[[], Callable]) -> DataFrame:
    """One output row a text. ``make()`` runs once a task and returns f(list of bytes) -> list of columns after the id.

    Only the two named columns are read, so other columns may have any name.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *out.fields])
    names = [f.name for f in schema.fields]

    def run(batches):
        f = make()
        for part in steps(batches):
            cols = f(texts_of(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), *(c if isinstance(c, pa.Array) else pa.array(c) for c in cols)], names=names)

    small_batches(df.sparkSession)
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(tidied(run), schema)


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words. Hashing anew is faster than a cache, and needs no memory."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_MIX = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xFF51AFD7ED558CCD)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * _MUL
    return x ^ (x >> np.uint64(29))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes; empty when there are fewer than k words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _MIX + hashes[i : i + n]
    return mix(out)


def crc_mod(id_col: str, m: int):
    """crc32 of the id as text, modulo m."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(m))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir).

    Where it is unset, a folder of this machine serves a session that runs on this machine alone; a cluster, whose
    executors would each write to their own disk, gets an error.
    """
    small_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, fold: int = 1) -> DataFrame:
    """The frame written as Parquet in the shared folder and read back, so that lost executors need no earlier stage.

    ``fold`` partitions share a file: results far smaller than what they were made from need fewer files.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    (df.coalesce(max(1, tasks(spark) // fold)) if fold > 1 else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
