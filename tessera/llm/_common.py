"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a maximal run of anything but these characters.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that Python code takes at once.
SLICE_BYTES = 4 << 20
#: Bytes of a batch that Spark hands to Python; else only rows are counted, 10,000, however long.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder of spark.checkpoint.dir. A temporary folder of our own is set only where the session has none and all runs on this machine, as in tests."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tessera-checkpoints-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside hands Python batches of SLICE_BYTES and a row at most, which both sides hold. A session's own setting stays."""
    if spark.conf.get(BATCH_BYTES, None) is not None:
        yield
        return
    spark.conf.set(BATCH_BYTES, str(SLICE_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_BYTES)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files and checkpoints of frames that are no longer referred to. Call it between the rounds of a loop: without a full collection they stay on disk until the driver's heap fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy() -> None:
    """Gives memory that a Python worker has freed back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES):
    """The batch in pieces of about `most` bytes of the column; one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // most
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)
    tidy()


def lowered(texts: pa.Array) -> pa.Array:
    """A-Z in lower case; null as empty. (pyarrow's ascii_lower misreads arrays that begin inside a buffer.)"""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).astype(np.int64)), pa.py_buffer(data.tobytes()))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and where each text's words begin (one more entry than texts). Null: no words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    # Arrow's ASCII white space is \x20 and \x09-\x0D, as in WORD; it only adds empty strings at the ends
    parts = pc.ascii_split_whitespace(texts)
    flat, ends = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(real)))[ends - ends[0]]
    return flat.filter(pa.array(real)), starts


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same on every machine."""
    import xxhash

    coded = flat.dictionary_encode()
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return own[coded.indices.to_numpy()] if len(flat) else np.empty(0, np.uint64)


def window_hashes(words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows that lie in one text, and the text of each."""
    if len(words) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i] + np.uint64(i + 1))
    whole = of[: len(words) - n + 1] == of[n - 1 :]
    return h[whole], of[: len(words) - n + 1][whole]
