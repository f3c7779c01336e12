"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.functions.memory import release  # noqa: F401
from relspark.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
# Everything below U+0080 that is neither a digit nor a letter separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def raw_words(text: Column) -> Column:
    """Words of a text in their own case; null and word-less texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def store(spark: SparkSession, df: DataFrame, name: str, partition_by: str | None = None) -> str:
    """Write ``df`` below the shared checkpoint folder (cuts lineage; survives a lost executor).

    Compressed Parquet rather than ``checkpoint()`` files; removed when the application ends.
    """
    path = scratch_path(spark, name)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    return path


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written to and read back from the shared checkpoint folder."""
    schema = df.schema
    path = store(spark, df, name)
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete tables that ``stored`` returned, once what was made of them is stored itself."""
    for t in tables:
        if t is not None:
            discard(t.sparkSession, t._stored_at)


def fresh_names(docs: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until no column of ``docs`` has them."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that ``store`` wrote, once nothing will read it again."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def bucketed(spark: SparkSession, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``df`` as a table below the shared checkpoint folder, bucketed by ``key``: later groupings and
    joins on ``key`` read it without a shuffle."""
    path = scratch_path(spark, name)
    named = path.rstrip("/").rpartition("/")[2].replace("-", "_")
    df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(named)
    return spark.table(named)


@contextmanager
def batch_bytes(spark: SparkSession, limit: int):
    """Arrow batches that Python gets from queries run inside hold about ``limit`` bytes at most; one
    batch is a whole task's input otherwise, in the JVM's memory and the worker's."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(limit))
    try:
        yield
    finally:
        spark.conf.set(name, before)


BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, size: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint when ``size`` (one row, one number: its bytes, or a bound of
    them) is at most ``limit``; else ``df`` as it is, for a shuffle join."""
    n = size.first()[0]
    return F.broadcast(df) if n is not None and n <= limit else df


# ---- words of a whole Arrow batch as flat numpy arrays -----------------------------------

_BYTE = np.arange(256)
IS_WORD = ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x41) & (_BYTE <= 0x5A)) | (
    (_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)
TO_LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 0x20, _BYTE).astype(np.uint8)

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (every input bit reaches every output bit); wraps modulo 2**64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets into them (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    width = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], dtype=width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each row's first word (plus the
    total at the end).  A word never crosses a row boundary."""
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = IS_WORD[flat]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]  # a word that begins a row begins there
    start[first] = inside[first]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[last] = inside[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of every word, A-Z lower-cased unless told otherwise: eight bytes at a time, each chunk mixed
    into the state of its word, so only the bytes of the words decide."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    low = np.concatenate([TO_LOWER[flat] if lower else flat, np.zeros(8, np.uint8)])
    # the little-endian 8-byte word that begins at each needed byte
    length = ends - starts
    state = mix64(length.astype(np.uint64) * _MULT + np.uint64(1))
    live = np.arange(len(starts))
    at = starts.copy()
    left = length.copy()
    windows = np.lib.stride_tricks.sliding_window_view(low, 8)
    while len(live):
        chunk = np.ascontiguousarray(windows[at]).view(np.uint64).ravel()
        short = left < 8
        keep = np.where(short, (np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1),
                        np.uint64(0xFFFFFFFFFFFFFFFF))
        state[live] = mix64(state[live] ^ (chunk & keep) * _MULT)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return state


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside each row, and the index of each row's first
    run.  A row of fewer than ``k`` words, but not none, has one run: all its words."""
    n = np.diff(first)
    runs = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(runs)])
    row = np.repeat(np.arange(len(n)), runs)
    at = first[:-1][row] + np.arange(out_first[-1]) - out_first[:-1][row]
    size = np.minimum(n[row], k)
    acc = size.astype(np.uint64) * _MULT
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    for j in range(k):
        nxt = mix64((acc ^ padded[at + j]) + _MULT)
        acc = nxt if n.size == 0 or n.min() >= k else np.where(j < size, nxt, acc)
    return acc, out_first


def batch_rows(batch: pa.RecordBatch, max_bytes: int, text: str = "text"):
    """Slices of a batch that hold at most ``max_bytes`` of text each (one row at least), so
    the numpy arrays over a slice are bounded whatever the session's batch size is."""
    col = batch.column(batch.schema.get_field_index(text))
    size = col if pa.types.is_integer(col.type) else pa.compute.binary_length(col)  # or a column of sizes
    size = size.fill_null(0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, n in enumerate(size):
        if total and total + n > max_bytes:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(n)
    if begin < len(col):
        yield batch.slice(begin)
