"""Flat numpy views of text columns: words, hashes and bounded batches without loops over rows.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, and never cross a row's end.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Fixed odd multipliers of the splitmix64 finaliser.
MIX_A, MIX_B, GOLDEN = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)
#: Masks that keep the first n bytes of a little-endian 8-byte load.
HEAD = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def shared_dir(spark: SparkSession) -> None:
    """Make sure that checkpoint() has a folder: the cluster's spark.checkpoint.dir; where it is unset, one of our own on a
    local master (as in tests), and an error on a cluster, whose machines share no folder that we could know."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not folder:
        import tempfile

        folder = tempfile.mkdtemp(prefix="spanforge-checkpoint-")
    context.setCheckpointDir(folder)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends; what it gave was written or checkpointed."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Most rows and bytes of one Arrow batch between Spark and a Python worker; texts are long.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to what these operators' workers are to hold at once (never raise it)."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def trim() -> None:
    """Give memory that a worker no longer uses back, since idle workers live on beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x + GOLDEN
    x ^= x >> U64(30)
    x *= MIX_A
    x ^= x >> U64(27)
    x *= MIX_B
    x ^= x >> U64(31)
    return x


@dataclass
class Words:
    """buf holds all rows' bytes; word i is buf[starts[i]:ends[i]]; row r has words first[r]:first[r + 1]."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, eight bytes at a time."""
        size = self.ends - self.starts
        padded = np.concatenate([self.buf, np.zeros(8, np.uint8)])
        loads = np.ndarray(shape=(len(self.buf) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
        out = mix(size.astype(np.uint64) ^ (loads[self.starts] & HEAD[np.minimum(size, 8)]) * MIX_A)
        left = np.flatnonzero(size > 8)
        at = 8
        while len(left):
            part = loads[self.starts[left] + at] & HEAD[np.minimum(size[left] - at, 8)]
            out[left] = mix(out[left] ^ part * MIX_B)
            at += 8
            left = left[size[left] > at]
        return out


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, one after the other, and each row's offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(wide), b"" if wide == pa.large_binary() else "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def words(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> Words:
    """Split every row into words; lower: turn A-Z to a-z first."""
    buf, offsets = text_bytes(column)
    if lower:
        buf = LOWER[buf]
    n = len(buf)
    space = SPACE[buf]
    before, after = np.empty(n, bool), np.empty(n, bool)
    if n:
        before[0] = after[-1] = True
        before[1:], after[:-1] = space[:-1], space[1:]
        edges = offsets[1:-1]
        before[edges[edges < n]] = True
        after[edges[edges > 0] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return Words(buf, starts, ends, np.searchsorted(starts, offsets), offsets)


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Regroup rows so that each table has about limit bytes of column, or one row that is longer; all rows, in order."""
    pending: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            part = int(ends[to - 1] - done)
            if pending and held + part > limit:
                yield pa.Table.from_batches(pending)
                pending, held = [], 0
            pending.append(batch.slice(at, to - at))
            held += part
            at = to
    if pending:
        yield pa.Table.from_batches(pending)
    del pending
    trim()


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array of values cut at offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def flat(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the length of each list; null lists are empty."""
    values = [np.asarray(chunk.flatten(), dtype=kind) for chunk in column.chunks]
    sizes = [np.asarray(pc.fill_null(pc.list_value_length(chunk), 0), dtype=np.int64) for chunk in column.chunks]
    return np.concatenate(values or [np.zeros(0, kind)]), np.concatenate(sizes or [np.zeros(0, np.int64)])
