"""Shared helpers: tables in the shared folder, bounded bitmaps, and word hashes over Arrow text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import new_path

#: Words are runs of characters other than these: 0x09-0x0D and 0x20.
WORD = r"[^\x20\x09-\x0D]+"

_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_OTHER_BYTE = np.random.Generator(np.random.PCG64(20240608)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: Text that is hashed at one time, in bytes; a longer document is a piece of its own.
PIECE_BYTES = 1 << 18
#: Most of a batch that goes to a Python worker: rows, and bytes; with Spark's own defaults, which it takes the place of.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", str(2 << 20))}


def drop(path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


_scratch: ContextVar[tuple[str, list[Broadcast], str | None] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized and values that are shared inside go when it ends; what is returned from it has to be kept().
    Inside another one, what is kept goes with that."""
    path, values, outer = new_path(spark, "scratch"), [], _scratch.get()
    token = _scratch.set((path, values, outer and outer[0]))
    try:
        yield
    finally:
        _scratch.reset(token)
        drop(path)
        for value in values:
            value.destroy()


def shared(spark: SparkSession, value) -> Broadcast:
    """A value for all tasks; inside scratch() it goes with the tables there."""
    out = spark.sparkContext.broadcast(value)
    if _scratch.get():
        _scratch.get()[1].append(out)
    return out


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow with batches of BATCH, unless the session sets others, so that a worker's memory doesn't hang on the length
    of texts; and what a task leaves in Arrow's pool goes back to the system when it ends."""
    for key, (default, value) in BATCH.items():
        if df.sparkSession.conf.get(key).rstrip("b") == default:
            df.sparkSession.conf.set(key, value)

    def task(batches: Iterator[pa.RecordBatch]):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(task, schema)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it again: the lineage ends there, and lost executors cost nothing."""
    inside = _scratch.get()
    return _written(df, f"{inside[0]}/{name}-{uuid.uuid4().hex}" if inside else new_path(df.sparkSession, name))


def kept(df: DataFrame, name: str) -> DataFrame:
    """The same, to stay when the scratch tables go."""
    inside = _scratch.get()
    return _written(df, f"{inside[2]}/{name}-{uuid.uuid4().hex}" if inside and inside[2] else new_path(df.sparkSession, name))


def bounded(df: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """df, for a join: marked to be broadcast if it has at most so many rows (of a few numbers each), else left to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bitmap_slot(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits))


def bitmap(df: DataFrame, slot: str, bits: int) -> np.ndarray:
    """A bitmap of 2^bits of the slots in a column: at most 2^bits / 4 bytes reach the driver, whatever the input, and as columns: no
    object is made for a word.

    It only thins out rows ahead of an exact join: a full bitmap keeps everything and loses nothing.
    """
    words = (
        df.select((F.col(slot) / 32).cast("int").alias("w"), F.expr(f"shiftleft(1, cast({slot} % 32 as int))").alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    )
    out = np.zeros(1 << bits >> 5, np.uint32)
    for some in words.to_batches():
        out[some.column("w").to_numpy()] = some.column("b").to_numpy().view(np.uint32)
    return out


def in_bitmap(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 5] >> (slots & 31).astype(np.uint32)) & np.uint32(1) != 0


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all of the input's."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_FIRST_PLACES = mix((np.arange(4096, dtype=np.uint64) + np.uint64(1)) * _A) | np.uint64(1)


def _places(n: int) -> np.ndarray:
    """A random odd factor for each place in a word; words differ in a sum of bytes' numbers times these by chance 2^-63."""
    return mix((np.arange(n, dtype=np.uint64) + np.uint64(1)) * _A) | np.uint64(1) if n > len(_FIRST_PLACES) else _FIRST_PLACES


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


class Words:
    """Words of consecutive rows of text: first[i]..first[i+1] are the words of row i; start and end are byte offsets into data."""

    def __init__(self, data: np.ndarray, at: np.ndarray, fold: bool, spaces: np.ndarray | None = None, twice: bool = False):
        """spaces: for each of the 256 bytes, whether it stands between words; the bytes that WORD leaves out unless given. twice: a
        second hash, `check`, that has nothing to do with the first."""
        lo, hi = int(at[0]), int(at[-1])
        self.data = b = data[lo:hi]
        at = at - lo
        space = (b == 32) | ((b >= 9) & (b <= 13)) if spaces is None else spaces[b]
        edge = np.zeros(len(b) + 1, bool)  # a word may not run over the end of its row
        edge[at] = True
        word = ~space
        begins = word.copy()
        begins[1:] &= space[:-1] | edge[1:-1]
        ends = word.copy()
        ends[:-1] &= space[1:] | edge[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, at)
        if fold:
            b = np.where((b >= 65) & (b <= 90), b | 32, b)
        size = self.end - self.start
        self.hash = self.check = np.zeros(0, np.uint64)
        if len(size):
            own = b[word]
            heads = np.zeros(len(size), np.int64)
            np.cumsum(size[:-1], out=heads[1:])
            place = np.arange(len(own), dtype=np.int32) - np.repeat(heads.astype(np.int32), size)
            factor = _places(int(size.max()))[place]
            value = _BYTE[own]
            value *= factor
            self.hash = mix(np.add.reduceat(value, heads) + size.astype(np.uint64))
            if twice:
                value = _OTHER_BYTE[own]
                value *= mix(factor)
                self.check = mix(np.add.reduceat(value, heads))

    def row(self, i: int) -> slice:
        return slice(self.first[i], self.first[i + 1])


def pieces(at: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many bytes each."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    h = left * _B
    h += right
    h ^= h >> np.uint64(32)
    h *= _C
    return h


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries of h: a tree over runs of powers of two. Nothing in it is linear, so that no pattern
    of words (as Thue and Morse's, with polynomials modulo 2^64) makes different runs equal."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, run, size = None, 0, h, 1
    while True:
        if k & size:
            part = run[at : at + n]
            out = part if out is None else joined(out, part)
            at += size
        if at == k:
            return mix(out)
        run, size = joined(run[:-size], run[size:]), 2 * size


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from values laid end to end."""
    at = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))
