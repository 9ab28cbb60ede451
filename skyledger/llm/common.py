"""Helpers the operators share: tables, hot keys, and text as numpy arrays."""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.session import scratch_path

#: Word separators of the contracts: space, tab, newline, vertical tab, form feed, return.
SEPARATORS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot if it holds more than this share of the rows; so there are fewer than
#: 1 / HOT_SHARE hot keys, whatever the table.
HOT_SHARE = 0.001


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of `rows` with one row of `table` for each key, without a hot task.

    `size` holds how many of the `total` rows have the key. Keys above HOT_SHARE are fewer than
    1 / HOT_SHARE and are broadcast; of the others none is large. `rows` is read twice, so it
    should be a stored table.
    """
    limit = max(1, int(total * HOT_SHARE))
    hot = F.broadcast(table.filter(F.col(size) > limit))
    rest = table.filter(F.col(size) <= limit)
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(rest, keys)
    return rows.join(hot, keys).unionByName(cold)


def share(spark: SparkSession, value) -> Broadcast:
    """Broadcast an object together with its class, which workers may not have installed."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(handle: Broadcast):
    """The object of `share`, unpacked once in a worker and kept between its tasks."""
    if not hasattr(handle, "unpacked"):
        handle.unpacked = pickle.loads(handle.value)
    return handle.unpacked


# ---- Text in Python workers ---------------------------------------------------------------

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[ord(c) for c in SEPARATORS]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection on 64 bits that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offset of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to `limit` bytes together, or of one longer text."""
    start = 0
    while start < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = max(start + 1, min(end, len(offsets) - 1))
        yield start, end
        start = end


def give_back() -> None:
    """Return freed memory to the system, at the end of a task: workers outlive their tasks, and
    idle ones share the executor's memory with those at work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of up to `limit` bytes of a text column, or of one longer text."""
    for batch in batches:
        width = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
        for a, b in pieces(np.concatenate(([0], np.cumsum(width))), limit):
            yield batch.slice(a, b - a)
    give_back()


@dataclass
class Words:
    """The words of several texts: byte range, text, 64-bit hash; and the first word of each text."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every k words in a row within a text, and the index of its first word."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[: n] == self.doc[k - 1 :])
        total = np.zeros(len(at), np.uint64)
        for i in range(k):
            total = mix(total * _BASE + self.hash[at + i])
        return total, at


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Split texts into words; `offsets` starts at 0."""
    count = len(offsets) - 1
    inside = ~_SEPARATOR[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(start, offsets, "left")
    if not len(start):
        return Words(start, end, doc, np.zeros(0, np.uint64), np.zeros(count + 1, np.int64))
    length = end - start
    power = np.cumprod(np.full(int(length.max()) + 1, _BASE, np.uint64))
    inner = np.flatnonzero(inside)
    head = np.concatenate(([0], np.cumsum(length)[:-1]))
    code = _BYTE[_LOWER[data[inner]] if lower else data[inner]]
    code *= power[np.arange(len(inner)) - np.repeat(head, length)]
    return Words(start, end, doc, mix(np.add.reduceat(code, head) + length.astype(np.uint64)), first)
