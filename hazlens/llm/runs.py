"""Text columns as flat byte arrays: cut into words and counted without a Python loop.

A text is cut before each ASCII white space that follows anything else, so a
run is the white space plus the word after it. No pre-tokenizer used here
matches across such a cut, so what is true of a run holds wherever it occurs
and each distinct run of a batch is worked on once.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text worked on at once; a longer single text is worked on alone.
BATCH_BYTES = 8 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


#: The one large table that a worker process keeps between tasks: (key, table).
_held: list[tuple[object, object]] = []


def held(key: object, make):
    """The table of ``key``, made once a worker process. Another key's table goes first."""
    if not _held or _held[0][0] != key:
        _held.clear()
        _held.append((key, make()))
    return _held[0][1]


def _tidy(work, keeps: object):
    """``work`` in a process that other kinds of tasks have used and will use: what they held goes, and freed memory too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _held and _held[0][0] != keeps:
            _held.clear()
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run


def mapped(df: DataFrame, work, schema, keeps: object = None) -> DataFrame:
    """``df.mapInArrow(work, schema)`` for rows with texts; keeps: the key of what ``work`` holds.

    Batches between the JVM and Python are bounded by bytes for the session, since rows alone
    don't bound them: ten thousand long texts are hundreds of megabytes, held on both sides.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(_tidy(work, keeps), schema)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each text (one more than texts); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        row = 0
        while row < len(sizes):
            done = ends[row - 1] if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(row, stop - row)
            row = stop


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes that aren't ASCII white space, and each text's first word."""
    edge = np.ones(len(data) + 1, bool)
    if len(data):
        space = SPACE[data]
        edge[:-1] = space
        starts = ~space
        first = at[:-1][at[:-1] < at[1:]]
        before = np.ones(len(data), bool)
        before[1:] = space[:-1]
        before[first] = True
        starts &= before
        last = ~space
        after = np.ones(len(data), bool)
        after[:-1] = space[1:]
        after[at[1:][at[:-1] < at[1:]] - 1] = True
        last &= after
        begin, end = np.flatnonzero(starts), np.flatnonzero(last) + 1
    else:
        begin = end = np.zeros(0, np.int64)
    return begin, end, np.searchsorted(begin, at)


def distinct(data: np.ndarray, at: np.ndarray, more: np.ndarray | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct runs, the number of each run in order, and each text's first run. more: where to cut as well."""
    if not len(data):
        return [], np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    space = SPACE[data]
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[at[:-1][at[:-1] < at[1:]]] = True
    if more is not None:
        cut |= more
    begin = np.flatnonzero(cut)
    offsets = np.append(begin, len(data))
    large = len(data) > 2_000_000_000
    kind, width = (pa.large_string(), np.int64) if large else (pa.string(), np.int32)
    array = pa.Array.from_buffers(kind, len(begin), [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = array.dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(begin, at)


def spread(values: np.ndarray, first: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ragged take: the values of each code in turn, and the offset of each. Code c has values[first[c]:first[c+1]]."""
    sizes = (first[1:] - first[:-1])[codes]
    ends = np.cumsum(sizes)
    where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[:-1][codes] - (ends - sizes), sizes)
    return values[where], np.concatenate([[0], ends]).astype(np.int64)


class Memo:
    """A bounded memory of ragged values worked out for strings; it forgets all when full."""

    def __init__(self, dtype: type = np.uint32, limit: int = 250_000) -> None:
        self.dtype, self.limit = dtype, limit
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.values, self.first = np.zeros(1 << 16, self.dtype), np.zeros(1 << 16, np.int64)
        self.used = 0

    def codes(self, keys: list[str], work) -> np.ndarray:
        """The number of each key, for :meth:`take`; good until the next call. ``work`` gets distinct keys that
        aren't known and returns their values in turn and the offset of each."""
        index = self.index
        new = [k for k in dict.fromkeys(keys) if k not in index]
        if new and len(index) + len(new) > self.limit:
            self._reset()
            index, new = self.index, list(dict.fromkeys(keys))
        if new:
            values, ends = work(new)
            at, n = len(index), len(new)
            self.values = self._room(self.values, self.used + len(values))
            self.first = self._room(self.first, at + n + 1)
            self.values[self.used : self.used + len(values)] = values
            self.first[at + 1 : at + n + 1] = self.used + ends[1:]
            self.used += len(values)
            index.update(zip(new, range(at, at + n), strict=True))
        return np.fromiter(map(index.__getitem__, keys), np.int64, len(keys))

    @staticmethod
    def _room(array: np.ndarray, need: int) -> np.ndarray:
        if need <= len(array):
            return array
        out = np.zeros(max(need, 2 * len(array)), array.dtype)
        out[: len(array)] = array
        return out

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of each code in turn and the offset of each."""
        return spread(self.values, self.first[: len(self.index) + 1], codes)
