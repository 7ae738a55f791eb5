"""Vectorised word tables over Arrow string columns: one numpy pass per batch, no Python string per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled by one numpy pass; bounds a worker's memory.
CHUNK_BYTES = 250_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts sum to about `limit` bytes (a longer text alone makes one slice)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row in them (nulls are empty)."""
    array = pc.fill_null(array, "").cast(pa.large_string())
    _, where, data = array.buffers()
    offsets = np.frombuffer(where, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def spans(data: np.ndarray, offsets: np.ndarray, bytes_of: np.ndarray = ~_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte and row number of every word: a longest run of the bytes marked, `[^\\x20\\x09-\\x0D]+` unless told."""
    n = len(data)
    solid = np.zeros(n + 1, bool)
    solid[:n] = bytes_of[data]
    before = np.zeros(n + 1, bool)
    before[1:] = solid[:-1]
    before[offsets] = False
    starts = np.flatnonzero(solid & ~before)
    closes = before & ~solid
    edge = offsets[1:]
    edge = edge[edge > 0]
    closes[edge] |= solid[edge - 1]
    ends = np.flatnonzero(closes)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        step = np.full(size, _BASE, np.uint64)
        step[0] = 1
        back = np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        back[0] = 1
        _powers.update(up=np.multiply.accumulate(step), down=np.multiply.accumulate(back))
    return _powers["up"], _powers["down"]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word; the same bytes hash alike in every process."""
    return span_hashes(_TABLE[data], starts, ends)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of an array of mixed 64-bit values, alike wherever the span stands."""
    up, down = _power(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive word hashes (of the whole array, rows not told apart)."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(_BASE) + words[i : i + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def row_bounds(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Index of the first word of each row, and one past the last."""
    return np.searchsorted(rows, np.arange(n_rows + 1))
