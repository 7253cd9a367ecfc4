"""Numpy kernels over the UTF-8 buffers of Arrow string columns.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, of the
text in lower case. Words and n-grams are known by 64-bit hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = 0x9E3779B97F4A7C15
_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_powers = np.ones(1, np.uint64)


#: How to drop what an operator holds between the tasks of a worker, by its name.
_HELD: dict[str, Callable[[], None]] = {}


def held_between_tasks(name: str, drop: Callable[[], None]) -> None:
    _HELD[name] = drop


def steady_memory(keep: str = "") -> None:
    """A worker that runs many steps holds no more than one needs: what other operators than `keep` hold is dropped, and large arrays, Arrow's too, go back to the system when they are freed. Without glibc the latter isn't so."""
    for name, drop in _HELD.items():
        if name != keep:
            drop()
    pa.default_memory_pool().release_unused()
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, fixed
        libc.malloc_trim(0)
    except (OSError, AttributeError):
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 4096) - 1, _ODD, np.uint64)]), dtype=np.uint64)
    return _powers


def utf8(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and where each begins (one more at the end). NULL counts as ""."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if lower:
        column = pc.utf8_lower(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, most: int = 500_000) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of about `most` bytes together; one text is never cut."""
    n, first = len(offsets) - 1, 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, end
        first = end


def sliced(data: np.ndarray, offsets: np.ndarray, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    return data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, none of which crosses into another text."""
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[begins] = inside[begins]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | start[1:]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def hashes(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of `values` (bytes of the runs in a row)."""
    if not len(lengths):
        return np.empty(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    at = np.arange(len(values)) - np.repeat(first, lengths)
    terms = _BYTE[values]
    terms *= powers(int(lengths.max()) + 1)[at]
    return mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in a row and how many each text has."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = WORD[data]
    start, end = spans(inside, offsets)
    return hashes(data[inside], end - start), np.diff(np.searchsorted(start, offsets))


def ngram_hashes(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all n-grams of words in a row and how many each text has.

    A text of 1 to n - 1 words has one, made of all its words; one without words has none.
    """
    first = np.cumsum(counts) - counts
    have = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    total = int(have.sum())
    at = np.arange(total) - np.repeat(np.cumsum(have) - have, have) + np.repeat(first, have)
    size = np.repeat(np.minimum(counts, n), have)
    out = words[at] if total else np.empty(0, np.uint64)
    for j in range(1, n):
        more = np.flatnonzero(size > j) if (size <= j).any() else slice(None)
        out[more] = mix(out[more] * np.uint64(_ODD) + words[at[more] + j])
    return out, have
