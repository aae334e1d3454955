"""Numpy kernels over whole Arrow string batches.

Every kernel works on the concatenated UTF-8 bytes of a batch plus row offsets,
so the Python cost is per batch and never per row or per token.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; bounds the temporaries (8-64x this) per Python worker.
CHUNK_BYTES = 1 << 19

SPACE, WORD, PUNCT = 0, 1, 2

#: Byte class of lower-cased UTF-8: letters, digits and every non-ASCII byte are WORD.
BYTE_CLASS = np.full(256, PUNCT, np.uint8)
BYTE_CLASS[[9, 10, 11, 12, 13, 32, 0]] = SPACE
for _lo, _hi in ((48, 57), (65, 90), (97, 122), (128, 255)):
    BYTE_CLASS[_lo : _hi + 1] = WORD

#: Maps letters to themselves and everything else to a space.
LETTERS = np.full(256, 32, np.uint8)
#: Maps letters and digits to themselves and everything else to a space.
ALNUM = np.full(256, 32, np.uint8)
for _lo, _hi in ((65, 90), (97, 122), (128, 255)):
    LETTERS[_lo : _hi + 1] = np.arange(_lo, _hi + 1)
    ALNUM[_lo : _hi + 1] = np.arange(_lo, _hi + 1)
ALNUM[48:58] = np.arange(48, 58)

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_BASE_INV = pow(_BASE, -1, 1 << 64)


def as_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous large_string array without nulls (null reads as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return pc.fill_null(column, "").cast(pa.large_string())


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array, offsets starting at 0."""
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8, int(off[-1] - off[0]), int(off[0])), off - off[0]


def row_chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most max_bytes, or of one row that is longer by itself."""
    n = len(column)
    if n == 0:
        return
    _, off = buffers(column)
    start = 0
    while start < n:
        end = int(np.searchsorted(off, off[start] + max_bytes, "right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end
    trim()


def trim() -> None:
    """Gives freed memory back to the system, where its C library can: a worker stays for the next task."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError, TypeError):
        pass


def padded_lower(column: pa.Array) -> pa.Array:
    """Lower case with one space before and after every row."""
    return pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.utf8_lower(column), pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))


def normalised(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes mapped through table, with runs of spaces collapsed.

    Every row begins and ends with exactly one space (a row without content is
    one space), so a word boundary is always a space byte.
    """
    buf, off = buffers(padded_lower(column))
    if len(buf) == 0:
        return buf, off
    mapped = table[buf]
    space = mapped == 32
    drop = np.zeros(len(buf), bool)
    drop[1:] = space[1:] & space[:-1]
    drop[off[:-1]] = False
    keep = ~drop
    position = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(keep, out=position[1:])
    return mapped[keep], position[off]


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES * 2)
        p, q = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INV, np.uint64)
        p[0] = q[0] = 1
        _POWERS["p"], _POWERS["q"] = np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)
    return _POWERS["p"], _POWERS["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur style)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, by differences of one running polynomial sum."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    p, q = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64) * _MULT)


def tokens(buf: np.ndarray, classes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one non-space class: (starts, ends, row of each token)."""
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    change = np.ones(len(buf) + 1, bool)
    change[1:-1] = classes[1:] != classes[:-1]
    change[off] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    real = classes[starts] != SPACE
    starts, ends = starts[real], ends[real]
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def word_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the lower-cased words (letters and digits) of every row."""
    buf, off = normalised(column, ALNUM)
    starts, ends, rows = tokens(buf, (buf != 32).astype(np.uint8), off)
    return span_hashes(buf, starts, ends), rows
