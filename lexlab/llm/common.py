"""Helpers of the subpackage for work inside tasks: Arrow batches and word hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: bytes of a slice for work that makes some sixty bytes of arrays for each byte of text
FINE = 256 << 10


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public domain constants of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_BYTE = splitmix(np.arange(256, dtype=U)) | U(1)
_STEP = U(0xD6E8FEB86659FD93)
_code = np.arange(256)
_UPPER = (_code >= 65) & (_code <= 90)
_LOWER = np.where(_UPPER, _code + 32, _code).astype(np.uint8)
#: bytes of words: digits, letters and everything outside ASCII
IS_WORD = ((_code >= 48) & (_code <= 57)) | _UPPER | ((_code >= 97) & (_code <= 122)) | (_code >= 128)
_BYTE = _BYTE[_LOWER]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, and the offsets of its
    rows in it (null rows are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or len(off) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all rows, and the first word of each row.

    A word is a longest run of ASCII letters, digits and non-ASCII characters;
    A-Z count as a-z.  Words never reach across rows."""
    n = len(data)
    if n == 0:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    inside = IS_WORD[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edges = offsets[:-1]
    edges = edges[edges < n]
    start[edges] = inside[edges]
    first = np.flatnonzero(start)
    if len(first) == 0:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    pos = np.flatnonzero(inside)
    which = np.cumsum(start[pos]) - 1
    depth = pos - first[which]
    power = np.ones(int(depth.max()) + 1, U)
    with np.errstate(over="ignore"):
        power[1:] = np.multiply.accumulate(np.full(len(power) - 1, _STEP, U))
        term = _BYTE[data[pos]] * power[depth]
        starts = np.searchsorted(pos, first)
        h = splitmix(np.add.reduceat(term, starts) + U(len(power) * 0))
    return h, np.searchsorted(first, offsets)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of one text; a text of
    fewer words, but not none, has one shingle of them all."""
    if len(words) == 0:
        return words
    k = min(k, len(words))
    m = len(words) - k + 1
    with np.errstate(over="ignore"):
        h = np.full(m, U(k), U)
        for i in range(k):
            h = (h ^ words[i:i + m]) * U(0x9FB21C651E98DF25)
            h ^= h >> U(32)
        return np.unique(splitmix(h))


def batches(frames, n_bytes: int = 2 << 20):
    """Arrow record batches cut into slices of about ``n_bytes`` (one row at
    least), so that what a task holds at once follows its longest text and not
    the number of rows of a batch.  What Arrow keeps of freed memory goes back
    after each batch, as the worker stays for the tasks that come later."""
    for batch in frames:
        if batch.num_rows == 0:
            continue
        rows = max(1, int(batch.num_rows * n_bytes / max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        pa.default_memory_pool().release_unused()


def fill_exactly(counts: dict[int, int], capacity: int, must: int) -> list[int] | None:
    """Lengths out of ``counts`` that fill ``capacity`` exactly, ``must`` among
    them; long lengths are tried first."""
    target, layers, reach = capacity - must, [], 1
    full = (1 << target + 1) - 1
    for size, n in sorted(counts.items(), reverse=True):
        n -= size == must
        unit = 1
        while n > 0 and not reach >> target & 1:
            take = min(unit, n)
            if take * size <= target:
                layers.append((size, take, reach))
                reach |= reach << take * size & full
            n, unit = n - take, unit * 2
    if not reach >> target & 1:
        return None
    out, at = [must], target
    for size, take, before in reversed(layers):
        if not before >> at & 1:
            out += [size] * take
            at -= take * size
    return out
