"""Vectorised hashes over the bytes of many texts, for use inside tasks.

Texts are laid end to end in one byte array; positions of different texts never mix,
because every n-gram that would cross an end is dropped by the caller's length check.
All arithmetic is modulo 2^64.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import zstandard

def _table(members: set[int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


#: Bytes between words: white space, or everything in ASCII but letters and digits.
SPACES = _table({32, 9, 10, 11, 12, 13})
NOT_LETTERS = _table({c for c in range(128) if not chr(c).isalnum()})

#: Odd multipliers and shifts of the 64-bit finaliser (fixed values).
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Base of the byte polynomial; odd, so that its powers can be inverted.
_BASE = 0x2545F4914F6CDD1D
#: Bytes hashed at once; keeps the working arrays small.
CHUNK_BYTES = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def chained(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two hashes in order."""
    return mixed(left * _STEP + right + _STEP)


def chunks(texts: Sequence[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """``(first, end)`` of runs of texts of about ``limit`` bytes; a longer text stays whole."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield first, i
            first, held = i, 0
        held += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


_known_powers: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """1, base, base^2 and so on, ``n`` of them; tables up to a chunk's size are kept."""
    table = _known_powers.get(base)
    if table is None or len(table) < n:
        steps = np.full(max(n, CHUNK_BYTES), base, dtype=np.uint64)
        steps[0] = 1
        table = np.multiply.accumulate(steps)
        if n <= CHUNK_BYTES:
            _known_powers[base] = table
    return table[:n]


_INVERSE = pow(_BASE, -1, 2**64)


def word_hashes(texts: Sequence[bytes], lower: bool = False, between: np.ndarray = SPACES):
    """``(hashes, starts, ends, first)`` of the words of texts.

    Words are runs of bytes that are not ``between`` words; ``lower`` lowers A-Z.
    ``starts`` and ``ends`` are places in the texts joined by one space; words of text
    ``i`` are ``first[i]:first[i + 1]``. Bytes are hashed in slices of bounded size.
    """
    joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    if lower:
        joined = joined + ((joined >= 65) & (joined <= 90)).astype(np.uint8) * np.uint8(32)
    inside = np.zeros(len(joined) + 1, dtype=bool)
    np.logical_not(between[joined], out=inside[1:])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    hashes = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + CHUNK_BYTES)))
        low, high = starts[i], ends[j - 1]
        hashes[i:j] = _hash_words(joined[low:high], starts[i:j] - low, ends[i:j] - low)
        i = j
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data), _BASE), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _powers(len(data), _INVERSE)[starts])


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` values from each place on; shorter by ``n - 1``."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    size = len(hashes) - n + 1
    out = np.zeros(size, dtype=np.uint64)
    for i in range(n):
        out *= _STEP
        out += hashes[i:i + size]
        out ^= out >> np.uint64(29)
    return mixed(out)


def byte_ngrams(joined: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` bytes (a multiple of 8) from each place on."""
    size = len(joined) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    eights = np.lib.stride_tricks.sliding_window_view(joined, 8)
    eights = np.ascontiguousarray(eights).view(np.uint64).ravel()
    return ngrams_apart(eights, n // 8, 8, size)


def ngrams_apart(values: np.ndarray, n: int, apart: int, size: int) -> np.ndarray:
    """Hash of ``n`` values that stand ``apart`` places apart, from each of ``size`` places."""
    out = np.zeros(size, dtype=np.uint64)
    for i in range(n):
        out *= _STEP
        out += values[i * apart:i * apart + size]
        out ^= out >> np.uint64(29)
    return mixed(out)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of ``width`` values from each place on, the first of equals.

    Values are compared by their upper half; the lower half carries the place.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    low = np.uint64(2**32 - 1)
    best = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while span < width:
        step = min(span, width - span)
        best = np.minimum(best[:len(best) - step], best[step:])
        span += step
    return (best & low).astype(np.int64)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers as compressed bytes. The first column should be sorted: it is
    stored as differences, and each byte of all its values stands together."""
    parts = [struct.pack("<I", len(columns))]
    for i, column in enumerate(columns):
        if i == 0 and column.dtype == np.uint64:
            column = np.diff(column, prepend=np.zeros(1, dtype=np.uint64))
        raw = np.ascontiguousarray(column).view(np.uint8).reshape(len(column), column.dtype.itemsize)
        parts.append(struct.pack("<4sI", column.dtype.str.encode(), len(column)) + raw.T.tobytes())
    return zstandard.compress(b"".join(parts), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(blob)
    (n_columns,), at, out = struct.unpack_from("<I", data), 4, []
    for i in range(n_columns):
        kind, n = struct.unpack_from("<4sI", data, at)
        dtype = np.dtype(kind.rstrip(b"\0").decode())
        raw = np.frombuffer(data, np.uint8, n * dtype.itemsize, at + 8).reshape(dtype.itemsize, n)
        column = np.ascontiguousarray(raw.T).view(dtype).ravel()
        out.append(np.cumsum(column, dtype=np.uint64) if i == 0 and dtype == np.uint64 else column)
        at += 8 + n * dtype.itemsize
    return out


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted values ``of``."""
    if not len(of):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(of, values)
    at[at == len(of)] = 0
    return of[at] == values
