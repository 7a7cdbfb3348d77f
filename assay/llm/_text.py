"""Vectorised text primitives over Arrow string columns.

A column is looked at as one byte array plus document offsets. Words are maximal runs without
the ASCII white space \\x20 \\x09-\\x0D, so they can be found on bytes. Hashes are differences of
prefix sums of a polynomial over random byte values, finished by a mixer: equal strings have equal
hashes wherever they stand, and any substring's hash costs O(1). prefix() and spans() count modulo the
prime 2**61 - 1. quick_prefix() and quick_spans() count modulo 2**64, where some strings that are made
for it (Thue-Morse words) collide whatever the base: they only choose positions, or are a second hash
beside the first, so that both must agree (128 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240229)
PRIME = (1 << 61) - 1
_P, _SHIFT = np.uint64(PRIME), np.uint64(61)
_LOW31, _LOW30, _31, _30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1), np.uint64(31), np.uint64(30)
BYTE = _rng.integers(0, 2**31, 256, dtype=np.uint64)
FOLDED = BYTE.copy()
FOLDED[65:91] = BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_POINT = 0x123456789ABCDEF
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_prime_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, in place."""
    over = x >> _SHIFT
    x &= _P
    x += over
    np.subtract(x, _P, out=x, where=x >= _P)
    return x


def _shifted(x: np.ndarray) -> np.ndarray:
    """x * 2**31 but for the modulus, of x below 2**62."""
    out = x & _LOW30
    out <<= _31
    out += x >> _30
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, of numbers below it: halves of 31 bits, as 2**61 counts as 1."""
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = a1 * b0
    middle += a0 * b1
    a1 *= b1
    a1 += a1
    a0 *= b0
    a1 += a0
    a1 += _shifted(middle)
    return _reduced(a1)


def _prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the point and of its inverse modulo the prime, at least n of each."""
    if len(_prime_pow[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, x in enumerate((_POINT, pow(_POINT, -1, PRIME))):
            have = np.ones(1, np.uint64)
            while len(have) < size:
                have = np.concatenate((have, times(have, np.full(len(have), pow(x, len(have), PRIME), np.uint64))))
            _prime_pow[k] = have
    return _prime_pow[0], _prime_pow[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_pow[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, b in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _pow[k] = np.multiply.accumulate(steps)
    return _pow[0], _pow[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Numbers that are worked on at once, so that they stay in a core's cache.
_AT_ONCE = 1 << 14


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * point**i modulo 2**61 - 1, with a leading 0."""
    n = len(values)
    power, out, carry = _prime_powers(n)[0], np.zeros(n + 1, np.uint64), np.uint64(0)
    for s in range(0, n, _AT_ONCE):
        v, w = values[s : s + _AT_ONCE], power[s : min(n, s + _AT_ONCE)]
        if v.max() > _LOW31:
            term = times(_reduced(v.copy()), w)
        else:
            term = _shifted(v * (w >> _31))
            term += v * (w & _LOW31)
            term = _reduced(term)
        # Sums of the halves don't overflow; the upper one counts 2**31 times.
        upper = np.cumsum(term >> _31)
        term &= _LOW31
        np.cumsum(term, out=term)
        term += _shifted(upper)
        term += carry
        out[s + 1 : s + 1 + len(term)] = _reduced(term)
        carry = out[s + len(term)]
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end) of what prefix() was given."""
    back, out = _prime_powers(len(sums))[1], np.empty(len(start), np.uint64)
    for s in range(0, len(start), _AT_ONCE):
        a, b = start[s : s + _AT_ONCE], end[s : s + _AT_ONCE]
        apart = sums[b] + _P
        apart -= sums[a]
        out[s : s + _AT_ONCE] = mixed(times(_reduced(apart), back[a]) ^ mixed((b - a).astype(np.uint64)))
    return out


def quick_prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * base**i modulo 2**64, with a leading 0."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def quick_spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end) of what quick_prefix() was given."""
    return mixed((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows, from 0) and bytes of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def slices(off: np.ndarray, most_bytes: int = 1 << 18, most_rows: int = 256) -> Iterator[tuple[int, int]]:
    """Row ranges of bounded size; a longer row comes alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + most_bytes, "right")) - 1
        j = max(i + 1, min(j, i + most_rows, n))
        yield i, j
        i = j


def parts(col: pa.Array, most_bytes: int = 1 << 18, most_rows: int = 256) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """slices() of a string column with each one's own offsets and bytes."""
    off, data = utf8(col)
    for i, j in slices(off, most_bytes, most_rows):
        yield i, j, off[i : j + 1] - off[i], data[off[i] : off[j]]


class Words:
    """Word starts, ends and rows of a slice; first[d] is the index of row d's first word."""

    def __init__(self, off: np.ndarray, data: np.ndarray, space: np.ndarray = SPACE) -> None:
        gap = space[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[off] = True
        head, tail = ~gap, ~gap
        if len(data):
            head[1:] &= gap[:-1] | cut[1:-1]
            tail[:-1] &= gap[1:] | cut[1:-1]
        self.start, self.end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(off) - 1), self.count)

    def hashes(self, data: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
        return spans(prefix(table[data]), self.start, self.end)


class Lines:
    """Lines of a slice, split at \\n: starts, ends, rows; first[d] is the index of row d's first line."""

    def __init__(self, off: np.ndarray, data: np.ndarray) -> None:
        breaks = np.flatnonzero(data == 10)
        self.start = np.sort(np.concatenate((off[:-1], breaks + 1)))
        self.end = np.sort(np.concatenate((off[1:], breaks)))
        self.count = np.searchsorted(breaks, off[1:]) - np.searchsorted(breaks, off[:-1]) + 1
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self.row = np.repeat(np.arange(len(off) - 1), self.count)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n positions lie in any of the ranges."""
    step = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def sums(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many flags are set in each range."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[end] - total[start]


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost minimum, by upper halves, of each window of w values."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    pad = -len(x) % w
    # The upper half of a value and its position: one minimum finds both, and equal windows agree.
    keyed = np.full(len(x) + pad, np.iinfo(np.uint64).max, np.uint64)
    keyed[: len(x)] = (x >> np.uint64(32) << np.uint64(32)) | np.arange(len(x), dtype=np.uint64)
    block = keyed.reshape(-1, w)
    left = np.minimum.accumulate(block, axis=1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(right[:n], left[w - 1 : w - 1 + n])
    return (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
