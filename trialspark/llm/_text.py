"""Vectorised hashing of byte and word sequences held in Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: Bytes that separate words: space and \t \n \v \f \r.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.empty(size, U)
        have[0] = 1
        done = 1
        while done < size:  # base**(i + done) = base**i * base**done
            step = min(done, size - done)
            have[done : done + step] = have[:step] * U(pow(base, done, 1 << 64))
            done += step
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_HASH = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))


class Prefix:
    """Prefix sums from which the hash of any range of a sequence of 64-bit values follows."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * powers(_INV, n), out=self.sums[1:])
        self.up = powers(_BASE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(U))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of every k consecutive values."""
        return mix((self.sums[k:] - self.sums[:-k]) * self.up[: len(self.sums) - k])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # more than a chunk can hold
        raise ValueError("a group of more than 2 GB of text")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def spans_of_rows(offsets: np.ndarray, most: int):
    """Ranges of rows of at most ``most`` bytes together (a longer row stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word of each row, and n+1 offsets of the rows' words. Offsets are relative to ``data``."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~SEPARATOR[data]
    first = inside[1:] & ~inside[:-1]
    last = ~inside[1:] & inside[:-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[inside[cut] & inside[cut + 1]]  # a word may not reach from one row into the next
    first[cut] = True
    last[cut] = True
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    return start, end, np.searchsorted(start, offsets)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    n, span = len(x) - w + 1, 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[w - span : w - span + n])


def pieces_of(data: np.ndarray, most: int, whole_words: bool = False) -> list[tuple[int, int]]:
    """Ranges of at most ``most`` bytes, cut after a separator where there is one, else at a character (or, for whole words, later)."""
    out, a, n = [], 0, len(data)
    end = most
    while end < n:
        at = np.flatnonzero(SEPARATOR[data[a:end]])
        if len(at):
            b = a + int(at[-1]) + 1
        elif whole_words:
            end += most
            continue
        else:
            b = end
            while b > a + 1 and data[b] & 0xC0 == 0x80:
                b -= 1
        out.append((a, b))
        a, end = b, b + most
    return [*out, (a, n)]
