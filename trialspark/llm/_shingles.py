"""Sets of word shingles, their MinHash bands, fingerprints, sketches and exact Jaccard similarity, over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from trialspark.llm._session import trim, trimming
from trialspark.llm._text import BYTE_HASH, Prefix, U, buffers, mix, pieces_of, spans_of_rows, words

#: Bytes of text that are read at once.
PIECE = 1 << 19
#: Two sets of similarity s share a band's key with s**ROWS: 0.8 in one of the bands with 1 - (1 - 0.8**5)**24 = 0.99993.
BANDS, ROWS = 24, 5
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_LANE = (np.arange(8) * 256).astype(np.int64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of a sketch; at similarity 0.8 it strays by 0.018 (one standard deviation).
PLACES = 512
_MIXED = mix(np.arange(1, 2 * PLACES + 1, dtype=U) * U(0x9E3779B97F4A7C15))
_XOR, _TIMES = _MIXED[::2], _MIXED[1::2] | U(1)


#: Words of more bytes are hashed by XXH64: sums of powers modulo 2**64 can be made to agree for long ones.
LONG_WORD = 256


def _word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, rows = words(data, off)
    out = Prefix(BYTE_HASH[data]).of(start, end)
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    return out, rows


def sets(column: pa.Array, k: int):
    """``(first, h, n)``: for a run of rows from ``first`` on, the sorted distinct hashes of each row's shingles end to end, and their numbers.

    A-Z count as lower case. A text of fewer than k words is one shingle, one without words has none.
    """
    data, off = buffers(column)
    for a, b in spans_of_rows(off, PIECE):
        d, o = _LOWER[data[off[a] : off[b]]], off[a : b + 1] - off[a]
        if len(d) > 2 * PIECE:  # one long row
            h = np.concatenate([_word_hashes(d[i:j], np.array([0, j - i]))[0] for i, j in pieces_of(d, PIECE, True)])
            w = np.array([0, len(h)])
        else:
            h, w = _word_hashes(d, o)
        m = np.diff(w)
        n = np.where(m >= k, m - k + 1, m > 0)
        row = np.repeat(np.arange(b - a), n)
        first = w[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        h = Prefix(h).of(first, np.minimum(first + k, w[row + 1]))
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        yield a, h[fresh], np.bincount(row[fresh], minlength=b - a)


def digests(h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """A hash of each set in 16 bytes."""
    raw, end = memoryview(h.tobytes()), np.cumsum(n) * 8
    return [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip((end - 8 * n).tolist(), end.tolist(), strict=True)]


def _least(h: np.ndarray, at: np.ndarray, places: int):
    """The least of each set's hashes under ``places`` functions."""
    for j in range(places):
        yield np.minimum.reduceat((h ^ _XOR[j]) * _TIMES[j], at)


def bands(k: int):
    """For ``mapInArrow`` over (doc_id, th, text): ``(doc_id, th, digest, n, bands)``; equal sets have equal digests, empty ones no bands."""

    def make(batches):
        for batch in batches:
            trim()
            for a, h, n in sets(batch.column(2), k):
                some = np.flatnonzero(n)
                out = np.zeros((len(some), BANDS), U)
                if len(some):
                    for j, least in enumerate(_least(h, (np.cumsum(n) - n)[some], BANDS * ROWS)):
                        out[:, j // ROWS] = mix((out[:, j // ROWS] ^ least) + U(j + 1))
                each = np.zeros(len(n) + 1, np.int32)
                each[1:] = np.cumsum(n > 0)
                lists = pa.ListArray.from_arrays(pa.array(each * BANDS), pa.array(out.ravel().view(np.int64)))
                columns = [batch.column(0).slice(a, len(n)), batch.column(1).slice(a, len(n)), pa.array(digests(h, n), pa.binary()), pa.array(n.astype(np.int64)), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "digest", "n", "bands"])

    return trimming(make), "doc_id long, th long, digest binary, n long, bands array<long>"


def prints(h: np.ndarray, n: np.ndarray, words: int) -> np.ndarray:
    """SimHash fingerprints of ``words`` times 64 bits of each non-empty set, from mixtures of its hashes."""
    out = np.empty((len(n), words), U)
    end = np.cumsum(n)
    for w in range(words):
        raw = mix(h + U(w * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8)
        for i, (a, b) in enumerate(zip((end - n).tolist(), end.tolist(), strict=True)):
            counts = np.bincount((raw[a:b] + _LANE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
            out[i, w] = np.packbits(counts.ravel() * 2 > b - a).view(U)[0]
    return out


def details(k: int, words: int):
    """For ``mapInArrow`` over (digest, text) of texts with words: ``(digest, n, print, sketch, shingles)``.

    ``print``: a fingerprint of ``words`` times 64 bits; ``sketch``: ``PLACES`` bytes, of which two sets of similarity s share s
    but for chance; ``shingles``: the sorted hashes of the set.
    """

    def make(batches):
        for batch in batches:
            trim()
            for a, h, n in sets(batch.column(1), k):
                end = np.cumsum(n)
                sketch = np.empty((len(n), PLACES), np.uint8)
                for j, least in enumerate(_least(h, end - n, PLACES)):
                    sketch[:, j] = mix(least) & U(255)
                raw = h.tobytes()
                columns = [
                    batch.column(0).slice(a, len(n)),
                    pa.array(n.astype(np.int64)),
                    pa.array([x.tobytes() for x in prints(h, n, words)], pa.binary()),
                    pa.array([x.tobytes() for x in sketch], pa.binary()),
                    pa.array([raw[8 * (e - m) : 8 * e] for m, e in zip(n.tolist(), end.tolist(), strict=True)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["digest", "n", "print", "sketch", "shingles"])

    return trimming(make), "digest binary, n long, print binary, sketch binary, shingles binary"
