"""Vectorised word scanning over the UTF-8 bytes of a column of texts.

A block is a run of whole texts laid end to end.  Words never cross texts.  Each word, line or window
has a 64-bit hash: a polynomial over its bytes, taken from one prefix sum over the block, then mixed.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A block's arrays have up to ten times its bytes; at this size they fit in a core's cache.
BLOCK_BYTES = 1 << 18
U = np.uint64
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(MULTIPLIER, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, once A-Z are lower-cased
LETTERED = np.zeros(256, bool)
LETTERED[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _mix_int(x: int) -> int:
    x = (x + MULTIPLIER) % (1 << 64)
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
    x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
    return x ^ x >> 31


BYTE_VALUES = np.array([_mix_int(i + 1) for i in range(256)], U)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _series(base: int, n: int) -> np.ndarray:
    x = np.full(n, U(base))
    x[:1] = 1
    return np.cumprod(x)


@functools.cache
def _block_series(base: int) -> np.ndarray:
    return _series(base, BLOCK_BYTES + 2)


def _powers_of(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1); only those of a usual block are kept, not what a giant text needs."""
    kept = _block_series(base)
    return kept[:n] if n <= len(kept) else _series(base, n)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts; a null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if offsets else np.zeros(len(texts) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: (first row, end row, bytes, offsets from 0)."""
    data, at = utf8(texts)
    row, n = 0, len(texts)
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


class Block:
    """One run of texts with hashes.  ``data`` is hashed as it is: lower-case it first if need be."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self._inverses = _powers_of(INVERSE, len(data) + 1)
        self._prefix = np.zeros(len(data) + 1, U)
        np.cumsum(BYTE_VALUES[data] * _powers_of(MULTIPLIER, len(data)), out=self._prefix[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._prefix[ends] - self._prefix[starts]) * self._inverses[starts] + (ends - starts).astype(U) * U(0x2545F4914F6CDD1D))

    def words(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, offsets): byte ranges of the words, and where each text's words begin."""
        return spans(kind[self.data], self.offsets)


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(inside)
    first, last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    first[offsets] = True
    last[offsets[offsets > 0] - 1] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | first[1:n]
    closes[:-1] &= ~inside[1:] | last[: n - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` items; runs are not kept from crossing texts."""
    n = max(0, len(hashes) - size + 1)
    out, k = np.zeros(n, U), 1
    for j in range(size):
        out += hashes[j : j + n] * U(k)
        k = k * 0xD6E8FEB86659FD93 % (1 << 64)
    return mix(out)


def owners(offsets: np.ndarray) -> np.ndarray:
    """For items dealt by ``offsets``, the row that each belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def inside_windows(offsets: np.ndarray, size: int) -> np.ndarray:
    """Which window starts lie whole in one text."""
    total = max(0, int(offsets[-1]) - size + 1)
    end_of = np.repeat(offsets[1:], np.diff(offsets))
    return np.arange(total) + size <= end_of[:total]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeats: equal to an earlier one, shared: one of two or more) for each key."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, either = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    either[order[1:][same]] = True
    either[order[:-1][same]] = True
    return later, either


def covered(starts: np.ndarray, sizes: np.ndarray | int, total: int) -> np.ndarray:
    """Which of ``total`` items lie in a window."""
    edge = np.bincount(starts, minlength=total + 1)[: total + 1].astype(np.int64)
    edge -= np.bincount(starts + sizes, minlength=total + 1)[: total + 1]
    return np.cumsum(edge)[:total] > 0


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each row."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
