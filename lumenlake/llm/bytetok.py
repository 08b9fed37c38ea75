"""Vectorised word splitting and hashing over the UTF-8 bytes of an Arrow text column.

A word is a maximal run of 0-9, a-z (A-Z folded) and bytes from 0x80, which on UTF-8 equals
`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` over code points after lower-casing A-Z.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = np.asarray(x, dtype=U64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


CODE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
CODE[65:91] = CODE[97:123]  # A-Z hash as a-z
WORD = np.zeros(256, dtype=bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = True
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, dtype=U64)


def powers(n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    global _powers
    while len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([_powers, _powers * U64(pow(_BASE, len(_powers), 1 << 64))])
    return _powers[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


class Words(NamedTuple):
    doc: np.ndarray  # index of the row
    start: np.ndarray  # byte offsets within the block
    end: np.ndarray
    hash: np.ndarray
    count: np.ndarray  # words of each row


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = WORD, hashed: bool = True) -> Words:
    """Words of every row, in row order; rows never share a word. Their hashes are left out unless hashed."""
    n, rows = len(data), len(offsets) - 1
    is_word = inside[data]
    first, last = is_word.copy(), is_word.copy()
    if n:
        first[1:] &= ~is_word[:-1]
        last[:-1] &= ~is_word[1:]
        full = offsets[1:] > offsets[:-1]
        head, tail = offsets[:-1][full], offsets[1:][full] - 1
        first[head], last[tail] = is_word[head], is_word[tail]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(doc, start, end, hash_spans(data, start, end) if hashed else np.zeros(0, U64), np.bincount(doc, minlength=rows).astype(np.int64))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the (non-empty, ascending, disjoint) byte spans."""
    if not len(start):
        return np.zeros(0, U64)
    size = end - start
    before = np.cumsum(size) - size
    rel = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(before, size)
    with np.errstate(over="ignore"):
        value = CODE[data[rel + np.repeat(start, size)]] * powers(int(size.max()))[rel]
        return mix64(np.add.reduceat(value, before) + size.astype(U64))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of k words; a row of fewer words, but not none, gives one run of all its words."""
    h, n = w.hash, len(w.hash)
    weight = [U64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(k)]
    with np.errstate(over="ignore"):
        if n >= k:
            total = h[: n - k + 1] * weight[0]
            for j in range(1, k):
                total = total + h[j : n - k + 1 + j] * weight[j]
            ok = w.doc[: n - k + 1] == w.doc[k - 1 :]
            doc, value = w.doc[: n - k + 1][ok], mix64(total[ok])
        else:
            doc, value = np.zeros(0, np.int64), np.zeros(0, U64)
        short = np.flatnonzero((w.count > 0) & (w.count < k))
        if len(short):
            at = np.cumsum(w.count) - w.count
            extra = np.zeros(len(short), U64)
            for j in range(k - 1):
                has = w.count[short] > j
                extra[has] += h[at[short[has]] + j] * weight[j]
            doc, value = np.concatenate([doc, short]), np.concatenate([value, mix64(extra)])
    return doc, value
