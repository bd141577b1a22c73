"""Whole texts of Arrow batches as byte arrays: blocks, words, shingles, hashes.

Everything here runs inside tasks on one bounded block of documents at a time.
White space is ``\\x20 \\x09-\\x0D``; all of it is ASCII, so words are cut on UTF-8
bytes without decoding, and only A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text that are worked on at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
SHINGLE_WORDS = 5

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_U = [np.uint64(x) for x in (0, 27, 30, 31)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x + _ODD
    x = (x ^ (x >> _U[2])) * _M1
    x = (x ^ (x >> _U[1])) * _M2
    return x ^ (x >> _U[3])


def byte_codes() -> np.ndarray:
    """A random-looking 64-bit code for each byte, equal for A-Z and a-z."""
    codes = mix(np.arange(1, 257, dtype=np.uint64))
    codes[65:91] = codes[97:123]
    return codes


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def blocks(
    batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BLOCK_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about ``size`` bytes of text at most."""
    for batch in batches:
        _, offsets = texts(batch.column(batch.schema.get_field_index(column)))
        at, n = 0, batch.num_rows
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
            to = min(n, max(to, at + 1))
            yield batch.slice(at, to - at)
            at = to


def words(
    data: np.ndarray, offsets: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of all words, and each text's first word."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def runs(
    data: np.ndarray, offsets: np.ndarray, member: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``words`` where a word is a maximal run of the bytes that ``member`` marks."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = member[data]
    opens, closes = inside[:n].copy(), inside[:n].copy()
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    opens[1:] &= ~inside[: max(n - 1, 0)] | edge[1:n]
    closes &= ~inside[1:] | edge[1:]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, blind to the case of A-Z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    total = int(sizes.sum())
    first = np.cumsum(sizes) - sizes
    within = np.arange(total) - np.repeat(first, sizes)
    powers = np.full(int(sizes.max()), _BASE)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    codes = byte_codes()[data[within + np.repeat(starts, sizes)]]
    return mix(np.add.reduceat(codes * powers[within], first) + sizes.astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text)."""
    starts, ends, first = words(data, offsets)
    return hashes(data, starts, ends), first


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive word hashes, across text borders too."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * _BASE + h[k : k + m]
    return mix(out)


def shingle_sets(
    data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE_WORDS
) -> list[np.ndarray]:
    """Each text's distinct n-word shingles as sorted hashes.

    A text with fewer words has its whole sequence as its only shingle, a text
    without words none.
    """
    h, first = word_hashes(data, offsets)
    g = grams(h, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        elif b > a:
            # the length keeps it apart from the runs of n words
            out.append(mix(grams(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(x) -> np.ndarray:
    return np.asarray(x).view(np.uint64)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
