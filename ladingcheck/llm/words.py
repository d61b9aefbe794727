"""Words and shingles of whole Arrow text columns as numpy arrays: no Python step per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a piece of its own.
PIECE_BYTES = 2 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that separate words of ASCII letters, digits and everything beyond ASCII.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[:128] = True
PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(n: int) -> None:
    if len(_powers[0]) <= n:
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for i, odd in enumerate((_ODD, inverse)):
            x = np.full(n + 1, odd, np.uint64)
            x[0] = 1
            _powers[i] = np.cumprod(x, dtype=np.uint64)


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of runs of rows with about `most` bytes; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, len(column))
        yield first, last - first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of words of each row."""
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of each word, A-Z lower-cased: differences of a running polynomial."""
    _grow(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[_lower][data] * _powers[0][:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers[1][starts])


def _place(j: int) -> np.uint64:
    return np.uint64((j + 1) * int(_ODD) & (1 << 64) - 1)


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `width` words inside a row (fewer words: the whole row as one), and their number by row."""
    n = len(hashes)
    first = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width):
        if len(out):
            out += mix(hashes[j:n - width + 1 + j] + _place(j))
    row = np.repeat(np.arange(len(counts)), counts)
    kept = row[:len(out)] == row[width - 1:width - 1 + len(out)]
    out, row = mix(out[kept]), row[:len(kept)][kept]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            has = counts[short] > j
            whole[has] += mix(hashes[first[short[has]] + j] + _place(j))
        out = np.concatenate([out, mix(whole ^ counts[short].astype(np.uint64))])
        row = np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        out, row = out[order], row[order]
    return out, np.bincount(row, minlength=len(counts))
