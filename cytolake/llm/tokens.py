"""Vectorised words and shingles of Arrow text columns: numpy over the column's bytes, no loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BLOCK = 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n + 1:
        size = max(n + 1, 2 * _BLOCK)
        inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
        for name, base in (("p", _PRIME), ("i", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["p"], _powers["i"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(column):
        return raw[:0], np.zeros(1, np.int64)
    return raw[off[0] : off[-1]], off - off[0]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, 64-bit hash, first byte and end byte of every word ``[^\\x20\\x09-\\x0D]+``, in order."""
    edges = np.zeros(len(data) + 1, bool)
    edges[offsets] = True
    rows, hashes, firsts, ends = [], [], [], []
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + _BLOCK)
        while end < n and not _SPACE[data[end - 1]] and not edges[end]:  # a word is never cut
            tail = np.flatnonzero(_SPACE[data[end : end + _BLOCK]] | edges[end : min(n, end + _BLOCK)])
            end = min(n, end + (int(tail[0]) + 1 if len(tail) else _BLOCK))
            if len(tail) and edges[end - 1]:
                end -= 1
        block = data[at:end]
        if lower:
            block = block | ((block - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))  # of A-Z this bit is 0
        space = (block == 32) | (block - np.uint8(9) < 5)
        fresh, last = np.empty(len(block), bool), np.empty(len(block), bool)
        fresh[0], fresh[1:] = True, space[:-1]
        last[-1], last[:-1] = True, space[1:]
        fresh |= edges[at:end]
        last[:-1] |= edges[at + 1 : end]
        s = np.flatnonzero(~space & fresh)
        e = np.flatnonzero(~space & last) + 1
        power, inverse = power_tables(len(block))
        sums = np.zeros(len(block) + 1, np.uint64)
        terms = block.astype(np.uint64)
        terms += np.uint64(1)
        terms *= power[: len(block)]
        np.cumsum(terms, out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)))
        firsts.append(s + at)
        ends.append(e + at)
        at = end
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = np.concatenate(firsts), np.concatenate(ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(first, offsets)))
    return row, np.concatenate(hashes), first, last


def shingles(row: np.ndarray, word: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and index of the first word of every run of ``width`` words of one row."""
    n = len(word) - width + 1
    if n <= 0:
        return row[:0], word[:0], np.zeros(0, np.int64)
    acc = word[:n].copy()
    for k in range(1, width):
        acc = mix(acc * _PRIME + word[k : k + n])
    ok = np.flatnonzero(row[:n] == row[width - 1 :])
    return row[ok], acc[ok], ok


def slices(offsets: np.ndarray, most: int = _BLOCK) -> list[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each; a longer row stands alone."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        out.append((a, min(b, n)))
        a = min(b, n)
    return out
