"""Vectorised words and shingles over Arrow string columns.

Words are maximal runs of characters outside ``\\x20`` and ``\\x09-\\x0D``; A-Z are lower-cased.
Both are properties of single UTF-8 bytes, so a whole column's buffer is worked on as bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MULT = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BYTE[SEPARATOR] = 0
_BYTE_LOWER = _BYTE[LOWER]
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x + U((seed * _MULT + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 18)
        with np.errstate(over="ignore"):
            for name, m in (("up", _MULT), ("down", pow(_MULT, -1, 2**64))):
                table = np.full(size, U(m))
                table[0] = 1
                _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null has no bytes."""
    if col.null_count:
        col = col.fill_null("")
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.large_string())
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    if offsets is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(col: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with up to limit bytes, or one longer row."""
    raw, off = buffers(col)
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def _words(raw: np.ndarray, heads: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    sep = SEPARATOR[raw]
    before = np.empty(len(raw), bool)
    before[0] = True
    before[1:] = sep[:-1]
    before[heads[heads < len(raw)]] = True
    starts = np.flatnonzero(before & ~sep)
    if not len(starts):
        return np.zeros(0, U), starts
    up, down = _power_tables(len(raw))
    with np.errstate(over="ignore"):
        sums = np.add.reduceat((_BYTE_LOWER if lower else _BYTE)[raw] * up[: len(raw)], starts)
        return mix(sums * down[starts]), starts


def words(raw: np.ndarray, off: np.ndarray, lower: bool = True, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, their first bytes, and offsets of the rows in them."""
    if len(raw) <= block:
        h, starts = _words(raw, off, lower) if len(raw) else (np.zeros(0, U), np.zeros(0, np.int64))
    else:  # one long row, in blocks that end at a separator
        parts, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + block)
            while end < len(raw):
                stop = np.flatnonzero(SEPARATOR[raw[end : end + block]])
                if len(stop):
                    end += int(stop[0])
                    break
                end = min(len(raw), end + block)
            inside = off[(off >= at) & (off < end)] - at
            x, y = _words(raw[at:end], inside, lower)
            parts.append((x, y + at))
            at = end
        h, starts = (np.concatenate(x) for x in zip(*parts, strict=True))
    return h, starts, np.searchsorted(starts, off)


def shingles(h: np.ndarray, wo: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words by row, and row offsets; a row of 1 to k-1 words has one of all of them."""
    n = np.diff(wo)
    with np.errstate(over="ignore"):
        if len(h) >= k:
            full = mix(h[: len(h) - k + 1], 1)
            for j in range(1, k):
                full = mix(full + h[j : len(h) - k + 1 + j], j + 1)
        else:
            full = np.zeros(0, U)
        counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        so = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(so[-1], U)
        if np.all((n >= k) | (n == 0)):
            keep = np.ones(len(full), bool)
            ends = wo[1:][(n > 0)]
            for j in range(1, k):
                x = ends - j
                keep[x[(x >= 0) & (x < len(full))]] = False
            out[:] = full[keep]
            return out, so
        for i in range(len(n)):
            if n[i] >= k:
                out[so[i] : so[i + 1]] = full[wo[i] : wo[i + 1] - k + 1]
            elif n[i]:
                x = mix(h[wo[i] : wo[i] + 1], 101 + int(n[i]))
                for j in range(1, n[i]):
                    x = mix(x + h[wo[i] + j], j + 1)
                out[so[i]] = x[0]
    return out, so
