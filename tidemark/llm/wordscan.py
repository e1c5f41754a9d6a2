"""Whole Arrow batches of texts as one byte array: word bounds and hashes without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_P, _INV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["p"]) < n:
        size = max(n, SEGMENT + 4096)
        for name, base in (("p", _P), ("i", _INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["p"], _POWERS["i"]


def text_bytes(column: pa.Array, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of rows ``at`` to ``at + n`` of a string column and their n + 1 offsets; null has no bytes."""
    column = column.slice(at, n)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + n + 1].astype(np.int64) if ends is not None and n else np.zeros(n + 1, np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column with at most ``limit`` bytes each, or one row where a text is longer."""
    n = len(column)
    if not n:
        yield 0, 0
        return
    sizes = np.diff(text_bytes(column, 0, n)[1])
    at = total = 0
    for k, size in enumerate(sizes.tolist()):
        if k > at and total + size > limit:
            yield at, k - at
            at, total = k, 0
        total += size
    yield at, n - at


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first byte, end byte, hash, row) of each word. ``table`` maps a byte to its word byte, or to 0 between words."""
    starts, ends, hashes = [], [], []
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    at = 0
    while at < len(data):
        stop = min(at + SEGMENT, len(data))
        mapped = table[data[at:stop]]
        while stop < len(data) and mapped[-1] and not cut[stop]:  # a word never spans two segments
            more = min(stop + 4096, len(data))
            tail = table[data[stop:more]]
            gaps = np.flatnonzero((tail == 0) | cut[stop:more])
            tail = tail[: gaps[0]] if len(gaps) else tail
            mapped, stop = np.concatenate((mapped, tail)), stop + len(tail)
            if len(gaps):
                break
        inside = mapped != 0
        before = np.concatenate(([False], inside[:-1])) & ~cut[at:stop]
        first = np.flatnonzero(inside & ~before)
        after = np.concatenate((inside[1:], [False])) & ~cut[at + 1 : stop + 1]
        last = np.flatnonzero(inside & ~after)
        p, inv = _powers(len(mapped))
        total = np.cumsum(mapped.astype(np.uint64) * p[: len(mapped)], dtype=np.uint64)
        h = (total[last] - np.where(first > 0, total[first - 1], np.uint64(0))) * inv[first]
        starts.append(first + at), ends.append(last + 1 + at), hashes.append(mix(h ^ (last - first + 1).astype(np.uint64)))
        at = stop
    if not starts:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z
    starts, ends, hashes = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
    return starts, ends, hashes, np.searchsorted(offsets, starts, side="right") - 1


def windows(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every window of n consecutive words of one row."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total, factor = np.zeros(m, np.uint64), 0x9E3779B97F4A7C15
    for j in range(n):
        total += hashes[j : j + m] * np.uint64(factor)
        factor = (factor * 0xD1342543DE82EF95 + 2) & ((1 << 64) - 1) | 1
    inside = np.flatnonzero(row[:m] == row[n - 1 :])
    return inside, mix(total[inside])
