"""Words of Arrow string columns as 64-bit hashes, for whole batches at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_LOWERED = _BYTE[_LOWER]
#: Bytes of text that are hashed at a time; a longer text is a slice of its own.
SLICE = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _UNBASE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def text_slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of runs of rows with about ``limit`` bytes; nulls are empty."""
    column = texts.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, len(column))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; words are the runs without ASCII white space."""
    n = len(data)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[:1] = True
    before[1:] = ~inside[:-1]
    after = np.empty(n, bool)
    after[-1:] = True
    after[:-1] = ~inside[1:]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes, A-Z lower-cased if asked for: a difference of prefix sums, rescaled."""
    n = len(data)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWERED if lower else _BYTE)[data] * up[:n], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, rows, hash of each word, row of each word)`` for runs of rows; words are lower-cased in A-Z."""
    for at, data, offsets in text_slices(texts):
        starts, ends, rows = word_bounds(data, offsets)
        yield at, len(offsets) - 1, hash_spans(data, starts, ends), rows


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a row, and their bounds by row.

    A row of fewer words, but at least one, has its whole sequence as one run.
    """
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    counts = np.diff(bounds)
    odd = mix64(np.arange(1, k + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    whole = len(words) - k + 1
    out = np.zeros(max(whole, 0), np.uint64)
    for i in range(k if whole > 0 else 0):
        out += words[i : i + whole] * odd[i]
    out = mix64(out)
    fits = rows[:whole] == rows[k - 1 :] if whole > 0 else np.zeros(0, bool)
    hashes, owner = out[fits], rows[:whole][fits] if whole > 0 else rows[:0]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.array([mix64(np.array([(words[bounds[r] : bounds[r + 1]] * odd[: counts[r]]).sum(dtype=np.uint64) + np.uint64(counts[r])]))[0] for r in short], np.uint64)
        hashes, owner = np.concatenate([hashes, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, np.searchsorted(owner, np.arange(n_rows + 1))
