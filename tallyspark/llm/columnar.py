"""Numpy views of Arrow text columns: word bounds, word hashes and rolling window hashes.

A word is ``[^\\x20\\x09-\\x0D]+``; every separator is one ASCII byte, so words are found on the UTF-8 bytes. A null text
has no words. A string's hash is a polynomial over a random byte table modulo 2^64 followed by a mixer; two independent
ones make a 128-bit identity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
CHUNK_BYTES = 1 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def chunks(batch: pa.RecordBatch, column: str, max_bytes: int = CHUNK_BYTES, max_rows: int | None = None):
    """Row slices of a batch with at most about max_bytes of text, and max_rows rows, each; a longer text is a slice of its own."""
    rows = batch.num_rows
    if not rows:
        return
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    group = np.cumsum(sizes) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), rows]
    for a, b in zip(cuts, cuts[1:]):
        step = max_rows or b - a
        for s in range(a, b, step):
            yield batch.slice(s, min(step, b - s))


def text_bytes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of the rows in them."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return (_LOWER[buf] if lower else buf), off - off[0]


def word_bounds(buf: np.ndarray, off: np.ndarray, between: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of the first word at or after its start (n + 1 entries)."""
    inside = np.zeros(len(buf) + 2, bool)
    np.logical_not(between[buf], out=inside[1:-1])
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return starts, ends, np.searchsorted(starts, off)


_TABLES: dict[int, tuple[np.ndarray, np.uint64]] = {}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i up to n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        out = []
        for b in (base, _inverse(base)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = (out[0], out[1])
        if size <= 1 << 22:
            _POWERS[base] = have
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def hash_base(seed: int) -> tuple[np.ndarray, int]:
    if seed not in _TABLES:
        r = np.random.default_rng(seed + 7)
        table = r.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        _TABLES[seed] = (table, int(r.integers(1, 1 << 60)) * 8 + 5)
    return _TABLES[seed]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for every span."""
    up, down = _powers(base, len(values))
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * up[:len(values)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts])


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    table, base = hash_base(seed)
    return span_hashes(table[buf], starts, ends, base)


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` consecutive entries (len - size + 1 of them)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return span_hashes(words, at, at + size, hash_base(seed + 100)[1])


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every run of ``size`` entries, by doubling."""
    have = 1
    while have * 2 <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if have < size:
        x = np.minimum(x[:len(x) - (size - have)], x[size - have:])
    return x
