"""Vectorised views over batches of texts, used inside Spark tasks.

An Arrow string column is one contiguous byte buffer plus offsets; everything
here works on that buffer with numpy, without a Python object per word:

* ``column_bytes``  buffer and offsets of a string/binary column (null = empty),
* ``pieces``        bounded slices of a batch, so scratch memory stays small,
* ``runs``          token boundaries (runs of one byte class inside one text),
* ``hash_runs``     a 64-bit hash per token,
* ``rolling``       a 64-bit hash per window of k consecutive tokens.

Hashes are polynomial over random 64-bit byte values, modulo 2^64, with a
final mixing step. They are a pure function of the token's bytes: equal in
every task, on every machine and after a retry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time (a longer single text is handled alone).
PIECE_BYTES = 1 << 18

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_STEP = _U(0xD6E8FEB86659FD93)


def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


#: Classes: 0 separates, every other value forms runs of its own.
BLANK = np.ones(256, np.uint8)
BLANK[[9, 10, 11, 12, 13, 32]] = 0

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def alnum_classes(punctuation: int = 0) -> np.ndarray:
    """1 for ASCII letters, digits and every byte of a non-ASCII character; white
    space 0; other ASCII characters ``punctuation``."""
    cls = np.full(256, punctuation, np.uint8)
    cls[[*range(9, 14), 32]] = 0
    cls[48:58] = cls[65:91] = cls[97:123] = cls[128:] = 1
    return cls


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h = h * _MULT
    h ^= h >> _U(29)
    h = h * _STEP
    return h ^ (h >> _U(32))


class _Powers:
    """Powers of an odd multiplier modulo 2^64, extended on demand."""

    def __init__(self, base: int):
        self.base, self.table = _U(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            more = np.full(max(n, 2 * len(self.table)), self.base)
            more[0] = 1
            self.table = np.cumprod(more, dtype=np.uint64)
        return self.table


_POWERS = {s: _Powers(b) for s, b in ((1, 0x2545F4914F6CDD1D), (2, 0x9FB21C651E98DF25))}
_VALUES = {s: _byte_values(s) for s in (1, 2)}


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (length n + 1) of a string or binary column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes each; every text is whole."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def runs(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of tokens, and for each text the number of
    its first token (length n + 1). Tokens do not cross from text to text."""
    cls = classes[data]
    return runs_of(cls, offsets)


def runs_of(cls: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same from the class of every byte."""
    change = np.ones(len(cls) + 1, bool)
    if len(cls):
        np.not_equal(cls[1:], cls[:-1], out=change[1:-1])
        change[offsets] = True
    at = np.flatnonzero(change)
    starts, ends = at[:-1], at[1:]
    keep = cls[starts] != 0
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets)


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None,
              seed: int = 1, strict: bool = False) -> np.ndarray:
    """A 64-bit hash of each token's bytes (after ``fold``). A polynomial modulo 2^64
    has long words that agree by their structure alone (the Thue-Morse word and its
    complement); ``strict`` folds every term before the sum, which breaks that."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.zeros(len(starts), np.int64)
    np.cumsum(lens[:-1], out=first[1:])
    total = int(first[-1] + lens[-1])
    at = np.arange(total)
    inside = at - np.repeat(first, lens)
    at = inside + np.repeat(starts, lens)
    values = _VALUES[seed] if fold is None else _VALUES[seed][fold]
    v = values[data[at]]
    v *= _POWERS[seed].upto(int(lens.max()))[inside]
    if strict:
        v ^= v >> _U(32)
    return mix(np.add.reduceat(v, first) + lens.astype(np.uint64) * _STEP)


def rolling(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of tokens i..i+k-1 for each i (length len(h) - k + 1), by doubling."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    q = _POWERS[seed].base
    out, width, block, step, power = None, 0, h, 1, q
    rest = k
    while rest:
        if rest & 1:
            if out is None:
                out = block
            else:  # out covers `width` tokens, block the `step` tokens after them
                n = len(h) - width - step + 1
                out = out[:n] * power + block[width:width + n]
            width += step
        rest >>= 1
        if rest:
            n = len(h) - 2 * step + 1
            block = block[:n] * power + block[step:step + n]
            with np.errstate(over="ignore"):
                power = power * power
            step *= 2
    return mix(out[:len(h) - k + 1])
