"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters, digits and marks (A-Z lower-cased); in scripts that are
written without spaces (Han, kana, Thai and their like) each character is a token.
Punctuation, symbols and spaces of any script separate and do not count. A document is compared with a benchmark item when they share a
seed, a run of ``min_match`` tokens found by a running Karp-Rabin hash. Then
the longest common run of unmarked tokens is marked as a tile in both, again
and again, until none of ``min_match`` tokens is left: tiles never overlap, and
their order does not matter, so reordered passages are found too. The item has
leaked if its tiles cover ``threshold`` of its tokens.

The seeds of the benchmark are joined in blocks of at most ``BLOCK_BYTES`` of
benchmark text: a sorted array of hashes goes to every task, behind a bit table
that turns away nearly all windows of clean documents. Documents are mapped in
place; nothing is shuffled, whatever one document or item holds. A seed that a
document repeats counts once when it is decided which items can reach the
threshold; only for those are all its places looked up.

Defined results: null and empty texts match nothing; items of fewer than
``min_match`` tokens are never reported; equal items are reported each; rows
with the same id, or a null id, are reported each; an empty benchmark reports
nothing and keeps every document.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.llm import vectext as vt
from ledgerloom.llm.shared import filter_texts

BLOCK_BYTES = 16 << 20
MIN_MATCH = 5
THRESHOLD = 0.5
_FILTER_BITS = 22

#: Scripts without spaces between words: Thai, Lao, Tibetan, Myanmar, Khmer, kana,
#: Han with its extensions and compatibility forms, half-width kana.
_UNSPACED = [(0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF),
             (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)]
#: At most so many (seed of a text, place in the benchmark) pairs are held at a time, but for one text.
_PAIRS = 1 << 20


@cache
def _classes() -> np.ndarray:
    """Per code point: 0 separates, 1 is part of a run, 2 is a token by itself."""
    out = np.array([unicodedata.category(chr(c))[0] in "LNM" for c in range(0x110000)], np.uint8)
    for lo, hi in _UNSPACED:
        out[lo:hi + 1] *= 2
    return out


def _byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character; neighbouring tokens of one character
    differ, by 2 and 3."""
    ascii_only = _classes()[:128]
    if not len(data) or data.max() < 128:
        return ascii_only[data]
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(lead, len(data)))
    b = data[np.minimum(lead[:, None] + np.arange(4), len(data) - 1)].astype(np.int64)
    tail = b & 0x3F
    point = np.select([size == 1, size == 2, size == 3], [b[:, 0], (b[:, 0] & 0x1F) << 6 | tail[:, 1], (b[:, 0] & 0x0F) << 12 | tail[:, 1] << 6 | tail[:, 2]],
                      (b[:, 0] & 0x07) << 18 | tail[:, 1] << 12 | tail[:, 2] << 6 | tail[:, 3])
    cls = _classes()[np.minimum(point, 0x10FFFF)]
    cls = cls + ((cls == 2) & (np.arange(len(cls)) % 2 == 1)).astype(np.uint8)
    return np.repeat(cls, size)


@dataclass
class Seeds:
    """One block of benchmark items."""
    items: list             # ids
    tokens: np.ndarray      # hashes of all tokens
    first: np.ndarray       # first token of each item (n + 1)
    hashes: np.ndarray      # of all runs of min_match tokens, sorted
    places: np.ndarray      # token at which each run starts
    filter: np.ndarray      # bool by the top bits of a hash
    own: np.ndarray         # hash of the run that starts at each token (0 if none)


def _tokens(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes, first token of each text, hashes of runs of k and their starts."""
    starts, ends, first = vt.runs_of(_byte_classes(data), offsets)
    h = vt.hash_runs(data, starts, ends, vt.LOWER, strict=True)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(h))
    at = np.flatnonzero(left >= k)
    return h, first, vt.rolling(h, k)[at] if len(at) else np.zeros(0, np.uint64), at


def seed_blocks(benchmark: DataFrame, min_match: int, key: str, text: str) -> Iterator[Seeds]:
    """The benchmark, block by block; a block is bounded, their number is not."""
    rows = benchmark.select(F.col(key).alias("item"), F.col(text).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for number in range(blocks):
        got = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number).toArrow()
        data, offsets = vt.column_bytes(got["text"])
        tokens, first, hashes, places = _tokens(data, offsets, min_match)
        order = np.argsort(hashes, kind="stable")
        known = np.zeros(1 << _FILTER_BITS, bool)
        known[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        own = np.zeros(len(tokens), np.uint64)
        own[places] = hashes
        yield Seeds(got["item"].to_pylist(), tokens, first, hashes[order], places[order], known, own)


def tiles(runs: list[tuple[int, int, int]], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: from maximal common runs (start in item, start in
    document, length), the longest unmarked first, then the earliest in the
    item. What is left of a run between marked tokens takes part again."""
    queue = [(-n, p, t) for p, t, n in runs]
    heapq.heapify(queue)
    marked_p: set[int] = set()
    marked_t: set[int] = set()
    out = []
    while queue:
        n, p, t = heapq.heappop(queue)
        free = [p + k not in marked_p and t + k not in marked_t for k in range(-n)]
        if all(free):
            out.append((p, t, -n))
            marked_p.update(range(p, p - n))
            marked_t.update(range(t, t - n))
            continue
        k = 0
        while k < -n:  # push the free stretches
            if not free[k]:
                k += 1
                continue
            stop = k
            while stop < -n and free[stop]:
                stop += 1
            if stop - k >= min_match:
                heapq.heappush(queue, (k - stop, p + k, t + k))
            k = stop
    return sorted(out)


def common_runs(p: np.ndarray, t: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Maximal common runs from seed hits (starts in item and document): hits
    next to each other on one diagonal are one run."""
    order = np.lexsort((p, t - p))
    p, t = p[order], t[order]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (np.diff(t - p) != 0) | (np.diff(p) != 1)
    at = np.flatnonzero(fresh)
    n = np.diff(np.append(at, len(p))) + min_match - 1
    return list(zip(p[at].tolist(), t[at].tolist(), n.tolist(), strict=True))


def _reachable(text: np.ndarray, hashes: np.ndarray, seeds: Seeds, min_match: int, threshold: float) -> np.ndarray:
    """(text, item) pairs of which all runs that the text shares, however they overlap,
    cover enough; ``text`` and ``hashes`` are distinct pairs with a seed."""
    lo = np.searchsorted(seeds.hashes, hashes, side="left")
    n = np.searchsorted(seeds.hashes, hashes, side="right") - lo
    place = seeds.places[np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
    text = np.repeat(text, n)
    order = np.lexsort((place, text))
    text, place = text[order], place[order]
    item = np.searchsorted(seeds.first, place, side="right") - 1
    fresh = np.ones(len(text) + 1, bool)
    fresh[1:-1] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
    step = np.full(len(text), min_match)
    step[:-1] = np.minimum(step[:-1], place[1:] - place[:-1])
    step[fresh[1:]] = min_match
    at = np.flatnonzero(fresh[:-1])
    covered = np.add.reduceat(step, at) if len(at) else np.zeros(0, np.int64)
    enough = covered >= threshold * np.diff(seeds.first)[item[at]]
    return np.column_stack([text[at], item[at]])[enough]


def leaks(data: np.ndarray, offsets: np.ndarray, seeds: Seeds, min_match: int, threshold: float) -> Iterator[tuple]:
    """(text number, item, tokens of the item, covered tokens, tiles)."""
    _, first, hashes, at = _tokens(data, offsets, min_match)
    if not len(hashes) or not len(seeds.hashes):
        return
    maybe = np.flatnonzero(seeds.filter[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    lo = np.searchsorted(seeds.hashes, hashes[maybe], side="left")
    maybe = maybe[seeds.hashes[np.minimum(lo, len(seeds.hashes) - 1)] == hashes[maybe]]
    text = np.searchsorted(first, at[maybe], side="right") - 1
    order = np.lexsort((hashes[maybe], text))
    text, hit = text[order], hashes[maybe][order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (hit[1:] != hit[:-1])
    text, hit = text[fresh], hit[fresh]
    pairs = np.cumsum(np.searchsorted(seeds.hashes, hit, side="right") - np.searchsorted(seeds.hashes, hit, side="left"))
    ends = np.flatnonzero(np.diff(text, append=-1)) + 1  # of each text's seeds
    start = 0
    while start < len(text):  # as many texts at a time as hold few pairs, one at least
        done = pairs[start - 1] if start else 0
        fits = ends[(ends > start) & (pairs[ends - 1] - done <= _PAIRS)]
        stop = int(fits[-1]) if len(fits) else int(ends[np.searchsorted(ends, start, side="right")])
        for d, i in _reachable(text[start:stop], hit[start:stop], seeds, min_match, threshold).tolist():
            found = _tiled(hashes, at, first, d, i, seeds, min_match)
            size, covered = int(seeds.first[i + 1] - seeds.first[i]), sum(n for _, _, n in found)
            if covered >= threshold * size:
                yield d, seeds.items[i], size, covered, len(found)
        start = stop


def _tiled(hashes: np.ndarray, at: np.ndarray, first: np.ndarray, d: int, i: int, seeds: Seeds, min_match: int) -> list[tuple[int, int, int]]:
    """The tiles of one text and one item, from all places of their common seeds."""
    a, b = np.searchsorted(at, [first[d], first[d + 1]])
    own = seeds.own[seeds.first[i]:seeds.first[i + 1] - min_match + 1]
    order = np.argsort(own, kind="stable")
    lo = np.searchsorted(own[order], hashes[a:b], side="left")
    n = np.searchsorted(own[order], hashes[a:b], side="right") - lo
    p = order[np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
    return tiles(common_runs(p, np.repeat(at[a:b] - first[d], n), min_match), min_match)


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD,
               key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_key, n_tokens, covered, coverage, n_tiles): every document and
    item whose tiles cover at least ``threshold`` of the item."""
    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_key].dataType)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    out = None
    for seeds in seed_blocks(benchmark, min_match, item_key, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)  # a block of BLOCK_BYTES of text at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data, offsets = vt.column_bytes(b.column(1))
                for lo, hi in vt.pieces(offsets):
                    found = list(leaks(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], shared.value,
                                       min_match, threshold))
                    if found:
                        d, item, size, covered, n = zip(*found, strict=True)
                        items = pa.array(list(item), item_type)
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(pa.array([lo + k for k in d])), items, pa.array(size, pa.int64()),
                             pa.array(covered, pa.int64()), pa.array(np.divide(covered, size)), pa.array(n, pa.int64())],
                            ["key", "item", "n_tokens", "covered", "coverage", "n_tiles"])

        part = rows.mapInArrow(run, f"key {kinds[0]}, item {kinds[1]}, n_tokens long, covered long, coverage double, n_tiles long")
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"key": key, "item": item_key})


def keep_clean(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD,
               text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which no item has leaked."""
    for seeds in seed_blocks(benchmark, min_match, item_key, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def clean(data: np.ndarray, offsets: np.ndarray, shared=shared) -> np.ndarray:
            out = np.ones(len(offsets) - 1, bool)
            for d, *_ in leaks(data, offsets, shared.value, min_match, threshold):
                out[d] = False
            return out

        docs = filter_texts(docs, text, clean)
    return docs
