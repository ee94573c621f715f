"""SimHash near-duplicates with a Gray-ordered hierarchical index.

Fingerprint: the text is lower-cased (A-Z), cut into words at white space, and
each run of ``shingle`` words (space-joined, repeats included; a shorter
sequence is one shingle) votes with the bits of its XXH64 (seed 42); a bit is
set if more than half the shingles set it. No words: fingerprint zero.

Linking all pairs at ``max_bits`` or fewer differing bits:

1. equal fingerprints fold to one row (partial aggregation before the shuffle),
   so copies never meet as pairs;
2. of ``max_bits`` + 1 bit fields two linked fingerprints agree in one, so each
   fingerprint goes to one group per field, keyed by that field's value; a
   group over ``GROUP_ROWS`` is split again by the fields of its remaining
   bits, to ``LEVELS`` levels, which loses no pair;
3. a group is held sorted by Gray rank, where neighbours share most bits. Its
   tree factors the bits that all fingerprints below a node share (masked
   pattern) into the node; comparing two nodes accumulates the differing bits
   of their patterns and drops the whole pair of subtrees beyond ``max_bits``;
4. each group returns the spanning forest of its links, not the pairs, and
   distributed union-find joins the forests into components.

Defined results: null text is the empty text; rows with a null id are not
linked and keep a null component; of repeated ids each row is a document of its
own, in the component of its fingerprint; an empty table gives an empty result;
other columns are not read, and pass through ``keep_first`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.shared import written

GROUP_ROWS = 1 << 16
LEVELS = 3
LEAF = 64
BUNDLE_ROWS = 1 << 13
BLOCK = 1 << 14
_PIECE_SHINGLES = 1 << 17


def _bit_counts(h: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of one UTF-8 text; long texts are counted in pieces."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the six white-space bytes
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    total = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, total, _PIECE_SHINGLES):
        part = words[lo:min(lo + _PIECE_SHINGLES, total) + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle))))
        counts += _bit_counts(np.fromiter((digest(g, 42) for g in grams), np.uint64, len(part) - shingle + 1))
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, version, fp long): one row per row of ``docs``; version is a hash of the text."""
    kind = docs.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py() or b"", shingle) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:2], pa.array(np.array(fps, np.uint64).view(np.int64))], ["key", "version", "fp"])

    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("version"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(scan, f"key {kind}, version long, fp long").withColumnRenamed("key", key)


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray order."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Binary tree over fingerprints in (group, Gray rank) order; a node keeps
    its range of groups and the shared mask and bits of all below it."""

    def __init__(self, fps: np.ndarray, grp: np.ndarray):
        self.order = np.lexsort((gray_rank(fps), grp))
        self.fps, self.grp = fps[self.order], grp[self.order]
        n = len(fps)
        self.lo = np.arange(0, n, LEAF)
        self.hi = np.minimum(self.lo + LEAF, n)
        ones = np.bitwise_and.reduceat(self.fps, self.lo)
        zeros = np.bitwise_and.reduceat(~self.fps, self.lo)
        first, last = self.grp[self.lo], self.grp[self.hi - 1]
        self.levels = [(ones | zeros, ones, first, last)]
        while len(ones) > 1:  # factor what children share into their parent
            at = np.arange(0, len(ones), 2)
            ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
            first, last = first[at], np.maximum.reduceat(last, at)
            self.levels.append((ones | zeros, ones, first, last))

    def linked_leaves(self, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (a <= b) of leaves that may hold a link, in bounded blocks."""
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, a, b = todo.pop()
            mask, bits, first, last = self.levels[level]
            differing = np.bitwise_count((bits[a] ^ bits[b]) & mask[a] & mask[b])
            keep = (differing <= max_bits) & (first[b] <= last[a])
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if level == 0:
                yield a, b
                continue
            size = len(self.levels[level - 1][0])
            x = np.concatenate([2 * a, 2 * a, 2 * a + 1, 2 * a + 1])
            y = np.concatenate([2 * b, 2 * b + 1, 2 * b, 2 * b + 1])
            ok = (x <= y) & (x < size) & (y < size)
            x, y = x[ok], y[ok]
            todo += [(level - 1, x[lo:lo + BLOCK], y[lo:lo + BLOCK]) for lo in range(0, len(x), BLOCK)]


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def forest(fps: np.ndarray, grp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, smallest fingerprint of its tree) of a spanning
    forest of the links inside each group."""
    index = GrayIndex(fps, grp)
    fps, grp = index.fps, index.grp
    parent = list(range(len(fps)))
    label = np.arange(len(fps))
    for a, b in index.linked_leaves(max_bits):
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            one, two = slice(index.lo[i], index.hi[i]), slice(index.lo[j], index.hi[j])
            # only pairs of one group that are not in one tree already
            open_ = (label[one, None] != label[None, two]) & (grp[one, None] == grp[None, two])
            if not open_.any():
                continue
            x, y = np.nonzero(open_ & (np.bitwise_count(fps[one, None] ^ fps[None, two]) <= max_bits))
            if not len(x):
                continue
            for p, q in zip((x + one.start).tolist(), (y + two.start).tolist(), strict=True):
                p, q = _root(parent, p), _root(parent, q)
                parent[max(p, q)] = min(p, q)
            for span in (one, two):
                label[span] = [_root(parent, p) for p in range(span.start, span.stop)]
    roots = np.array([_root(parent, p) for p in range(len(fps))], np.int64)
    signed = fps.view(np.int64)
    least = np.full(len(fps), np.iinfo(np.int64).max)
    np.minimum.at(least, roots, signed)
    low = least[roots]
    moved = low != signed
    return signed[moved], low[moved]


def _fields(width: int, count: int) -> list[tuple[int, int]]:
    """(shift, bits) of ``count`` fields over ``width`` bits."""
    cut = [round(width * k / count) for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): spanning forests, over all groups, of the links of ``distinct.fp``.

    ``rest`` holds the bits of a fingerprint outside the fields its group
    already shares (moved down to bit 0). Several groups travel as one bundle
    of about ``BUNDLE_ROWS`` rows, so that small groups cost no call each.
    """
    bundles = max(1, -(-distinct.count() * (max_bits + 1) // BUNDLE_ROWS))

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = forest(rows["fp"].to_numpy().view(np.uint64), rows["grp"].to_numpy(), max_bits)
        return pd.DataFrame({"a": a, "b": b})

    found = None
    todo = [(distinct.select("fp", F.col("fp").alias("rest"), F.lit(0).cast("long").alias("grp")), 64, 0)]
    while todo:
        rows, bits, depth = todo.pop()
        parts = []
        for k, (shift, size) in enumerate(_fields(bits, max_bits + 1)):
            value = F.shiftrightunsigned("rest", shift).bitwiseAND(F.lit((1 << size) - 1))
            low = F.col("rest").bitwiseAND(F.lit((1 << shift) - 1))
            high = F.shiftleft(F.shiftrightunsigned("rest", shift + size), shift) if shift + size < 64 else F.lit(0).cast("long")
            parts.append(F.struct(F.lit(size).alias("size"), low.bitwiseOR(high).alias("rest"),
                                  F.xxhash64("grp", F.lit(k), value).alias("grp")))
        groups = rows.select("fp", F.explode(F.array(*parts)).alias("g")).select("fp", "g.*")
        if depth + 1 < LEVELS:
            large = written(groups.groupBy("grp").count().where(F.col("count") > GROUP_ROWS).select("grp"), "simhash-large")
            if not large.isEmpty():
                over = groups.join(large, "grp", "left_semi")
                sizes = sorted({size for _, size in _fields(bits, max_bits + 1)})
                todo += [(over.where(F.col("size") == s).drop("size"), bits - s, depth + 1) for s in sizes]
                groups = groups.join(large, "grp", "left_anti")
        edges = (groups.select("fp", "grp", F.pmod("grp", F.lit(bundles)).alias("bundle"))
                 .groupBy("bundle").applyInPandas(link, "a long, b long"))
        found = edges if found is None else found.unionByName(edges)
    return found.distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(key, version, fp long, component_id): the smallest id reachable over links."""
    fps = written(fingerprints(docs, shingle, key, text), "simhash-fps")
    least = fps.groupBy("fp").agg(F.min(key).alias("least"))
    found = written(links(least.where(F.col("least").isNotNull()).select("fp"), max_bits), "simhash-links")
    label = components(found)  # (node, component): fingerprints in a link
    named = least.join(label, least.fp == label.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    member = named.join(smallest, "component").select("fp", "component_id")
    return fps.join(member, "fp").select(
        key, "version", "fp", F.when(F.col(key).isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, shingle: int = 3, max_bits: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose id is its component's smallest (one per group);
    rows without an id are kept."""
    groups = near_duplicates(docs, shingle, max_bits, key, text)
    gone = groups.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("id"), "version").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("id"), F.xxhash64(text).alias("version"))
    return rows.join(gone, ["id", "version"], "left_anti").select("row.*")
