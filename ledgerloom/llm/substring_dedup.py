"""Exact repeats across documents by fixed-block anchors.

Any ``window`` consecutive words hold a whole aligned block of ``window // 2``
words of the document they are in, so two equal windows meet in a block: the
blocks (non-overlapping, one position in ``block``) form the index, and every
rolling window of that many words of every document probes it.

Documents are dealt into groups of about ``GROUP_BYTES`` of text by their id,
and hashes into shards; both numbers follow the size of the input, so groups
and shards keep their size. Groups and shards exchange packed sorted hash lists
(each hash once per group, however often it occurs there), answered by one bit
per hash:

1. probe: rolling hashes of each group -> shards; a shard marks the hashes that
   are an indexed block and occur at least twice;
2. extend: every ``window``-word window around a marked anchor, as a 96-bit
   hash with the smallest id of its group -> shards; a shard marks those that
   a document with a smaller id has too;
3. cover: marked windows cover words, overlapping ones join to the maximal
   exact repeat, and covered words go.

Copies of one text fold first: only the smallest id is searched, the others
are covered wholly (if they have a window at all). So neither copies nor hot
passages gather rows in one task. The texts are shuffled once; the three steps
read the same exchange.

Defined results: null text has no words; rows with a null id neither lose words
nor make others lose any; rows with the same id do not cover each other; an
empty table gives an empty result.
"""

from __future__ import annotations

from hashlib import md5
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import vectext as vt
from ledgerloom.llm.shared import written

GROUP_BYTES = 4 << 20
GROUPS_PER_SHARD = 2

_LOW = np.uint64((1 << 40) - 1)
_SIGN = np.uint64(1 << 63)


def _planes(values: np.ndarray, n_bytes: int) -> bytes:
    """Low bytes of uint64 values, byte position by byte position: sorted or
    small values leave planes of equal bytes, which shuffle compression folds."""
    return values.view(np.uint8).reshape(-1, 8)[:, :n_bytes].T.tobytes()


def _values(raw: np.ndarray, n_bytes: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :n_bytes] = raw.reshape(n_bytes, n).T
    return out.view(np.uint64).ravel()


class _Words:
    """Word hashes of the searched documents of one group."""

    def __init__(self, ids: np.ndarray, col: pa.Array, window: int, shards: int):
        self.window, self.block, self.shards = window, window // 2, np.uint64(shards)
        data, offsets = vt.column_bytes(col)
        hashes, counts = [], []
        for lo, hi in vt.pieces(offsets):
            part = data[offsets[lo]:offsets[hi]]
            starts, ends, first = vt.runs(part, offsets[lo:hi + 1] - offsets[lo], vt.BLANK)
            hashes.append(vt.hash_runs(part, starts, ends, strict=True))
            counts.append(np.diff(first))
        self.h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        self.ids = np.repeat(ids, self.counts)
        self.left = np.repeat(self.first[1:], self.counts) - np.arange(len(self.h))  # words to the document's end

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions of the rolling windows, their keys (shard and 40 bits),
        the distinct keys and, of each position, the number of its key."""
        at = np.flatnonzero(self.left >= self.block)
        r = vt.rolling(self.h, self.block)[at] if len(at) else np.zeros(0, np.uint64)
        keys = ((r % self.shards) << np.uint64(40)) | (r >> np.uint64(24))
        distinct, inverse = np.unique(keys, return_inverse=True)
        return at, keys, distinct, inverse

    def probes(self) -> tuple[np.ndarray, np.ndarray]:
        at, _, distinct, inverse = self.anchors()
        flags = np.zeros(len(distinct), np.uint8)
        place = at - self.first[np.searchsorted(self.first, at, side="right") - 1]
        flags[inverse[place % self.block == 0]] = 1  # an indexed block
        flags[np.bincount(inverse, minlength=len(distinct)) > 1] |= 2  # more than once in this group
        return distinct, flags

    def windows(self, marked: np.ndarray) -> tuple[np.ndarray, ...]:
        """Windows around marked anchors: positions, number of each one's
        distinct hash, and of each distinct hash: shard, two parts, smallest id."""
        at, _, _, inverse = self.anchors()
        hit = np.zeros(len(self.h) + self.window + 1, np.int64)
        if len(at):
            hit[at + 1] = marked[inverse]
        hit = np.cumsum(hit)
        start = np.flatnonzero(self.left >= self.window)
        start = start[hit[start + self.window - self.block + 1] > hit[start]]
        if not len(start):
            empty = np.zeros(0, np.uint64)
            return start, start, empty, empty, empty, np.zeros(0, np.int64)
        one = vt.rolling(self.h, self.window)[start]
        two = vt.rolling(self.h, self.window, seed=2)[start] & np.uint64(0xFFFFFFFF)
        ids = self.ids[start]
        shard = one % self.shards
        order = np.lexsort((ids, two, one, shard))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        top = order[fresh]
        return start, number, shard[top], one[top], two[top], ids[top]


_MESSAGE = pa.schema([("grp", pa.int32()), ("kind", pa.int32()), ("shard", pa.int32()),
                      ("id", pa.int64()), ("payload", pa.binary())])
_MESSAGE_DDL = "grp int, kind int, shard int, id long, payload binary"
COPY, PROBE, WINDOW = 0, 1, 2


def _messages(grp: int, kind: int, shards: np.ndarray, payloads: list[bytes]) -> pa.Table:
    n = len(payloads)
    return pa.table([pa.array(np.full(n, grp, np.int32)), pa.array(np.full(n, kind, np.int32)),
                     pa.array(shards.astype(np.int32)), pa.nulls(n, pa.int64()), pa.array(payloads, pa.binary())],
                    schema=_MESSAGE)


def _by_shard(shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shards with entries and the range of each, in an array sorted by shard."""
    if not len(shard):
        return shard, np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    return shard[lo], lo, np.append(lo[1:], len(shard))


def _answers(inbox: pa.Table, kind: int, shard: np.ndarray) -> np.ndarray:
    """The bits that shards returned, in the order of the entries sent."""
    out = np.zeros(len(shard), bool)
    rows = inbox.filter(pa.compute.equal(inbox["kind"], kind))
    replies = dict(zip(rows["shard"].to_pylist(), rows["payload"].to_pylist(), strict=True))
    for s, lo, hi in zip(*(x.tolist() for x in _by_shard(shard)), strict=True):
        if s in replies:
            out[lo:hi] = np.unpackbits(np.frombuffer(replies[s], np.uint8), count=hi - lo)
    return out


def _searched(texts: pa.Table, inbox: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Masks over the group's rows: those searched, and the copies of another row's text."""
    known = np.asarray(texts["id"].combine_chunks().is_valid())
    rows = inbox.filter(pa.compute.equal(inbox["kind"], COPY))
    copies = set(zip(rows["id"].to_pylist(), rows["payload"].to_pylist(), strict=True))
    of_copy = {i for i, _ in copies}
    copy = np.array([i in of_copy and (i, md5(texts["text"][k].as_py()).digest()) in copies
                     for k, i in enumerate(texts["id"].to_pylist())], bool)
    return known & ~copy, copy


def _load(texts: pa.Table, mask: np.ndarray, window: int, shards: int) -> _Words:
    rows = texts.filter(pa.array(mask))
    return _Words(rows["id"].to_numpy(), rows["text"].combine_chunks(), window, shards)


def remove_repeats(docs: DataFrame, window: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept): words (cut at white space) covered by a
    window whose words also start in a document with a smaller id are removed;
    ``kept`` holds the others, joined by one space."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    sizes = written(rows.select("id", F.md5("text").alias("digest"), F.length("text").alias("size")), "substring-ids")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    groups = int(max(1, -(-total // GROUP_BYTES)))
    shards = max(1, groups // GROUPS_PER_SHARD)

    def group(rows: DataFrame):
        spread = F.when(F.col("id").isNull(), F.xxhash64("text")) if "text" in rows.columns else F.when(F.lit(False), 0)
        return F.pmod(spread.otherwise(F.xxhash64("id")), F.lit(groups)).cast("int")

    known = sizes.where("id is not null")
    least = known.groupBy("digest").agg(F.min("id").alias("least"), F.count("id").alias("n")).where("n > 1")
    least = written(least, "substring-least")  # a table of its own, so that a hot digest's rows can be split in the join
    copies = written(known.join(least, "digest").where("id <> least").select("id", "digest").distinct(), "substring-copies")
    null = F.lit(None)
    copies = copies.select(group(copies).alias("grp"), F.lit(COPY).alias("kind"), null.cast("int").alias("shard"),
                           "id", F.unhex("digest").alias("payload"))
    texts = rows.select(group(rows).alias("grp"), "id", "text")

    def probe(texts: pa.Table, inbox: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _MESSAGE.empty_table()
        words = _load(texts, _searched(texts, inbox)[0], window, shards)
        distinct, flags = words.probes()
        shard, lo, hi = _by_shard(distinct >> np.uint64(40))
        low = distinct & _LOW
        return _messages(texts["grp"][0].as_py(), PROBE, shard,
                         [_planes(low[a:b], 5) + flags[a:b].tobytes() for a, b in zip(lo, hi, strict=True)])

    def mark_anchors(sent: pa.Table) -> pa.Table:
        raw = [np.frombuffer(p, np.uint8) for p in sent["payload"].to_pylist()]
        n = np.array([len(r) // 6 for r in raw])
        v = np.concatenate([_values(r[:5 * k], 5, k) for r, k in zip(raw, n, strict=True)])
        flags = np.concatenate([r[5 * k:] for r, k in zip(raw, n, strict=True)])
        _, inverse = np.unique(v, return_inverse=True)
        size = int(inverse.max()) + 1
        several = np.bincount(inverse, minlength=size) > 1
        several[inverse[(flags & 2) > 0]] = True
        block = np.zeros(size, bool)
        block[inverse[(flags & 1) > 0]] = True
        return _reply(sent, PROBE, (several & block)[inverse], n)

    def _reply(sent: pa.Table, kind: int, marked: np.ndarray, n: np.ndarray) -> pa.Table:
        cut = np.concatenate([[0], np.cumsum(n)])
        grp, shard = sent["grp"].to_numpy(), sent["shard"].to_numpy()
        some = [(i, marked[a:b]) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if marked[a:b].any()]
        at = [i for i, _ in some]
        return pa.table([pa.array(grp[at], pa.int32()), pa.array(np.full(len(at), kind, np.int32)),
                         pa.array(shard[at], pa.int32()), pa.nulls(len(at), pa.int64()),
                         pa.array([np.packbits(m).tobytes() for _, m in some], pa.binary())], schema=_MESSAGE)

    def extend(texts: pa.Table, inbox: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _MESSAGE.empty_table()
        words = _load(texts, _searched(texts, inbox)[0], window, shards)
        distinct = words.anchors()[2]
        marked = _answers(inbox, PROBE, distinct >> np.uint64(40))
        _, _, shard, one, two, ids = words.windows(marked)
        named, lo, hi = _by_shard(shard)
        places = ids.view(np.uint64) ^ _SIGN  # in the order of the ids
        return _messages(texts["grp"][0].as_py(), WINDOW, named,
                         [_planes(one[a:b], 8) + _planes(two[a:b], 4) + _planes(places[a:b], 8)
                          for a, b in zip(lo, hi, strict=True)])

    def mark_windows(sent: pa.Table) -> pa.Table:
        raw = [np.frombuffer(p, np.uint8) for p in sent["payload"].to_pylist()]
        n = np.array([len(r) // 20 for r in raw])
        part = lambda a, b: np.concatenate([_values(r[a * k:b * k], b - a, k) for r, k in zip(raw, n, strict=True)])
        one, two, ids = part(0, 8), part(8, 12), part(12, 20)
        order = np.lexsort((ids, two, one))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        smallest = ids[order][fresh][np.cumsum(fresh) - 1]
        marked = np.empty(len(order), bool)
        marked[order] = smallest < ids[order]
        return _reply(sent, WINDOW, marked, n)

    def cover(texts: pa.Table, inbox: pa.Table) -> pa.Table:
        searched, copy = _searched(texts, inbox)
        gone = {}
        if searched.any():
            words = _load(texts, searched, window, shards)
            marked = _answers(inbox, PROBE, words.anchors()[2] >> np.uint64(40))
            start, number, shard, _, _, ids = words.windows(marked)
            elsewhere = _answers(inbox, WINDOW, shard)
            start = start[elsewhere[number] | (words.ids[start] > ids[number])] if len(start) else start
            steps = np.zeros(len(words.h) + 1, np.int64)
            np.add.at(steps, start, 1)
            np.add.at(steps, start + window, -1)
            covered = np.cumsum(steps[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(covered)])
            for i, row in enumerate(np.flatnonzero(searched).tolist()):
                a, b = words.first[i], words.first[i + 1]
                if total[b] > total[a]:
                    gone[row] = ~covered[a:b]
        n_words, n_removed, kept = [], [], []
        for i, t in enumerate(texts["text"].to_pylist()):
            w = t.split()
            n_words.append(len(w))
            if copy[i] and len(w) >= window:
                w = []
            elif i in gone:
                w = list(compress(w, gone[i]))
            n_removed.append(n_words[-1] - len(w))
            kept.append(b" ".join(w))
        return pa.table([texts["id"].combine_chunks(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                         pa.array(kept, pa.binary())], names=["id", "n_words", "n_removed", "kept"])

    by_group = texts.groupBy("grp")

    sent = by_group.cogroup(copies.groupBy("grp")).applyInArrow(probe, _MESSAGE_DDL)
    anchored = copies.unionByName(sent.groupBy("shard").applyInArrow(mark_anchors, _MESSAGE_DDL))
    sent = by_group.cogroup(anchored.groupBy("grp")).applyInArrow(extend, _MESSAGE_DDL)
    repeated = sent.groupBy("shard").applyInArrow(mark_windows, _MESSAGE_DDL)
    out = by_group.cogroup(anchored.unionByName(repeated).groupBy("grp")).applyInArrow(
        cover, "id long, n_words long, n_removed long, kept binary")
    return out.select(F.col("id").cast(kind).alias(key), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))
