"""Periodic runs of words inside a text, found by seed and extend on diagonals.

A run is a maximal stretch of words with smallest period q and a length of at
least max(6, 4 q). On the diagonal of lag q (word i against word i + q) it is a
match of length - q words, at least max(5, 3 q). So for the lags from 2^j to
2^(j+1) - 1 the guaranteed overlap is k = 3 * 2^j words (5 for lag 1):

* the k-grams of each size that occur twice in their text are indexed. A larger
  gram is two smaller ones, so its rank is the rank of a pair; ranks stand for the
  words themselves, and a hash only rules out 5-grams that occur once;
* only neighbouring occurrences of a gram are paired. That is enough: k is q or
  more, so an occurrence between i and i + q would give the run a smaller period;
* a pair whose lag belongs to the size is extended word by word in both
  directions, unless the table of the furthest word covered per lag says that the
  match it lies in has been extended.

The pairs of a size are fewer than the words, and there are log(words) sizes, so
the work does not grow with the square of a repeated gram.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined results: a null or blank text has no words and
no runs; a null or repeated key stays a row of its own; other columns take no
part. Texts are taken whole, in pieces of many short texts or one long one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ledgerloom.llm import vectext as vt

LEAST_WORDS, LEAST_PERIODS = 6, 4
_FIRST_GRAM = 5

RUN = StructType([StructField(name, LongType()) for name in ("start", "length", "period")])


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the keys from 0, and how often each key occurs, per element."""
    _, rank, count = np.unique(keys, return_inverse=True, return_counts=True)
    return rank.astype(np.int64), count[rank]


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number from 0 per word, equal for equal words only."""
    if not len(starts):
        return np.zeros(0, np.int64)
    bounds = np.column_stack([starts, ends]).ravel().astype(np.int64)
    both = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    return _dense(both.dictionary_encode().indices.to_numpy()[::2])[0]


def _first_index(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and ranks of the 5-grams that occur twice or more in their text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(np.arange(len(codes)) + _FIRST_GRAM <= first[1:][text])
    mixed = vt.mix(codes.astype(np.uint64) + vt.mix(text.astype(np.uint64)))
    _, often = _dense(vt.rolling(mixed, _FIRST_GRAM)[at])
    at = at[often > 1]
    rank, often = text[at], None
    for j in range(_FIRST_GRAM):
        rank, often = _dense(rank * len(codes) + codes[at + j])
    return at[often > 1], rank[often > 1]


def _longer(at: np.ndarray, rank: np.ndarray, later: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams made of an indexed one and of what ``later`` (per word, -1 for
    nothing) has ``shift`` words on; only those that occur twice or more."""
    inside = at + shift < len(later)
    at, rank = at[inside], rank[inside]
    other = later[at + shift]
    at, rank, other = at[other >= 0], rank[other >= 0], other[other >= 0]
    rank, often = _dense(rank * len(later) + other)
    return at[often > 1], rank[often > 1]


def _neighbours(at: np.ndarray, rank: np.ndarray, least: int, most: int) -> np.ndarray:
    """(position, lag) of neighbouring occurrences of a gram with such lags, by position."""
    order = np.lexsort((at, rank))
    at, rank = at[order], rank[order]
    lag = at[1:] - at[:-1]
    keep = (rank[1:] == rank[:-1]) & (lag >= least) & (lag <= most)
    pairs = np.column_stack([at[:-1][keep], lag[keep]])
    return pairs[np.argsort(pairs[:, 0], kind="stable")]


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning of two sequences, the shorter one deciding."""
    n, done, step = min(len(a), len(b)), 0, 32
    while done < n:
        unlike = np.flatnonzero(a[done:min(n, done + step)] != b[done:min(n, done + step)])
        if len(unlike):
            return done + int(unlike[0])
        done, step = done + step, 2 * step
    return n


def find_runs(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(text, start, length, period) of every run, in this order; text t is
    ``codes[first[t]:first[t + 1]]`` and starts count from its first word."""
    found: list[tuple[int, int, int, int]] = []

    def extend(pairs: np.ndarray) -> None:
        covered: dict[int, int] = {}
        texts = np.searchsorted(first, pairs[:, 0], side="right") - 1
        for (i, lag), text in zip(pairs.tolist(), texts.tolist(), strict=True):
            if i < covered.get(lag, 0):
                continue
            low, high = int(first[text]), int(first[text + 1])
            start = i - _agreeing(codes[low:i][::-1], codes[low + lag:i + lag][::-1])
            end = i + _agreeing(codes[i:high - lag], codes[i + lag:high])
            covered[lag] = end
            if end + lag - start >= max(LEAST_WORDS, LEAST_PERIODS * lag):
                found.append((text, start - low, end + lag - start, lag))

    at, rank = _first_index(codes, first)
    extend(_neighbours(at, rank, 1, 1))
    ends = np.repeat(first[1:], np.diff(first))
    inner = at[at + _FIRST_GRAM < ends[at]]
    at, rank = _longer(inner, rank[np.isin(at, inner, assume_unique=True)], codes, _FIRST_GRAM)
    least, k = 2, LEAST_WORDS
    while len(at):
        extend(_neighbours(at, rank, least, 2 * least - 1))
        later = np.full(len(codes), -1)
        later[at] = rank
        at, rank = _longer(at, rank, later, k)
        least, k = 2 * least, 2 * k
    out = np.array(found, np.int64).reshape(-1, 4)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _repeated_words(runs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words that a run holds after its first period."""
    step = np.zeros(int(first[-1]) + 1, np.int64)
    start = first[runs[:, 0]] + runs[:, 1]
    np.add.at(step, start + runs[:, 3], 1)
    np.add.at(step, start + runs[:, 2], -1)
    return np.cumsum(step[:-1]) > 0


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each text with one space between them."""
    texts = len(first) - 1
    word = np.flatnonzero(kept)
    text = np.repeat(np.arange(texts), np.diff(first))[word]
    follows = np.ones(len(word), bool)
    if len(word):
        follows[:-1], follows[-1] = text[1:] == text[:-1], False
    step = np.zeros(len(data) + 2, np.int8)
    np.add.at(step, starts[word], 1)
    np.add.at(step, ends[word] + follows, -1)
    spaced = data.copy()
    spaced[ends[word][follows]] = 32
    out = spaced[np.cumsum(step[:len(data)], dtype=np.int8) > 0]
    offsets = np.zeros(texts + 1, np.int64)
    np.cumsum(np.bincount(text, weights=(ends - starts)[word] + follows, minlength=texts).astype(np.int64), out=offsets[1:])
    return pa.Array.from_buffers(pa.large_string(), texts, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _run_lists(runs: np.ndarray, texts: int) -> pa.Array:
    fields = [pa.array(np.ascontiguousarray(runs[:, c])) for c in (1, 2, 3)]
    offsets = np.searchsorted(runs[:, 0], np.arange(texts + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))


def collapse(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, runs, collapsed) per row: the runs as (start, length, period) by
    start, then period, and the text without the words that repeat a run's period."""
    schema = StructType([StructField("_key", docs.schema[key].dataType), StructField("n_words", LongType()),
                         StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = vt.column_bytes(batch.column(1))
            for lo, hi in vt.pieces(offsets):
                own, bounds = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
                starts, ends, first = vt.runs(own, bounds, vt.BLANK)
                runs = find_runs(word_codes(own, starts, ends), first)
                collapsed = _joined(own, starts, ends, first, ~_repeated_words(runs, first))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(np.diff(first).astype(np.int64)),
                                                  _run_lists(runs, hi - lo), collapsed.cast(pa.string())], ["_key", "n_words", "runs", "collapsed"])

    packed = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    return packed.mapInArrow(run, schema).withColumnRenamed("_key", key)


def strongest(runs):
    """Of a column of runs the one with the greatest length / period; ties: the
    smallest start, then period. Null where there is none."""
    better = lambda best, r: r.length * best.period > best.length * r.period
    return F.when(F.size(runs) > 0, F.aggregate(runs, F.element_at(runs, 1), lambda best, r: F.when(better(best, r), r).otherwise(best)))


def cycled(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) where the tails of a tenth of the texts, chosen by the crc32 of the
    key, repeat their beginning: with h = crc32(key), g = h div 10 and n words, if
    h % 10 = 0 each word i >= a = g % n becomes word a + (i - a) % p, with
    p = 1 + (n - a) div (3 + g % 8). All other texts stay as they are."""
    h = F.crc32(F.col(key).cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    out = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), words.alias("words"), F.floor(h / 10).alias("g"))
    out = out.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    out = out.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("transform(sequence(0, n - 1), i -> words[cast(if(i < a, i, a + (i - a) % p) AS int)])")
    return out.select(F.col("_key").alias(key), F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("_text")).alias(text))


ORACLE_SQL = r"""
WITH hashed AS (
    SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, xor(4294967295, list_reduce(
        list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
        lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                 lambda d, z: xor(d >> 1, 3988292384 * (d & 1))))) AS h
    FROM documents
), cut AS (
    SELECT doc_id, coalesce(w, []) AS w, coalesce(len(w), 0) AS n, h, h // 10 AS g,
        (h // 10) % nullif(len(w), 0) AS a FROM hashed
), damaged AS (
    SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
        w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM cut
), places AS (
    SELECT doc_id, n, w, unnest(range(n)) AS i FROM damaged
), grams AS (
    SELECT doc_id, n, i, array_to_string(w[i + 1:i + 5], ' ') AS gram FROM places WHERE i + 5 <= n
), hits AS (
    SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.gram = y.gram AND y.i > x.i
    WHERE 4 * (y.i - x.i) <= x.n
), matched AS (
    SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length
    FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM hits)
    GROUP BY doc_id, q, island HAVING count(*) + 4 + q >= greatest(6, 4 * q)
), runs AS (
    SELECT doc_id, start, length, min(q) AS period FROM matched GROUP BY doc_id, start, length
), listed AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS all_runs
    FROM runs GROUP BY doc_id
), best AS (
    SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), left_over AS (
    SELECT p.doc_id, string_agg(p.w[p.i + 1], ' ' ORDER BY p.i) AS kept FROM places p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i
    GROUP BY p.doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.start, best.length, best.period, 1000 * best.length // best.period AS exponent_milli,
    sha256(coalesce(all_runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM damaged d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""
