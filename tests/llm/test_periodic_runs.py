"""Periodic runs against brute force, their removal, edge rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import keys, periodic_runs
from tests.llm import frames


def brute(words: list) -> list[tuple[int, int, int]]:
    """Every maximal stretch of each period, by definition; of equal stretches the smallest period."""
    found: dict[tuple[int, int], int] = {}
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def sequence(dice: random.Random) -> list[int]:
    letters = dice.randrange(1, 5)
    out: list[int] = []
    while len(out) < dice.randrange(1, 160):
        unit = [dice.randrange(letters) for _ in range(dice.randrange(1, 14))]
        out += (unit * dice.randrange(1, 9))[:dice.randrange(1, 90)]
    return out


@pytest.mark.parametrize("seed", range(12))
def test_equals_brute_force(seed):
    dice = random.Random(seed)
    texts = [sequence(dice) for _ in range(120)] + [[], [1] * 6, [1] * 5, [1, 2] * 4]
    dice.shuffle(texts)
    first = np.cumsum([0] + [len(t) for t in texts])
    codes = np.array([w for t in texts for w in t], np.int64)
    found = periodic_runs.find_runs(codes, first)
    assert [tuple(r) for r in found] == [(t, *r) for t, words in enumerate(texts) for r in brute(words)]


def damaged(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_registered_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{frames.SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in keys.op11_periodic_runs(spark, frames.SF).collect()}
    assert len(got) == len(rows) and any(r.n_runs for r in got.values())
    for doc_id, text in rows:
        words = damaged(doc_id, text)
        if len(words) > 1500:
            continue  # covered by the SQL; brute force is quadratic
        runs, r = brute(words), got[doc_id]
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
        if runs:
            s, n, q = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, n, q, 1000 * n // q)
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4


def test_awkward_rows(spark):
    for df in (frames.awkward(spark), frames.clashing(spark)):
        out = periodic_runs.collapse(df)
        assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
        want = sorted((str(i), len((t or "").encode().split()), " ".join(w.decode() for w in (t or "").encode().split())) for i, t, *_ in frames.ROWS
                      if t is None or len(t) < 10_000)
        got = [(str(r.doc_id), r.n_words, r.collapsed) for r in out.collect() if r.n_words < 1000]
        assert sorted(got) == want
    assert periodic_runs.collapse(frames.empty(spark)).collect() == []
    assert periodic_runs.cycled(frames.awkward(spark)).count() == len(frames.ROWS)


def test_equal_words_hash_or_not_and_blanks(spark):
    nbsp = " "
    df = spark.createDataFrame([(1, "x " + "ab cd\t\n" * 4), (2, f"a{nbsp}b " * 6), (3, " a " * 6)], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic_runs.collapse(df).collect()}
    assert [tuple(r) for r in got[1].runs] == [(1, 8, 2)] and got[1].collapsed == "x ab cd"
    assert got[2].n_words == 6 and got[2].collapsed == f"a{nbsp}b" and got[3].collapsed == " a"


def test_work_grows_in_line_with_the_words():
    """A word repeated, and a phrase repeated with a word between that never repeats."""
    n = 200_000
    same = periodic_runs.find_runs(np.zeros(n, np.int64), np.array([0, n]))
    assert same.tolist() == [[0, 0, n, 1]]
    mixed = np.arange(n, dtype=np.int64) + 10
    for j in range(6):
        mixed[j::7] = j
    assert periodic_runs.find_runs(mixed, np.array([0, n])).tolist() == []


def test_strongest_is_exact(spark):
    df = spark.range(1).select(F.expr("array(named_struct('start', 0L, 'length', 8L, 'period', 2L), named_struct('start', 3L, 'length', 4000000001L, "
                                      "'period', 1000000000L), named_struct('start', 9L, 'length', 16L, 'period', 4L))").alias("runs"))
    assert tuple(df.select(periodic_runs.strongest(F.col("runs")).alias("b")).first().b) == (3, 4000000001, 1000000000)
