"""Recall of the line signatures on near, not equal, lines of exact similarity
0.8 or more: the share of pairs that share a band and pass the sketch."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import fuzzy_lines as fl

N = 300


def _jaccard(x, y):
    s, t = ({line[i:i + fl.SHINGLE] for i in range(max(1, len(line) - fl.SHINGLE + 1))} for line in (x, y))
    return len(s & t) / len(s | t)


def _words(rng, n, least=3, most=9):
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(least, most))) for _ in range(n)]


def _edited(rng, line, times=1):
    for _ in range(times):
        i = rng.randrange(len(line))
        line = line[:i] + rng.choice("ABCDEF") + line[i + 1:]
    return line


def _kind(name):
    rng = random.Random(name)
    line = lambda n, *size: " ".join(_words(rng, n, *size))
    pairs = []
    while len(pairs) < N:
        if name.endswith("words and a dot"):
            x = line(int(name.split()[0]))
            y = x + "."
        elif name == "a word appended to 12":
            x = line(12)
            y = x + " " + line(1)
        elif name == "an edit in long words":
            x = line(5, 18, 24)
            y = _edited(rng, x)
        elif name == "an edit in 18 words":
            x = line(18)
            y = _edited(rng, x)
        elif name == "24 characters a word":
            x = line(10, 24, 24)[:240].ljust(240, "q")
            y = x + "z"
        elif name == "two bytes a character":
            x = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(30)) + line(1, 30, 30)
            y = x + "z"
        else:  # at the threshold
            x = line(rng.randint(12, 40))
            y = _edited(rng, x, rng.randint(1, 3))
            if _jaccard(x, y) > 0.83:
                continue
        if _jaccard(x, y) >= fl.SIMILARITY:
            pairs.append((name, x, y))
    return pairs


def _recall(spark, kinds):
    """(share that meets, share that passes the sketch) by kind."""
    pairs = spark.createDataFrame([p for k in kinds for p in _kind(k)], "kind string, x string, y string")
    lines = pairs.select(F.explode(F.array("x", "y")).alias("line")).distinct().select(
        "*", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))
    signed = fl.signatures(lines).join(lines, ["a", "b"]).persist()
    other = signed.withColumnsRenamed({c: f"p{c}" for c in signed.columns})
    met = F.greatest(*(F.col(f"k{k}") == F.col(f"pk{k}") for k in range(fl.BANDS)))
    both = pairs.join(signed, pairs.x == signed.line).join(other, F.col("y") == F.col("pline"))
    rows = both.groupBy("kind").agg(F.avg(met.cast("int")).alias("met"), F.avg(fl._agree().cast("int")).alias("agree")).collect()
    signed.unpersist()
    return {r.kind: (r.met, r.agree) for r in rows}


def test_recall_by_length(spark):
    kinds = [*(f"{n} words and a dot" for n in (4, 5, 6, 8, 10)), "a word appended to 12", "an edit in long words", "an edit in 18 words"]
    got = _recall(spark, kinds)
    print(got)
    assert set(got) == set(kinds)
    for k in kinds:
        assert min(got[k]) >= 0.98, (k, got[k])


def test_recall_beside_the_former_switch(spark):
    """Lines on either side of 24 characters a word, or of two bytes a character."""
    kinds = ["24 characters a word", "two bytes a character"]
    got = _recall(spark, kinds)
    print(got)
    assert set(got) == set(kinds) and min(min(v) for v in got.values()) == 1.0


def test_flips_reach_every_bit():
    flips = fl._flips()
    assert len(set(flips)) == len(flips)
    for bit in range(32):
        assert 6 <= sum(c >> bit & 1 for c in flips) <= len(flips) - 6, bit


def test_recall_at_the_threshold(spark):
    kinds = ["similarity 0.80 to 0.83"]
    got = _recall(spark, kinds)
    print(got)
    assert min(got[kinds[0]]) >= 0.99
