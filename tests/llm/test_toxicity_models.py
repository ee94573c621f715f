"""Exact keys and whole-text ratios of the toxicity models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.llm import kneser_ney
from ledgerloom.llm import vectext as vt


def _grams(text):
    return kneser_ney.grams(*vt.column_bytes(pa.array([text])))


def test_grams_tell_all_code_points_apart():
    letters = [chr(c) for c in (*range(0x4E00, 0x4E00 + 6000), *range(0xAC00, 0xAC00 + 6000), *range(0x20000, 0x20000 + 6000))]
    seen = {tuple(zip(g.high.tolist(), g.low.tolist())) for g in map(_grams, letters)}
    assert len(seen) == len(letters)


def test_tables_hold_every_gram_apart():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 1_500_000, dtype=np.uint64))
    table = kneser_ney.Counts(keys, np.arange(len(keys))[:, None])
    assert len(table) == len(keys) > 1 << 20
    assert (table[keys][:, 0] == np.arange(len(keys))).all()
    assert not table[keys[:10] + np.uint64(1)][~np.isin(keys[:10] + np.uint64(1), keys)].any()


def test_mild_evidence_counts(spark):
    """Words that either class uses, one of them three times as often."""
    rng = np.random.default_rng(1)
    words = np.array([f"{a}{b}{c}" for a in "bdfg" for b in "aeio" for c in "lmnr"])
    tilt = np.where(np.arange(len(words)) % 2, 3.0, 1.0)
    rows = [(i, " ".join(rng.choice(words, 60, p=(t := tilt if i % 2 else tilt[::-1]) / t.sum())), i % 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    fitted = kneser_ney.fit(docs.drop("toxic"), docs.drop("text"), F.col("doc_id") < 300, "toxic")
    got = {r.doc_id: r.score for r in kneser_ney.score(docs, fitted).collect()}
    toxic, clean = ([got[i] for i in range(300, 400) if i % 2 == y] for y in (1, 0))
    assert np.mean([a > b for a in toxic for b in clean]) > 0.9


def _units(text):
    return "".join(w + "_" for w in "".join(c if c.isalpha() else " " for c in text.lower()).split())


def _brute_ratio(text, learned, everything):
    """The definition: counts of five units by class, scaled; continuation counts below."""
    def padded(t):
        # the unit before a text is a border, and nothing is before that
        u = "\0" * 3 + "_" + _units(t)
        return [u[i - 4:i + 1] for i in range(4, len(u))]

    top = [{}, {}]
    for t, y in learned:
        for g in padded(t):
            top[y][g] = top[y].get(g, 0) + 1
    amount = [sum(c.values()) for c in top]
    for y in (0, 1):
        top[y] = {g: n * min(amount) / amount[y] for g, n in top[y].items()}
    levels, grams = {}, {g for t in everything for g in padded(t)}
    for order in (4, 3, 2, 1):
        counts: dict = {}
        for g in grams:
            counts[g[1:]] = counts.get(g[1:], 0) + 1
        levels[order], grams = counts, set(counts)

    def p_low(g, order):
        if order == 0:
            return 1 / (1 << kneser_ney.BITS)
        own = {x: n for x, n in levels[order].items() if x[:-1] == g[:-1]}
        total = sum(own.values())
        if not total:
            return p_low(g[1:], order - 1)
        d = kneser_ney.DISCOUNT
        return max(own.get(g, 0) - d, 0) / total + d * len(own) / total * p_low(g[1:], order - 1)

    def p(g, y):
        own = {x: n for x, n in top[y].items() if x[:-1] == g[:-1]}
        total = sum(own.values())
        if not total:
            return p_low(g[1:], 4)
        d = kneser_ney.DISCOUNT
        return max(own.get(g, 0) - d, 0) / total + sum(min(n, d) for n in own.values()) / total * p_low(g[1:], 4)

    u = padded(text)
    return sum(np.log(p(g, 1) / p(g, 0)) for g in u) / len(u)


def test_ratio_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    words = ["ana", "banana", "nab", "cab", "\u4e2d\u6587", "abba", "z"]
    rows = [(i, " ".join(rng.choice(words, 8 + i % 5, p=np.roll([.3, .2, .15, .15, .1, .05, .05], i % 2 * 3))), i % 2) for i in range(60)]
    rows += [(100 + i, " ".join(rng.choice(words + ["unseen", "bzz"], 6)), None) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learn = F.col("doc_id") < 60
    fitted = kneser_ney.fit(docs.drop("toxic"), docs.drop("text"), learn, "toxic")
    sample = kneser_ney.label_sample(docs.drop("text"), learn, "toxic", kneser_ney.LEARN_ROWS).withColumn(
        "link", F.pmod(F.xxhash64("key", F.lit("link")), F.lit(kneser_ney.LINK_ONE_IN)) == 0)
    text = {i: t for i, t, _ in rows}
    learned = [(text[r.key], r.label) for r in sample.where("NOT link").collect()]
    got = kneser_ney._ratios(docs.select(F.col("doc_id").alias("key"), "text"), fitted, "key", "bigint").collect()
    for r in got:
        assert abs(r.ratio - _brute_ratio(text[r.key], learned, list(text.values()))) < 1e-9


def test_tables_hold_only_what_the_sample_can_reach(spark):
    """Documents unlike the learning texts add their first units, which follow a border,
    and single units, not their thousands of other grams."""
    rows = [(i, ["good fine kind", "bad vile mean"][i % 2], i % 2) for i in range(40)]
    schema, rng = "doc_id long, text string, toxic int", np.random.default_rng(9)
    han = [(1000 + i, "".join(chr(0x4E00 + c) for c in rng.integers(0, 5000, 300)), None) for i in range(100)]
    sizes = []
    for all_rows in (rows, rows + han):
        docs = spark.createDataFrame(all_rows, schema)
        model = kneser_ney.fit(docs.drop("toxic"), docs.drop("text"), F.col("doc_id") < 40, "toxic").tables.value
        sizes.append([len(t) for t in model.lower])
    assert all(b <= a + len(han) for a, b in zip(sizes[0][1:], sizes[1][1:], strict=True)) and sizes[1][0] > sizes[0][0] + 4000
