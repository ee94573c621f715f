"""Learned operators: held-out accuracy, defined results, exactness of parts."""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import keys, kneser_ney, langid, nbsvm
from ledgerloom.llm import vectext as vt
from ledgerloom.llm.shared import remainder
from tests.llm import frames

SF = "/root/testdata/sf0.1"


def _scores(rows):
    return np.array([r.score for r in rows])


def _held_out(spark, query, label, modulus, rest):
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = keys.QUERIES[query](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    return [(r.score, r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]


def test_quality_on_held_out_documents(spark):
    rows = _held_out(spark, "op1_nbsvm_quality", "quality", 5, 0)
    assert np.mean([p == y for _, p, y in rows]) > 0.97


def test_toxicity_on_held_out_documents(spark):
    rows = _held_out(spark, "op3_kneser_ney_toxicity", "toxic", 4, 2)
    assert np.mean([p == y for _, p, y in rows]) > 0.94
    toxic, clean = [s for s, _, y in rows if y], [s for s, _, y in rows if not y]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.9


def test_language_on_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = keys.QUERIES["op9_language_id"](spark, SF).collect()
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]) > 0.99


@pytest.mark.parametrize("module", [nbsvm, kneser_ney])
def test_scores_of_awkward_documents(spark, module):
    docs = frames.clashing(spark)
    for labels in (frames.labels(spark), frames.labels(spark, []), frames.labels(spark, [(1, 1, 1), (2, 1, 1)])):
        for label in ("quality", "toxic"):
            model = module.fit(docs, labels, remainder(5) != 99, label)
            rows = module.score(docs, model).collect()
            assert len(rows) == len(frames.ROWS) and all(0 <= r.score <= 1 for r in rows)
            scores = {r.doc_id: r.score for r in rows}
            assert math.isclose(scores[4], scores[5], rel_tol=1e-9)  # null text scores like the empty one
            assert module.score(frames.empty(spark), model).count() == 0
    nothing = module.fit(docs, frames.labels(spark, []), remainder(5) != 99, "quality")
    assert np.allclose(_scores(module.score(docs, nothing).collect()), 0.5)
    module.fit(frames.empty(spark), frames.labels(spark), remainder(5) != 99, "quality")


def test_dual_descent_solves_the_hinge_problem():
    rng = np.random.default_rng(1)
    rows = [(int(i % 3 == 0), np.unique(rng.integers(0, 60, 12) + 20 * (i % 3 == 0))) for i in range(240)]
    scale = rng.normal(size=nbsvm.BUCKETS)
    w = nbsvm.dual_descent(rows, scale)
    y = np.array([1 if label else -1 for label, _ in rows])
    x = np.zeros((len(rows), 81))
    for i, (_, slots) in enumerate(rows):
        x[i, slots] = scale[slots] / np.linalg.norm(scale[slots])
    x[:, 80] = 1
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    primal = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    found = np.append(w[:80], w[-1])
    best = primal(found)
    for scale_ in (1e-3, 1e-2, 1e-1):  # no better point nearby
        for _ in range(200):
            assert primal(found + rng.normal(size=81) * scale_) >= best - 0.02 * best


def test_repeated_words_share_their_features():
    def slots(text):
        data, offsets = vt.column_bytes(pa.array([text]))
        return set(nbsvm.features(data, offsets)[1].tolist())
    one, two = slots("foo foo foo foo"), slots("bar bar bar bar")
    assert len(one) == 4 and len(one & two) == 2  # the marker and the pair of markers


def _texts(texts):
    data, offsets = vt.column_bytes(pa.array(texts))
    return data, offsets


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(4)
    alphabet = "abcdefghij "
    texts = ["".join(rng.choice(list(alphabet), rng.integers(0, 22))) for _ in range(150)]
    batch = langid.words(*_texts(texts))
    known = np.unique(batch.grams)[::2]
    model = langid.Model(["de", "en", "fr"], langid.GramTable(known), rng.normal(size=(3, len(known) + 1)).astype(np.float32),
                         np.ones((3, len(langid.NAMES)), bool))
    scores = model.word_scores(batch)
    for switch in (0.5, 2.0, 6.0):
        path = model.paths(batch, switch)
        for i in range(len(texts)):
            a, b = batch.text_first[i], batch.text_first[i + 1]
            if not 0 < b - a <= 7:
                continue
            total = lambda p: sum(scores[a + t, k] for t, k in enumerate(p)) - switch * sum(x != y for x, y in zip(p, p[1:]))
            best = max(total(p) for p in itertools.product(range(3), repeat=int(b - a)))
            assert total(path[a:b].tolist()) == pytest.approx(best, abs=1e-6)


def test_language_of_awkward_documents_and_spans(spark):
    docs = frames.clashing(spark)
    learn = ~F.col("doc_id").isin(8, 9)  # few words fill the long text
    model = langid.fit(docs, learn)
    assert model.languages == ["de", "en", "ja"]
    rows = {(r.doc_id, i): r for i, r in enumerate(langid.label(docs, model, spans=True).collect())}
    by_id = {k[0]: r for k, r in rows.items()}
    assert len(rows) == len(frames.ROWS)
    for i in (4, 5, 6, 7):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].spans) == ("und", 0.0, [])
    assert by_id[3].lang_pred == "de" and by_id[11].lang_pred == "ja" and by_id[1].lang_pred == "en"
    text = "the quick brown fox jumps over the lazy dog. der schnelle braune fuchs springt über den hund. 日本語のテキストです"
    mixed = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = langid.label(mixed, model, spans=True, switch=2.0).first().spans
    assert [s.lang for s in spans] == ["en", "de", "ja"]
    assert text[spans[1].start:spans[1].start + spans[1].length].startswith("der schnelle")
    assert langid.label(frames.empty(spark), model).count() == 0
    nothing = langid.fit(frames.empty(spark), learn)
    assert {r.lang_pred for r in langid.label(docs, nothing).collect()} == {"und"}
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns
    assert not {4, 5, 6, 7} & {r[0] for r in kept.collect()} and kept.count() == len(frames.ROWS) - 4


def test_kneser_ney_lower_orders_sum_to_one(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["ab abc abd", "bca cab abc", "ddd abcd dcba"] * 3)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(9)], "doc_id long, quality int, toxic int")
    tables = kneser_ney.fit(docs, labels, remainder(5) != 99, "toxic").tables.value
    code = lambda s: sum((ord(c) + 2 if c != "_" else kneser_ney._EDGE) << (kneser_ney.BITS * k) for k, c in enumerate(reversed(s)))
    at = lambda table, gram, order: table[np.array([gram], np.uint64)][0]
    for context in ("", "_", "_a", "_ab", "abc"):
        total = 0.0
        for x, times in (*((x, 1) for x in "abcd_"), (None, (1 << kneser_ney.BITS) - 5)):  # the last: all symbols never seen
            p = 1 / (1 << kneser_ney.BITS)
            for order in range(1, min(kneser_ney.ORDER, len(context) + 2)):
                before = context[len(context) - order + 1:] if order > 1 else ""
                t, f = at(tables.contexts[order - 1], code(before), order + 100)
                n = at(tables.lower[order - 1], code(before + x), order)[0] if x else 0
                p = (max(n - kneser_ney.DISCOUNT, 0) + kneser_ney.DISCOUNT * f * p) / t if t else p
            total += times * p
        assert total == pytest.approx(1, abs=0.02)
