from __future__ import annotations

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import fuzzy_lines, langid, piece_fst, simhash, string_tiling, vectext
from ledgerloom.llm.shared import read, remainder, written
from tests.llm import frames

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_follow_the_operators(spark):
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "sentencepiece"]
    docs = read(spark, frames.SF, "documents")
    for name, stage in cp.STAGES:
        out = written(stage(spark, docs, frames.SF), "test-stage")
        if name == "language_id":
            model = langid.fit(docs, remainder(3) != 1)
            want = {r.doc_id for r in langid.label(docs, model).where("lang_pred <> 'und' AND score >= 0.5").collect()}
        elif name == "line_dedup":
            want = {r.doc_id for r in docs.collect()}
            gone = fuzzy_lines.drop_lines(docs).select("doc_id", "text").collect()
            assert {r.doc_id: r.text for r in gone} == {r.doc_id: r.text for r in out.collect()}
            assert out.where(F.col("n_chars") != F.length("text")).isEmpty()
        elif name == "simhash_near_dedup":
            groups = simhash.near_duplicates(docs).collect()
            want = {r.doc_id for r in groups if r.doc_id == r.component_id}
        elif name == "decontamination":
            leaks = {r.doc_id for r in string_tiling.find_leaks(docs, read(spark, frames.SF, "benchmark")).collect()}
            want = {r.doc_id for r in docs.collect()} - leaks
            assert leaks
        else:
            want = {r.doc_id for r in docs.collect()}
            assert out.where("NOT same").isEmpty()
        assert {r.doc_id for r in out.select("doc_id").collect()} == want, name
        if name != "sentencepiece":
            assert out.columns == COLUMNS
            docs = out
    assert cp.run(spark, frames.SF).count() == out.count()


@pytest.mark.parametrize("frame", [frames.awkward, frames.clashing, frames.empty])
def test_stages_on_awkward_documents(spark, frame):
    docs = frame(spark)
    for name, stage in cp.STAGES:
        out = written(stage(spark, docs, frames.SF), "test-stage")
        if name != "sentencepiece":
            assert out.columns == docs.columns
            docs = out
    assert out.columns == ["doc_id", "ids", "same"]


def test_token_hashes_are_pure(spark):
    import numpy as np
    import pyarrow as pa

    texts = ["one two  three", "two", None, "", " three\x0bone ", "über ZWEI two"]
    data, offsets = vectext.column_bytes(pa.array(texts))
    starts, ends, first = vectext.runs(data, offsets, vectext.BLANK)
    words = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    assert words == " ".join(t or "" for t in texts).split() and np.diff(first).tolist() == [3, 1, 0, 0, 2, 3]
    h = vectext.hash_runs(data, starts, ends)
    assert len(set(h.tolist())) == len(set(words)) and h[1] == h[3] == h[8] and h[0] == h[5]
    for k in (1, 2, 3, 5, 7):
        r = vectext.rolling(h, k)
        grams = [tuple(words[i:i + k]) for i in range(len(words) - k + 1)]
        assert len(r) == len(grams) and len(set(r.tolist())) == len(set(grams))
    assert piece_fst.SPACE == "▁"
