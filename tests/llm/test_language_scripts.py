"""Languages that do not write a script never win its words, however long."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.llm import langid
from ledgerloom.llm import vectext as vt
from ledgerloom.llm.charwords import NAMES


def test_long_runs_stay_with_languages_that_write_them():
    claims = np.zeros((2, len(NAMES)), bool)
    claims[0, NAMES.index("latin")] = claims[1, NAMES.index("han")] = True
    model = langid.Model(["en", "zh"], langid.GramTable(np.zeros(0, np.uint64)), np.full((2, 1), -15.0, np.float32), claims)
    texts = ["\u4e2d\u6587" * n for n in (5, 400, 1000, 50_000)]
    lang, score, _ = model.predict(langid.words(*vt.column_bytes(pa.array(texts))), langid.SWITCH)
    assert lang.tolist() == [1] * len(texts) and (score == 1).all()


def test_gram_table_equals_a_dictionary():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) >> rng.integers(0, 60, 5000, dtype=np.uint64))
    table = langid.GramTable(keys)
    rows = {int(k): i for i, k in enumerate(keys)}
    asked = np.concatenate([keys[::-1], keys + np.uint64(1), rng.integers(0, 1 << 63, 3000, dtype=np.uint64)])
    assert table.find(asked).tolist() == [rows.get(int(k), len(keys)) for k in asked]
    assert langid.GramTable(keys[:0]).find(keys).tolist() == [0] * len(keys)


def test_keys_tell_all_grams_apart():
    letters = "abcxyz\u00e9\u4e2d\u6587\uac00\U00020000\U00020001\U00010400"
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list(letters + " "), 400)) for _ in range(40)]
    batch = langid.words(*vt.column_bytes(pa.array(texts)))
    grams = []
    for text in texts:
        for word in text.lower().split():
            grams += [("\0" * 3 + word)[i:i + 4] for i in range(len(word))]
    assert len(grams) == len(batch.grams)
    assert len(set(zip(grams, batch.grams.tolist(), strict=True))) == len(set(grams)) == len(set(batch.grams.tolist()))


def test_unlike_documents_change_no_score_but_by_smoothing(spark):
    near = [(i, f"the small boat number{i % 7} sails over the water", "en") for i in range(40)]
    near += [(100 + i, f"das kleine boot nummer{i % 7} segelt auf dem wasser", "de") for i in range(40)]
    rng = np.random.default_rng(5)
    han = [(1000 + i, "".join(chr(0x4E00 + c) for c in rng.integers(0, 20000, 400)), "zh") for i in range(300)]
    schema, texts = "doc_id long, text string, lang string", pa.array(["the boat sails", "das boot segelt", "water nummer"])
    few, many = (langid.fit(spark.createDataFrame(rows, schema), F.lit(True)) for rows in (near, near + han))
    assert len(many.table.keys) > 1 << 18  # more grams than the old table had places
    batch = langid.words(*vt.column_bytes(texts))
    a, b = few.word_scores(batch), many.word_scores(batch)[:, :2]
    assert np.abs((a[:, 0] - a[:, 1]) - (b[:, 0] - b[:, 1])).max() < 0.5
    assert few.predict(batch, langid.SWITCH)[0][:2].tolist() == many.predict(batch, langid.SWITCH)[0][:2].tolist() == [1, 0]


def test_counts_equal_brute_force(spark):
    rows = [(i, " ".join(f"w{chr(97 + (i * k) % 26)}{chr(97 + k % 26)}x" for k in range(60)), ["en", "de", None][i % 3]) for i in range(60)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), F.lit(True))
    counts: dict = {}
    for _, text, lang in rows:
        for word in text.split() if lang else []:
            word = "".join(c for c in word if c.isalpha())
            for i in range(len(word)):
                g = ("\0" * 3 + word)[i:i + 4]
                counts.setdefault(lang, {}).setdefault(g, 0)
                counts[lang][g] += 1
    assert model.languages == ["de", "en"]
    seen = set(counts["de"]) | set(counts["en"])
    for k, lang in enumerate(model.languages):
        total = sum(counts[lang].values()) + langid.ALPHA * len(seen)
        for g in seen:
            # the key of the gram that ends a word of its letters
            key = langid.words(*vt.column_bytes(pa.array([g.strip("\0")]))).grams[-1:]
            want = np.log(counts[lang].get(g, 0) + langid.ALPHA) - np.log(total)
            assert abs(model.grams[k, model.table.find(key)[0]] - want) < 1e-4
