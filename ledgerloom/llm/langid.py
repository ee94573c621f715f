"""Language identification with spans.

Words are runs of letters (lower-cased). Per-word scores are log-likelihoods
of the word's character 4-grams (with a word boundary before it) under each
language, smoothed; counts come from all learning documents. Grams are told apart
by a 64-bit key (their four letters; hashed only where a letter lies beyond the
first plane), so unlike grams never add up, and the tables grow with the distinct
grams of the learning documents, which are collected and broadcast. The script of a word (by Unicode range) narrows the
languages that may claim it to those that write it in the learning rows. A
Viterbi pass over the words, with a penalty for each change of language,
labels the spans of a text; the predicted language is the one with most
letters, the score its share of all letters.

The pass is vectorised over texts. A text in which no run of words gains more
than the penalty by leaving the best single language has that language as its
optimal path, exactly; only the others need the word-by-word recursion.

Defined results: null text, or no letter: ``und`` with score 0; ties go to the
language that is first in alphabetical order; null langs are not learned from;
nothing to learn from: ``und`` everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import vectext as vt
from ledgerloom.llm.charwords import NAMES, letter_words
from ledgerloom.llm.shared import filter_texts

GRAM = 4
ALPHA = 0.5
SWITCH = 14.0
#: A language claims the words of a script that has this share of its letters.
SCRIPT_SHARE = 0.01
MAX_LANGUAGES = 512
#: Rows of counts that a learning task holds before it sums them.
_FLUSH = 1 << 20
#: Score of a word for a language that does not write its script, and of each of
#: its letters on top: less than a letter gets in any language that writes it.
_OUT, _OUT_LETTER = -1e4, -1e2


_U = np.uint64


@dataclass
class _Batch:
    """Words of some texts: letters with their grams, words, texts."""
    grams: np.ndarray       # key of the gram that ends at each letter
    word_first: np.ndarray  # first letter of each word
    word_len: np.ndarray
    word_start: np.ndarray  # code point at which it starts in its text
    script: np.ndarray      # of each word
    text_first: np.ndarray  # first word of each text (n + 1)


def words(data: np.ndarray, offsets: np.ndarray) -> _Batch:
    w = letter_words(data, offsets)
    low, inside = w.letters.astype(_U), w.inside
    key, wide = low.copy(), low > _U(0xFFFF)
    other = wide.any()
    far, above = vt.mix(low) if other else None, wide.copy()
    for back in range(1, GRAM):  # letters before the word's first count as the boundary, 0
        before = np.zeros_like(low)
        before[back:] = low[:len(low) - back]
        before[inside < back] = 0
        key |= before << _U(16 * back)
        if other:
            above |= before > _U(0xFFFF)
            far = vt.mix(far + before + _U(back))
    if other:
        key[above] = far[above]
    return _Batch(key, w.first, w.lens, w.starts, w.scripts, w.text_first)


class GramTable:
    """Row numbers by key: open addressing, at most a quarter full."""

    def __init__(self, keys: np.ndarray):
        self.none = len(keys)  # the row of a key that is not there
        size = 1 << max(4, (4 * len(keys)).bit_length())
        self.mask = _U(size - 1)
        self.keys, self.rows = np.zeros(size, _U), np.full(size, self.none, np.int32)
        left, at = np.arange(len(keys)), vt.mix(keys) & self.mask
        while len(left):
            free = self.rows[at] == self.none
            self.rows[at[free]] = left[free]  # of several that want a place, one gets it
            got = self.rows[at] == left
            self.keys[at[got]] = keys[left[got]]
            left, at = left[~got], (at[~got] + _U(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = vt.mix(keys) & self.mask
        out = self.rows[at]
        miss = np.flatnonzero((out != self.none) & (self.keys[at] != keys))
        at = at[miss]
        while len(miss):
            at = (at + _U(1)) & self.mask
            out[miss] = self.rows[at]
            on = (out[miss] != self.none) & (self.keys[at] != keys[miss])
            miss, at = miss[on], at[on]
        return out


@dataclass
class Model:
    languages: list[str]
    table: GramTable
    grams: np.ndarray    # languages x grams (the last: any other gram) log-probabilities
    claims: np.ndarray   # languages x scripts

    def word_scores(self, b: _Batch) -> np.ndarray:
        """words x languages; languages that do not write the word's script are out."""
        out = np.empty((len(b.word_len), len(self.languages)))
        rows = self.table.find(b.grams)
        for k in range(len(self.languages)):
            out[:, k] = np.add.reduceat(self.grams[k][rows], b.word_first) if len(b.word_len) else 0
        claim = self.claims[:, b.script].T
        claim = claim | ~claim.any(axis=1, keepdims=True)  # a script nobody learned: all languages stay
        return np.where(claim, out, _OUT + _OUT_LETTER * b.word_len[:, None])

    def paths(self, b: _Batch, switch: float) -> np.ndarray:
        """Language number of each word on the best path of its text."""
        s, first = self.word_scores(b), b.text_first
        n_words = np.diff(first)
        some = np.flatnonzero(n_words)
        path = np.zeros(len(s), np.int64)
        if not len(some) or len(self.languages) < 2:
            return path
        total = np.add.reduceat(s, first[some], axis=0)
        best = total.argmax(axis=1)
        path[:] = np.repeat(best, n_words[some])
        mixed = self._may_gain(s, path, first, some, switch)
        for block in np.array_split(mixed, max(1, len(mixed) // 512)):
            if len(block):
                self._viterbi(s, first, block, switch, path)
        return path

    def _may_gain(self, s, path, first, some, switch):
        """Texts in which leaving the best language may pay. A departure is a run
        of words that all leave it and costs at least one switch."""
        own = s[np.arange(len(s)), path]
        others = s.copy()
        others[np.arange(len(s)), path] = -np.inf
        gain = others.max(axis=1) - own
        # Kadane over all texts at once: running sums restart at each text
        run = np.cumsum(np.maximum(gain, -1e5))
        n = np.diff(first)[some]
        before = np.concatenate([[0.0], run])[first[some]]
        run = run - np.repeat(before, n)
        # lowest earlier sum inside the text: an offset per text keeps the minimum from crossing
        depth = np.abs(run).max(initial=0) + 1.0
        level = -2.0 * depth * np.repeat(np.arange(len(some)), n)
        earlier = np.concatenate([[0.0], run[:-1]])
        earlier[first[some]] = 0.0
        low = np.minimum.accumulate(earlier + level) - level
        top = np.maximum.reduceat(run - low, first[some])
        return some[top > switch - 1e-6]

    def _viterbi(self, s, first, texts, switch, path):
        """Word-by-word recursion, all ``texts`` in step."""
        n = first[texts + 1] - first[texts]
        texts, n = texts[np.argsort(-n, kind="stable")], np.sort(n)[::-1]
        start, steps, langs = first[texts], int(n[0]), s.shape[1]
        alive = np.searchsorted(-n, -np.arange(steps), side="left")  # texts longer than t
        v = s[start].copy()
        back = [None]
        for t in range(1, steps):
            k = int(alive[t])
            top = v[:k].argmax(axis=1)
            jump = v[np.arange(k), top] - switch
            stay = v[:k] >= jump[:, None]
            back.append(np.where(stay, np.arange(langs), top[:, None]).astype(np.int16))
            v[:k] = np.where(stay, v[:k], jump[:, None]) + s[start[:k] + t]
        now = v.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            k = int(alive[t])
            path[start[:k] + t] = now[:k]
            if t:
                now[:k] = back[t][np.arange(k), now[:k]]

    def predict(self, b: _Batch, switch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: language number (-1: und), score; and the path of all words."""
        path = self.paths(b, switch)
        n = len(b.text_first) - 1
        text = np.repeat(np.arange(n), np.diff(b.text_first))
        letters = np.zeros((n, len(self.languages)))
        np.add.at(letters, (text, path), b.word_len)
        total = letters.sum(axis=1)
        lang = np.where(total > 0, letters.argmax(axis=1), -1)
        return lang, letters.max(axis=1) / np.where(total > 0, total, 1), path


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang") -> Model:
    """Counts of the rows where ``learn`` holds and ``lang`` is known, over whole texts."""
    rows = docs.where(learn & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text"))
    n_scripts = len(NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        scripts: dict[str, np.ndarray] = {}

        def out(name: str, number: np.ndarray | None, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            # a row counts a gram, or the letters of a script (``script`` is not null)
            script = pa.nulls(len(key), pa.int32()) if number is None else pa.array(number.astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array([name] * len(key), pa.string()), script, pa.array(key.view(np.int64)), pa.array(n)],
                                              ["lang", "script", "gram", "n"])

        def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            key, number = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return key, np.bincount(number, np.concatenate([n for _, n in parts]), len(key)).astype(np.int64)

        for b in batches:
            data, offsets = vt.column_bytes(b.column(1))
            langs = b.column(0).to_pylist()
            for lo, hi in vt.pieces(offsets):
                w = words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                names, number = np.unique(np.array(langs[lo:hi], dtype=object).astype(str), return_inverse=True)
                of_word = np.repeat(number, np.diff(w.text_first))
                of_letter = np.repeat(of_word, w.word_len)
                for k, name in enumerate(names.tolist()):
                    key, n = np.unique(w.grams[of_letter == k], return_counts=True)
                    grams.setdefault(name, []).append((key, n))
                    mine = of_word == k
                    letters = np.bincount(w.script[mine], w.word_len[mine], n_scripts).astype(np.int64)
                    scripts[name] = scripts.get(name, 0) + letters
                if sum(len(key) for parts in grams.values() for key, _ in parts) > _FLUSH:
                    for name, parts in grams.items():
                        parts[:] = [summed(parts)]
                    if sum(len(parts[0][0]) for parts in grams.values()) > _FLUSH // 2:
                        for name, parts in grams.items():
                            yield out(name, None, *parts[0])
                        grams.clear()
        for name, parts in grams.items():
            yield out(name, None, *summed(parts))
        for name, letters in scripts.items():
            yield out(name, np.arange(n_scripts), np.zeros(n_scripts, _U), letters)

    summed = (rows.mapInArrow(count, "lang string, script int, gram long, n long")
              .groupBy("lang", "script", "gram").agg(F.sum("n").alias("n")).where("n > 0"))
    found = summed.toArrow()  # grows with the distinct grams
    names = sorted(set(found["lang"].unique().to_pylist()))
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"{len(names)} languages; a model holds {MAX_LANGUAGES}")
    codes = found["lang"].combine_chunks().dictionary_encode()
    place = np.array([names.index(x) for x in codes.dictionary.to_pylist()], np.int64)
    number = place[codes.indices.to_numpy()] if len(found) else np.zeros(0, np.int64)
    n, script = found["n"].to_numpy(), found["script"].fill_null(-1).to_numpy()
    scripts = np.zeros((len(names), n_scripts))
    scripts[number[script >= 0], script[script >= 0]] = n[script >= 0]
    of = script < 0
    keys, row = np.unique(found["gram"].to_numpy()[of].astype(np.int64).view(_U), return_inverse=True)
    grams = np.zeros((len(names), len(keys) + 1), np.float32)
    grams[number[of], row] = n[of]
    totals = grams.sum(axis=1, dtype=np.float64, keepdims=True) + ALPHA * max(1, len(keys))
    logp = np.log(grams + ALPHA) - np.log(totals)
    share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return Model(names, GramTable(keys), logp.astype(np.float32), share >= SCRIPT_SHARE)


def label(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", switch: float = SWITCH,
          spans: bool = False) -> DataFrame:
    """(key, lang_pred, score) of every row; with ``spans`` also the spans, as
    (start, length in code points up to the last letter, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("lang", pa.string())]))
    names = ["key", "lang_pred", "score", "spans"][:4 if spans else 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            data, offsets = vt.column_bytes(b.column(1))
            for lo, hi in vt.pieces(offsets):
                w = words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                if m.languages:
                    lang, score, path = m.predict(w, switch)
                else:
                    lang, score, path = np.full(hi - lo, -1), np.zeros(hi - lo), None
                columns = [b.column(0).slice(lo, hi - lo),
                           pa.array(["und" if k < 0 else m.languages[k] for k in lang.tolist()]), pa.array(score)]
                if spans:
                    columns.append(pa.array([_spans(w, path, i, m.languages) for i in range(hi - lo)], span_type))
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    ddl = f"key {kind}, lang_pred string, score double" + ", spans array<struct<start:long,length:long,lang:string>>" * spans
    return rows.mapInArrow(run, ddl).withColumnRenamed("key", key)


def keep_identified(docs: DataFrame, model: Model, least_share: float = 0.5, text: str = "text",
                    switch: float = SWITCH) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has letters and one
    language with at least ``least_share`` of them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not shared.value.languages:
            return np.zeros(len(offsets) - 1, bool)
        lang, score, _ = shared.value.predict(words(data, offsets), switch)
        return (lang >= 0) & (score >= least_share)

    return filter_texts(docs, text, keep)


def _spans(w: _Batch, path: np.ndarray | None, i: int, languages: list[str]) -> list[dict]:
    a, b = int(w.text_first[i]), int(w.text_first[i + 1])
    if a == b or path is None:
        return []
    cut = [a, *(np.flatnonzero(np.diff(path[a:b])) + a + 1).tolist(), b]
    return [{"start": int(w.word_start[x]), "length": int(w.word_start[y - 1] + w.word_len[y - 1] - w.word_start[x]),
             "lang": languages[int(path[x])]} for x, y in zip(cut, cut[1:], strict=False)]
