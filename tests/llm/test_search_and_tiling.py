from __future__ import annotations

import random
import re

import numpy as np
import pytest

from ledgerloom.llm import keys, string_tiling, vptree
from tests.llm import frames

SF = "/root/testdata/sf0.1"


def _exact(ids, vectors, query, k):
    """Nearest first, ties to the smaller id."""
    v, q = vectors.astype(float), vectors[list(ids).index(query)].astype(float)
    score = vptree.cosine(np.broadcast_to(q, v.shape), v)
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != query][:k]
    return [(int(ids[i]), float(score[i])) for i in order]


def test_factor_one_is_exact_and_production_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float32)
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = vptree.nearest(df, lambda i: i % 50 == 0, k=5, factor=1.0).collect()
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.score)
    assert set(by_query) == {int(i) for i in ids if i % 50 == 0}
    for q, found in by_query.items():
        want = _exact(ids, vectors, q, 5)
        assert [found[k][0] for k in range(1, 6)] == [i for i, _ in want]
        assert [found[k][1] for k in range(1, 6)] == pytest.approx([s for _, s in want], abs=1e-12)
    near = {}
    for r in keys.QUERIES["op2_vantage_point_search"](spark, SF).collect():
        near.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(near[q] & {i for i, _ in found.values()}) / 5 for q, found in by_query.items()]) >= 0.9


def test_search_on_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 20)
    monkeypatch.setattr(vptree, "BLOCK_ROWS", 3)
    monkeypatch.setattr(vptree, "LEAF", 4)
    rng = np.random.default_rng(0)
    good = [(i, rng.normal(size=4).round(1).tolist(), "x") for i in range(100) if i % 7]
    good += [(1000 + i, [1.0, 0.0, 0.0, 0.0], "copy") for i in range(60)]  # a hot vector
    good += [(2000, [1e200, 1e200, 0.0, 0.0], "large"), (2050, [5e-320, 0.0, 0.0, 0.0], "small"), (3000, [1.0, 2.0], "short")]
    bad = [(0, None, "x"), (50, [0.0] * 4, "x"), (150, [1.0, None, 0.0, 0.0], "x"), (200, [float("nan")] * 4, "x"),
           (250, [float("inf"), 0.0, 0.0, 0.0], "x"), (None, [1.0, 1.0, 1.0, 1.0], "x"), (300, [], "x")]
    df = spark.createDataFrame(good + bad + good[:5], "vec_id long, embedding array<double>, shard string")
    got = {}
    for r in vptree.nearest(df, lambda i: i % 50 == 0, k=5, factor=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    same = [(i, v) for i, v, _ in good if len(v) == 4]
    ids, vectors = np.array([i for i, _ in same]), np.array([v for _, v in same])
    unit = vptree._unit(vectors)
    for q in [i for i, v, _ in good if i % 50 == 0 and len(v) == 4]:
        score = np.round(unit @ unit[list(ids).index(q)], 12)
        want = [int(ids[i]) for i in np.lexsort((ids, -score)) if ids[i] != q][:5]
        assert [i for _, i in sorted(got[q])] == want
    assert 3000 not in got  # no other vector of its length
    assert set(got) == {i for i, v, _ in good if i % 50 == 0 and len(v) == 4}
    assert vptree.nearest(df.limit(0), lambda i: i % 50 == 0).count() == 0


def _tile(p, t, k):
    """Greedy string tiling by looking at every pair of positions."""
    mp, mt, tiles = [False] * len(p), [False] * len(t), []
    while True:
        best = (k - 1, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not mp[i + n] and not mt[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return sorted(tiles)
        tiles.append((i, j, n))
        mp[i:i + n], mt[j:j + n] = [True] * n, [True] * n


def test_tiling_equals_brute_force():
    rng = random.Random(9)
    for _ in range(150):
        p = [rng.randrange(4) for _ in range(rng.randrange(25))]
        t = [rng.randrange(4) for _ in range(rng.randrange(30))]
        hits = [(i, j) for i in range(len(p) - 1) for j in range(len(t) - 1) if p[i:i + 2] == t[j:j + 2]]
        runs = string_tiling.common_runs(np.array([i for i, _ in hits], int), np.array([j for _, j in hits], int), 2) if hits else []
        got, want = string_tiling.tiles(runs, 2), _tile(p, t, 2)
        assert sorted(n for *_, n in got)[-1:] == sorted(n for *_, n in want)[-1:]
        assert sum(n for *_, n in got) == sum(n for *_, n in want)
        assert all(p[i:i + n] == t[j:j + n] for i, j, n in got)


ITEMS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu."),
    (2, "one two three"), (3, None), (4, ""), (None, "red orange yellow green blue indigo violet black white grey"),
    (5, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu."),
]
DOCS = [
    (1, "x y z alpha, BETA gamma delta epsilon zeta eta theta iota kappa lambda mu x"),                # whole
    (2, "eta theta iota kappa lambda mu and then alpha beta gamma delta epsilon zeta"),                # reordered
    (3, "alpha beta gamma delta epsilon and nothing else of it"),                                      # under half
    (4, "alpha beta q gamma delta q epsilon zeta q eta theta q iota kappa q lambda mu"),               # too broken up
    (5, "one two three"), (6, None), (7, ""), (None, "alpha beta gamma delta epsilon zeta eta"),
    (8, "red orange yellow green blue indigo violet " * 3), (8, "clean"),
]


def test_leaks(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "'x' AS row", "1 AS key", "2 AS item")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = None
    for size in (1 << 24, 40):  # one block, several blocks
        monkeypatch.setattr(string_tiling, "BLOCK_BYTES", size)
        rows = string_tiling.find_leaks(docs, items).collect()
        found = sorted(((r.doc_id, r.item_id, r.n_tokens, r.covered, r.n_tiles) for r in rows), key=repr)
        assert got is None or got == found
        got = found
        kept = string_tiling.keep_clean(docs, items)
        assert kept.columns == docs.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "5", "6", "7", "8"]
    assert got == sorted([(1, 1, 12, 12, 1), (1, 5, 12, 12, 1), (2, 1, 12, 12, 2), (2, 5, 12, 12, 2), (None, 1, 12, 7, 1),
                          (None, 5, 12, 7, 1), (8, None, 10, 7, 1)], key=repr)
    assert string_tiling.find_leaks(docs, items.limit(0)).count() == 0
    assert string_tiling.keep_clean(docs, items.limit(0)).count() == len(DOCS)
    assert string_tiling.find_leaks(docs.limit(0), items).count() == 0
    assert string_tiling.find_leaks(frames.awkward(spark), items).count() == 0


def test_registered_leaks_equal_brute_force(spark):
    token = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
    cut = lambda t: [w.lower() if w.isascii() else w for w in token.findall(t)]
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    docs = {r.doc_id: cut(low(r.text)) for r in frames.documents(spark).select("doc_id", "text").collect()}
    items = {r.item_id: cut(low(r.text)) for r in spark.read.parquet(f"{frames.SF}/benchmark.parquet").collect()}
    by_gram = {}
    for i, w in items.items():
        for p in range(len(w) - 4):
            by_gram.setdefault(tuple(w[p:p + 5]), set()).add(i)
    want = set()
    for d, w in docs.items():
        near = set().union(*(by_gram.get(tuple(w[p:p + 5]), set()) for p in range(len(w) - 4)))
        for i in near:
            if len(w) * len(items[i]) < 40_000 and sum(n for *_, n in _tile(items[i], w, 5)) >= 0.5 * len(items[i]):
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in keys.QUERIES["op8_string_tiling"](spark, frames.SF).collect()}
    assert want <= got and {p for p in got if len(docs[p[0]]) * len(items[p[1]]) < 40_000} == want and want


def test_rows_with_one_id_and_ties_everywhere(spark):
    """Both rows of an id are candidates; distances that all tie do not make a deep tree."""
    rows = [(50, [1.0, 0.0]), (7, [0.0, 1.0]), (7, [1.0, 0.01]), (9, [-1.0, 0.0]), (100, [0.0, 1.0]), (100, [1.0, 1.0])]
    df = spark.createDataFrame(rows + rows[:2], "vec_id long, embedding array<double>")
    got = {}
    for r in vptree.nearest(df, lambda i: i % 50 == 0, k=3, factor=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {50: [7, 100, 7], 100: [7, 7, 9]}

    n = 1100  # each vector has one near partner, all others are equally far
    v = np.zeros((2 * n, n + 1))
    v[np.arange(2 * n), np.arange(2 * n) // 2] = 1.0
    v[1::2, n] = 0.05
    q, i, _ = vptree.search_shard(np.arange(2 * n), v, np.arange(0, 2 * n, 50), v[::50], 1, 1.0)
    assert q.tolist() == list(range(0, 2 * n, 50)) and (i == q + 1).all()
    assert _depth(vptree.Tree(vptree._unit(v)).root) < 8


def _depth(node):
    return 0 if isinstance(node, np.ndarray) else 1 + max(_depth(node[2]), _depth(node[3]))


UNSPACED = [
    "光合作用是植物利用光能把二氧化碳和水转化为有机物的过程。这个过程释放氧气，维持大气平衡。",
    "富士山は日本で一番高い山です。「毎年」多くの人が登ります。頂上からの眺めは素晴らしい！",
    "ภาษาไทยเขียนโดยไม่เว้นวรรคระหว่างคำ ผู้อ่านต้องรู้จักคำ",
    "Straße—Übung–Größe «naïve» élève déjà vu пример текста без повторов",
]


def test_leaks_without_ascii_spaces(spark):
    items = spark.createDataFrame(list(enumerate(UNSPACED)), "item_id long, text string")
    clean = "另一篇完全不同的文章，讲述城市交通和天气。" * 3 + "東京の天気は晴れです。" + "สภาพอากาศวันนี้ดีมาก"
    docs = [(10 + i, f"前文没有关系。{t}后面也没有关系。") for i, t in enumerate(UNSPACED)] + [(99, clean), (98, "word " * 50)]
    docs += [(50, UNSPACED[0][22:] + "插入一些别的内容" + UNSPACED[0][:22])]  # reordered
    docs += [(60, UNSPACED[3].replace("—", " ").replace("–", ", ").replace(" ", " ").replace(" ", "\n"))]
    found = string_tiling.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(10, 0), (11, 1), (12, 2), (13, 3), (50, 0), (60, 3)]


def test_one_phrase_in_all_items_and_often_in_a_text(monkeypatch):
    """Pairs of places are looked up only where an item can be covered."""
    phrase = "one phrase that all share "
    items = [phrase + " ".join(f"w{i}x{j}" for j in range(12)) for i in range(20_000)]
    data, offsets = _bytes(items)
    tokens, first, hashes, places = string_tiling._tokens(data, offsets, 5)
    order = np.argsort(hashes, kind="stable")
    known = np.zeros(1 << 22, bool)
    known[(hashes >> np.uint64(42)).astype(np.int64)] = True
    own = np.zeros(len(tokens), np.uint64)
    own[places] = hashes
    seeds = string_tiling.Seeds(list(range(len(items))), tokens, first, hashes[order], places[order], known, own)
    monkeypatch.setattr(string_tiling, "_PAIRS", 50_000)
    text = (phrase + "gap ") * 3000
    found = list(string_tiling.leaks(*_bytes([text, text + items[7], "nothing of it", items[9] + " " + text]), seeds, 5, 0.5))
    assert [(d, i) for d, i, *_ in found] == [(1, 7), (3, 9)]


def _bytes(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
