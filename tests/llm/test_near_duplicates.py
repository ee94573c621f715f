"""SimHash groups, line dedup, substring dedup and union-find against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import fuzzy_lines, simhash, substring_dedup
from ledgerloom.llm.components import components
from tests.llm import frames

WORD = re.compile("[^\x20\x09-\x0d]+")


class Sets:
    def __init__(self):
        self.parent = {}

    def root(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def _fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    docs = [r for r in frames.ROWS if r[0] not in (8, 9)] + [(50, "ÀB c A b C a B c x", None, None, 0)]
    got = simhash.fingerprints(spark.createDataFrame(docs, frames.SCHEMA), 3).collect()
    assert sorted(r.fp & (2**64 - 1) for r in got) == sorted(_fingerprint(r[1]) for r in docs)


@pytest.mark.parametrize("split", [False, True])
def test_components_of_close_fingerprints(spark, monkeypatch, split):
    rng = random.Random(5)
    fps = {0, 2**64 - 1}
    while len(fps) < 1500:
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(rng.randrange(6)):  # a chain of small steps
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                base ^= 1 << b
            fps.add(base)
    if split:  # hot groups: all share their low half
        monkeypatch.setattr(simhash, "GROUP_ROWS", 40)
        fps = {f & ~0xFFFFFFFF | f >> 60 for f in fps}
    fps = sorted(fps)
    table = np.array(fps, np.uint64)
    want = Sets()
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(table ^ table[i]) <= 3):
            want.join(f, fps[j])
    signed = table.view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 3).collect()
    got = Sets()
    for r in found:
        got.join(r.a & (2**64 - 1), r.b & (2**64 - 1))
    group = lambda s: sorted(sorted(x) for x in _groups(s, fps))
    assert group(got) == group(want)


def _groups(sets, items):
    out = defaultdict(list)
    for x in items:
        out[sets.root(x)].append(x)
    return out.values()


def test_awkward_documents(spark):
    out = simhash.near_duplicates(frames.awkward(spark)).collect()
    assert len(out) == len(frames.ROWS)
    component = {(r.doc_id, r.version): r.component_id for r in out}
    by_id = defaultdict(set)
    for (i, _), c in component.items():
        by_id[i].add(c)
    assert by_id[1] == by_id[2] == {1}
    assert by_id[4] == by_id[5] == by_id[6] == {4}  # no words: linked by fingerprint zero
    assert by_id[None] == {None}
    kept = simhash.keep_first(frames.clashing(spark))
    assert kept.columns == frames.clashing(spark).columns
    ids = sorted((r[0] is None, r[0] or 0) for r in kept.collect())
    assert [i for null, i in ids if not null and i in (1, 2, 4, 5, 6, 10)] == [1, 4, 10, 10, 10]
    assert simhash.near_duplicates(frames.empty(spark)).count() == simhash.keep_first(frames.empty(spark)).count() == 0


def test_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges += [(2000, 2001 + i) for i in range(300)] + [(7, 7), (7, 7)]
    want = Sets()
    for a, b in edges:
        if a != b:
            want.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: want.root(x) for x in list(want.parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _covered(docs, window):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in docs]
    for i, w in words:
        for p in range(len(w) - window + 1):
            k = tuple(w[p:p + window])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p:p + window])] < i:
                gone[p:p + window] = [True] * window
        yield i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()


@pytest.mark.parametrize("window", [2, 5, 8])
def test_substrings_equal_brute_force(spark, monkeypatch, window):
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 700)  # many groups and shards
    rng = random.Random(window)
    passages = [[f"p{k}w{i}" for i in range(rng.randrange(3, 30))] for k in range(12)]
    docs = []
    for i in range(150):
        words = []
        for _ in range(rng.randrange(4)):
            words += rng.choice(passages)[rng.randrange(4):] if rng.random() < 0.5 else [f"u{rng.randrange(40)}" for _ in range(rng.randrange(9))]
        docs.append((rng.choice([i, i, i, rng.randrange(150), None if i % 40 == 0 else i]), rng.choice([" ", "\n", " \t "]).join(words)))
    docs += [(500 + i, docs[3][1]) for i in range(30)] + [(7, None), (8, ""), (600, "z " * 200), (601, "z " * 77)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), window)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, _covered(docs, window)))


def test_substrings_of_awkward_documents(spark):
    got = substring_dedup.remove_repeats(frames.clashing(spark), 50).collect()
    docs = [(r[0], r[1]) for r in frames.ROWS]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, _covered(docs, 50)))
    assert substring_dedup.remove_repeats(frames.empty(spark)).count() == 0


def _shingles(line):
    u = line.encode("utf-16-be")
    n, c = len(u) // 2, fuzzy_lines.SHINGLE
    return frozenset(u[2 * i:2 * i + 2 * c] for i in range(max(n - c + 1, 1)))


def _removed_lines(docs):
    """Brute force: every pair of lines that share a shingle."""
    first, order = {}, sorted((d for d in docs if d[0] is not None), key=lambda d: d[0])
    for i, t in order:
        for pos, line in enumerate((t or "").split("\n") if t is not None else []):
            if line.strip(" \t\r\x0b\x0c"):
                first.setdefault(line, (i, pos))
    lines = list(first)
    sets, found, by = [_shingles(x) for x in lines], Sets(), defaultdict(list)
    for i, s in enumerate(sets):
        found.root(i)
        near = {j for g in s for j in by[g]}
        for j in near:
            both = len(s & sets[j])
            if both >= 0.8 * (len(s) + len(sets[j]) - both):
                found.join(i, j)
        for g in s:
            by[g].append(i)
    least = {}
    for i, line in enumerate(lines):
        r = found.root(i)
        least[r] = min(least.get(r, (1 << 60, 0)), first[line])
    number = {line: i for i, line in enumerate(lines)}
    return lambda i, t: [pos for pos, line in enumerate((t or "").split("\n")) if line in number and i is not None
                         and least[found.root(number[line])] != (i, pos)]


def test_lines_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in frames.documents(spark).select("doc_id", "text").collect()]
    rng = random.Random(3)
    base = [line for _, t in docs for line in t.split("\n") if len(line) > 150][:25]
    for k, line in enumerate(base):  # variants with one or two words changed, and the line without spaces
        for v in range(4):
            words = line.split(" ")
            for _ in range(1 + v % 2):
                words[rng.randrange(len(words))] = f"new{k}x{v}"
            docs.append((10_000 + 10 * k + v, ("" if k % 5 == 0 else " ").join(words)))
    want = _removed_lines(docs)
    got = fuzzy_lines.drop_lines(spark.createDataFrame(docs, "doc_id long, text string"), removed="removed").collect()
    text = dict(docs)
    lost = extra = total = 0
    for r in got:
        expected, found = set(want(r.doc_id, text[r.doc_id])), set(r.removed)
        total, lost, extra = total + len(expected), lost + len(expected - found), extra + len(found - expected)
        assert r.text == "\n".join(x for i, x in enumerate(text[r.doc_id].split("\n")) if i not in found)
    assert extra == 0 and lost <= 0.01 * total, (lost, extra, total)


def _variants(n, words, changed, seed):
    """A line of random words and ``n`` variants of it with some words replaced."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    base = [word() for _ in range(words)]
    lines = [" ".join(base)]
    for _ in range(n):
        line = list(base)
        for i in rng.sample(range(words), changed):
            line[i] = word()
        lines.append(" ".join(line))
    return lines


def test_variants_below_the_similarity_are_not_all_paired(spark, monkeypatch):
    """Every two variants share buckets and pass the sketch, none is linked."""
    lines = _variants(150, 80, 7, 5)
    sets = [_shingles(x) for x in lines]
    assert max(len(s & t) / len(s | t) for i, s in enumerate(sets) for t in sets[:i]) < 0.8
    verified, pairs = fuzzy_lines.verified, []

    def counted(found, texts):
        pairs.append(found.count())
        return verified(found, texts)

    monkeypatch.setattr(fuzzy_lines, "verified", counted)
    docs = spark.createDataFrame([*enumerate(lines)], "doc_id long, text string")
    assert fuzzy_lines.drop_lines(docs).where("text = ''").count() == 0
    assert sum(pairs) <= 6 * len(lines), pairs


def test_links_between_variants_of_an_unlinked_line(spark):
    """Each variant is far from the line with most copies, near one other variant;
    nulls, repeated shingles and short lines beside them."""
    lines = _variants(60, 80, 9, 6)
    docs = [(i, lines[0]) for i in range(5)] + [(10 + i, x) for i, x in enumerate(lines[1:])]
    docs += [(100 + i, x + " end") for i, x in enumerate(lines[1:])]
    docs += [(300 + i, "ab " * (200 + 40 * i)) for i in range(6)] + [(400, "short"), (401, "short."), (402, None), (None, lines[1])]
    want = _removed_lines([d for d in docs if d[0] is not None])
    got = fuzzy_lines.drop_lines(spark.createDataFrame(docs, "doc_id long, text string"), removed="removed").collect()
    text = {i: t for i, t in docs if i is not None}
    assert {r.doc_id: r.removed for r in got if r.doc_id is not None and r.text is not None} == {
        i: want(i, t) for i, t in text.items() if t is not None}
    assert sum(want(100 + i, x + " end") == [0] for i, x in enumerate(lines[1:])) == 60


def test_folds_rule_out_no_similar_pair(spark):
    """Pairs around the similarity, from one shingle to thousands."""
    rng, pairs = random.Random(8), []
    for _ in range(400):
        x = "".join(rng.choices("abcde ", k=rng.choice([1, 9, 10, 11, 30, 100, 500, 3000])))
        y = list(x)
        for _ in range(rng.randrange(1 + len(x) // 60 + 1)):
            y[rng.randrange(len(y))] = rng.choice("ABC")
        pairs.append((x, "".join(y[rng.randrange(2):])))
    near = [len(s & t) >= 0.8 * len(s | t) for s, t in ((_shingles(x), _shingles(y)) for x, y in pairs)]
    assert 50 < sum(near) < 350
    rows = spark.createDataFrame([(2 * i + k, 0, line) for i, p in enumerate(pairs) for k, line in enumerate(p)], "a long, b long, line string")
    folds = fuzzy_lines.folded(rows.select("a", "b", fuzzy_lines._units(F.col("line")).alias("units")))
    other = folds.withColumnsRenamed({c: f"p{c}" for c in folds.columns})
    met = folds.join(other, F.col("pa") == F.col("a") + 1).where("a % 2 = 0").select("a", "size", fuzzy_lines._reach().alias("reach")).collect()
    assert len(met) == len(pairs)
    assert all(r.reach for r in met if near[r.a // 2]) and not all(r.reach for r in met)
    assert all(r["size"] == len(_shingles(pairs[r.a // 2][0])) for r in met)


def test_lines_of_awkward_documents(spark):
    out = fuzzy_lines.drop_lines(frames.clashing(spark), removed="n")
    assert out.columns == [*frames.clashing(spark).columns, "n"]
    rows = out.collect()
    assert len(rows) == len(frames.ROWS)
    by_id = defaultdict(list)
    for r in rows:
        by_id[r[0]].append(r)
    assert by_id[1][0].n == [] and by_id[2][0].n == [0, 1] and by_id[2][0][1] == ""
    assert by_id[4][0][1] is None and by_id[5][0][1] == "" and by_id[6][0][1] == " \n\t "
    assert by_id[None][0].n == [] and by_id[3][0].n == []
    assert by_id[9][0].n == [0]  # nearly the long line of document 8
    assert sorted(tuple(r.n) for r in by_id[10]) == [(), (), ()]  # equal rows are one document
    assert fuzzy_lines.drop_lines(frames.empty(spark)).count() == 0


def test_registered_digests(spark):
    from ledgerloom.llm import keys

    text = {r.doc_id: r.text for r in frames.documents(spark).select("doc_id", "text").collect()}
    want = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in _covered(list(text.items()), 50)}
    got = keys.QUERIES["op7_substring_dedup"](spark, frames.SF).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    fps = keys.QUERIES["op6_simhash"](spark, frames.SF).collect()
    assert {r.doc_id: r.fingerprint for r in fps} == {i: f"{_fingerprint(t):016x}" for i, t in text.items()}
    lines = keys.QUERIES["op4_fuzzy_lines"](spark, frames.SF).collect()
    want = _removed_lines(list(text.items()))
    assert sum(r.removed_lines != want(r.doc_id, text[r.doc_id]) for r in lines) <= 2


def test_long_words_of_like_structure_are_different_words(spark):
    """The Thue-Morse word and its complement agree under a polynomial modulo 2^64."""
    from ledgerloom.llm import substring_dedup

    for bits in (10, 11, 12):
        word = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << bits))
        other = word.translate(str.maketrans("ab", "ba"))
        lead = " ".join(f"word{i}" for i in range(49))
        df = spark.createDataFrame([(1, f"{lead} {word}"), (2, f"{lead} {other}"), (3, f"{lead} {word}")], "doc_id long, text string")
        assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(df).collect()} == {1: 0, 2: 0, 3: 50}
