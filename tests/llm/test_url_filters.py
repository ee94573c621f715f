from __future__ import annotations

import re

import numpy as np

from ledgerloom.llm import url_filters as uf

URLS = [
    "https://www.example.org/en/1234?x=1", "http://EXAMPLE.ORG/en/1", "https://example.org/en/2", "https://a.b.example.org/es/9#t",
    "https://notexample.org/es/1", "https://example.com/fr/a", "https://example.com/de/a", "https://com/de/", "https://x.net/de/1",
    "https://example.org", "https://example.org?a=/es/", "no scheme.org/", "", None, "a://b://c.org/es/", "://example.org/es/",
    "https://example.org:80/es/1", "https://user@example.org/es/", "https://org/", "http://ÄÖ.org/Fr/", "https://example.org/EN/1",
    "https://" + "a." * 3000 + "org/" + "p" * 5000, "https://..org/es/", "https://example.org/es",
]


def _brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for action, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = h + p, action
    return (host, path, *best) if best else (host, path, None, "allow")


def test_equals_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[0]), (3, URLS[3])]
    got = uf.judge(spark.createDataFrame(rows, "page_id long, url string"), uf.RULES).collect()
    want = [(i, *_brute(u, uf.RULES)) for i, u in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_colliding_digests_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(uf, "_digest", lambda key: len(key) % 3)  # nearly everything collides
    names = uf.build_index(spark, uf.RULES)
    index = uf._Index(names)
    assert (np.diff(index.keys.astype(np.int64)) >= 0).all()
    for url in URLS:
        host, path, rule, verdict = _brute(url, uf.RULES)
        got_rule, got_action = index.probe([host], [path])
        assert (got_rule[0], got_action[0] or "allow") == (rule, verdict)


def test_empty_table_and_no_rules(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert uf.judge(none, uf.RULES).collect() == []
    some = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert tuple(uf.judge(some, []).first()) == (1, "a.org", "/", None, "allow")
