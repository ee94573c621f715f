"""URL rules from a sorted digest array.

The index of a rule list is two flat files: the sorted 64-bit xxHash keys of
the rule strings (``host`` + ``path``), and the stored strings with their
offsets and actions. Tasks memory-map both, so a list costs page cache, not
heap, whatever its length. A url is probed with every key it could match (each
host suffix at a label boundary, with each path prefix of a length that some
rule has) by one vectorised binary search per batch, and a key that is found
counts only if the stored string equals the probe, so collisions of the 64-bit
digest cannot change a verdict.

Rules are a curated configuration: ``build_index`` takes at most ``MAX_BYTES``
of them and raises beyond that. The files travel with ``addFile``, so executors
that join or are replaced later fetch them again.

Defined results: a null url, or one without ``://``, has empty host and path
and matches no rule; without a matching rule the verdict is ``allow`` (the
url's keys are not in the array). Of several rules the longest (host and path
together) wins, then the longer host; repeated rules: the last given counts.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 256 << 20
ALLOW, BLOCK = "allow", "block"

#: (action, host, path): the rules of the registered query. Fixed values.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def _digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"))


def build_index(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> tuple[str, str]:
    """Write the two index files and give them to all executors; their names."""
    by_key: dict[tuple[str, str], str] = {}
    for action, host, path in rules:
        if action not in (ALLOW, BLOCK):
            raise ValueError(f"unknown action {action!r}")
        by_key[(host.lower(), path)] = action
    if sum(len(h) + len(p) for h, p in by_key) > MAX_BYTES:
        raise ValueError(f"more than {MAX_BYTES} bytes of rules")
    entries = sorted(((_digest(h + p), h, p, a) for (h, p), a in by_key.items()))
    stored = [f"{a}\t{len(h)}\t{h}{p}".encode() for _, h, p, a in entries]
    name = f"url-rules-{uuid.uuid4().hex}"
    folder = tempfile.mkdtemp(prefix="url-rules-")
    keys_file, text_file = os.path.join(folder, f"{name}.keys"), os.path.join(folder, f"{name}.text")
    offsets = np.zeros(len(entries) + 1, np.int64)
    np.cumsum([len(x) for x in stored], out=offsets[1:])
    lengths = sorted({len(p) for _, _, p, _ in entries})
    with open(keys_file, "wb") as f:
        np.array([len(entries), len(lengths), *lengths], np.int64).tofile(f)
        np.array([x[0] for x in entries], np.uint64).tofile(f)
    with open(text_file, "wb") as f:
        offsets.tofile(f)
        f.write(b"".join(stored))
    for path in (keys_file, text_file):
        spark.sparkContext.addFile(path)
    return os.path.basename(keys_file), os.path.basename(text_file)


class _Index:
    """The memory-mapped arrays inside a task."""

    def __init__(self, names: tuple[str, str]):
        keys, text = (np.memmap(SparkFiles.get(n), np.uint8, "r") for n in names)
        n, n_lengths = keys[:16].view(np.int64)
        head = 16 + 8 * int(n_lengths)
        self.path_lengths = keys[16:head].view(np.int64).tolist()
        self.keys = keys[head:].view(np.uint64)
        self.offsets = text[:8 * (int(n) + 1)].view(np.int64)
        self.text = text[8 * (int(n) + 1):]

    def entry(self, at: int) -> tuple[str, int, str]:
        raw = self.text[self.offsets[at]:self.offsets[at + 1]].tobytes().decode()
        action, host_length, key = raw.split("\t", 2)
        return action, int(host_length), key

    def probe(self, hosts: list[str], paths: list[str]) -> tuple[list, list]:
        """Rule string and action of each url, from one search over all probes."""
        memo: dict[tuple[str, str], list] = {}
        probes: list[tuple[int, int, str]] = []  # url, host length, key
        longest = self.path_lengths[-1] if self.path_lengths else 0
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            same = memo.setdefault((host, path[:longest]), [])
            same.append(i)
            if len(same) > 1 or not host:
                continue
            suffix = host
            while suffix:
                probes.extend((i, len(suffix), suffix + path[:n]) for n in self.path_lengths if n <= len(path))
                suffix = suffix.partition(".")[2]
        rule, action = [None] * len(hosts), [None] * len(hosts)
        if probes and len(self.keys):
            digests = np.array([_digest(k) for _, _, k in probes], np.uint64)
            at = np.searchsorted(self.keys, digests)
            found = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digests)
            best: dict[int, tuple[int, int]] = {}
            for j in found.tolist():
                url, host_length, key = probes[j]
                k = int(at[j])
                while k < len(self.keys) and self.keys[k] == digests[j]:  # colliding digests stand side by side
                    act, stored_host, stored = self.entry(k)
                    if stored == key and stored_host == host_length and best.get(url, (-1, -1)) < (len(key), host_length):
                        best[url], rule[url], action[url] = (len(key), host_length), key, act
                    k += 1
            for same in memo.values():
                for i in same[1:]:
                    rule[i], action[i] = rule[same[0]], action[same[0]]
        return rule, action


def split_url(url: str = "url"):
    """Host (A-Z lower-cased) and path Columns of a url Column, both empty without ``://``."""
    rest = F.regexp_extract(F.col(url), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge(urls: DataFrame, rules: Sequence[tuple[str, str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) of every row of ``urls``; other columns are not read."""
    names = build_index(urls.sparkSession, rules)
    host, path = split_url(url)
    rows = urls.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _Index(names)
        for rows in batches:
            rule, action = index.probe(rows["host"].tolist(), rows["path"].tolist())
            yield rows.assign(rule=pd.Series(rule, rows.index, dtype=object),
                              verdict=[a or ALLOW for a in action])

    kind = rows.schema["key"].dataType.simpleString()
    # the key travels as text so that a null in an integer column stays null
    out = rows.withColumn("key", F.col("key").cast("string")).mapInPandas(
        probe, "key string, host string, path string, rule string, verdict string")
    return out.select(F.col("key").cast(kind).alias(key), "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH parts AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), split AS (
    SELECT page_id,
           translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
    FROM parts
), rules(action, rhost, rpath) AS (
    VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
           ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
    SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
           arg_max(action, length(rhost || rpath)) AS action
    FROM split JOIN rules ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath)
    GROUP BY ALL
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM split s LEFT JOIN (SELECT DISTINCT host, path, rule, action FROM fits) f USING (host, path)
"""
