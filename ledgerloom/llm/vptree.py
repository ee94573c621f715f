"""Approximate nearest neighbours: vantage-point trees per shard.

Vectors are scaled to unit length, where the Euclidean distance is a metric and
orders like the cosine. Rows are dealt into shards of about ``SHARD_ROWS`` by
their id, queries into blocks of ``BLOCK_ROWS``; each (shard, block) pair is
one task unit that builds the shard's tree and answers the block, and the
partial lists of a query merge by rank. Both counts follow the input.

A node holds a vantage point and the median distance ``mu`` to it; the other points
are halved by rank, so a tree has the depth of a balanced one however many
distances tie, and points at ``mu`` itself may lie on both sides. The inner
subtree is skipped when ``d - mu`` exceeds the query's current k-th distance
divided by ``factor``, the outer one when ``mu - d`` does. Factor 1 is the
triangle inequality and exact; larger factors skip more. Leaves are compared
by blocks. Equal vectors of a shard fold to one point with their k + 1 smallest
ids, which is all a query can return of them, so a hot vector neither unbalances
a tree nor makes a task larger.

Scores of the results are computed from the original vectors in double
precision. Defined results: vectors that are null, empty, zero or hold null or
non-finite components take no part, nor do rows with a null id; equal rows count
once; rows with one id and different vectors are all candidates for other ids, and
if that id is a query, its smallest vector asks; only vectors of one length compare.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 8192
BLOCK_ROWS = 4096
LEAF = 64
#: Points kept beyond k before the exact scores decide (rounding of the block products).
SPARE = 3


class Tree:
    """Vantage-point tree over distinct unit vectors, as nested tuples."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.root = self._build(np.arange(len(points)))

    def _build(self, at: np.ndarray):
        if len(at) <= LEAF:
            return at
        # the vantage point whose distances spread most, of a few spaced candidates
        probes = at[:: max(1, len(at) // 8)][:8]
        sample = at[:: max(1, len(at) // 256)]
        spread = [_distance(self.points[sample], self.points[p]).var() for p in probes]
        vantage = int(probes[int(np.argmax(spread))])
        rest = at[at != vantage]
        d = _distance(self.points[rest], self.points[vantage])
        half = len(rest) // 2
        order = np.argpartition(d, half)
        return vantage, float(d[order[half]]), self._build(rest[order[:half]]), self._build(rest[order[half:]])


def _distance(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (points @ one), 0.0))


class Search:
    """All queries of a block against one tree."""

    def __init__(self, tree: Tree, queries: np.ndarray, k: int, factor: float):
        self.tree, self.queries, self.factor = tree, queries, factor
        self.best = np.full((len(queries), k), np.inf)   # distances, ascending
        self.found = np.full((len(queries), k), -1)
        self._visit(tree.root, np.arange(len(queries)))

    def _offer(self, who: np.ndarray, points: np.ndarray, d: np.ndarray) -> None:
        k = self.best.shape[1]
        better = (d < self.best[who, -1][:, None]).any(axis=1)
        if not better.any():
            return
        who, d = who[better], d[better]
        all_d = np.concatenate([self.best[who], d], axis=1)
        all_p = np.concatenate([self.found[who], np.broadcast_to(points, d.shape)], axis=1)
        top = np.argsort(all_d, axis=1, kind="stable")[:, :k]
        self.best[who] = np.take_along_axis(all_d, top, axis=1)
        self.found[who] = np.take_along_axis(all_p, top, axis=1)

    def _visit(self, node, who: np.ndarray) -> None:
        if not len(who):
            return
        points = self.tree.points
        if isinstance(node, np.ndarray):
            self._offer(who, node, np.sqrt(np.maximum(2.0 - 2.0 * (self.queries[who] @ points[node].T), 0.0)))
            return
        vantage, mu, inner, outer = node
        d = _distance(self.queries[who], points[vantage])
        self._offer(who, np.array([vantage]), d[:, None])
        near = d < mu
        self._visit(inner, who[near])
        self._visit(outer, who[~near])
        reach = self.best[who, -1] / self.factor
        self._visit(outer, who[near & (mu - d <= reach)])
        self._visit(inner, who[~near & (d - mu <= reach)])


def _unit(v: np.ndarray) -> np.ndarray:
    v = _scaled(v)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows by a power of two, exactly, so that their squares stay in range."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; equal rows give equal scores."""
    a, b = _scaled(a), _scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int,
                 factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of up to k nearest rows of the shard for each query."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    distinct, first, number = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
    members = [[] for _ in distinct]
    for i, g in zip(ids.tolist(), number.ravel().tolist(), strict=True):
        if len(members[g]) <= k:
            members[g].append(i)
    # a query's own points, of which it takes none, must not take the places of others
    own = np.unique(np.column_stack([ids, number.ravel()])[np.isin(ids, query_ids)], axis=0)[:, 0]
    most = int(np.unique(own, return_counts=True)[1].max()) if len(own) else 0
    search = Search(Tree(_unit(distinct)), _unit(queries), k + most + SPARE, factor)
    out_q, out_i, out_s = [], [], []
    which, col = np.nonzero(search.found >= 0)
    points = search.found[which, col]
    scores = cosine(queries[which], distinct[points])
    for w, p, s in zip(which.tolist(), points.tolist(), scores.tolist(), strict=True):
        for i in members[p]:
            out_q.append(w)
            out_i.append(i)
            out_s.append(s)
    q, i, s = np.array(out_q, np.int64), np.array(out_i, np.int64), np.array(out_s)
    keep = query_ids[q] != i
    q, i, s = q[keep], i[keep], s[keep]
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    top = rank < k
    return query_ids[q[top]], i[top], s[top]


def valid(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, dim, v): the distinct rows of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return (rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite & some)
            .select(F.col(key).cast("long").alias("id"), v.alias("v")).distinct()
            .select("id", F.size("v").alias("dim"), "v"))


def nearest(rows: DataFrame, is_query, k: int = 5, factor: float = 1.0, key: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row where ``is_query(id Column)``
    holds, its k nearest other rows."""
    data = valid(rows, key, vector)
    queries = data.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v")).select("id", F.size("v").alias("dim"), "v")
    n, n_queries = data.agg(F.count("*"), F.count_if(is_query(F.col("id")))).first()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-n_queries // BLOCK_ROWS))

    def spread(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other)
        return df.select("*", F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int").alias(own), every)

    def answer(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        q, i, s = search_shard(own["id"].to_numpy(), np.stack(own["v"].to_numpy()), asked["id"].to_numpy(),
                               np.stack(asked["v"].to_numpy()), k, factor)
        return pd.DataFrame({"query_id": q, "id": i, "score": s})

    keys = ["dim", "shard", "block"]
    found = (spread(data, "shard", shards, "block", blocks).groupBy(*keys)
             .cogroup(spread(queries, "block", blocks, "shard", shards).groupBy(*keys))
             .applyInPandas(answer, "query_id long, id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
