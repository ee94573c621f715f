"""Order-dependent building blocks that stay correct when one key is hot.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. When
one product, date or document holds a large share of all rows, that task does
the work of the whole job. The helpers here cut the rows into *ranges* of the whole
sort key (keys, then order), at quantiles that Spark samples:

1. ``in_ranges`` range-partitions the rows and writes them once, with the number of
   their range, to the checkpoint folder; everything after reads that table, and
   the totals read its narrow columns only;
2. totals per (key, range) by a partial/final aggregate;
3. a window over those totals only gives each range the sum of the earlier ones;
4. a window partitioned by (key, range) finishes the sum inside the range, and the
   offset of step 3 is added.

The result equals the single-window form exactly. A range holds about the same
number of rows whatever the keys and times are: a key with a third of all rows is in
a third of the ranges, also if all its rows are of one instant, as long as ``order``
tells them apart. ``bucket`` names a column that already cuts the rows so.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.scratch import written

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _join_null_safe(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Inner equi-join on ``cols`` where NULL matches NULL, so no row is lost to a NULL key."""
    r = right.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(cols)],
                     *[c for c in right.columns if c not in cols])
    cond = None
    for i, c in enumerate(cols):
        eq = left[c].eqNullSafe(r[f"_r{i}"])
        cond = eq if cond is None else cond & eq
    return left.join(r, cond, "inner").drop(*[f"_r{i}" for i in range(len(cols))])


def _with_offsets(rows: DataFrame, offsets: DataFrame, keys: Sequence[str], names: Sequence[str], ranged: bool) -> DataFrame:
    """Each row with the offsets of its (key, ``_bkt``). In ranges of the whole sort key
    only the first key of a range has earlier rows, so at most one offset per range
    is not 0: these are broadcast, and the rows stay where they are."""
    if not ranged:
        return _join_null_safe(rows, offsets, [*keys, "_bkt"])
    cols = [*keys, "_bkt"]
    some = offsets.where(reduce(lambda a, b: a | b, (F.col(n) != 0 for n in names)))
    some = F.broadcast(some.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(cols)], *[F.col(n).alias(f"_s{n}") for n in names]))
    same = reduce(lambda a, b: a & b, (rows[c].eqNullSafe(some[f"_r{i}"]) for i, c in enumerate(cols)))
    return rows.join(some, same, "left").select(*rows.columns, *(F.coalesce(f"_s{n}", F.lit(0)).alias(n) for n in names))


RANGE = "_range"


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[ColumnOrName]) -> DataFrame:
    """The rows written once, with ``RANGE``: numbers that do not fall along ``order``
    within a key, and that few rows share."""
    cut = df.repartitionByRange(*[F.col(k) for k in keys], *[_c(o) for o in order])
    return written(cut.withColumn(RANGE, F.spark_partition_id()), "ranges")


def _cut(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column | None) -> DataFrame:
    return in_ranges(df, keys, order).withColumnRenamed(RANGE, "_bkt") if bucket is None else df.withColumn("_bkt", bucket)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[ColumnOrName],
                value: ColumnOrName, out: str, bucket: Column | None = None,
                frame: str = "rows", inclusive: bool = True) -> DataFrame:
    """Cumulative ``sum(value)`` per ``keys`` in ``order``.

    ``frame='rows'`` counts rows strictly in order (ties must be broken by
    ``order``); ``frame='range'`` includes all peers of the current row (``order`` ascending).
    ``inclusive=False`` gives the sum of strictly earlier rows (rows frame only).
    ``bucket`` must be non-decreasing along ``order`` within a key. Peers are summed
    first, so one instant may hold any number of them.
    """
    keys = list(keys)
    order = [_c(o) for o in order]
    val = _c(value)
    if frame == "range" and not inclusive:
        raise ValueError("an exclusive frame needs frame='rows'")

    if frame == "range":
        names = [f"_o{i}" for i in range(len(order))]
        rows = df.select("*", *[o.alias(n) for o, n in zip(order, names, strict=True)])
        steps = rows.groupBy(*keys, *names).agg(F.sum(val).alias("_step"))
        summed = running_sum(steps, keys, names, "_step", out)
        return _join_null_safe(rows, summed.drop("_step"), [*keys, *names]).drop(*names)

    b = _cut(df, keys, order, bucket)
    totals = b.groupBy(*keys, "_bkt").agg(F.sum(val).alias("_bsum"))
    before = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bkt", F.coalesce(F.sum("_bsum").over(before), F.lit(0)).alias("_off"))
    joined = _with_offsets(b, offsets, keys, ["_off"], bucket is None)
    w = Window.partitionBy(*keys, "_bkt").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    inner = F.coalesce(F.sum(val).over(w), F.lit(0))
    return joined.withColumn(out, F.col("_off") + inner).drop("_bkt", "_off")


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[ColumnOrName],
                 values: dict[str, Column], bucket: Column | None = None, inclusive: bool = True, ranged: bool = False) -> DataFrame:
    """Several cumulative sums (rows frame) over the same key and order in one pass;
    ``ranged``: ``bucket`` is the ``RANGE`` of ``in_ranges`` for these keys and order."""
    keys = list(keys)
    order = [_c(o) for o in order]
    end = Window.currentRow if inclusive else -1
    tmp = {out: f"_v_{out}" for out in values}
    b = df.select("*", *[col.alias(tmp[out]) for out, col in values.items()])
    b = _cut(b, keys, order, bucket)
    totals = b.groupBy(*keys, "_bkt").agg(*[F.sum(tmp[o]).alias(f"_t_{o}") for o in values])
    before = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bkt", *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}")
                                             for o in values])
    joined = _with_offsets(b, offsets, keys, [f"_o_{o}" for o in values], ranged or bucket is None)
    w = Window.partitionBy(*keys, "_bkt").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    return joined.select(*df.columns, *[(F.col(f"_o_{o}") + F.coalesce(F.sum(tmp[o]).over(w), F.lit(0))).alias(o)
                                        for o in values])


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[ColumnOrName], out: str = "pos",
              bucket: Column | None = None) -> DataFrame:
    """1-based position of each row inside its key, in ``order`` (ties as ordered)."""
    keys = list(keys)
    order = [_c(o) for o in order]
    b = _cut(df, keys, order, bucket)
    counts = b.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bkt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    joined = _with_offsets(b, offsets, keys, ["_off"], bucket is None)
    rn = F.row_number().over(Window.partitionBy(*keys, "_bkt").orderBy(*order))
    return joined.withColumn(out, F.col("_off") + rn).drop("_bkt", "_off")


def nest_ordered(child: DataFrame, keys: Sequence[str], order: Sequence[ColumnOrName],
                 payload: Sequence[ColumnOrName], name: str, chunk_size: int = 1000,
                 bucket: Column | None = None) -> DataFrame:
    """Children of each key as arrays of at most ``chunk_size`` ordered structs.

    Returns one row per (key, ``chunk_no``) with ``name`` = array<struct<pos, payload...>>
    sorted by ``pos``. A key with more children than ``chunk_size`` gets several
    rows, so no single group is ever collected whole into one task.
    """
    keys = list(keys)
    pos = positions(child, keys, order, "pos", bucket)
    chunked = pos.withColumn("chunk_no", F.floor((F.col("pos") - 1) / F.lit(chunk_size)).cast("int"))
    return chunked.groupBy(*keys, "chunk_no").agg(
        F.array_sort(F.collect_list(F.struct("pos", *payload))).alias(name))


def nest_short(child: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[ColumnOrName],
               name: str, chunk_size: int = 1000) -> DataFrame:
    """``nest_ordered`` where most keys have few children: a count per key names those
    with more than one chunk, which are ranged; all others are collected by one
    shuffle and sorted in their array, and ``order`` is ascending columns."""
    keys = list(keys)
    of = [F.col(k).alias(f"_l{i}") for i, k in enumerate(keys)]
    long = written(child.groupBy(*keys).count().where(F.col("count") > chunk_size).select(*of), "long")
    is_long = reduce(lambda a, b: a & b, (child[k].eqNullSafe(long[f"_l{i}"]) for i, k in enumerate(keys)))
    few = child.join(long, is_long, "left_anti")
    listed = few.groupBy(*keys).agg(F.collect_list(F.struct(
        F.struct(*order).alias("at"), F.struct(*payload).alias("of"))).alias("_rows"))
    fields = few.select(F.struct(*payload).alias("of")).schema["of"].dataType.names
    ranked = F.transform(F.array_sort("_rows"), lambda x, i: F.struct(
        (i + 1).cast("bigint").alias("pos"), *(x["of"][f].alias(f) for f in fields)))
    chunks = listed.select(*keys, F.lit(0).alias("chunk_no"), ranked.alias(name))
    if long.isEmpty():
        return chunks
    return chunks.unionByName(nest_ordered(child.join(long, is_long, "left_semi"), keys, order, payload, name, chunk_size))
