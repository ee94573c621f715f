"""Order-dependent sums over sampled ranges: no task holds a hot key or a hot instant."""

from __future__ import annotations

import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import ordered
from ledgerloom.functions.ordered import RANGE, in_ranges, nest_ordered, nest_short, positions, running_sum, running_sums
from ledgerloom.plans import registry

from .conftest import SF_SMALL


def hot(spark, n=20_000):
    """A third of all rows under one key, all of them at one instant."""
    return spark.range(n).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('k', id % 50) END AS k",
                                     "CASE WHEN id % 3 = 0 THEN timestamp_ntz'2001-01-01' ELSE timestamp_ntz'2001-01-01' + make_dt_interval(id % 90) END AS t",
                                     "id", "id % 7 - 3 AS v").repartition(6)


def uncoalesced(spark, fn):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return fn()
    finally:
        spark.conf.set(key, before)


def test_ranges_are_even(spark):
    cut = uncoalesced(spark, lambda: in_ranges(hot(spark), ["k"], ["t", "id"]))
    sizes = [r["count"] for r in cut.groupBy("k", RANGE).count().collect()]
    assert cut.where("k = 'hot'").select(RANGE).distinct().count() > 1
    per_range = [r["count"] for r in cut.groupBy(RANGE).count().collect()]
    assert max(per_range) <= 3 * statistics.median(per_range) and max(sizes) <= 3 * statistics.median(per_range)
    falls = cut.withColumn("next", F.lead(RANGE).over(Window.partitionBy("k").orderBy("t", "id"))).where(f"next < {RANGE}")
    assert falls.count() == 0 and cut.count() == 20_000


def test_sums_and_positions_equal_the_single_window(spark):
    df = hot(spark, 3000)
    w = Window.partitionBy("k").orderBy("t", "id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def check():
        assert sorted(running_sum(df, ["k"], ["t", "id"], "v", "s").select("id", "s").collect()) == sorted(
            df.select("id", F.sum("v").over(whole).alias("s")).collect())
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        assert sorted(running_sums(df, ["k"], ["t", "id"], {"s": F.col("v")}, inclusive=False).select("id", "s").collect()) == sorted(
            df.select("id", F.coalesce(F.sum("v").over(earlier), F.lit(0)).alias("s")).collect())
        assert sorted(positions(df, ["k"], [F.desc("t"), "id"]).select("id", "pos").collect()) == sorted(
            df.select("id", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("t"), "id")).alias("pos")).collect())
        peers = Window.partitionBy("k").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        assert sorted(running_sum(df, ["k"], ["t"], "v", "s", frame="range").select("id", "s").collect()) == sorted(
            df.select("id", F.sum("v").over(peers).alias("s")).collect())
        chunks = nest_ordered(df, ["k"], ["t", "id"], ["id"], "rows", chunk_size=100).collect()
        assert sum(len(c.rows) for c in chunks) == 3000 and max(len(c.rows) for c in chunks) == 100

    uncoalesced(spark, check)


def test_the_input_is_computed_once(spark):
    """Totals and rows come from the written table, not from the input again."""
    plan = positions(hot(spark, 100), ["k"], ["t", "id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (" not in plan


def test_empty(spark):
    assert positions(hot(spark, 0), ["k"], ["t", "id"]).collect() == []
    assert running_sum(hot(spark, 0), [], ["t", "id"], "v", "s").collect() == []


def test_short_keys_are_not_ranged(spark, monkeypatch):
    """Keys of one chunk take one shuffle; only longer ones are ranged, and the arrays are the same."""
    df = spark.range(3000).selectExpr("CASE WHEN id < 900 THEN 0 WHEN id < 2900 THEN id % 400 + 1 WHEN id < 2910 THEN NULL ELSE -1 END AS k",
                                      "CASE WHEN id % 4 > 0 THEN id % 5 END AS t", "id", "cast(id AS decimal(9,2)) AS v")
    ranged = []
    monkeypatch.setattr(ordered, "in_ranges", lambda rows, keys, order: ranged.append(rows.count()) or in_ranges(rows, keys, order))

    def found(nest, rows, size):
        out = nest(rows, ["k"], ["t", "id"], ["id", "v", (F.col("v") * 2).alias("w")], "xs", chunk_size=size)
        return out.schema["xs"].dataType.simpleString(), sorted(out.collect(), key=str)

    for size, long in ((100, 900), (50, 990), (5, 2990)):
        want = found(nest_ordered, df, size)
        ranged.clear()
        assert found(nest_short, df, size)[0] == want[0] and found(nest_short, df, size)[1] == want[1]
        assert ranged[0] <= (3000 if size == 5 else long)
    ranged.clear()
    assert found(nest_short, df, 1000) == found(nest_ordered, df, 1000) and ranged == [3000]


def test_challan_documents_are_not_ranged(spark, monkeypatch):
    monkeypatch.setattr(ordered, "in_ranges", lambda *a: pytest.fail("short challans are ranged"))
    assert registry.queries()["challan_document"](spark, SF_SMALL).count() > 0


def test_offsets_do_not_move_the_rows(spark):
    """The few offsets that are not 0 are broadcast, whatever the size limit of broadcasts."""
    plan = positions(hot(spark, 3000), ["k"], ["t", "id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_movements_do_not_look_for_the_short_items(spark):
    from ledgerloom.plans.keys_commands import confirm_drafts_fixture

    plan = confirm_drafts_fixture(spark, SF_SMALL)["movements"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
