"""The history load: names, outcomes, and loads that run again."""

from __future__ import annotations

import glob
import hashlib

from ledgerloom.sources import history as hs

SALES = "challan_number string, user string, customer string, product string, quantity int, confirmed_at timestamp_ntz"


def frames(spark):
    users = spark.createDataFrame([(1, "a@x"), (2, "b@x"), (3, "b@x")], "id long, email string")
    customers = spark.createDataFrame([(1, "Ann"), (2, "Twin"), (3, "Twin"), (4, None)], "id long, customer_name string")
    products = spark.createDataFrame([(1, "P", "s1", 2.5)], "id long, product_name string, sku string, unit_price double")
    return users, customers, products


def sales(spark, rows):
    return spark.createDataFrame(rows, "n string, u string, c string, p string, q int, t string").selectExpr(
        "n AS challan_number", "u AS user", "c AS customer", "p AS product", "q AS quantity", "CAST(t AS timestamp_ntz) AS confirmed_at")


def test_names_and_outcomes(spark):
    rows = [("d1", "a@x", "Ann", "s1", 1, "2001-01-05"), ("d2", "b@x", "Ann", "s1", 1, "2001-01-05"), ("d3", "a@x", "Twin", "s1", 1, "2001-01-05"),
            ("d4", "a@x", None, "s1", 1, "2001-01-05"), ("d5", "a@x", "Ann", "s9", 1, "2001-01-05"), ("d6", "zz", "Twin", None, 1, "2001-01-05")]
    got = {r.challan_number: r for r in hs.resolve(sales(spark, rows), *frames(spark)).collect()}
    assert {k: r.outcome for k, r in got.items()} == {"d1": "loaded", "d2": "ambiguous_user", "d3": "ambiguous_customer", "d4": "unknown_customer",
                                                       "d5": "unknown_product", "d6": "unknown_user"}
    assert (got["d1"].customer_id, got["d1"].created_by, got["d1"].product_id, str(got["d1"].unit_price_snapshot)) == (1, 1, 1, "2.50")


def test_a_load_twice_is_a_load_once(spark, scratch):
    rows = [(f"DEMO10-{i}", "a@x", "Ann", "s1", i, f"2001-{1 + i % 4:02d}-0{1 + i % 9}") for i in range(40)]
    resolved = hs.resolve(sales(spark, rows), *frames(spark))
    hs.load(resolved, scratch, "DEMO10")
    hs.load(resolved.where("challan_number = 'DEMO10-1'"), scratch, "OTHER")
    once, files = sorted(hs.history(spark, scratch).collect()), _files(scratch)
    hs.load(resolved, scratch, "DEMO10")
    assert sorted(hs.history(spark, scratch).collect()) == once and len(once) == 41
    before = _files(scratch)
    hs.load(resolved.where("month(confirmed_at) = 2 AND quantity < 10"), scratch, "DEMO10")
    after = _files(scratch)
    assert {f for f in before if f not in after} == {f for f in before if "load=DEMO10/month=2001-02" in f}
    assert all(before[f] == after[f] for f in before if f in after) and files
    assert hs.history(spark, scratch).where("load = 'DEMO10' AND month = '2001-02'").count() == 3
    plan = hs.numbered_like(hs.history(spark, scratch), "DEMO10-")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(challan_number,DEMO10-)" in plan
    assert hs.numbered_like(hs.history(spark, scratch), "DEMO1_").count() == 0


def _files(path):
    return {f: hashlib.sha256(open(f, "rb").read()).hexdigest() for f in glob.glob(f"{path}/load=*/month=*/part-*")}
