"""Golden history worked out from the seed formulas (FIXTURES.md §3)."""

from __future__ import annotations

import datetime as dt

import pytest

from ledgerloom.operators import sales

from .frames import CHALLANS, CUSTOMERS, ITEMS, PRODUCTS, USERS, frame, money, ts

TODAY = dt.date(2026, 3, 15)
# Demo catalogue of the seed history: sku and price are fixed values; names are placeholders.
SEED_PRODUCTS = [("PAP-A4-75", "A4 Paper 75gsm", "285.00"), ("PEN-BLU-10", "Blue Pens (10)", "95.00"),
                 ("NOTE-A5-HB", "A5 Notebook", "140.00"), ("MARK-BLK-01", "Permanent Marker - Black", "55.00")]
SELLERS = ["sales", "admin", "accounts"]   # seller order of the seed history


@pytest.fixture(scope="module")
def history(spark):
    users = frame(spark, [(i + 1, name, f"{name}@example.test", "SALES") for i, name in enumerate(SELLERS)], USERS)
    customers = frame(spark, [(1, "Priya Sharma", "Evergreen Stores", "+919800000001", None, None, "RETAIL",
                               "ACTIVE", None)], CUSTOMERS)
    products = frame(spark, [(i + 1, n, sku, "Stationery", money(p), 5, "A1")
                             for i, (sku, n, p) in enumerate(SEED_PRODUCTS)], PRODUCTS)
    challans, items = [], []
    for d in range(10):
        for o in range(2):
            cid = 100 + 2 * d + o
            day = TODAY - dt.timedelta(days=9 - d)
            at = ts(day, 10, o)
            challans.append((cid, f"CH-2026-{cid:05d}", 1, (d + o) % 3 + 1, "CONFIRMED", at, at, None))
            p = (2 * d + o) % 4
            sku, name, price = SEED_PRODUCTS[p]
            items.append((cid, 1, p + 1, name, sku, money(price), 1 + (d + o) % 3))
    return (frame(spark, challans, CHALLANS), frame(spark, items, ITEMS), users, customers, products)


def test_daily(history):
    ch, it, *_ = history
    rows = sales.sales_daily(ch, it, TODAY, 30).collect()
    expected = [(2, "475.00", 3), (2, "445.00", 5), (2, "950.00", 4), (2, "250.00", 3), (2, "855.00", 5),
                (2, "475.00", 4), (2, "475.00", 3), (2, "445.00", 5), (2, "950.00", 4), (2, "250.00", 3)]
    assert [r.sale_date for r in rows] == [TODAY - dt.timedelta(days=9 - d) for d in range(10)]
    assert [(r.challans, str(r.revenue), r.units) for r in rows] == expected


def test_by_seller(history):
    ch, it, users, *_ = history
    rows = sales.sales_by_seller(ch, it, users, TODAY, 30).collect()
    assert [(r.challans, str(r.revenue), r.units) for r in rows] == [
        (6, "2745.00", 18), (7, "1730.00", 14), (7, "1095.00", 7)]
    assert rows[0].user_name == "accounts"


def test_totals_and_seven_day_window(history):
    ch, it, *_ = history
    tot = sales.sales_period_total(ch, it, TODAY, 30).collect()[0]
    assert (tot.challans, str(tot.revenue), tot.units) == (20, "5570.00", 39)
    seven = sales.sales_daily(ch, it, TODAY, 7).collect()
    assert len(seven) == 8
    assert sum(r.challans for r in seven) == 16
    assert str(sum(r.revenue for r in seven)) == "4650.00"
    assert sum(r.units for r in seven) == 31


def test_days_bounds(history):
    ch, it, *_ = history
    for bad in (6, 366, 30.0, True):
        with pytest.raises(ValueError):
            sales.sales_daily(ch, it, TODAY, bad)


def test_share_of_max(history):
    ch, it, users, *_ = history
    rows = {r.user_name: r.bar_bp for r in sales.seller_share_of_max(ch, it, users, TODAY, 30).collect()}
    assert rows["accounts"] == 10000
    assert rows["sales"] == 173000 * 10000 // 274500 or rows["admin"] == 173000 * 10000 // 274500
