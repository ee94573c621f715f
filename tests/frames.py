"""Small in-memory domain frames for edge and golden tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

USERS = "id bigint, name string, email string, role string"
CUSTOMERS = ("id bigint, customer_name string, business_name string, mobile string, email string, "
             "gst_number string, customer_type string, status string, follow_up_date date")
PRODUCTS = ("id bigint, product_name string, sku string, category string, unit_price decimal(12,2), "
            "minimum_stock_alert_quantity int, warehouse_location string")
CHALLANS = ("id bigint, challan_number string, customer_id bigint, created_by bigint, status string, "
            "created_at timestamp_ntz, confirmed_at timestamp_ntz, cancelled_at timestamp_ntz")
ITEMS = ("challan_id bigint, line_no int, product_id bigint, product_name_snapshot string, sku_snapshot string, "
         "unit_price_snapshot decimal(12,2), quantity int")
MOVEMENTS = ("product_id bigint, quantity_changed int, movement_type string, reason string, reference_type string, "
             "reference_id bigint, created_by bigint, created_at timestamp_ntz")
QUERIES = ("id bigint, customer_id bigint, subject string, message string, status string, priority string, "
           "created_by bigint")
REQUESTS = ("id bigint, product_id bigint, requested_by bigint, quantity int, urgency string, message string, "
            "status string, reviewed_by bigint, created_at timestamp_ntz")


def ts(d: dt.date, h: int = 0, m: int = 0, s: int = 0) -> dt.datetime:
    return dt.datetime(d.year, d.month, d.day, h, m, s)


def money(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)
