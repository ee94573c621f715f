"""Fixed values shared by operators, fixtures and the SQL oracle."""

from __future__ import annotations

import datetime as _dt

# Fixture clock: the largest order date at every scale factor.
AS_OF = _dt.date(2001, 8, 1)
AS_OF_SQL = "DATE '2001-08-01'"

# Fixed values that must equal the modelled application's (enums, limits,
# texts), listed in their natural order.
ROLES = ["ADMIN", "SALES", "WAREHOUSE", "ACCOUNTS"]
CHALLAN_STATUSES = ["DRAFT", "CONFIRMED", "CANCELLED"]
CUSTOMER_TYPES = ["RETAIL", "WHOLESALE", "DISTRIBUTOR"]
CUSTOMER_STATUSES = ["LEAD", "ACTIVE", "INACTIVE"]
PRIORITIES = ["LOW", "MEDIUM", "HIGH"]
QUERY_STATUSES = ["OPEN", "IN_PROGRESS", "RESOLVED"]
REQUEST_STATUSES = ["PENDING", "APPROVED", "REJECTED"]
MOVEMENT_TYPES = ["IN", "OUT"]
ALERT_TYPES = ["LOW_STOCK", "FOLLOW_UP", "CUSTOMER_QUERY"]
OPENING_STOCK_REASON = "Opening stock recorded when the product was created"

PAGE_DEFAULT, PAGE_MAX = 20, 100
DAYS_DEFAULT, DAYS_MIN, DAYS_MAX = 30, 7, 365
INBOX_SIZE = 30
DASHBOARD_LIST = 5
FOLLOW_UP_HORIZON_DAYS = 7
ALERT_DETAIL_CHARS = 100
DAY_BAR_FLOOR_BP = 600      # 6 % of the largest day
SELLER_BAR_FLOOR_BP = 800   # 8 % of the largest seller
API_RATE_LIMIT, LOGIN_RATE_LIMIT = 600, 10
RATE_WINDOW = "15 minutes"

# Role -> capability matrix of the access-control document, in its order.
# Columns: ADMIN, SALES, WAREHOUSE, ACCOUNTS.
CAPABILITY_MATRIX = [
    ("Sign in and view dashboard, analytics, alerts", True, True, True, True),
    ("View and search customers", True, True, False, False),
    ("Create/update customers", True, True, False, False),
    ("Add follow-ups", True, True, False, False),
    ("Record incoming customer queries and customer feedback", False, True, False, False),
    ("Reply to customer queries", False, True, False, False),
    ("Resolve customer queries", True, True, False, False),
    ("View customer queries and reviews", True, True, False, False),
    ("View product catalogue and stock levels", True, True, True, False),
    ("Create/update products", True, False, True, False),
    ("Record stock movements", True, False, True, False),
    ("Request stock for a product", False, True, False, False),
    ("Approve or reject Sales stock requests", True, False, True, False),
    ("View challans", True, True, True, True),
    ("Create, confirm, or cancel challans", True, True, False, False),
    ("Download challan PDFs and sales CSV", True, True, False, True),
    ("Mark personal notifications read", True, True, True, True),
]

# Input rules (min, max lengths) of the application's validators.
CUSTOMER_RULES = {"customer_name": (2, 160), "mobile": (6, 30), "business_name": (2, 180),
                  "gst_number": (0, 30), "address": (5, 1000)}
PRODUCT_RULES = {"product_name": (2, 180), "sku": (2, 80), "category": (2, 100),
                 "warehouse_location": (2, 120)}
PRICE_MAX = 9999999999
REASON_RULE = (3, 500)
CRM_RULES = {"note": (1, 2000), "subject": (3, 180), "message": (3, 3000),
             "reply": (1, 3000), "review": (3, 2000)}
REQUEST_QTY_MAX = 100000
REQUEST_MESSAGE_RULE = (3, 1000)
REVIEW_NOTE_MAX = 1000
