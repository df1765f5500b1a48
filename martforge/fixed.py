"""Fixed values.

These must equal the shop's own values for results to be right; they are
stated here once, in plain text, and imported everywhere else.
"""

from __future__ import annotations

# --- fixed values: data model -------------------------------------------------
ORDER_STATUSES = ("pending", "confirmed", "shipped", "delivered", "cancelled")
PAYMENT_STATUSES = ("pending", "completed", "failed", "refunded")
PAYMENT_METHODS = ("card", "bank_transfer", "paypal")
PAYMENT_METHODS_STORED = ("CARD", "BANK_TRANSFER", "PAYPAL")
PAYMENT_COMPLETED_STORED = "COMPLETED"
CONFIRMED = "confirmed"
VAT_RATES = (0.0, 5.5, 10.0, 20.0)
STAGING_TABLES = ("admins", "customers", "items", "orders", "order_items", "payments", "invoices")
NAMESPACES = ("staging", "dwh", "dmart")

# --- fixed values: change capture ---------------------------------------------
TOPIC_PREFIX = "ecommerce"
SOURCE_DATABASE = "ecommerce"
DELETED_TRUE = "true"
DELETED_FALSE = "false"

# --- fixed values: refresh cadence ----------------------------------------------
REFRESH_PERIOD = "2 minutes"
RETRIES = 1
RETRY_DELAY_S = 120.0

# --- fixed values: shop rules ---------------------------------------------------
REORDER_TOP_K = 8
CART_TTL_SECONDS = 7 * 24 * 3600
INVOICE_DUE_DAYS = 30
INVOICE_PREFIX = "INV-"
INVOICE_SUFFIX_HEX = 6
TXN_PREFIX = "TXN-"
TXN_HEX = 12
TITLE_LIMIT = 40
TITLE_KEEP = 37
TITLE_ELLIPSIS = "..."
STOCK_LOW_BELOW = 5
SEGMENTS = (("no_order", 0, 0), ("one_time", 1, 1), ("recurring", 2, 4), ("loyal", 5, None))
DUE_OVERDUE = "overdue"
DUE_ON_TIME = "on_time"

# --- fixed values: display ------------------------------------------------------
PAYMENT_METHOD_LABELS = {"card": "Carte", "paypal": "PayPal", "other": "Virement", "missing": "—"}
PAYMENT_STATUS_LABELS = {"completed": "Payé", "pending": "En attente", "failed": "Échoué", "other": "Remboursé"}
NO_TRANSACTION_LABEL = "—"
DELETED_ITEM_LABEL = "Article supprimé"
DELETED_ITEM_LABEL_PLAIN = "Article supprime"
MONEY_SUFFIX = " EUR"
DATE_FORMAT = "dd/MM/yyyy"
NO_DATE = "-"
INVOICE_DATE_FORMAT = "yyyyMMdd"
