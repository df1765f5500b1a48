"""Column expressions shared by the operators. All JVM-side built-ins."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import (DATE_FORMAT, DELETED_FALSE, DELETED_ITEM_LABEL, DELETED_ITEM_LABEL_PLAIN,  # noqa: F401
                     MONEY_SUFFIX, NO_DATE, NO_TRANSACTION_LABEL, PAYMENT_METHOD_LABELS, PAYMENT_STATUS_LABELS,
                     STOCK_LOW_BELOW, TITLE_ELLIPSIS, TITLE_KEEP, TITLE_LIMIT)

MONEY = "decimal(10,2)"
RATE = "decimal(5,2)"


def c(name_or_col) -> Column:
    return F.col(name_or_col) if isinstance(name_or_col, str) else name_or_col


def live_row() -> Column:
    """Soft-delete filter: a NULL ``__deleted`` counts as live."""
    return F.coalesce(F.col("__deleted"), F.lit(DELETED_FALSE)) == F.lit(DELETED_FALSE)


def epoch_ms_to_ts(col) -> Column:
    """Epoch milliseconds -> timestamp (session time zone is UTC)."""
    return F.timestamp_millis(c(col))


def small_int_bool(col) -> Column:
    """Boolean delivered as a small int: 1 -> true, other -> false, NULL stays NULL."""
    return c(col) == F.lit(1)


def money(col) -> Column:
    return c(col).cast(MONEY)


def ttc_from_ht_exact(price_ht, vat_rate) -> Column:
    """Price incl. VAT = round(HT * (1 + VAT/100), 2) in exact decimal
    arithmetic, half-up (HT and VAT carry at most two decimals; the shop's
    binary-float rounding can differ by a cent on ties)."""
    factor = F.lit(Decimal("1")) + c(vat_rate).cast(RATE) * F.lit(Decimal("0.01"))
    return F.round(c(price_ht).cast("decimal(12,2)") * factor, 2)


def stock_level(qty) -> Column:
    """Stock badge: <= 0 out, < 5 low, else ok."""
    q = c(qty)
    return F.when(q <= 0, "out").when(q < STOCK_LOW_BELOW, "low").when(q.isNotNull(), "ok")


def order_status_label(status) -> Column:
    """Capitalised status (statuses are single words)."""
    return F.initcap(c(status))


def payment_method_label(method) -> Column:
    m = F.lower(c(method))
    lab = PAYMENT_METHOD_LABELS
    return (F.when(m.isNull(), lab["missing"]).when(m == "card", lab["card"])
            .when(m == "paypal", lab["paypal"]).otherwise(lab["other"]))


def payment_status_label(status) -> Column:
    s = F.lower(c(status))
    lab = PAYMENT_STATUS_LABELS
    return (F.when(s == "completed", lab["completed"]).when(s == "pending", lab["pending"])
            .when(s == "failed", lab["failed"]).otherwise(lab["other"]))


def short_title(title, limit: int = TITLE_LIMIT, keep: int = TITLE_KEEP) -> Column:
    """Document title: missing item labelled, long titles cut to ``keep`` chars + '...'."""
    t = F.coalesce(c(title), F.lit(DELETED_ITEM_LABEL_PLAIN))
    return F.when(F.char_length(t) > limit, F.concat(F.substring(t, 1, keep), F.lit(TITLE_ELLIPSIS))).otherwise(t)


def eur(amount) -> Column:
    """'%.2f EUR' formatting (half-up to cents); NULL stays NULL. A decimal
    with scale 2 prints exactly two places, so no per-row String.format."""
    return F.concat(c(amount).cast("decimal(38,2)").cast("string"), F.lit(MONEY_SUFFIX))


def dmy(ts, missing: str = NO_DATE) -> Column:
    """dd/MM/yyyy date text, ``missing`` for NULL."""
    return F.coalesce(F.date_format(c(ts), DATE_FORMAT), F.lit(missing))


# White space as the shop's own stripping knows it: ASCII blanks and
# separators, NEL, NBSP and the Unicode space characters.
_BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(col) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(c(col), rf"\A{_BLANK}+", ""), rf"(?<!{_BLANK}){_BLANK}+\z", "")


def blank_to_null(col) -> Column:
    """Strip; empty text becomes NULL."""
    return F.nullif(strip(col), F.lit(""))
