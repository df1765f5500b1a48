"""Cart cookie parsing: JSON object {item_id: quantity} -> array of entries.

Semantics of the shop: every value goes through Python's ``int()``: JSON
integers stay, floats truncate toward zero, booleans are 1/0, strings must be
integer text (surrounding blanks and single underscores between digits
allowed); anything else -- or a value of another type, or text that is not a
JSON object -- empties the whole cart. A repeated key keeps its last value
(session conf ``spark.sql.variant.allowDuplicateKeys``). A missing cookie is
an empty cart.

Everything is evaluated per row with higher-order functions (no explode and
regroup, so no shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_TEXT = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
INTEGER_TYPES = ("BIGINT", "INT", "SMALLINT", "TINYINT")
ENTRY = "array<struct<item_key:string,item_id:bigint,quantity:bigint>>"


def int_of_text(s: Column) -> Column:
    """Python ``int(str)`` for plain integer text; NULL where it would raise."""
    cleaned = F.regexp_replace(F.regexp_replace(s, r"\s", ""), "_", "")
    return F.when(s.rlike(INT_TEXT), cleaned.try_cast("bigint"))


def int_of_variant(v: Column) -> Column:
    """Python ``int(value)`` of one JSON value; NULL where it would raise."""
    t = F.schema_of_variant(v)
    return (F.when(t.isin(*INTEGER_TYPES), F.try_variant_get(v, "$", "bigint"))
            .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"),
                  F.try_variant_get(v, "$", "double").try_cast("bigint"))
            .when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("bigint"))
            .when(t == "STRING", int_of_text(F.try_variant_get(v, "$", "string"))))


def cart_entries(raw: Column) -> Column:
    """Array<struct<item_key, item_id, quantity>> of a raw cart; empty when malformed."""
    m = F.try_variant_get(F.try_parse_json(F.coalesce(raw, F.lit("{}"))), "$", "map<string,variant>")
    entries = F.transform(F.map_entries(m), lambda e: F.struct(
        e["key"].alias("item_key"), int_of_text(e["key"]).alias("item_id"),
        int_of_variant(e["value"]).alias("quantity")))
    ok = m.isNotNull() & F.forall(entries, lambda e: e["quantity"].isNotNull())
    return F.when(ok, entries).otherwise(F.array().cast(ENTRY))


def cart_count(raw: Column) -> Column:
    """Sum of the parsed quantities; 0 for an empty or malformed cart."""
    return F.aggregate(cart_entries(raw), F.lit(0).cast("bigint"), lambda acc, e: acc + e["quantity"])


def cart_count_raw(raw: Column) -> Column:
    """The catalogue/account badge: sum of the *raw* JSON values (integers,
    floats and booleans add up as numbers; a value of any other type, or text
    that is not a JSON object, makes the count 0). Double, since floats stay
    fractional."""
    m = F.try_variant_get(F.try_parse_json(F.coalesce(raw, F.lit("{}"))), "$", "map<string,variant>")

    def num(v):
        t = F.schema_of_variant(v)
        return (F.when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double"))
                .when(t.isin(*INTEGER_TYPES) | t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"),
                      F.try_variant_get(v, "$", "double")))
    values = F.transform(F.map_values(m), num)
    ok = m.isNotNull() & F.forall(values, lambda x: x.isNotNull())
    return F.when(ok, F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)).otherwise(F.lit(0.0))
