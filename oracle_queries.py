"""Independent SQL oracles (DuckDB dialect) for ``__spark_entry__.oracle_sql``.

Each oracle restates the stand-in input rules (staging adapter) as CTEs over
the provided tables, then the cleaning and mart logic as plain SQL. Result
columns are cast to the types the Spark side produces, so both sides compare
value for value.
"""

from __future__ import annotations

DELETED = ("CASE WHEN {k} % 50 = 49 THEN 'true' WHEN {k} % 50 = 48 THEN NULL "
           "ELSE 'false' END AS __deleted")
MS = "(epoch_us({c}) // 1000)"

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: tuple[str, ...], sql: str) -> None:
    CTES[name] = (deps, sql)


# --- staging stand-ins -------------------------------------------------------
for _t, _key, _name, _bal, _contact in (("customers", "c_custkey", "c_name", "c_acctbal", True),
                                         ("admins", "s_suppkey", "s_name", "s_acctbal", False)):
    _src = "customer" if _t == "customers" else "supplier"
    cte(f"stg_{_t}", (), f"""
SELECT {_key} AS id, lower({_name}) || '@example.com' AS email,
       split_part({_name}, '#', 1) AS first_name, split_part({_name}, '#', 2) AS last_name,
       {"CAST(NULL AS VARCHAR) AS phone, CAST(NULL AS VARCHAR) AS address," if _contact else ""}
       CAST(CASE WHEN {_bal} >= 0 THEN 1 ELSE 0 END AS SMALLINT) AS is_active,
       1704067200000 + 1000 * {_key} AS __source_ts_ms, {DELETED.format(k=_key)}
FROM {_src}""")

cte("stg_items", (), f"""
SELECT id, title, description, image_url, price_ht, CAST(vat AS DOUBLE) AS tva_rate,
       CAST(round(CAST(price_ht AS DECIMAL(12,2)) * (1 + vat * CAST(0.01 AS DECIMAL(3,2))), 2) AS DOUBLE) AS price_ttc,
       quantity, __source_ts_ms AS created_at, __source_ts_ms AS updated_at, 'r' AS __op,
       __source_ts_ms AS __ts_ms, __source_ts_ms, __deleted
FROM (SELECT p_partkey AS id, p_name AS title, p_type AS description, CAST(NULL AS VARCHAR) AS image_url,
             p_retailprice AS price_ht,
             CAST(CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 5.5 WHEN 2 THEN 10 WHEN 3 THEN 20 END AS DECIMAL(5,2)) AS vat,
             CAST(CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size END AS INTEGER) AS quantity,
             1704067200000 + 1000 * p_partkey AS __source_ts_ms, {DELETED.format(k="p_partkey")}
      FROM part)""")

_TOTAL_HT = "round(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.80 AS DECIMAL(3,2)), 2)"
cte("stg_orders", (), f"""
SELECT o_orderkey AS id, o_custkey AS customer_id,
       CASE o_orderstatus WHEN 'F' THEN 'CONFIRMED' WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'SHIPPED' END AS status,
       CAST({_TOTAL_HT} AS DOUBLE) AS total_ht, o_totalprice AS total_ttc,
       {MS.format(c="o_orderdate")} AS __source_ts_ms, {DELETED.format(k="o_orderkey")}
FROM orders""")

cte("stg_order_items", (), f"""
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS order_id, l_partkey AS item_id,
       CAST(trunc(l_quantity) AS INTEGER) AS quantity, l_extendedprice AS unit_price_ht,
       CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 + CAST(l_tax AS DECIMAL(4,2))), 2) AS DOUBLE) AS unit_price_ttc,
       {MS.format(c="l_shipdate")} AS __source_ts_ms,
       {DELETED.format(k="(l_orderkey * 10 + l_linenumber)")}
FROM lineitem""")

cte("stg_payments", (), f"""
SELECT o_orderkey AS id, o_orderkey AS order_id, o_totalprice AS amount,
       CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'FAILED' END AS status,
       CASE o_orderkey % 3 WHEN 0 THEN 'CARD' WHEN 1 THEN 'BANK_TRANSFER' WHEN 2 THEN 'PAYPAL' END AS payment_method,
       'TXN-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS transaction_id,
       {MS.format(c="o_orderdate")} AS __source_ts_ms, {DELETED.format(k="o_orderkey")}
FROM orders""")

cte("stg_invoices", (), f"""
SELECT o_orderkey AS id, o_orderkey AS order_id,
       'INV-' || strftime(o_orderdate, '%Y%m%d') || '-' || CAST(o_orderkey AS VARCHAR) AS invoice_number,
       {MS.format(c="o_orderdate")} AS issued_at,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE {MS.format(c="o_orderdate")} + 2592000000 END AS due_date,
       CAST({_TOTAL_HT} AS DOUBLE) AS total_ht,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) - {_TOTAL_HT} AS DOUBLE) AS total_tva,
       o_totalprice AS total_ttc,
       {MS.format(c="o_orderdate")} AS __source_ts_ms, {DELETED.format(k="o_orderkey")}
FROM orders WHERE o_orderstatus = 'F'""")

# --- cleaned layer ------------------------------------------------------------
LIVE = "WHERE coalesce(__deleted, 'false') = 'false'"
TS = "epoch_ms({c})"
cte("dwh_admins", ("stg_admins",), f"""
SELECT id AS admin_id, email, first_name, last_name, (is_active = 1) AS is_active,
       {TS.format(c="__source_ts_ms")} AS source_updated_at FROM stg_admins {LIVE}""")
cte("dwh_customers", ("stg_customers",), f"""
SELECT id AS customer_id, email, first_name, last_name, phone, address, (is_active = 1) AS is_active,
       {TS.format(c="__source_ts_ms")} AS source_updated_at FROM stg_customers {LIVE}""")
cte("dwh_items", ("stg_items",), f"""
SELECT id AS item_id, title, description, image_url, CAST(price_ht AS DECIMAL(10,2)) AS price_ht,
       CAST(tva_rate AS DECIMAL(5,2)) AS tva_rate, CAST(price_ttc AS DECIMAL(10,2)) AS price_ttc,
       CAST(quantity AS INTEGER) AS quantity, {TS.format(c="__source_ts_ms")} AS source_updated_at
FROM stg_items {LIVE}""")
cte("dwh_orders", ("stg_orders",), f"""
SELECT id AS order_id, customer_id, lower(status) AS status, CAST(total_ht AS DECIMAL(10,2)) AS total_ht,
       CAST(total_ttc AS DECIMAL(10,2)) AS total_ttc, {TS.format(c="__source_ts_ms")} AS source_updated_at
FROM stg_orders {LIVE}""")
cte("dwh_order_items", ("stg_order_items",), f"""
SELECT id AS order_item_id, order_id, item_id, CAST(quantity AS INTEGER) AS quantity,
       CAST(unit_price_ht AS DECIMAL(10,2)) AS unit_price_ht, CAST(unit_price_ttc AS DECIMAL(10,2)) AS unit_price_ttc,
       CAST(quantity * unit_price_ht AS DECIMAL(10,2)) AS line_total_ht,
       CAST(quantity * unit_price_ttc AS DECIMAL(10,2)) AS line_total_ttc
FROM stg_order_items {LIVE}""")
cte("dwh_payments", ("stg_payments",), f"""
SELECT id AS payment_id, order_id, CAST(amount AS DECIMAL(10,2)) AS amount, status AS payment_status,
       payment_method, transaction_id, {TS.format(c="__source_ts_ms")} AS source_updated_at
FROM stg_payments {LIVE}""")
cte("dwh_invoices", ("stg_invoices",), f"""
SELECT id AS invoice_id, order_id, invoice_number, {TS.format(c="issued_at")} AS issued_at,
       {TS.format(c="due_date")} AS due_date, CAST(total_ht AS DECIMAL(10,2)) AS total_ht,
       CAST(total_tva AS DECIMAL(10,2)) AS total_tva, CAST(total_ttc AS DECIMAL(10,2)) AS total_ttc,
       {TS.format(c="__source_ts_ms")} AS source_updated_at
FROM stg_invoices {LIVE}""")


def _closure(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in CTES[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_ctes(uses: tuple[str, ...], body: str) -> str:
    """Prefix ``body`` with the CTEs it uses (and theirs), in dependency order."""
    parts = [f"{n} AS ({CTES[n][1].strip()})" for n in _closure(uses)]
    body = body.strip()
    if body.upper().startswith("WITH "):  # merge the body's own CTEs
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


ORACLES: dict[str, str] = {}


def oracle(name: str, uses: tuple[str, ...], body: str) -> None:
    ORACLES[name] = with_ctes(uses, body)


for _t in ("admins", "customers", "items", "orders", "order_items", "payments", "invoices"):
    oracle(f"dwh_{_t}", (f"dwh_{_t}",), f"SELECT * FROM dwh_{_t}")

AS_OF = "1997-01-01"  # fixed as-of date for the invoice due status in compared runs

CONF = "SELECT * FROM dwh_orders WHERE status = 'confirmed'"

oracle("mart_sales_daily", ("dwh_orders", "dwh_order_items"), f"""
WITH per_day AS (
  SELECT CAST(k.source_updated_at AS DATE) AS order_date, count(DISTINCT k.order_id) AS nb_orders,
         CAST(sum(l.quantity) AS BIGINT) AS units_sold, CAST(sum(l.line_total_ht) AS DECIMAL(20,2)) AS revenue_ht,
         CAST(sum(l.line_total_ttc) AS DECIMAL(20,2)) AS revenue_ttc
  FROM ({CONF}) k JOIN dwh_order_items l USING (order_id)
  GROUP BY CAST(k.source_updated_at AS DATE))
SELECT *, CAST(sum(revenue_ttc) OVER (ORDER BY order_date ASC NULLS LAST) AS DECIMAL(30,2)) AS cumulative_revenue_ttc
FROM per_day""")

oracle("mart_revenue_by_item", ("dwh_items", "dwh_order_items", "dwh_orders"), f"""
WITH sold AS (
  SELECT l.item_id, count(DISTINCT l.order_id) AS n, sum(l.quantity) AS u, sum(l.line_total_ht) AS ht,
         sum(l.line_total_ttc) AS ttc
  FROM dwh_order_items l JOIN ({CONF}) k USING (order_id) GROUP BY l.item_id)
SELECT item_id, title, price_ht, price_ttc, tva_rate, quantity AS current_stock, coalesce(n, 0) AS nb_orders,
       CAST(coalesce(u, 0) AS BIGINT) AS total_units_sold, CAST(coalesce(ht, 0) AS DECIMAL(20,2)) AS total_revenue_ht,
       CAST(coalesce(ttc, 0) AS DECIMAL(20,2)) AS total_revenue_ttc
FROM dwh_items LEFT JOIN sold USING (item_id)""")

oracle("mart_customer_lifetime", ("dwh_customers", "dwh_orders"), f"""
WITH per_customer AS (
  SELECT customer_id, count(order_id) AS n, sum(total_ttc) AS total, avg(total_ttc) AS mean,
         min(source_updated_at) AS first_at, max(source_updated_at) AS last_at
  FROM ({CONF}) GROUP BY customer_id),
joined AS (
  SELECT customer_id, first_name, last_name, email, coalesce(n, 0) AS nb_orders,
         CAST(coalesce(total, 0) AS DECIMAL(20,2)) AS lifetime_value_ttc,
         CAST(coalesce(mean, 0) AS DECIMAL(16,6)) AS avg_basket_ttc, first_at AS first_order_at, last_at AS last_order_at
  FROM dwh_customers LEFT JOIN per_customer USING (customer_id))
SELECT *, CASE WHEN nb_orders >= 5 THEN 'loyal' WHEN nb_orders >= 2 THEN 'recurring'
               WHEN nb_orders = 1 THEN 'one_time' ELSE 'no_order' END AS customer_segment
FROM joined""")

oracle("mart_customer_reorders", ("dwh_order_items", "dwh_orders", "dwh_items"), f"""
WITH bought AS (
  SELECT k.customer_id, l.item_id, CAST(sum(l.quantity) AS BIGINT) AS total_qty_purchased,
         count(DISTINCT l.order_id) AS nb_orders_with_item, max(k.source_updated_at) AS last_purchased_at
  FROM dwh_order_items l JOIN ({CONF}) k USING (order_id) GROUP BY k.customer_id, l.item_id)
SELECT b.customer_id, b.item_id, it.title, it.price_ttc, b.total_qty_purchased, b.nb_orders_with_item,
       b.last_purchased_at, it.quantity AS current_stock
FROM bought b JOIN dwh_items it USING (item_id)""")

oracle("mart_payments", ("dwh_payments", "dwh_orders", "dwh_customers"), """
WITH owners AS (SELECT order_id, customer_id FROM dwh_orders),
people AS (SELECT customer_id, first_name, last_name, email FROM dwh_customers)
SELECT payment_id, order_id, customer_id, first_name, last_name, email, amount, payment_status, payment_method,
       transaction_id, source_updated_at AS paid_at
FROM dwh_payments JOIN owners USING (order_id) JOIN people USING (customer_id)""")

oracle("mart_invoices", ("dwh_invoices", "dwh_orders", "dwh_customers"), f"""
WITH owners AS (SELECT order_id, customer_id FROM dwh_orders),
people AS (SELECT customer_id, first_name, last_name, email FROM dwh_customers)
SELECT invoice_id, invoice_number, order_id, customer_id, first_name, last_name, email, total_ht, total_tva, total_ttc,
       issued_at, due_date,
       CASE WHEN due_date IS NOT NULL AND due_date < DATE '{AS_OF}' THEN 'overdue' ELSE 'on_time' END AS due_status
FROM dwh_invoices JOIN owners USING (order_id) JOIN people USING (customer_id)""")

# --- change capture and staging ------------------------------------------------
_OP = ("CASE event_type WHEN 'signup' THEN 'c' WHEN 'click' THEN 'u' WHEN 'view' THEN 'u' "
       "WHEN 'purchase' THEN 'u' WHEN 'error' THEN 'd' END")
cte("stg_change_log", (), f"""
SELECT user_id AS id, value, props, {_OP} AS __op, {MS.format(c="ts")} AS __ts_ms,
       {MS.format(c="ts")} AS __source_ts_ms,
       CASE WHEN {_OP} = 'd' THEN 'true' ELSE 'false' END AS __deleted, event_id AS "offset", event_type
FROM events""")
cte("unwrapped", ("stg_change_log",), """
SELECT CASE WHEN event_type = 'error' THEN 'schema-changes.ecommerce' ELSE 'ecommerce.ecommerce.' || event_type END
         AS topic, CAST(id AS VARCHAR) AS "key", "offset", id, value, props, __op, __ts_ms, __source_ts_ms, __deleted
FROM stg_change_log""")
_LATEST = """
SELECT id, value, props, __op, __ts_ms, __source_ts_ms, __deleted, "offset" FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY __source_ts_ms DESC NULLS LAST, "offset" DESC) AS rn
  FROM stg_change_log) WHERE rn = 1"""
oracle("cdc_unwrap", ("unwrapped",), "SELECT * FROM unwrapped")
oracle("cdc_decode", ("unwrapped",), "SELECT * FROM unwrapped")
oracle("cdc_route", ("unwrapped",), r"""
SELECT *, regexp_extract(topic, '^ecommerce\.ecommerce\.(.*)$', 1) AS "table" FROM unwrapped
WHERE regexp_matches(topic, '^ecommerce\.ecommerce\.(.*)$')""")
oracle("staging_upsert", ("stg_change_log",), _LATEST)
oracle("staging_merge", ("stg_change_log",), _LATEST)
oracle("schema_evolve", ("stg_change_log",), """
SELECT id, value, CASE WHEN event_type IN ('signup', 'error') THEN NULL ELSE props END AS props,
       __op, __ts_ms, __source_ts_ms, __deleted, "offset" FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY __source_ts_ms DESC NULLS LAST, "offset" DESC) AS rn
  FROM stg_change_log) WHERE rn = 1""")
oracle("cdc_bad_records", ("stg_change_log",), """
SELECT "offset", CASE WHEN "offset" % 7 IN (1, 3) THEN 'rejected' ELSE 'decoded' END AS outcome FROM stg_change_log""")
oracle("cdc_snapshot_then_stream", ("stg_customers", "stg_change_log"), """
SELECT id, email, __ts_ms, __source_ts_ms, value, props, __op, __deleted, "offset" FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY __source_ts_ms DESC NULLS LAST, "offset" DESC) AS rn
  FROM (SELECT id, email, __source_ts_ms AS __ts_ms, __source_ts_ms, CAST(NULL AS DOUBLE) AS value,
               CAST(NULL AS VARCHAR) AS props, 'r' AS __op, 'false' AS __deleted, CAST(-1 AS BIGINT) AS "offset"
        FROM stg_customers
        UNION ALL
        SELECT id, NULL, __ts_ms, __source_ts_ms, value, props, __op, __deleted, "offset" FROM stg_change_log))
WHERE rn = 1""")

# --- shop reads ------------------------------------------------------------------
CONFIRMED_LINES = """SELECT oi.*, o.customer_id, o.source_updated_at AS order_time FROM dwh_order_items oi
  JOIN dwh_orders o ON o.order_id = oi.order_id WHERE o.status = 'confirmed'"""
oracle("catalog_in_stock", ("dwh_items",), "SELECT * FROM dwh_items WHERE quantity > 0")
oracle("items_by_newest", ("dwh_items",), "SELECT * FROM dwh_items")
oracle("reorder_suggestions", ("dwh_items", "dwh_order_items", "dwh_orders"), f"""
SELECT * FROM (
  SELECT p.item_id, p.customer_id, i.title, i.price_ttc, i.quantity,
         CAST(row_number() OVER (PARTITION BY p.customer_id ORDER BY p.item_id DESC) AS INTEGER) AS rank
  FROM (SELECT DISTINCT customer_id, item_id FROM ({CONFIRMED_LINES})) p
  JOIN dwh_items i ON i.item_id = p.item_id WHERE i.quantity > 0)
WHERE rank <= 8""")
oracle("purchased_in_stock", ("dwh_items", "dwh_order_items", "dwh_orders"), f"""
SELECT * FROM dwh_items WHERE quantity > 0 AND item_id IN (SELECT item_id FROM ({CONFIRMED_LINES}))""")
INITCAP = "upper(substr({c}, 1, 1)) || lower(substr({c}, 2))"
oracle("order_history", ("dwh_orders", "dwh_order_items", "dwh_items"), f"""
SELECT o.customer_id, o.order_id, {INITCAP.format(c="o.status")} AS status_label, o.total_ttc,
       o.source_updated_at AS ordered_at, oi.order_item_id, oi.item_id,
       CASE WHEN oi.order_item_id IS NOT NULL THEN coalesce(i.title, 'Article supprimé') END AS title,
       oi.quantity, oi.unit_price_ttc, CAST(oi.unit_price_ttc * oi.quantity AS DECIMAL(20,2)) AS line_total_ttc
FROM dwh_orders o LEFT JOIN dwh_order_items oi ON oi.order_id = o.order_id
LEFT JOIN dwh_items i ON i.item_id = oi.item_id""")
oracle("customer_payments", ("dwh_payments", "dwh_orders"), """
SELECT p.*, o.customer_id FROM dwh_payments p JOIN dwh_orders o ON o.order_id = p.order_id""")
oracle("customer_invoices", ("dwh_invoices", "dwh_orders"), """
SELECT v.*, o.customer_id FROM dwh_invoices v JOIN dwh_orders o ON o.order_id = v.order_id""")
EUR = "CASE WHEN {c} IS NOT NULL THEN printf('%.2f EUR', CAST({c} AS DOUBLE)) END"
DMY = "coalesce(strftime({c}, '%d/%m/%Y'), '-')"
oracle("invoice_lines", ("dwh_invoices", "dwh_orders", "dwh_order_items", "dwh_items"), f"""
SELECT v.invoice_id, v.invoice_number, o.customer_id, {DMY.format(c="v.issued_at")} AS issued_on,
       {DMY.format(c="v.due_date")} AS due_on, {EUR.format(c="v.total_ht")} AS total_ht_text,
       {EUR.format(c="v.total_tva")} AS total_tva_text, {EUR.format(c="v.total_ttc")} AS total_ttc_text,
       oi.order_item_id,
       CASE WHEN oi.order_item_id IS NOT NULL THEN
         CASE WHEN length(coalesce(i.title, 'Article supprime')) > 40
              THEN substr(coalesce(i.title, 'Article supprime'), 1, 37) || '...'
              ELSE coalesce(i.title, 'Article supprime') END END AS title,
       oi.quantity, {EUR.format(c="oi.unit_price_ht")} AS unit_ht_text, {EUR.format(c="oi.unit_price_ttc")} AS unit_ttc_text,
       CAST(round(oi.unit_price_ttc * oi.quantity, 2) AS DECIMAL(20,2)) AS line_ttc,
       {EUR.format(c="round(oi.unit_price_ttc * oi.quantity, 2)")} AS line_ttc_text
FROM dwh_invoices v JOIN dwh_orders o ON o.order_id = v.order_id
LEFT JOIN dwh_order_items oi ON oi.order_id = v.order_id LEFT JOIN dwh_items i ON i.item_id = oi.item_id""")
cte("conf_requests", (), """
SELECT o_orderkey AS order_id, o_custkey AS customer_id FROM orders
UNION ALL SELECT o_orderkey, o_custkey + 1 FROM orders""")
oracle("order_confirmation", ("conf_requests", "dwh_orders", "dwh_order_items", "dwh_items"), """
SELECT o.order_id, o.customer_id, o.status, o.total_ht, o.total_ttc, oi.order_item_id, oi.item_id, i.title,
       oi.quantity, CAST(round(oi.unit_price_ttc * oi.quantity, 2) AS DECIMAL(20,2)) AS subtotal_ttc
FROM conf_requests r JOIN dwh_orders o ON o.order_id = r.order_id AND o.customer_id = r.customer_id
LEFT JOIN dwh_order_items oi ON oi.order_id = o.order_id LEFT JOIN dwh_items i ON i.item_id = oi.item_id""")
PRICE_EXACT = "round(CAST({ht} AS DECIMAL(12,2)) * (1 + CAST({vat} AS DECIMAL(5,2)) * CAST(0.01 AS DECIMAL(3,2))), 2)"
oracle("item_pricing", ("stg_items",), f"""
SELECT id, price_ht, tva_rate, CAST({PRICE_EXACT.format(ht="price_ht", vat="tva_rate")} AS DECIMAL(10,2)) AS price_ttc
FROM stg_items""")

# --- carts -----------------------------------------------------------------------
N_PARTS = "(SELECT count(*) FROM part)"
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
cte("cart_lines", (), f"""
SELECT user_id AS cart_id, ({K} * 20) % {N_PARTS} AS item_id, CAST(1 + event_id % 5 AS INTEGER) AS quantity,
       event_id AS arrival
FROM events WHERE event_type = 'purchase'""")
cte("cart_items", ("cart_lines",), """
SELECT cart_id, item_id, CAST(SUM(quantity) AS BIGINT) AS q FROM cart_lines GROUP BY cart_id, item_id""")
cte("cart_ids", ("cart_lines",), "SELECT DISTINCT cart_id FROM cart_lines")
oracle("cart_parse", ("cart_items",), """
SELECT cart_id, CAST(item_id AS VARCHAR) AS item_key, item_id, q AS quantity FROM cart_items""")
oracle("cart_count", ("cart_items",), """
SELECT cart_id, CAST(SUM(q) AS BIGINT) AS cart_count FROM cart_items GROUP BY cart_id""")
cte("priced_cart_lines", ("cart_items", "dwh_items"), """
SELECT c.cart_id, c.item_id, c.q AS quantity, round(i.price_ht * c.q, 2) AS subtotal_ht,
       round(i.price_ttc * c.q, 2) AS subtotal_ttc
FROM cart_items c JOIN dwh_items i ON i.item_id = c.item_id WHERE c.q > 0""")
oracle("cart_pricing", ("cart_ids", "priced_cart_lines"), """
SELECT k.cart_id, CAST(coalesce(t.n, 0) AS BIGINT) AS n_lines, CAST(round(coalesce(t.s, 0), 2) AS DECIMAL(20,2)) AS total_ttc
FROM cart_ids k LEFT JOIN (SELECT cart_id, count(*) AS n, sum(subtotal_ttc) AS s FROM priced_cart_lines GROUP BY 1) t
ON t.cart_id = k.cart_id""")
oracle("checkout_summary", ("cart_ids", "priced_cart_lines"), """
SELECT k.cart_id, CAST(round(coalesce(t.h, 0), 2) AS DECIMAL(20,2)) AS total_ht,
       CAST(round(coalesce(t.s, 0), 2) AS DECIMAL(20,2)) AS total_ttc
FROM cart_ids k LEFT JOIN (SELECT cart_id, sum(subtotal_ht) AS h, sum(subtotal_ttc) AS s FROM priced_cart_lines GROUP BY 1) t
ON t.cart_id = k.cart_id""")

# --- orders ----------------------------------------------------------------------
cte("order_requests", ("cart_lines",), """
SELECT arrival AS request_id, cart_id AS customer_id, item_id, quantity, arrival, 0 AS line_no FROM cart_lines""")
cte("alloc", ("order_requests", "dwh_items"), """
SELECT request_id, customer_id, item_id, line_no, requested, allotted AS quantity, price_ht AS unit_price_ht,
       price_ttc AS unit_price_ttc, round(price_ht * allotted, 2) AS subtotal_ht,
       round(price_ttc * allotted, 2) AS subtotal_ttc
FROM (SELECT *, CAST(greatest(0, least(requested, stock - prior)) AS INTEGER) AS allotted FROM (
  SELECT r.request_id, r.customer_id, r.item_id, r.line_no, r.quantity AS requested, i.quantity AS stock,
         i.price_ht, i.price_ttc,
         coalesce(SUM(r.quantity) OVER (PARTITION BY r.item_id ORDER BY r.arrival, r.request_id, r.line_no
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM order_requests r JOIN dwh_items i ON i.item_id = r.item_id WHERE r.quantity > 0))""")
oracle("allocate_orders", ("alloc",), """
SELECT request_id, customer_id, item_id, line_no, requested, quantity, unit_price_ht, unit_price_ttc,
       CAST(subtotal_ht AS DECIMAL(20,2)) AS subtotal_ht, CAST(subtotal_ttc AS DECIMAL(20,2)) AS subtotal_ttc
FROM alloc""")
cte("order_totals", ("order_requests", "alloc"), """
SELECT h.request_id AS order_id, h.customer_id, round(coalesce(t.h, 0), 2) AS total_ht,
       round(coalesce(t.s, 0), 2) AS total_ttc
FROM (SELECT request_id, min(customer_id) AS customer_id FROM order_requests GROUP BY 1) h
LEFT JOIN (SELECT request_id, sum(subtotal_ht) AS h, sum(subtotal_ttc) AS s FROM alloc GROUP BY 1) t
ON t.request_id = h.request_id""")
oracle("order_totals", ("order_totals",), """
SELECT order_id, customer_id, CAST(total_ht AS DECIMAL(20,2)) AS total_ht, CAST(total_ttc AS DECIMAL(20,2)) AS total_ttc
FROM order_totals""")
oracle("stock_after_orders", ("dwh_items", "alloc"), """
SELECT i.item_id, i.quantity AS stock_before, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken,
       CAST(i.quantity - coalesce(t.taken, 0) AS BIGINT) AS stock_after
FROM dwh_items i LEFT JOIN (SELECT item_id, sum(quantity) AS taken FROM alloc GROUP BY 1) t ON t.item_id = i.item_id""")
HEX = "upper(sha256(CAST(order_id AS VARCHAR)))"
oracle("derive_payments", ("order_totals",), f"""
SELECT order_id, CAST(total_ttc AS DECIMAL(20,2)) AS amount, 'COMPLETED' AS status,
       CASE CAST(('0x' || substr({HEX}, 13, 8)) AS BIGINT) % 3 WHEN 0 THEN 'CARD' WHEN 1 THEN 'BANK_TRANSFER'
            ELSE 'PAYPAL' END AS payment_method,
       'TXN-' || substr({HEX}, 1, 12) AS transaction_id
FROM order_totals""")
ISSUED = "TIMESTAMP '2024-06-30 10:00:00'"
oracle("derive_invoices", ("order_totals",), f"""
SELECT order_id, 'INV-' || strftime({ISSUED}, '%Y%m%d') || '-' || printf('%06X', order_id) AS invoice_number,
       {ISSUED} AS issued_at, {ISSUED} + INTERVAL 30 DAY AS due_date,
       CAST(total_ht AS DECIMAL(20,2)) AS total_ht, CAST(round(total_ttc - total_ht, 2) AS DECIMAL(20,2)) AS total_tva,
       CAST(total_ttc AS DECIMAL(20,2)) AS total_ttc
FROM order_totals""")

# --- cart state ------------------------------------------------------------------
cte("cart_events", (), f"""
SELECT user_id AS cart_id, ({K} * 20) % {N_PARTS} AS item_id,
       CASE event_type WHEN 'purchase' THEN 'add' WHEN 'click' THEN 'add' WHEN 'view' THEN 'update'
            WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'clear' END AS action,
       CAST(floor(value) - 5 AS INTEGER) AS quantity, ts, event_id AS arrival
FROM events""")
SEC = "(epoch_us({c}) // 1000000)"
def _cart_state_sql(as_of_sql: str) -> str:
    return f"""
WITH a AS (SELECT e.*, i.quantity AS stock FROM cart_events e LEFT JOIN dwh_items i ON i.item_id = e.item_id),
eff AS (SELECT * FROM a WHERE (action = 'add' AND stock > 0) OR action IN ('update', 'remove', 'clear')),
g AS (SELECT *, lag(ts) OVER (PARTITION BY cart_id ORDER BY arrival) AS prev_ts FROM eff),
pc AS (SELECT cart_id,
              max(CASE WHEN action = 'clear' THEN arrival * 2 + 1
                       WHEN {SEC.format(c="ts")} - {SEC.format(c="prev_ts")} > 604800 THEN arrival * 2 - 1 END) AS reset_point,
              max(arrival) AS last_arrival FROM g GROUP BY cart_id),
lastev AS (SELECT g.cart_id, g.ts AS last_ts, g.action = 'clear' AS cleared FROM g JOIN pc
           ON pc.cart_id = g.cart_id AND pc.last_arrival = g.arrival),
ev AS (SELECT e.* FROM eff e JOIN pc ON pc.cart_id = e.cart_id
       WHERE e.action <> 'clear' AND (pc.reset_point IS NULL OR e.arrival * 2 > pc.reset_point)),
sets AS (SELECT *, row_number() OVER (PARTITION BY cart_id, item_id ORDER BY arrival DESC) AS rn FROM ev
         WHERE action = 'remove' OR (action = 'update' AND (quantity <= 0 OR stock IS NOT NULL))),
bases AS (SELECT cart_id, item_id, arrival AS base_arrival,
                 CASE WHEN action = 'update' AND quantity > 0 THEN least(quantity, stock) END AS base
          FROM sets WHERE rn = 1),
adds AS (SELECT e.cart_id, e.item_id, sum(greatest(1, e.quantity)) AS added, min(e.stock) AS stock
         FROM ev e LEFT JOIN bases b ON b.cart_id = e.cart_id AND b.item_id = e.item_id
         WHERE e.action = 'add' AND (b.base_arrival IS NULL OR e.arrival > b.base_arrival)
         GROUP BY e.cart_id, e.item_id),
st AS (SELECT coalesce(b.cart_id, d.cart_id) AS cart_id, coalesce(b.item_id, d.item_id) AS item_id,
              CAST(CASE WHEN d.added IS NOT NULL THEN least(coalesce(b.base, 0) + d.added, d.stock) ELSE b.base END
                   AS BIGINT) AS quantity
       FROM bases b FULL OUTER JOIN adds d ON d.cart_id = b.cart_id AND d.item_id = b.item_id)
SELECT st.* FROM st JOIN lastev l ON l.cart_id = st.cart_id
WHERE st.quantity IS NOT NULL AND NOT l.cleared
  AND {SEC.format(c=as_of_sql)} - {SEC.format(c="l.last_ts")} <= 604800"""


oracle("cart_state_batch", ("cart_events", "dwh_items"), _cart_state_sql("TIMESTAMP '2024-02-05 00:00:00'"))
oracle("cart_state_stream", ("cart_events", "dwh_items"), _cart_state_sql("(SELECT max(ts) FROM events)"))

# --- customers -------------------------------------------------------------------
cte("candidates", (), """
SELECT event_id AS arrival, lower('Customer#' || lpad(CAST(user_id * 13 AS VARCHAR), 9, '0')) || '@example.com' AS email,
       '  New ' AS first_name, 'Customer#' || lpad(CAST(user_id * 13 AS VARCHAR), 9, '0') AS last_name,
       ' ' AS phone, CAST(NULL AS VARCHAR) AS address
FROM events WHERE event_type = 'signup'""")
oracle("profile_normalise", ("candidates",), """
WITH b AS (SELECT string_agg(chr(i::INTEGER), '') AS ws FROM (SELECT unnest(
  [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288]) AS i))
SELECT arrival, trim(first_name, ws) AS first_name, trim(last_name, ws) AS last_name,
       nullif(trim(phone, ws), '') AS phone, nullif(trim(address, ws), '') AS address FROM candidates, b""")
oracle("register_new_customers", ("candidates", "dwh_customers"), """
SELECT email, first_name, last_name, nullif(phone, '') AS phone, nullif(address, '') AS address, arrival FROM (
  SELECT c.*, row_number() OVER (PARTITION BY email ORDER BY arrival) AS rn FROM candidates c
  WHERE NOT EXISTS (SELECT 1 FROM dwh_customers d WHERE d.email = c.email)) WHERE rn = 1""")
_IOP = ("CASE event_type WHEN 'signup' THEN 'c' WHEN 'click' THEN 'u' WHEN 'view' THEN 'u' "
        "WHEN 'purchase' THEN 'u' WHEN 'error' THEN 'd' END")
cte("item_actions", (), f"""
SELECT action, CASE WHEN action = 'c' THEN {N_PARTS} + event_id ELSE (k * 20) % {N_PARTS} END AS id,
       'item ' || CAST(k AS VARCHAR) AS title, CASE WHEN k % 10 = 0 THEN '' ELSE event_type END AS description,
       value AS price_ht, CASE k % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 5.5 WHEN 2 THEN 10.0 WHEN 3 THEN 20.0 END AS tva_rate,
       CAST(k % 7 AS INTEGER) AS quantity, {MS.format(c="ts")} AS ts_ms, event_id AS "offset"
FROM (SELECT *, {K} AS k, {_IOP} AS action FROM events)""")
oracle("item_changes", ("item_actions", "stg_items"), f"""
WITH cur AS (SELECT * FROM stg_items WHERE coalesce(__deleted, 'false') = 'false'),
chg AS (
  SELECT a.id,
         CASE WHEN a.action = 'd' THEN c.title ELSE a.title END AS title,
         CASE WHEN a.action = 'd' THEN c.description ELSE nullif(a.description, '') END AS description,
         c.image_url AS image_url,
         CASE WHEN a.action = 'd' THEN c.price_ht ELSE a.price_ht END AS price_ht,
         CASE WHEN a.action = 'd' THEN c.tva_rate ELSE a.tva_rate END AS tva_rate,
         CASE WHEN a.action = 'd' THEN c.price_ttc
              ELSE CAST({PRICE_EXACT.format(ht="a.price_ht", vat="a.tva_rate")} AS DOUBLE) END AS price_ttc,
         CASE WHEN a.action = 'd' THEN c.quantity ELSE a.quantity END AS quantity,
         CASE WHEN a.action = 'c' THEN a.ts_ms ELSE c.created_at END AS created_at, a.ts_ms AS updated_at,
         a.action AS __op, a.ts_ms AS __ts_ms, a.ts_ms AS __source_ts_ms,
         CASE WHEN a.action = 'd' THEN 'true' ELSE 'false' END AS __deleted, a."offset"
  FROM item_actions a LEFT JOIN cur c ON c.id = a.id WHERE a.action = 'c' OR c.id IS NOT NULL),
u AS (SELECT id, title, description, image_url, price_ht, tva_rate, price_ttc, quantity, created_at, updated_at,
             __op, __ts_ms, __source_ts_ms, __deleted, CAST(-1 AS BIGINT) AS "offset" FROM stg_items
      UNION ALL SELECT * FROM chg)
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY __source_ts_ms DESC NULLS LAST, "offset" DESC) AS rn FROM u)
WHERE rn = 1""")

# --- labels ----------------------------------------------------------------------
oracle("payment_labels", ("dwh_payments",), """
SELECT payment_id,
       CASE WHEN payment_method IS NULL THEN '—' WHEN lower(payment_method) = 'card' THEN 'Carte'
            WHEN lower(payment_method) = 'paypal' THEN 'PayPal' ELSE 'Virement' END AS method_label,
       CASE WHEN lower(payment_status) = 'completed' THEN 'Payé' WHEN lower(payment_status) = 'pending' THEN 'En attente'
            WHEN lower(payment_status) = 'failed' THEN 'Échoué' ELSE 'Remboursé' END AS status_label,
       coalesce(transaction_id, '—') AS transaction_label
FROM dwh_payments""")
oracle("order_status_label", ("dwh_orders",), f"""
SELECT order_id, status, {INITCAP.format(c="status")} AS status_label FROM dwh_orders""")
oracle("stock_level", ("dwh_items",), """
SELECT item_id, quantity,
       CASE WHEN quantity <= 0 THEN 'out' WHEN quantity < 5 THEN 'low' WHEN quantity IS NOT NULL THEN 'ok' END AS stock_level,
       CAST(trunc(tva_rate) AS INTEGER) AS tva_rate_shown
FROM dwh_items""")

# --- data-quality checks ---------------------------------------------------------
_ALL_DWH = tuple(f"dwh_{t}" for t in ("admins", "customers", "items", "orders", "order_items", "payments", "invoices"))
_UNIQUE = (("customers.email", "dwh_customers", "email"), ("admins.email", "dwh_admins", "email"),
           ("invoices.invoice_number", "dwh_invoices", "invoice_number"),
           ("payments.order_id", "dwh_payments", "order_id"), ("invoices.order_id", "dwh_invoices", "order_id"),
           ("order_items.order_item_id", "dwh_order_items", "order_item_id"))
oracle("dq_unique", _ALL_DWH, "\nUNION ALL\n".join(
    f"SELECT '{n}' AS \"check\", CAST({c} AS VARCHAR) AS \"key\", count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1"
    for n, t, c in _UNIQUE))
_FK = (("orders.customer_id", "dwh_orders", "order_id", "customer_id", "dwh_customers", "customer_id"),
       ("order_items.order_id", "dwh_order_items", "order_item_id", "order_id", "dwh_orders", "order_id"),
       ("order_items.item_id", "dwh_order_items", "order_item_id", "item_id", "dwh_items", "item_id"),
       ("payments.order_id", "dwh_payments", "payment_id", "order_id", "dwh_orders", "order_id"),
       ("invoices.order_id", "dwh_invoices", "invoice_id", "order_id", "dwh_orders", "order_id"))
oracle("dq_foreign_keys", _ALL_DWH, "\nUNION ALL\n".join(
    f"SELECT '{n}' AS \"check\", c.{cid} AS id, c.{fk} AS parent_id FROM {ct} c "
    f"WHERE NOT EXISTS (SELECT 1 FROM {pt} p WHERE p.{pk} = c.{fk})"
    for n, ct, cid, fk, pt, pk in _FK))
_REQUIRED = {
    "admins": ("admin_id", "email", "first_name", "last_name"),
    "items": ("item_id", "title", "price_ht", "tva_rate", "price_ttc"),
    "orders": ("order_id", "customer_id", "status", "total_ht", "total_ttc"),
    "order_items": ("order_item_id", "order_id", "item_id", "quantity", "unit_price_ht", "unit_price_ttc"),
    "customers": ("customer_id", "email", "first_name", "last_name"),
    "payments": ("payment_id", "order_id", "amount"),
    "invoices": ("invoice_id", "order_id", "invoice_number", "total_ht", "total_tva", "total_ttc"),
}
oracle("dq_not_null", _ALL_DWH, "\nUNION ALL\n".join(
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM dwh_{t}"
    for t, cols in _REQUIRED.items() for c in cols))
oracle("dq_domains", _ALL_DWH, r"""
SELECT 'orders.status' AS "check", order_id AS id, CAST(status AS VARCHAR) AS value FROM dwh_orders
 WHERE lower(status) NOT IN ('pending', 'confirmed', 'shipped', 'delivered', 'cancelled')
UNION ALL SELECT 'payments.payment_status', payment_id, payment_status FROM dwh_payments
 WHERE lower(payment_status) NOT IN ('pending', 'completed', 'failed', 'refunded')
UNION ALL SELECT 'payments.payment_method', payment_id, payment_method FROM dwh_payments
 WHERE lower(payment_method) NOT IN ('card', 'bank_transfer', 'paypal')
UNION ALL SELECT 'items.tva_rate', item_id, CAST(tva_rate AS VARCHAR) FROM dwh_items
 WHERE tva_rate NOT IN (0, 5.5, 10, 20)
UNION ALL SELECT 'customers.email', customer_id, email FROM dwh_customers
 WHERE NOT regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$')
UNION ALL SELECT 'admins.email', admin_id, email FROM dwh_admins
 WHERE NOT regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$')""")
oracle("dq_reconcile", _ALL_DWH, """
SELECT "check", order_id, CAST(expected AS DECIMAL(22,2)) AS expected, CAST(actual AS DECIMAL(22,2)) AS actual FROM (
  SELECT 'payment.amount' AS "check", p.order_id, o.total_ttc AS expected, p.amount AS actual
  FROM dwh_payments p JOIN dwh_orders o ON o.order_id = p.order_id WHERE p.amount IS DISTINCT FROM o.total_ttc
  UNION ALL SELECT 'invoice.total_ht', v.order_id, o.total_ht, v.total_ht
  FROM dwh_invoices v JOIN dwh_orders o ON o.order_id = v.order_id WHERE v.total_ht IS DISTINCT FROM o.total_ht
  UNION ALL SELECT 'invoice.total_ttc', v.order_id, o.total_ttc, v.total_ttc
  FROM dwh_invoices v JOIN dwh_orders o ON o.order_id = v.order_id WHERE v.total_ttc IS DISTINCT FROM o.total_ttc
  UNION ALL SELECT 'invoice.total_tva', v.order_id, v.total_ttc - v.total_ht, v.total_tva
  FROM dwh_invoices v JOIN dwh_orders o ON o.order_id = v.order_id WHERE v.total_tva IS DISTINCT FROM v.total_ttc - v.total_ht
  UNION ALL SELECT 'order.lines_ttc', order_id, s, total_ttc FROM (
    SELECT o.order_id, o.total_ttc, (SELECT coalesce(sum(line_total_ttc), 0) FROM dwh_order_items l WHERE l.order_id = o.order_id) AS s,
           (SELECT count(*) FROM dwh_order_items l WHERE l.order_id = o.order_id) AS n FROM dwh_orders o)
  WHERE abs(s - total_ttc) > n * CAST(0.01 AS DECIMAL(3,2)))""")

# --- whole pipeline runs -----------------------------------------------------------
_MART_BODIES = {k: v for k, v in ORACLES.items() if k.startswith("mart_")}
oracle("refresh_pipeline", _ALL_DWH, "\nUNION ALL\n".join(
    [f"SELECT 'dwh.{t[4:]}' AS table_name, count(*) AS n_rows FROM {t}" for t in _ALL_DWH]
    + [f"SELECT 'dmart.{m}' AS table_name, count(*) AS n_rows FROM ({body.replace(chr(10), ' ')})"
       for m, body in sorted(_MART_BODIES.items())]))
oracle("cdc_stream_ingest", ("stg_change_log",), """
SELECT id, value, props, __op, __ts_ms, __source_ts_ms, __deleted, "offset", event_type AS "table" FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type, id ORDER BY __source_ts_ms DESC NULLS LAST, "offset" DESC) AS rn
  FROM stg_change_log WHERE event_type <> 'error') WHERE rn = 1""")
oracle("cart_count_raw", ("cart_items",), """
SELECT cart_id, CAST(SUM(q) AS DOUBLE) AS cart_count FROM cart_items GROUP BY cart_id""")

# --- staging tables in batches ---------------------------------------------------
_DAY = 86400000
_EDITS = {"orders": "CASE WHEN status = 'CONFIRMED' THEN 'PENDING' ELSE 'CONFIRMED' END AS status, total_ttc + 1 AS total_ttc",
          "order_items": "CAST(quantity + 1 AS INTEGER) AS quantity", "items": "CAST(quantity + 1 AS INTEGER) AS quantity",
          "customers": "last_name || '-b' AS last_name", "admins": "last_name || '-b' AS last_name", "payments": "'FAILED' AS status", "invoices": "total_ht + 1 AS total_ht"}


def _after_batches(table: str, edits: dict) -> str:
    """Latest row per id of the table's rows, edits, late edits and deletes."""
    offset = "CAST(floor(unit_price_ht * 100 + 0.5) AS BIGINT)" if table == "order_items" else "0"
    raw = f"FROM raw_{table} WHERE id %"
    return f"""
SELECT * EXCLUDE (o, rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY __source_ts_ms DESC, o DESC) AS rn FROM (
    SELECT *, {offset} AS o FROM raw_{table}
    UNION ALL SELECT * REPLACE ({edits[table]}, __source_ts_ms + {_DAY} AS __source_ts_ms), {offset} {raw} 5 = 0
    UNION ALL SELECT * REPLACE ({edits[table]}, __source_ts_ms - 1000 AS __source_ts_ms), {offset} {raw} 11 = 0
    UNION ALL SELECT * REPLACE ('true' AS __deleted, __source_ts_ms + {2 * _DAY} AS __source_ts_ms), {offset} {raw} 7 = 0))
WHERE rn = 1"""


def _with_batches(sql: str, edits: dict = _EDITS) -> str:
    """An oracle over the staging tables as they are after the batches."""
    for t in _EDITS:
        if f"stg_{t} AS (" in sql:
            head, tail = sql.split(f"stg_{t} AS (", 1)
            own = CTES[f"stg_{t}"][1].strip()
            sql = f"{head}raw_{t} AS ({own}),\nstg_{t} AS ({_after_batches(t, edits).strip()}){tail[len(own) + 1:]}"
    return sql


for _name, _sql in _MART_BODIES.items():
    ORACLES[f"{_name}_kept"] = _with_batches(_sql)
ORACLES["staging_merge_on_read"] = _with_batches(with_ctes(("stg_orders",), """
SELECT id, customer_id, status, total_ht, total_ttc, __source_ts_ms, __deleted FROM stg_orders"""))
ORACLES["staging_copy_by_chunks"] = with_ctes(("stg_orders",), """
SELECT id, customer_id,
       CASE WHEN id % 5 <> 0 THEN status WHEN status = 'CONFIRMED' THEN 'PENDING' ELSE 'CONFIRMED' END AS status,
       total_ttc + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 11 = 0 AND id % 7 <> 0 AND id % 13 <> 0 THEN 2 ELSE 0 END AS total_ttc,
       CASE WHEN id % 7 = 0 OR id % 13 = 0 THEN 'true' ELSE 'false' END AS __deleted
FROM stg_orders""")
ORACLES["cart_state_table"] = ORACLES["cart_state_batch"]
ORACLES["allocate_orders_stream"] = ORACLES["allocate_orders"]
ORACLES["reorder_suggestions_kept"] = _with_batches(ORACLES["reorder_suggestions"])
ORACLES["dq_unique_kept"] = _with_batches(ORACLES["dq_unique"], {
    **_EDITS, "customers": _EDITS["customers"] + ", 'shared' || CAST(id // 10 AS VARCHAR) || '@shop.test' AS email",
    "invoices": _EDITS["invoices"] + ", CAST(id // 10 AS BIGINT) AS order_id"})
ORACLES["dq_foreign_keys_kept"] = _with_batches(ORACLES["dq_foreign_keys"])
