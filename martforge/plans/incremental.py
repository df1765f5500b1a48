"""Marts kept up to date from the changes of their sources.

A refresh costs in proportion to the change, not to the tables. For each mart
it takes the keys that changed in the source tables since the versions it has
seen, and reads the old image (of the version seen, kept by a lease) and the
new image of what those keys touch. From both it makes signed contributions:
those of the old image count -1, those of the new one +1. Contributions are
appended to a table of mergeable sums; equal ones cancel before they are
written. The mart itself is a query over the sums.

* Sums and counts are added up per key (items, days).
* Minima and maxima can't be taken back from a sum. Their tables keep the
  multiset: a count per (key, time). The least and greatest time whose count
  isn't zero are the minimum and maximum, whatever was retracted.
* Running totals go over a tree: days within a month, months within a year,
  years; no window spans the whole calendar, and a changed day alters the
  stored sum of that day alone.
* Marts of one row per source row (payments, invoices) are upserted: rows of
  touched keys are computed anew, and those that are gone are marked deleted.

Names and prices of items and customers, and due states, are looked up when a
mart is read, where a change of them would touch many rows (items), and are
part of the upserted rows where the source has them (customers).

Few touched keys are semi-joined: the source tables are filtered where they lie
and not shuffled. Of many, the rows of both images are read once and meet their
orders in one shuffle (``Change``). After a batch that brought a LARGE share of a
source's rows nearly every key is touched: then only the present image is read,
whole, and compared with the stored rows, which are the earlier image's.

Source versions are taken with the contributions in one commit: a refresh
that is run again after a failure either finds its batch applied or redoes it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import live_row
from ..operators import dwh, marts
from ..session import materialise, release
from .changes import SEQ, ChangeTable
from .versions import Manifest

#: Keys up to which an image is filtered by them before it is folded.
SMALL = 100_000
#: Share of a source's rows (more than SMALL) from which a batch is taken by comparing the whole present image with the stored rows.
LARGE = 0.125
#: How long a consumer's hold on the version it has seen lasts without a refresh.
HOLD_SECONDS = 30 * 86400


class Image:
    """The cleaned rows of the sources at one version each, read only where asked for."""

    def __init__(self, tables: dict[str, ChangeTable], manifests: dict[str, Manifest | None]):
        self.tables, self.manifests = tables, manifests

    def rows(self, table: str, keys: DataFrame | None, column: str = "id") -> DataFrame:
        """Cleaned rows of ``table`` whose staging ``column`` is among ``keys`` (None: all)."""
        manifest = self.manifests[table]
        if keys is None and manifest is not None:
            return dwh.LOADS[table](self.tables[table].read(manifest))
        if manifest is None:  # before the first version: no rows, the columns of the present one
            return dwh.LOADS[table](self.tables[table].read().limit(0))
        return dwh.LOADS[table](self.tables[table].only(keys, column, manifest))


def large(table: ChangeTable, after: int, manifest: Manifest) -> bool:
    """Did commits after ``after`` bring a large share of the table's rows?"""
    brought, stored = table.brought(after, manifest)
    return brought > SMALL and brought >= LARGE * stored


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _keys(*parts: DataFrame) -> DataFrame:
    """The distinct values of one-column tables, written: their size is then
    known, and the planner broadcasts them below its limit."""
    return materialise(_union([p.toDF("key").where(F.col("key").isNotNull()) for p in parts]).distinct(), "touched")


# -- contributions -----------------------------------------------------------

class Change:
    """The cleaned rows of the sources over a refresh, each read once: ``was``
    and ``now`` tell in which of the two images a row is. A row whose commit
    the earlier image has seen is in both; of the others the earlier image's
    rows are looked up by key."""

    def __init__(self, tables: dict[str, ChangeTable], old: dict[str, Manifest | None], now: dict[str, Manifest]):
        self.tables, self.old, self.now = tables, old, now
        self.moved: dict[str, DataFrame] = {}  # keys of rows that commits after the earlier image have replaced
        for t, was in old.items():
            if was is not None and now[t].next_seq > was.next_seq:
                changed = materialise(tables[t].changed(was.next_seq - 1, now[t]), "changed")
                fresh = self._present(t, changed, tables[t].keys[0]).where(F.col(SEQ) >= was.next_seq)
                self.moved[t] = materialise(fresh.select(tables[t].keys[0]), "moved")
                release(changed)

    def _present(self, table: str, among: DataFrame | None, column: str) -> DataFrame:
        """The present image; of few keys their rows alone, filtered where they lie."""
        if among is not None and among.count() <= SMALL:
            return self.tables[table].only(among, column, self.now[table], seq=True)
        return self.tables[table].read(self.now[table], seq=True)

    def _earlier(self, table: str) -> DataFrame:
        return dwh.LOADS[table](self.tables[table].only(self.moved[table], None, self.old[table]))

    def rows(self, table: str, among: DataFrame | None = None, column: str = "id") -> DataFrame:
        """All rows, or at least those whose staging ``column`` is in ``among``."""
        was = self.old[table]
        rows = dwh.LOADS[table](self._present(table, among, column), SEQ)
        seen = F.lit(False) if was is None else F.col(SEQ) < was.next_seq
        rows = rows.withColumn("was", seen).withColumn("now", F.lit(True)).drop(SEQ)
        if table not in self.moved:
            return rows
        return rows.unionByName(self._earlier(table).withColumns({"was": F.lit(True), "now": F.lit(False)}))

    def orders(self) -> DataFrame | None:
        """The orders of rows that differ; None: all, nothing was seen before."""
        if all(was is None for was in self.old.values()):
            return None
        parts = []
        for t in self.old:
            if t in self.moved or self.old[t] is None:
                differ = self.rows(t, self.moved.get(t)).where(F.col("was") != F.col("now")).select("order_id")
                # an order's key is its id
                parts.append(self.moved[t] if t == "orders" and t in self.moved else differ)
        return _keys(*parts)

    def release(self) -> None:
        release(*self.moved.values())


def _signed(rows: DataFrame, keys: dict[str, Column], sums: dict[str, Callable]) -> DataFrame:
    """The contributions per ``keys`` of both images: what is now less what
    was. ``rows`` has one row per group that counts once, with ``was`` and
    ``now``; a sum maps one of these to its column."""
    rows = rows.select(*[c.alias(k) for k, c in keys.items()], *[(of("now") - of("was")).alias(c) for c, (of, _) in sums.items()])
    some = reduce(lambda a, b: a | b, [F.col(c) != 0 for c in sums])
    rows = rows.where(some)  # what hasn't changed isn't moved
    return rows.groupBy(*keys).agg(*[F.sum(c).cast(kind).alias(c) for c, (_, kind) in sums.items()]).where(some)


MONEY_SUM = "decimal(20,2)"
_COUNT = "long"


def _confirmed_lines(change: Change, orders: DataFrame | None, group: list[str]) -> DataFrame:
    """The lines of the touched confirmed orders, added up per order and
    ``group``: how many there were and are, and their sums. Order and lines
    meet in one shuffle by the order, which is that of the grouping too."""
    kept = marts._confirmed(change.rows("orders", orders)).select("order_id", "customer_id", F.col("source_updated_at").alias("at"), F.col("was").alias("had"), F.col("now").alias("has"))
    if orders is not None:
        kept = kept.join(orders.toDF("order_id"), "order_id", "left_semi")
    lines = change.rows("order_items", orders, "order_id").select("order_id", "item_id", "quantity", "line_total_ht", "line_total_ttc", "was", "now")
    lines = lines.join(kept, "order_id").withColumns({"was": F.col("was") & F.col("had"), "now": F.col("now") & F.col("has")}).where(F.col("was") | F.col("now"))
    values = {"q": "quantity", "ht": "line_total_ht", "ttc": "line_total_ttc"}
    return lines.groupBy("order_id", *group).agg(
        *[F.max(side).cast(_COUNT).alias(f"n_{side}") for side in ("was", "now")],
        *[F.sum(F.when(F.col(side), F.col(c))).alias(f"{v}_{side}") for side in ("was", "now") for v, c in values.items()])


def _n(side: str) -> Column:
    return F.col(f"n_{side}")


def _value(v: str, kind: str):
    """A sum, NULL (no value at all) as zero."""
    return (lambda side: F.coalesce(F.col(f"{v}_{side}"), F.lit(0)).cast(kind)), kind


def _count_of(v: str):
    """Groups that have a value."""
    return (lambda side: F.col(f"{v}_{side}").isNotNull().cast(_COUNT)), _COUNT


def _item_sums(change: Change, orders: DataFrame | None) -> DataFrame:
    return _signed(_confirmed_lines(change, orders, ["item_id"]), {"item_id": F.col("item_id")},
                   {"nb_orders": (_n, _COUNT), "units": _value("q", "long"), "ht": _value("ht", MONEY_SUM), "ttc": _value("ttc", MONEY_SUM)})


def _purchases(change: Change, orders: DataFrame | None) -> DataFrame:
    return _signed(_confirmed_lines(change, orders, ["item_id", "customer_id", "at"]), {c: F.col(c) for c in ("customer_id", "item_id", "at")},
                   {"n": (_n, _COUNT), "q": _value("q", "long"), "q_known": _count_of("q")})


def _day_sums(change: Change, orders: DataFrame | None) -> DataFrame:
    return _signed(_confirmed_lines(change, orders, ["at"]), {"order_date": F.to_date("at")},
                   {"nb_orders": (_n, _COUNT), "units": _value("q", "long"), "ht": _value("ht", MONEY_SUM), "ttc": _value("ttc", MONEY_SUM),
                    "units_known": _count_of("q"), "ht_known": _count_of("ht"), "ttc_known": _count_of("ttc")})


def _known(value: str, count: str):
    """A sum of which no value is left is NULL, as SQL's."""
    return F.when(F.col(count) > 0, F.col(value))


def _baskets(change: Change, orders: DataFrame | None) -> DataFrame:
    rows = marts._confirmed(change.rows("orders", orders)).where(F.col("was") != F.col("now"))
    of = lambda c, kind: ((lambda side: F.when(F.col(side), F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast(kind)), kind)
    return _signed(rows, {"customer_id": F.col("customer_id"), "at": F.col("source_updated_at")},
                   {"n": of(F.lit(1), _COUNT), "priced": of(F.col("total_ttc").isNotNull().cast("int"), _COUNT), "total": of(F.col("total_ttc"), MONEY_SUM)})


# -- marts over the sums -------------------------------------------------------

def _revenue_by_item(sums: DataFrame, items: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return items.join(sums, "item_id", "left").select(
        "item_id", "title", "price_ht", "price_ttc", "tva_rate", F.col("quantity").alias("current_stock"),
        F.coalesce("nb_orders", zero).alias("nb_orders"), F.coalesce("units", zero).alias("total_units_sold"),
        F.coalesce("ht", zero).cast(MONEY_SUM).alias("total_revenue_ht"), F.coalesce("ttc", zero).cast(MONEY_SUM).alias("total_revenue_ttc"))


def _customer_reorders(sums: DataFrame, items: DataFrame) -> DataFrame:
    bought = sums.where(F.col("n") > 0).groupBy("customer_id", "item_id").agg(
        F.sum(_known("q", "q_known")).alias("total_qty_purchased"), F.sum("n").alias("nb_orders_with_item"), F.max("at").alias("last_purchased_at"))
    return bought.join(items.select("item_id", "title", "price_ttc", "quantity"), "item_id").select(
        "customer_id", "item_id", "title", "price_ttc", "total_qty_purchased", "nb_orders_with_item", "last_purchased_at",
        F.col("quantity").alias("current_stock"))


def _customer_lifetime(sums: DataFrame, customers: DataFrame) -> DataFrame:
    stats = sums.where(F.col("n") > 0).groupBy("customer_id").agg(
        F.sum("n").alias("n"), F.sum("priced").alias("priced"), F.sum("total").alias("s"), F.min("at").alias("first_order_at"), F.max("at").alias("last_order_at"))
    nb, zero = F.coalesce("n", F.lit(0).cast("long")), F.lit(0)
    mean = F.when(F.col("priced") > 0, (F.col("s") / F.col("priced")).cast("decimal(16,6)"))
    return customers.select("customer_id", "first_name", "last_name", "email").join(stats, "customer_id", "left").select(
        "customer_id", "first_name", "last_name", "email", nb.alias("nb_orders"), F.coalesce("s", zero).cast(MONEY_SUM).alias("lifetime_value_ttc"),
        F.coalesce(mean, zero).cast("decimal(16,6)").alias("avg_basket_ttc"), "first_order_at", "last_order_at",
        marts.customer_segment(nb).alias("customer_segment"))


def _sales_daily(sums: DataFrame) -> DataFrame:
    """Running totals by blocks: the day within its month, the months before
    it in its year, the years before. ``d`` counts the days with a total."""
    days = sums.where(F.col("nb_orders") > 0).withColumns({
        "y": F.year("order_date"), "m": F.month("order_date"), "t": _known("ttc", "ttc_known"), "d": (F.col("ttc_known") > 0).cast("int")})
    months = days.groupBy("y", "m").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
    years = months.groupBy("y").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
    last = F.lit(1 << 20)  # days without a date come after all years
    earlier = years.select(F.col("y").alias("ey"), F.col("t").alias("et"), F.col("d").alias("ed"))
    before = years.join(earlier, F.coalesce("ey", last) < F.coalesce("y", last), "left").groupBy(F.col("y").alias("by")).agg(
        F.sum("et").alias("bt"), F.sum("ed").alias("bd"))
    of_year = "OVER (PARTITION BY y ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    months = months.select(F.col("y").alias("my"), F.col("m").alias("mm"), *[F.expr(f"sum({c}) {of_year}").alias(f"m{c}") for c in "td"])
    of_month = "OVER (PARTITION BY y, m ORDER BY order_date)"
    placed = (days.withColumns({f"w{c}": F.expr(f"sum({c}) {of_month}") for c in "td"})
              .join(months, F.col("y").eqNullSafe(F.col("my")) & F.col("m").eqNullSafe(F.col("mm"))).join(before, F.col("y").eqNullSafe(F.col("by"))))
    total, counted = (sum((F.coalesce(f"{p}{c}", F.lit(0)) for p in "mb"), F.coalesce(f"w{c}", F.lit(0))) for c in "td")
    return placed.select(
        "order_date", "nb_orders", _known("units", "units_known").alias("units_sold"), _known("ht", "ht_known").alias("revenue_ht"),
        F.col("t").alias("revenue_ttc"), F.when(counted > 0, total.cast("decimal(30,2)")).alias("cumulative_revenue_ttc"))


# -- marts of one row per source row ------------------------------------------

def _owned_keys(table: str) -> Callable:
    def keys(changed: dict[str, DataFrame], images: tuple[Image, Image]) -> DataFrame:
        """Ids of ``table`` whose own row, order or customer changed."""
        orders = [changed["orders"]] if "orders" in changed else []
        if "customers" in changed:
            people = _keys(changed["customers"])
            orders += [image.rows("orders", people, "customer_id").select("order_id") for image in images]
        parts = [changed[table]] if table in changed else []
        if orders:
            orders = _keys(*orders)
            parts += [image.rows(table, orders, "order_id").select(F.col(f"{table[:-1]}_id")) for image in images]
        return _keys(*parts)
    return keys


def _owned_rows(table: str, mart: Callable) -> Callable:
    def rows(image: Image, keys: DataFrame | None) -> DataFrame:
        own = image.rows(table, keys)
        orders = image.rows("orders", None if keys is None else _keys(own.select("order_id")))
        return mart(own, orders, image.rows("customers", None if keys is None else _keys(orders.select("customer_id"))))
    return rows


def _invoice_rows(own, orders, customers):
    return marts.invoices(own, orders, customers, as_of="1970-01-01").drop("due_status")


@dataclass(frozen=True)
class Kept:
    """How one mart is kept: what it listens to, its stored rows, its reading."""

    sources: tuple[str, ...]
    keys: tuple[str, ...]
    kind: str  # of the stored rows: "sum" or "latest"
    touched: Callable  # (change), or (changed keys, images)
    rows: Callable  # (change, touched keys) -> contributions, or (image, touched keys) -> rows; None: all keys
    view: Callable  # (stored rows, *dimensions) -> mart
    dimensions: tuple[str, ...] = ()


KEPT = {
    "mart_revenue_by_item": Kept(("orders", "order_items"), ("item_id",), "sum", Change.orders, _item_sums, _revenue_by_item, ("items",)),
    "mart_customer_reorders": Kept(("orders", "order_items"), ("customer_id", "item_id", "at"), "sum", Change.orders, _purchases, _customer_reorders, ("items",)),
    "mart_payments": Kept(("payments", "orders", "customers"), ("payment_id",), "latest", _owned_keys("payments"),
                          _owned_rows("payments", marts.payments), lambda rows: rows),
    "mart_invoices": Kept(("invoices", "orders", "customers"), ("invoice_id",), "latest", _owned_keys("invoices"),
                          _owned_rows("invoices", _invoice_rows), lambda rows: rows),
    "mart_customer_lifetime": Kept(("orders",), ("customer_id", "at"), "sum", Change.orders, _baskets, _customer_lifetime, ("customers",)),
    "mart_sales_daily": Kept(("orders", "order_items"), ("order_date",), "sum", Change.orders, _day_sums, _sales_daily),
}


class KeptMart:
    """One mart, refreshed from the change tables of its sources."""

    def __init__(self, spark: SparkSession, name: str, staging: dict[str, ChangeTable], root: str | None = None, kept: Kept | None = None):
        self.spark, self.name, self.kept, self.staging = spark, name, kept or KEPT[name], staging
        self.store = ChangeTable(spark, f"dmart.{name}__kept", root, keys=self.kept.keys, kind=self.kept.kind, order=(), public=False)

    def seen(self) -> dict[str, int]:
        """The versions of the sources that the stored rows hold."""
        manifest = self.store.versions.current()
        return dict(manifest.applied) if manifest else {}

    def _whole(self, old: dict[str, Manifest | None], now: dict[str, Manifest]) -> bool:
        """Is nothing seen before, or is what changed a large share of a source?"""
        if all(was is None for was in old.values()):
            return True
        return any(was is not None and large(self.staging[s], was.next_seq - 1, now[s]) for s, was in old.items())

    def _less_stored(self, sums: DataFrame) -> DataFrame:
        """What the sums of the whole present image are more than the stored ones."""
        kinds, keys = dict(sums.dtypes), list(self.kept.keys)
        counted = [c for c in sums.columns if c not in keys]
        stored = self.store.read().select(*keys, *[(-F.col(c)).cast(kinds[c]).alias(c) for c in counted])
        some = reduce(lambda a, b: a | b, [F.col(c) != 0 for c in counted])
        return sums.unionByName(stored).groupBy(*keys).agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in counted]).where(some)

    def _differing(self, rows: DataFrame, touched: DataFrame | None) -> DataFrame:
        """The rows that aren't stored so, and those stored that are gone, marked."""
        if self.store.current() is None:
            return rows.withColumn("__deleted", F.lit("false"))
        key, rest = self.kept.keys[0], [c for c in rows.columns if c not in self.kept.keys]
        stored = (self.store.read() if touched is None else self.store.only(touched)).where(live_row())
        both = rows.select(key, F.struct(*rest).alias("new")).join(stored.select(key, F.struct(*rest).alias("old")), key, "full_outer")
        gone = F.col("new").isNull()
        return both.where(~F.col("new").eqNullSafe(F.col("old"))).select(
            key, *[F.when(gone, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c) for c in rest],
            F.when(gone, F.lit("true")).otherwise(F.lit("false")).alias("__deleted"))

    def refresh(self, compact: bool = True) -> bool:
        """Take what changed since the last refresh. True if anything did."""
        seen, now, holds = self.seen(), {}, []
        for s in self.kept.sources:
            now[s], hold = self.staging[s].versions.take(HOLD_SECONDS, owner=f"{self.name}-{s}")
            holds.append((s, hold))
        old = {s: self.staging[s].versions.manifest(seen[s]) if seen.get(s) else None for s in self.kept.sources}
        fresh = {s for s in self.kept.sources if old[s] is None or now[s].next_seq > old[s].next_seq}
        if not fresh:
            for s, hold in holds:
                self.staging[s].versions.give_back(hold)
            return False
        whole, used = self._whole(old, now), []
        if self.kept.kind == "sum":
            change = Change(self.staging, dict.fromkeys(old) if whole else old, now)
            touched = self.kept.touched(change)
            delta, used = self.kept.rows(change, touched), [] if touched is None else [touched]
            if whole and self.store.current() is not None:
                delta = self._less_stored(delta)
        else:  # rows of touched keys anew; those that are gone are marked
            change, touched = None, None
            if not whole:
                changed = {s: materialise(self.staging[s].changed(old[s].next_seq - 1 if old[s] else 0, now[s]), "changed") for s in fresh}
                touched = self.kept.touched(changed, (Image(self.staging, old), Image(self.staging, now)))
                used = [touched, *changed.values()]
            delta = self._differing(self.kept.rows(Image(self.staging, now), touched), touched)
        segment = self.store._segment(delta)

        def add(m: Manifest):
            if m.applied != seen:
                return False  # another refresh was first
            segment.seq = m.next_seq
            m.segments.append(segment)
            m.next_seq += 1
            m.applied = {s: now[s].version for s in self.kept.sources}

        done = self.store.versions.commit(add)
        kept_versions = self.seen()
        for s in self.kept.sources:  # hold what has been seen, and nothing older
            for version, _, name in self.staging[s].versions._leases():
                if f".{self.name}-{s}." in name and version != kept_versions.get(s):
                    self.staging[s].versions.give_back(f"{self.staging[s].versions.folder}/leases/{name}")
        release(*used)
        if change is not None:
            change.release()
        if done is None:
            self.store.versions.files.delete(segment.path)
            return False
        if compact:
            self.store.compact()
        return True

    def read(self, as_of=None) -> DataFrame:
        """The mart at the versions it has seen."""
        stored = self.store.read()
        if self.kept.kind == "latest":
            stored = stored.where(live_row()).drop("__deleted")
        dimensions = [dwh.LOADS[d](self.staging[d].read()) for d in self.kept.dimensions]
        out = self.kept.view(stored, *dimensions)
        if self.name == "mart_invoices":
            out = out.withColumn("due_status", marts.due_status("due_date", F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")))
        return out


def refresh_kept(spark: SparkSession, staging: dict[str, ChangeTable], root: str | None = None, names=tuple(KEPT)) -> dict[str, bool]:
    """Refresh the kept marts; {mart: anything changed?}."""
    return {name: KeptMart(spark, name, staging, root).refresh() for name in names}
