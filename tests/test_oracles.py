"""Every registered query against its DuckDB oracle (the driver's gate),
on the smallest provided scale; ``python -m tests.oracle_compare`` runs the
same check on sf0.01."""

from __future__ import annotations

import pytest

import __spark_entry__ as E

from .conftest import SF_SMALL
from .oracle_compare import compare, duck

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, SF_SMALL, E.queries()[name], E.oracle_sql()[name], con)
    assert r["columns_match"] and r["values_match"] and not r["type_diffs"], r


def test_every_warehouse_query_has_an_oracle():
    from martforge.queries import REGISTRY
    assert set(REGISTRY) <= set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["order_date", "nb_orders", "units_sold", "revenue_ht", "revenue_ttc",
                          "cumulative_revenue_ttc"]
    assert df.count() > 0
