"""Side-by-side check of a registered Spark query and its DuckDB oracle.

Compares row count, column names, Arrow types and order-insensitive values
(the same three things the driver checks). Usable from pytest and as a CLI:

    python -m tests.oracle_compare [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "∅" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f") if v == v else "∅"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_canon(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def _rows(table):
    cols = sorted(table.column_names)
    data = {c: table.column(c).to_pylist() for c in cols}
    n = table.num_rows
    return cols, sorted(tuple(_canon(data[c][i]) for c in cols) for i in range(n))


def _types(table):
    return {f.name: str(f.type).replace(', tz=UTC', '').replace('[us]', '') for f in table.schema}


def compare(spark, name: str, sf_dir: str, query, sql: str, con=None) -> dict:
    con = con or duck(sf_dir)
    s_tab = query(spark, sf_dir).toArrow()
    d_tab = con.sql(sql).to_arrow_table()
    s_cols, s_rows = _rows(s_tab)
    d_cols, d_rows = _rows(d_tab)
    st, dt_ = _types(s_tab), _types(d_tab)
    out = {"name": name, "spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "columns_match": s_cols == d_cols, "values_match": s_rows == d_rows,
           "type_diffs": {c: (st.get(c), dt_.get(c)) for c in set(st) | set(dt_) if st.get(c) != dt_.get(c)}}
    if not out["values_match"]:
        sd = sorted(set(s_rows) - set(d_rows))[:3]
        ds = sorted(set(d_rows) - set(s_rows))[:3]
        out["sample"] = {"cols": s_cols if s_cols == d_cols else (s_cols, d_cols),
                         "spark_only": sd, "oracle_only": ds}
    return out


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from martforge.session import build_session
    sf_dir = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")]
    spark = build_session("local[8]", shuffle_partitions=8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or sorted(sqls):
        try:
            r = compare(spark, name, sf_dir, qs[name], sqls[name], con)
        except Exception as exc:  # report and go on
            r = {"name": name, "error": repr(exc)[:600]}
        ok = r.get("values_match") and r.get("columns_match") and not r.get("type_diffs")
        bad += not ok
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    missing = sorted(set(qs) - set(sqls))
    print(f"{bad} bad; no oracle: {missing}")


if __name__ == "__main__":
    main(sys.argv[1:])
