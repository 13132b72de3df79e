"""Holds queries against their SQL: python tests/oracle.py SF_DIR [QUERY...]"""

from __future__ import annotations

import sys
import time
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def plain(v):  # noqa: ANN001, ANN201
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, Decimal):
        return f"{float(v):.6g}"
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((plain(k), plain(x)) for k, x in v.items()))
    return v


def connect(sf_dir: str):  # noqa: ANN201
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def compare(spark, name: str, sf_dir: str, con=None) -> str:  # noqa: ANN001
    """Empty if rows and column names agree, else what differs."""
    import __spark_entry__ as e

    began = time.time()
    df = e.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    took = time.time() - began
    sql = e.oracle_sql().get(name)
    print(f"{name}: {sum(got.values())} rows, {took:.1f} s", flush=True)
    if sql is None:
        return ""
    res = (con or connect(sf_dir)).execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = Counter(tuple(plain(r[k]) for k in order) for r in res.fetchall())
    if got == want:
        return ""
    return f"{sum((got - want).values())} rows only here, {sum((want - got).values())} only in SQL: {list((got - want).items())[:3]} {list((want - got).items())[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from conftest import session

    spark = session()
    con = connect(sys.argv[1])
    for q in sys.argv[2:] or e.queries():
        try:
            if bad := compare(spark, q, sys.argv[1], con):
                print("  DIFFERS", bad)
        except Exception as x:  # noqa: BLE001
            print("  FAILED", q, str(x)[:3000])
