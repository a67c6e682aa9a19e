"""Run registered queries beside their oracle text and report differences.

usage: python tests/oracle_check.py <data folder> [name …]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from placegrid.plans.views import TABLES  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value) if value % 1 else int(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def spark_rows(df):
    names = sorted(df.columns)
    kinds = [df.schema[n].dataType.simpleString() for n in names]
    return names, kinds, sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())


def duck_rows(con, sql: str):
    cur = con.execute(sql)
    found = [d[0] for d in cur.description]
    kinds = [str(d[1]) for d in cur.description]
    order = sorted(range(len(found)), key=lambda i: found[i])
    rows = sorted(repr(tuple(plain(r[i]) for i in order)) for r in cur.fetchall())
    return [found[i] for i in order], [kinds[i] for i in order], rows


def compare(spark, con, sf_dir: str, q, look=lambda df: None) -> tuple[bool, str]:
    """Whether a query agrees with its oracle, and how; `look` sees the query's frame before it runs."""
    began = time.time()
    df = q.run(spark, sf_dir)
    look(df)
    names, kinds, rows = spark_rows(df)
    took = time.time() - began
    if q.sql is None:
        return True, f"{len(rows)} rows, no oracle, {took:.1f}s"
    want_names, want_kinds, want = duck_rows(con, q.sql)
    if names != want_names:
        return False, f"columns {names} != {want_names}"
    if rows != want:
        only = [r for r in rows if r not in set(want)][:2]
        miss = [r for r in want if r not in set(rows)][:2]
        return False, f"{len(rows)} rows against {len(want)}\n    spark {only}\n    duck  {miss}"
    note = " ".join(f"{n}:{a}/{b}" for n, a, b in zip(names, kinds, want_kinds) if not _same(a, b))
    return True, f"{len(rows)} rows, {took:.1f}s {note}"


def _same(a: str, b: str) -> bool:
    pairs = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}
    return pairs.get(a) == b


def main() -> int:
    from placegrid.plans import QUERIES
    from placegrid.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                              "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in names:
        try:
            ok, text = compare(spark, con, sf_dir, QUERIES[name])
        except Exception as exc:  # noqa: BLE001
            ok, text = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, text[:1500], flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
