"""Side-by-side check of a registered query against its DuckDB oracle.

Used by the tests and by ``python -m ledgerlens.plans.verify [names...]``.
Both results are brought to the driver here, which is fine for the small scale
factors this check runs at; the queries themselves never collect.
"""
from __future__ import annotations

import math
import sys

from .registry import entries

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return f"{round(v, 6):.6f}"
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def _rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in records)


def compare(spark, sf_dir: str, name: str, con=None, show: int = 3) -> tuple[bool, str]:
    e = entries()[name]
    sdf = e.fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    if not e.oracle:
        return True, f"{name}: rows-only ({len(s_rows)} rows)"
    con = con or duck(sf_dir)
    res = con.execute(e.oracle)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"{name}: columns differ spark={sorted(s_cols)} duck={sorted(d_cols)}"
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    if len(a) != len(b):
        return False, f"{name}: row count spark={len(a)} duck={len(b)}"
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:show]
        return False, f"{name}: values differ ({sum(1 for x, y in zip(a, b) if x != y)} rows) cols={sorted(s_cols)} e.g. {diff}"
    return True, f"{name}: ok ({len(a)} rows)"


def main(argv):
    from ..session import get_session
    sf_dir = "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("--")]
    for a in argv:
        if a.startswith("--sf="):
            sf_dir = a.split("=", 1)[1]
    spark = get_session("local[8]", 8)
    con = duck(sf_dir)
    todo = names or sorted(entries())
    bad = 0
    for n in todo:
        try:
            ok, msg = compare(spark, sf_dir, n, con)
        except Exception as ex:  # noqa: BLE001 - report and continue
            ok, msg = False, f"{n}: ERROR {type(ex).__name__}: {str(ex)[:400]}"
        bad += not ok
        print(("OK   " if ok else "FAIL ") + msg, flush=True)
    print(f"{len(todo) - bad}/{len(todo)} passed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
