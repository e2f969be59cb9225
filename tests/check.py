"""Run registered queries against the oracle and report differences."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.execute(sql).df()


def norm(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    return v.item() if hasattr(v, "item") else v


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = [tuple(norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)) if x is None else "", x if x is not None else 0) for x in r))


def compare(a: pd.DataFrame, b: pd.DataFrame) -> str:
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} != {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    ra, rb = rows(a), rows(b)
    bad = [(x, y) for x, y in zip(ra, rb) if x != y]
    # pandas turns a whole-number column with nulls into floats
    kinds = {c: (a[c].dtype.kind, b[c].dtype.kind) for c in a.columns if a[c].dtype.kind != b[c].dtype.kind
             and not (a[c].isna().any() and {a[c].dtype.kind, b[c].dtype.kind} == {"f", "i"})}
    note = f" kinds {kinds}" if kinds else ""
    return (f"{len(bad)} of {len(ra)} rows differ, e.g. {bad[0][0]} | {bad[0][1]}" if bad else "") + note


if __name__ == "__main__":
    from tickforge.session import get_session

    sf = f"/root/testdata/{sys.argv[1]}"
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.enabled": "false",
                                              "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    import __spark_entry__ as E

    names = sys.argv[2].split(",") if len(sys.argv) > 2 else list(E.queries())
    ok = 0
    for n in names:
        t0 = time.time()
        try:
            got = E.queries()[n](spark, sf).toPandas()
            t1 = time.time()
            msg = compare(got, oracle(sf, E.oracle_sql()[n])) if n in E.oracle_sql() else "no oracle"
            print(("OK  " if not msg else "DIFF"), n, len(got), f"{t1 - t0:.1f}s {time.time() - t1:.1f}s", msg[:600], flush=True)
            ok += not msg or msg == "no oracle"
        except Exception as e:
            print("FAIL", n, f"{time.time() - t0:.1f}s", str(e)[:700].replace("\n", " "), flush=True)
    print(ok, "of", len(names))
