"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name-substring ...]
Prints one line per query: rows, columns, exact-value and tolerant-value match.
"""
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import numpy as np
import pandas as pd


def normalise(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if pdf[c].dtype == object:
            pdf[c] = pdf[c].map(lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else
                                (str(v) if not isinstance(v, (int, float, np.integer, np.floating)) else float(v)))
        elif str(pdf[c].dtype).startswith("datetime"):
            pdf[c] = pdf[c].astype(str)
    return pdf


def frames_match(a: pd.DataFrame, b: pd.DataFrame):
    if list(a.columns) != list(b.columns) or len(a) != len(b):
        return False, False
    num = [c for c in a.columns if pd.api.types.is_numeric_dtype(a[c]) or a[c].map(lambda v: isinstance(v, float)).all()]
    key = [c for c in a.columns]
    sa = a.astype(str).sort_values(key).reset_index(drop=True)
    sb = b.astype(str).sort_values(key).reset_index(drop=True)
    exact = sa.equals(sb)
    if exact:
        return True, True
    # tolerant: sort by string columns, then numerics rounded
    def keyed(df):
        d = df.copy()
        for c in d.columns:
            d[c] = d[c].map(lambda v: round(float(v), 4) if v is not None and not isinstance(v, str)
                            and not (isinstance(v, float) and math.isnan(v)) else (v if v is not None else ""))
        return d.astype(str).sort_values(list(d.columns)).index
    ia, ib = keyed(a), keyed(b)
    ra, rb = a.loc[ia].reset_index(drop=True), b.loc[ib].reset_index(drop=True)
    for c in a.columns:
        x, y = ra[c], rb[c]
        for u, v in zip(x, y):
            un = u is None or (isinstance(u, float) and math.isnan(u))
            vn = v is None or (isinstance(v, float) and math.isnan(v))
            if un or vn:
                if un != vn:
                    return exact, False
                continue
            if isinstance(u, (int, float, np.integer, np.floating)) and isinstance(v, (int, float, np.integer, np.floating)):
                if not math.isclose(float(u), float(v), rel_tol=1e-7, abs_tol=1e-7):
                    return exact, False
            elif str(u) != str(v):
                return exact, False
    return exact, True


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    from ledgerlens.session import build_session
    import __spark_entry__ as E

    spark = build_session()
    con = duckdb.connect()
    from ledgerlens.sources.tables import TABLES
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, orc = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            sp = fn(spark, sf).toPandas()
        except Exception as e:  # noqa
            print(flush=True); print(f"{name:45s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}", flush=True)
            bad += 1
            continue
        dt = time.time() - t0
        if name not in orc:
            print(flush=True); print(f"{name:45s} rows={len(sp):7d} (no oracle) {dt:6.1f}s", flush=True)
            continue
        try:
            du = con.execute(orc[name]).df()
        except Exception as e:  # noqa
            print(flush=True); print(f"{name:45s} SQL-ERROR {str(e)[:300]}", flush=True)
            bad += 1
            continue
        a, b = normalise(sp), normalise(du)
        cols_ok = list(a.columns) == list(b.columns)
        exact, tol = frames_match(a, b) if cols_ok else (False, False)
        ok = cols_ok and len(a) == len(b) and tol
        bad += 0 if ok else 1
        print(flush=True); print(f"{name:45s} rows={len(sp):7d}/{len(du):7d} cols={'ok' if cols_ok else 'DIFF'} "
              f"exact={'Y' if exact else 'n'} tol={'Y' if tol else 'N'} {dt:6.1f}s")
        if not cols_ok:
            print("   spark:", list(a.columns), "\n   duck: ", list(b.columns), flush=True)
    print("mismatches:", bad, flush=True)


if __name__ == "__main__":
    main()
