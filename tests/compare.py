"""Run registered Spark queries and their DuckDB oracles side by side.

    python tests/compare.py [sf_dir] [name ...]

Prints, per query, row counts on both sides, whether the column sets match
and whether the order-insensitive contents match exactly (floats compared
after the same output rounding both sides apply).
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from ledgerline.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normalise(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and pd.isna(v))
                              else str(v))
        elif str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].map(lambda v: None if pd.isna(v) else str(v.date() if v == v.normalize() else v))
    return df.sort_values(list(df.columns), na_position="last").reset_index(drop=True)


def compare(spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame) -> tuple[bool, str]:
    if sorted(spark_pdf.columns) != sorted(oracle_pdf.columns):
        return False, f"columns {sorted(spark_pdf.columns)} != {sorted(oracle_pdf.columns)}"
    if len(spark_pdf) != len(oracle_pdf):
        return False, f"rows {len(spark_pdf)} != {len(oracle_pdf)}"
    a, b = normalise(spark_pdf), normalise(oracle_pdf)
    bad = []
    for c in a.columns:
        x, y = a[c], b[c]
        if pd.api.types.is_numeric_dtype(x) and pd.api.types.is_numeric_dtype(y):
            xx, yy = x.astype(float), y.astype(float)
            eq = (xx == yy) | (xx.isna() & yy.isna())
        else:
            eq = (x.astype(str) == y.astype(str))
        if not eq.all():
            i = int((~eq).to_numpy().nonzero()[0][0])
            bad.append(f"{c}: {int((~eq).sum())} diffs e.g. {x.iloc[i]!r} vs {y.iloc[i]!r}")
    return (not bad), "; ".join(bad) or "ok"


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E
    spark = build_session("local[8]", 8)
    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    names = names or list(qs)
    n_ok = 0
    for n in names:
        t0 = time.time()
        try:
            sp = qs[n](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: spark error {str(e)[:400]}")
            continue
        t1 = time.time()
        if n not in orc:
            print(f"ROWS {n}: spark {len(sp)} rows, no oracle ({t1 - t0:.1f}s)")
            continue
        try:
            od = con.execute(orc[n]).fetchdf()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: oracle error {str(e)[:400]}")
            continue
        ok, msg = compare(sp, od)
        n_ok += ok
        print(f"{'OK  ' if ok else 'DIFF'} {n}: spark {len(sp)} / oracle {len(od)} rows; {msg} "
              f"(spark {t1 - t0:.1f}s, duck {time.time() - t1:.1f}s)")
    print(f"{n_ok}/{len(names)} match")


if __name__ == "__main__":
    main()
