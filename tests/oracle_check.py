"""Compare registered queries with their SQL on DuckDB: ``python tests/oracle_check.py [NAME...]``."""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["TZ"] = "UTC"

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def canonical(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return None
        if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
            return bool(v)
        if isinstance(v, (int, float)) or type(v).__module__ == "numpy":
            return float(f"{float(v):.12g}") if not type(v).__name__.startswith("datetime") else str(pd.Timestamp(v))
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        return str(v) if type(v).__name__ != "Decimal" else float(v)

    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.astype(object).itertuples(index=False)), key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def differs(spark, name: str, f, sql: str, sf_dir: str, db) -> str:
    got = f(spark, sf_dir)
    want = db.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = canonical(got.toPandas()), canonical(want)
    if a == b:
        return ""
    odd = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return f"{len(a)} rows and {len(b)}; first differences {odd}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from conftest import make_spark

    spark, sf = make_spark(), os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    db, q, o = database(sf), entry.queries(), entry.oracle_sql()
    for name in sys.argv[1:] or [k for k in q if k in o]:
        began = time.time()
        try:
            said = differs(spark, name, q[name], o[name], sf, db)
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{'ok  ' if not said else 'FAIL'} {name} {time.time() - began:.1f} s {said}", flush=True)
