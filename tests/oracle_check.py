"""Run registered queries in Spark and their SQL oracles in DuckDB on the same
parquet folder and compare row count, column names and values.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (decimal.Decimal,)):
        v = float(v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return float(v)
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((0, "") if x is None else (1, str(x)) for x in row)


def compare(spark_rows, spark_cols, duck_rows, duck_cols, rel=1e-6):
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns differ: {sorted(spark_cols)} vs {sorted(duck_cols)}"
    order_s = sorted(range(len(spark_cols)), key=lambda i: spark_cols[i])
    order_d = sorted(range(len(duck_cols)), key=lambda i: duck_cols[i])
    a = sorted([tuple(_norm(r[i]) for i in order_s) for r in spark_rows], key=_key)
    b = sorted([tuple(_norm(r[i]) for i in order_d) for r in duck_rows], key=_key)
    if len(a) != len(b):
        return f"row count {len(a)} vs {len(b)}"
    names = sorted(spark_cols)
    for ra, rb in zip(a, b):
        for n, x, y in zip(names, ra, rb):
            if x == y:
                continue
            if isinstance(x, float) and isinstance(y, float) and abs(x - y) <= rel * max(1.0, abs(x), abs(y)):
                continue
            return f"value differs in {n}: {x!r} vs {y!r}; row {ra} vs {rb}"
    return None


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
          "boolean": "BOOLEAN", "array<double>": "DOUBLE[]", "smallint": "SMALLINT", "timestamp": "TIMESTAMP"}


def type_mismatches(spark_dtypes, duck_description) -> list[str]:
    """Column types that differ between the engines (after the usual mapping)."""
    duck = {d[0]: str(d[1]).upper() for d in duck_description}
    out = []
    for name, t in spark_dtypes:
        want = _TYPES.get(t, t.upper())
        got = duck.get(name)
        if got is not None and got != want and not (t.startswith("decimal") and got.startswith("DECIMAL")):
            out.append(f"{name}: spark {t} vs duckdb {got}")
    return out


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as E

    sf_dir = argv[0] if argv and os.path.isdir(argv[0]) else "/root/testdata/sf0.01"
    names = [a for a in argv if not os.path.isdir(a)]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in orc:
            print(f"ROWS {name}: {len(rows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            res = con.execute(orc[name])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        msg = compare(rows, cols, drows, dcols)
        tm = type_mismatches(df.dtypes, res.description)
        if tm and not msg:
            msg = "types differ: " + "; ".join(tm)
        if msg:
            bad += 1
            print(f"FAIL {name}: {msg}")
        else:
            print(f"OK   {name}: {len(rows)} rows {ts:.1f}s")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
