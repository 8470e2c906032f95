"""Holds queries against their SQL: python tests/compare.py DATA_FOLDER [NAME_PREFIX ...]."""

import glob
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(glob.glob(f"{folder}/*.parquet")):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p + '/*.parquet' if Path(p).is_dir() else p}'")
    return con


def cell(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(cell, v))
    if isinstance(v, dict):
        return tuple((k, cell(x)) for k, x in sorted(v.items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(cell(r[i]) for i in order) for r in rows)


def differ(spark_df, con, sql) -> str:
    """Empty if both give the same columns and rows."""
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} against {want[0]}"
    if got[1] != want[1]:
        return f"{sum(got[1].values())} rows against {sum(want[1].values())}; only here {list((got[1] - want[1]).items())[:3]}; only there {list((want[1] - got[1]).items())[:3]}"
    return ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    b = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    spark = b.config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = connect(sys.argv[1]), e.oracle_sql()
    for name, f in e.queries().items():
        if len(sys.argv) > 2 and not name.startswith(tuple(sys.argv[2:])):
            continue
        t = time.time()
        try:
            said = differ(f(spark, sys.argv[1]), con, oracles[name]) if name in oracles else f"no SQL, {f(spark, sys.argv[1]).count()} rows"
        except Exception as x:
            said = f"ERROR {str(x)[:1500]}"
        print(name, said or "same", f"{time.time() - t:.1f}s", flush=True)
