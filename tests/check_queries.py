"""Compare registered queries with their SQL: python tests/check_queries.py [sf_dir] [name ...]"""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from workload.inputs import TABLES  # noqa: E402


def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 2**53 else str(v)
    return str(v)


def compare(spark, con, sf_dir, name):
    """(rows, seconds, problem or None)"""
    start = time.time()
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(v) for v in row) for row in df.select(*[f"`{c}`" for c in columns]).collect())
    seconds = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(got), seconds, None if got else "no rows"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return len(got), seconds, f"columns {columns} / {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = sorted(tuple(cell(row[i]) for i in order) for row in cursor.fetchall())
    if got == want:
        return len(got), seconds, None if got else "no rows"
    only_got, only_want = set(got) - set(want), set(want) - set(got)
    return len(got), seconds, f"{len(got)}/{len(want)} rows; got {sorted(only_got)[:2]} want {sorted(only_want)[:2]}"


if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(entry.queries())
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    con, bad = database(sf_dir), 0
    for name in wanted:
        try:
            rows, seconds, problem = compare(session, con, sf_dir, name)
            bad += problem is not None
            print(f"{'ok ' if problem is None else 'BAD'} {name:18} {rows:7} rows {seconds:6.1f}s {problem or ''}"[:1500], flush=True)
        except Exception as error:  # keep going: one failure should not hide the others
            bad += 1
            print(f"ERR {name}: {type(error).__name__} {str(error)[:900]}", flush=True)
    print("failures:", bad, flush=True)
    sys.exit(bool(bad))
