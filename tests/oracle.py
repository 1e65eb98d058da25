"""Runs queries of __spark_entry__ beside their SQL in DuckDB: python tests/oracle.py FOLDER [NAME...]"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def connect(folder):
    db = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        at = p if p.is_file() else p / "*.parquet"
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{at}'")
    return db


def compare(spark, db, folder, f, sql):
    """None if equal, else what differs."""
    df = f(spark, folder)
    cols = sorted(df.columns)
    got = sorted(([norm(v) for v in r] for r in df.select(*cols).collect()), key=repr)
    rel = db.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} and {sorted(rel.columns)}"
    want = sorted(([norm(v) for v in r] for r in rel.select(*[f'"{c}"' for c in cols]).fetchall()), key=repr)
    if repr(got) == repr(want):
        return None
    odd = [(a, b) for a, b in zip(got, want) if repr(a) != repr(b)][:2]
    return f"{len(got)} rows and {len(want)}; {odd}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
         .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", "/tmp/heronry-warehouse").getOrCreate())
    s.sparkContext.setLogLevel("OFF")
    q, sql, db, bad = e.queries(), e.oracle_sql(), connect(sys.argv[1]), 0
    for name in sys.argv[2:] or list(q):
        t = time.time()
        try:
            r = compare(s, db, sys.argv[1], q[name], sql[name]) if name in sql else f"no SQL, {q[name](s, sys.argv[1]).count()} rows"
        except Exception as x:
            r = f"{type(x).__name__}: {str(x)[:600]}"
        bad += r is not None and not r.startswith("no SQL")
        print(f"{name}: {'equal' if r is None else r} ({time.time() - t:.1f} s)", flush=True)
    print("differ:", bad)
