"""Compare a registered query with its DuckDB oracle on one scale, values and all."""

from __future__ import annotations

import math
import os
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _view(path: str) -> str:
    return f"{path}/*.parquet" if os.path.isdir(path) else path


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{_view(f'{sf_dir}/{t}.parquet')}'")
    rel = con.execute(sql)
    return [c[0] for c in rel.description], rel.fetchall()


def _key(row):
    return tuple((v is None, round(v, 6) if isinstance(v, float) and not math.isnan(v) else (str(v) if v is None or isinstance(v, (list, float)) else v)) for v in row)


def compare(df, sql: str, sf_dir: str) -> tuple[int, list[str]]:
    """(rows, differences)."""
    names, want = oracle_rows(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return 0, [f"columns {sorted(df.columns)} against {sorted(names)}"]
    order = sorted(names)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=_key)
    want = sorted((tuple(r[names.index(c)] for c in order) for r in want), key=_key)
    out = [] if len(got) == len(want) else [f"{len(got)} rows against {len(want)}"]
    for g, w in zip(got, want):
        for c, x, y in zip(order, g, w):
            if x != y and not (isinstance(x, float) and isinstance(y, float) and (math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) or (math.isnan(x) and math.isnan(y)))):
                out.append(f"{c}: {x!r} against {y!r} in {g}")
    return len(got), out


if __name__ == "__main__":
    import time

    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1]
    qs, os_ = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or qs:
        t = time.time()
        if name in os_:
            n, diff = compare(qs[name](spark, sf), os_[name], sf)
            print(name, n, "ok" if not diff else f"{len(diff)} DIFFERENCES {diff[:3]}", f"{time.time() - t:.1f}s", flush=True)
        else:
            print(name, qs[name](spark, sf).count(), "rows, no oracle", f"{time.time() - t:.1f}s", flush=True)
