"""Run registered queries beside their SQL twins and report differences: ``python tests/oracle_check.py SF [names...]``."""

from __future__ import annotations

import math
import os
import sys
import threading
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(df, con, sql: str) -> str:
    t = time.time()
    got_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    timer = threading.Timer(float(os.environ.get("SQL_LIMIT", "60")), con.interrupt)
    timer.start()
    rel = con.sql(sql)
    want_rows = rel.fetchall()
    timer.cancel()
    print(f"   spark {t1 - t:.1f}s sql {time.time() - t1:.1f}s", end=" ")
    gt, wt = dict(df.dtypes), dict(zip(rel.columns, [str(t) for t in rel.types], strict=True))
    if sorted(gt) != sorted(wt):
        return f"columns differ: {sorted(gt)} / {sorted(wt)}"
    bad = [(c, gt[c], wt[c]) for c in gt if gt[c] in SAME and SAME[gt[c]] != wt[c]]
    got, want = rows_of(df.columns, got_rows), rows_of(rel.columns, want_rows)
    if got != want:
        only_g, only_w = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        n = len(set(got) - set(want))
        return f"rows differ {len(got)}/{len(want)} ({n} unlike) cols={sorted(df.columns)} spark={only_g} sql={only_w}"
    return f"types differ: {bad}" if bad else f"ok {len(got)} rows"


def main() -> None:
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, queries = connect(sf_dir), entry.oracle_sql(), entry.queries()
    for name in sys.argv[2:] or list(queries):
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sqls:
                msg = compare(df, con, sqls[name])
            else:
                msg = f"rows-only {df.count()} {df.dtypes}"
        except Exception as err:  # report and go on
            msg = "FAILED " + str(err)[:900]
        print(f"{name:28s} {time.time() - t:6.1f}s {msg}", flush=True)


if __name__ == "__main__":
    main()
