"""Runs registered queries beside their SQL: ``python tests/compare.py [--sf DIR] [NAME...]``."""

from __future__ import annotations

import atexit
import math
import os
import shutil
import sys
import tempfile
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


def session() -> SparkSession:
    scratch = tempfile.mkdtemp(prefix="siftmill-tests-")
    atexit.register(shutil.rmtree, scratch, True)
    conf = {
        "spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("TEST_DRIVER_MEMORY", "6g"), "spark.sql.warehouse.dir": f"{scratch}/warehouse",
        "spark.checkpoint.dir": f"file://{scratch}/shared",
    }
    spark = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        c.execute(f"create view {p.stem} as select * from '{p / '*.parquet' if p.is_dir() else p}'")
    return c


def plain(x):
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def rows(names: list[str], data) -> list:
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(((tuple(plain(r[i]) for i in at)) for r in data), key=repr)


def compare(spark: SparkSession, c: duckdb.DuckDBPyConnection, query, sql: str, folder: str) -> str:
    """Empty if both agree, else what differs."""
    df = query(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = c.execute(sql)
    names = [x[0] for x in rel.description]
    want = rows(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if got == want:
        return ""
    extra, less = [r for r in got if r not in want][:2], [r for r in want if r not in got][:2]
    return f"{len(got)} rows against {len(want)}; only here {extra}; only in SQL {less}"


def main() -> int:
    import __spark_entry__ as e

    args = sys.argv[1:]
    folder = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        folder, args = args[1], args[2:]
    spark, c, bad = session(), duck(folder), 0
    for name, q in e.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t = time.time()
        sql = e.oracle_sql().get(name)
        try:
            said = compare(spark, c, q, sql, folder) if sql else f"rows only: {q(spark, folder).count()}"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:500]}"
        bad += bool(said) and not said.startswith("rows only")
        print(f"{name}: {said or 'ok'} ({time.time() - t:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
