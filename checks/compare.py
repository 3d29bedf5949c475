"""Run registered queries next to their SQL and compare rows, columns and values."""

from __future__ import annotations

import sys
import time
import traceback

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def local_session(cores: str = "8", settings: dict[str, str] | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in (settings or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{directory}/{table}.parquet'")
    return con


def normalized(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def cell(value):
        if value is None or value is pd.NA or (isinstance(value, float) and value != value):
            return "<null>"
        if isinstance(value, bool) or type(value).__name__ == "bool_":
            return str(bool(value))
        if isinstance(value, (int, float)) or hasattr(value, "dtype"):
            return repr(round(float(value), 9) + 0.0)
        return str(value)

    return sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False, name=None))


def main(directory: str, names: list[str]) -> int:
    from checks.oracle import ORACLES
    from checks.registry import QUERIES

    spark, con, bad = local_session(), connect(directory), 0
    for name in names or list(QUERIES):
        try:
            start = time.time()
            got = QUERIES[name](spark, directory).toPandas()
            spent = time.time() - start
            line = f"{name}: rows={len(got)} spark={spent:.1f}s"
            if name in ORACLES:
                start = time.time()
                want = con.execute(ORACLES[name]).df()
                line += f" sql={time.time() - start:.1f}s"
                left, right = normalized(got), normalized(want)
                same = sorted(got.columns) == sorted(want.columns) and left == right
                line += " OK" if same else " DIFFERENT"
                if not same:
                    bad += 1
                    line += f"\n  {sorted(got.columns)} {len(left)}\n  {sorted(want.columns)} {len(right)}"
                    extra = [r for r in left if r not in set(right)][:3]
                    missing = [r for r in right if r not in set(left)][:3]
                    line += f"\n  only spark: {extra}\n  only sql:   {missing}"
            else:
                line += " (no sql)"
        except Exception:
            bad += 1
            line = f"{name}: FAILED\n" + traceback.format_exc()[-1500:]
        print(line, flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
