"""Run registered queries and their SQL side by side: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from typing import TYPE_CHECKING

from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES

if TYPE_CHECKING:
    import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()

# Spark type -> the DuckDB type it must meet.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def local_session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("reliefsignals-checks")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    import duckdb  # only the comparison needs it, not those that take the session

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v: object) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def differences(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, sf_dir: str) -> list[str]:
    """What differs between the two results; empty when they agree."""
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    result = con.execute(ORACLE[name])
    described = {d[0]: str(d[1]) for d in result.description}
    if sorted(described) != columns:
        return [f"columns {columns} against {sorted(described)}"]
    problems = []
    for c, t in frame.dtypes:
        if TYPES.get(t, t) != described[c]:
            problems.append(f"type of {c}: {t} against {described[c]}")
    order = [list(described).index(c) for c in columns]
    expected = sorted(tuple(_cell(r[i]) for i in order) for r in result.fetchall())
    actual = sorted(tuple(_cell(r[c]) for c in columns) for r in frame.collect())
    if len(actual) != len(expected):
        problems.append(f"rows {len(actual)} against {len(expected)}")
    if not expected:
        problems.append("no rows")
    if actual != expected:
        extra, missing = set(actual) - set(expected), set(expected) - set(actual)
        problems.append(f"{len(extra)} rows only in Spark, {len(missing)} only in SQL {columns}")
        problems += [f"  spark {r}" for r in sorted(extra)[:2]] + [f"  sql   {r}" for r in sorted(missing)[:2]]
    return problems


def main(args: list[str]) -> int:
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(QUERIES)
    spark, con, bad = local_session(), database(sf_dir), 0
    for name in names:
        start = time.perf_counter()
        try:
            problems = differences(spark, con, name, sf_dir) if name in ORACLE else ["no SQL"]
        except Exception as error:  # noqa: BLE001 - the report goes on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(problems)
        print(f"{'DIFF' if problems else 'ok':5}{name:28}{time.perf_counter() - start:7.2f}s", flush=True)
        for p in problems:
            print("     ", p[:900])
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
