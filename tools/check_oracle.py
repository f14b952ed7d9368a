"""Compare registered queries with their SQL: python tools/check_oracle.py SF_DIR [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from understory.catalog.oracle import all_oracles  # noqa: E402
from understory.catalog.queries import all_queries  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        files = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"create view {path.stem} as select * from read_parquet('{files}')")
    return con


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(spark: SparkSession, con, name: str, sf_dir: str) -> tuple[bool, str]:
    frame = all_queries()[name](spark, sf_dir)
    start = time.time()
    mine = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    spent = time.time() - start
    result = con.execute(all_oracles()[name])
    names = [d[0] for d in result.description]
    theirs = canonical(names, result.fetchall())
    if sorted(names) != sorted(frame.columns):
        return False, f"columns {sorted(names)} vs {sorted(frame.columns)}"
    if mine == theirs:
        return True, f"{len(mine)} rows, {spent:.1f}s"
    missing = [r for r in theirs if r not in set(mine)][:2]
    extra = [r for r in mine if r not in set(theirs)][:2]
    return False, f"{len(mine)} vs {len(theirs)} rows\n  only SQL {missing}\n  only Spark {extra}"


def main() -> None:
    sf_dir, *names = sys.argv[1:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names or all_queries():
        try:
            same, note = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the other queries
            same, note = False, str(error)[:600]
        failed += not same
        print("ok  " if same else "FAIL", name, note, flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
