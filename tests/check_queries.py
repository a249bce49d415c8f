"""Run the catalog against its SQL twins: python tests/check_queries.py SF_DIR [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession

from __spark_entry__ import oracle_sql, queries
from tests.compare import connect, difference


def main(sf_dir: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    builds, sql = queries(), oracle_sql()
    bad = 0
    for name in names or builds:
        start = time.time()
        try:
            rows = builds[name](spark, sf_dir).toPandas()
            took = time.time() - start
            problem = difference(rows, con.sql(sql[name]).df()) if name in sql else "no sql"
            shape = f"{len(rows)}x{len(rows.columns)}"
        except Exception as error:  # noqa: BLE001
            problem, took, shape = f"{type(error).__name__}: {str(error)[:400]}", 0.0, "-"
        good = problem in (None, "no sql")
        bad += not good
        print(f"{'ok ' if good else 'BAD'} {name:28s} {took:6.2f}s {shape:>12s} {problem or ''}",
              flush=True)
    print(f"{bad} bad of {len(names or builds)}")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
