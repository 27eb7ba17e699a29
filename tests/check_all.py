"""python tests/check_all.py <sf_dir> [query ..]: compare the registered queries with their SQL."""

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

import __spark_entry__ as entry  # noqa: E402
from compare import spark_rows, sql_rows  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

if __name__ == "__main__":
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        start = time.time()
        try:
            mine = spark_rows(entry.queries()[name](spark, sf_dir))
            took = time.time() - start
            theirs = sql_rows(entry.oracle_sql()[name], sf_dir)
            verdict = "ok" if mine == theirs else "DIFFERS"
            print(f"{name:32} {verdict:8} {sum(mine[1].values()):8} rows {took:6.2f} s", flush=True)
            if mine != theirs:
                print("   columns", mine[0], theirs[0])
                print("   only spark", list((mine[1] - theirs[1]).items())[:3])
                print("   only sql", list((theirs[1] - mine[1]).items())[:3])
        except Exception as e:
            print(f"{name:32} ERROR {str(e)[:600]}", flush=True)
