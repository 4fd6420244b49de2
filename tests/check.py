"""Command line: python tests/check.py FOLDER [name part ...] -- compare queries with their twins."""

import sys
import time

sys.path.insert(0, ".")
from gustfront.catalog.load import registered, twins
from gustfront.session import build_session
from tests.harness import compare, connect

if __name__ == "__main__":
    folder, parts = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(folder), twins(), 0
    for name, build in registered().items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            n = compare(spark, folder, build, sql[name], con) if name in sql else len(build(spark, folder).collect())
            print(f"{'ok  ' if name in sql else 'rows'} {name} rows={n} {time.time() - t:.2f}s", flush=True)
        except Exception as e:
            bad += 1
            print(f"FAIL {name} {type(e).__name__}: {str(e)[:900]}", flush=True)
    print("failures:", bad)
