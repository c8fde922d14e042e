"""Run registered queries against their SQL: check_all.py SF [name part ...]"""

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from pyspark.sql import SparkSession  # noqa: E402

from catalog import CASES  # noqa: E402
from tests.compare import connect, difference_of_rows  # noqa: E402


def main(sf: str, parts) -> int:
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    db, bad = connect(sf), 0
    for name, case in CASES.items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start = time.time()
        try:
            df = case.run(spark, sf)
            got = df.collect()
            spent = time.time() - start
            problem = difference_of_rows(df, got, db, case.sql) if case.sql else None
            note = f"{len(got)} rows, Spark {spent:.2f}s" + ("" if case.sql else ", no SQL")
        except Exception as error:  # noqa: BLE001
            problem, note = f"{type(error).__name__}: {str(error)[:600]}", ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok':4} {name:32} {time.time() - start:6.2f}s {note}"
              + (f"\n     {problem}" if problem else ""), flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
