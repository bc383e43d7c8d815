"""Times the headline work at one scale and prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of cores. The headline value is one
general clean of lineitem as a user runs it: CSV parts written, and the report with the column
profile and the count of exact copies.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame

from sieveframe import build_session, clean, profile, scratch_folder, write_result
from sieveframe.catalog import QUERIES

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
HEADLINE = ("tidy_write_parts", "tidy_report")
REGISTERED = ["tidy_rows", "exact_dedup", "run_report", "column_profile", "html_text", "slug_text", "latest_by_key",
              "delivery_gaps", "retained_deliveries", "sheet_union", "fragment_stack", "json_rows", "stream_dedup"]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": str(CPUS), "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    # The provided file is a single row group, which one task would read alone; a table of any size
    # comes in many. The whole table is written out as one file per core, outside the timings.
    split = scratch_folder(spark, "lineitem")
    spark.read.parquet(f"{FOLDER}/lineitem.parquet").repartition(CPUS).write.parquet(split)
    lineitem = spark.read.parquet(split)

    work = {
        "tidy_write_parts": lambda: write_result(clean(lineitem), scratch_folder(spark, "bench")),
        "tidy_report": lambda: run(clean(lineitem).report),
        "tidy_data": lambda: run(clean(lineitem).data),
        "profile_lineitem": lambda: run(profile(lineitem)),
        "dedup_lineitem": lambda: run(clean(lineitem, "dedup").data),
        "duplicates_report": lambda: run(clean(lineitem, "duplicates").report),
        **{name: (lambda name=name: run(QUERIES[name](spark, FOLDER))) for name in REGISTERED},
    }
    run(profile(lineitem.limit(1000)))  # the JVM's first query
    first, seconds = {}, {}
    for name, job in work.items():  # the first run compiles, the second is the figure
        for figures in (first, seconds):
            started = time.perf_counter()
            job()
            figures[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds[name] for name in HEADLINE), 3)
    rows = lineitem.count()
    print(json.dumps({"metric": "clean_and_profile_lineitem", "value": total, "unit": "sec", "queries": seconds,
                      "first_run": first, "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1], "rows": rows,
                      "rows_per_sec": round(rows / total)}))


if __name__ == "__main__":
    main()
