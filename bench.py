"""Headline queries of the engine: prints one JSON line.

BENCH_SF_DIR: the tables (default /root/testdata/sf0.1); BENCH_CPUS: threads (default 8).
Each query is run once to warm up and once to be timed. csv_* read a text file rendered from lineitem.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tabloom.operators.profile import basic_statistics  # noqa: E402
from tabloom.operators.sink import csv_lines, header_line, write_parquet  # noqa: E402
from tabloom.sources.csv import read_csv  # noqa: E402


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    work = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{work}/shared").config("spark.sql.files.maxPartitionBytes", "8m")
        # HotSpot doesn't compile methods of over 8000 bytes; Spark then generates smaller ones
        .config("spark.sql.codegen.hugeMethodLimit", "8000").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    path = f"{work}/lineitem.csv"
    with open(path, "w") as out:
        out.write(header_line(lineitem.columns) + "\n")
        for row in csv_lines(lineitem, exact=True).toLocalIterator():
            out.write(row.value + "\n")
    size = os.path.getsize(path)

    def read(**named):
        return read_csv(spark, path, **named)

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    runs = {
        "csv_open_and_infer": lambda: read(),
        "csv_count": lambda: read(separator=",").num_rows,
        "csv_typed_parse": lambda: noop(read(separator=",").df),
        "csv_two_columns": lambda: read(separator=",").df.groupBy("l_returnflag").agg(F.sum("l_quantity")).collect(),
        "csv_infer_all_rows": lambda: read(separator=",", sample_rows=0),
        "csv_to_parquet": lambda: write_parquet(read(separator=",").df, f"{work}/out"),
        "csv_errors": lambda: read(separator=",", error_mode="permissive").errors.count(),
        "csv_render": lambda: noop(csv_lines(lineitem)),
        "statistics": lambda: basic_statistics(lineitem).collect(),
    }
    seconds = {}
    for name, run in runs.items():
        run()
        began = time.time()
        run()
        seconds[name] = round(time.time() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    rates = {n: round(size / 1e6 / s, 1) for n, s in seconds.items() if n.startswith("csv_") and n != "csv_open_and_infer" and s}
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"), "text_mb": round(size / 1e6, 1), "mb_per_sec": rates}))
    spark.stop()


if __name__ == "__main__":
    main()
