"""Headline queries over tables laid out in several files: one warm-up and BENCH_RUNS timed runs each into the noop sink; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 1), BENCH_ONLY (names by comma).
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from checks.registry import STREAMS, queries
from pickflow.session import build_session

TABLES = ("lineitem", "orders", "part")

HEADLINE = (
    "receive_summary receive_orders classify_orders split_batch_by_rack batch_counts merge_batch stock_priority assign_candidates"
    " allocate_lines allocate next_mapping_order map_boxes input_seq_list box_input_tab resolve_scan picking_jobs confirm_pick"
    " pick_to_orders station_done box_packs batch_progress_jobs batch_progress_orders batch_result close_check stream_progress"
).split()


def laid_out(spark: SparkSession, sf_dir: str, folder: str, files: int) -> str:
    """The tables the batch queries read, in several files each, as a table of any size is; one file of one row group is one task."""
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(files).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered, medians, every = queries(), {}, {}
    start, folder = time.perf_counter(), tempfile.mkdtemp(prefix="bench-")
    tables = laid_out(spark, sf_dir, folder, int(cpus))
    layout = round(time.perf_counter() - start, 3)
    for name in names:
        times, read = [], sf_dir if name in STREAMS else tables
        for _ in range(runs + 1):
            start = time.perf_counter()
            registered[name](spark, read).write.format("noop").mode("overwrite").save()
            times.append(round(time.perf_counter() - start, 3))
        every[name], medians[name] = times[1:], statistics.median(times[1:])
        print(name, times, file=sys.stderr, flush=True)
    spark.stop()
    shutil.rmtree(folder, ignore_errors=True)
    result = {
        "metric": "total of median query times",
        "value": round(sum(medians.values()), 3),
        "unit": "sec",
        "queries": medians,
        "runs": every,
        "layout": layout,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": int(cpus),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
