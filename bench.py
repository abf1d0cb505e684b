"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up and then three times; its figure is the best.  Parquet
writing and reading by codec (a million employee-shaped rows, a file for each core, by the
engine's own reader and writer) are beside them.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.plans import queries as core
from tessera.sources import parquet

NAMES = "pricing_summary filter inner_join left_join full_join join_multi grp_aggregate grp_top count_distinct n_largest distinct_by cum_sum rolling_mean shift forward_fill melt explode parse_date cast_values".split()


def timed(run, times: int = 3) -> float:
    run()
    best = float("inf")
    for _ in range(times):
        began = time.perf_counter()
        run()
        best = min(best, time.perf_counter() - began)
    return round(best, 4)


def main() -> None:
    where, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = core.queries()
    took = {n: timed(lambda n=n: known[n](spark, where).write.format("noop").mode("overwrite").save()) for n in NAMES}
    top = tempfile.mkdtemp(prefix="tessera-bench-")
    rows = spark.range(1_000_000).select(
        F.col("id").cast("int").alias("id"), F.concat(F.lit("Employee "), "id").alias("name"), F.concat(F.lit("user"), "id", F.lit("@example.com")).alias("email"),
        (F.col("id") % 2 == 0).alias("active"), (F.col("id") * 0.5 + 50000).cast("decimal(12,2)").alias("salary"), F.date_add(F.lit("1980-01-01").cast("date"), (F.col("id") % 9000).cast("int")).alias("born"),
    )
    rows = rows.repartition(int(cpus)).cache()
    rows.count()
    sizes = {}
    for codec in ("UNCOMPRESSED", "SNAPPY", "GZIP", "LZ4"):
        path, name = f"{top}/{codec}", parquet.CODECS[codec]
        took[f"parquet_write_{name}"] = timed(lambda p=path, c=codec: parquet.write(rows, p, compression=c))
        took[f"parquet_read_{name}"] = timed(lambda p=path: parquet.read_table(spark, p).write.format("noop").mode("overwrite").save())
        sizes[name] = sum(e.stat().st_size for e in os.scandir(path))
    shutil.rmtree(top, ignore_errors=True)
    scale = re.search(r"sf([\d.]+)", where)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale[1]) if scale else None, "parquet_bytes": sizes, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
