"""Headline timings.  Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

import tabscope as ts  # noqa: E402
from tabscope.operators import relations  # noqa: E402

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tabscope-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(max(8, int(cpus) * 2)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}

    def run(fn):
        t0 = time.time()
        fn()
        return round(time.time() - t0, 3)

    # warm-up (not timed): JIT-compiles the JVM code paths once, as in any
    # long-running session, by profiling the 5-row region table
    ts.profile_table(frames["region"], "region")

    q = {}
    q["profile_lineitem"] = run(lambda: ts.profile_table(frames["lineitem"], "lineitem").profile.count())
    q["profile_all_tables"] = run(lambda: ts.profile_tables(frames).report.collect())
    q["exact_profile_lineitem"] = run(
        lambda: ts.column_profile(frames["lineitem"], ts.ProfileOptions(exact=True), "lineitem").collect())
    q["fk_star_all_tables"] = run(lambda: relations.containment(frames, rule="star").collect())
    q["pii_scores_documents"] = run(lambda: ts.pii_scores(frames["documents"], source_table="documents").collect())
    total = round(sum(q.values()), 3)
    print(json.dumps({"metric": "profile_suite_total", "value": total, "unit": "sec", "queries": q,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
