"""Print the physical plans of the main passes (for plan review).

usage: python tools/show_plans.py [sf_dir]
"""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

import tabscope as ts  # noqa: E402
from tabscope.functions.families import column_specs  # noqa: E402
from tabscope.operators import pii, patterns, relations, stats  # noqa: E402
from tabscope.operators.scan import FusedScan  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    opts = ts.ProfileOptions()
    specs = column_specs(li.schema)
    scan = FusedScan(li, specs)
    stats.add_stats_aggs(scan, opts)
    pii.add_pii_aggs(scan, opts)
    patterns.add_pattern_aggs(scan, opts)
    print("===== first pass")
    scan.aggregate().explain("formatted")
    print("===== exact distinct counts")
    stats.exact_distinct(li, specs).explain("formatted")
    frames = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("lineitem", "orders", "customer")}
    print("===== foreign keys, star rule")
    relations.containment(frames, rule="star").explain("formatted")


if __name__ == "__main__":
    main()
