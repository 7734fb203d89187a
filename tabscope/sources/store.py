"""Report store: append-only table of (report_id, source_table, source_system,
profiled_at, report_json, profiled_date).

A new store is partitioned by a bucket of the report's id, then by day: a lookup by id lists the files of one bucket of
4096, whatever the number of days.  A store that exists keeps its partitioning (older ones have days only).  An append leaves out
reports that the store already has, so that a rerun of a failed or finished append writes none twice; only the new ids'
buckets are read for that.
"""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import delta_available, list_dirs, path_exists

BUCKET, DAY = "id_bucket", "profiled_date"
STORED = f"report_id string, source_table string, source_system string, profiled_at timestamp, report_json string, {DAY} date"
#: The report document, as :func:`tabscope.plans.profile.build_report` makes it.
REPORT_SCHEMA = (
    "report_id string, source_table string, source_system string, profiled_at timestamp, row_count bigint, "
    "columns array<struct<ordinal:int,name:string,spark_type:string,nullable:boolean,is_pk_candidate:boolean,uniqueness_ratio:double>>, "
    "stats array<struct<ordinal:int,column:string,null_pct:double,cardinality_est:bigint,min_num:double,max_num:double,min_str:string,max_str:string,"
    "mean_val:double,stddev_val:double,q1:double,q3:double,outlier_count:bigint,has_outliers:boolean>>, "
    "pii_info array<struct<ordinal:int,column:string,is_pii:boolean,pii_type:string,confidence:double>>, "
    "detected_patterns array<struct<ordinal:int,column:string,patterns:array<string>,heuristics:array<string>,uniqueness_score:double>>, "
    "fk_hints array<struct<source_col:string,target_table:string,target_col:string,match_ratio:double>>, "
    "interpretation struct<suggested_entity_name:string,bk_candidates:array<struct<column:string,confidence:double,reasoning:string>>,"
    "pii_summary:array<string>,dq_flags:array<string>,confidence:double>, "
    "errors array<string>, schema_version string"
)


def id_bucket(report_id: Column) -> Column:
    return F.substring(F.sha2(report_id, 256), 1, 3)


def report_rows(reports: DataFrame) -> DataFrame:
    """Nested reports to the stored columns."""
    return reports.select(
        "report_id", "source_table", "source_system", "profiled_at",
        F.to_json(F.struct(*[F.col(c) for c in reports.columns]), {"ignoreNullFields": "false"}).alias("report_json"),
        F.to_date("profiled_at").alias(DAY),
    )


def _stored(spark: SparkSession, path: str | None, table: str | None) -> DataFrame | None:
    """The store, if there is one."""
    if table:
        return spark.table(table) if spark.catalog.tableExists(table) else None
    partitions = path_exists(spark, path) and any("=" in d for d in list_dirs(spark, path))
    return read_reports(spark, path) if partitions else None


def _missing(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows whose (report_id, profiled_at) the store doesn't have."""
    if BUCKET in stored.columns:
        buckets = [r[0] for r in rows.select(id_bucket(F.col("report_id"))).distinct().collect()]  # 4096 at most
        stored = stored.where(F.col(BUCKET).isin(buckets))
    have = stored.select(F.col("report_id").alias("_id"), F.col("profiled_at").alias("_at"))
    return rows.join(have, rows["report_id"].eqNullSafe(have["_id"]) & rows["profiled_at"].eqNullSafe(have["_at"]), "left_anti")


def write_reports(reports: DataFrame, path: str | None = None, table: str | None = None,
                  fmt: str | None = None) -> None:
    """Append the reports that aren't there yet to a catalog table (when ``table`` is given) or a folder."""
    if not (path or table):
        raise ValueError("give a path or a table")
    spark = reports.sparkSession
    fmt = fmt or ("delta" if delta_available(spark) else "parquet")
    rows, stored = report_rows(reports).dropDuplicates(["report_id", "profiled_at"]), _stored(spark, path, table)
    by = [BUCKET, DAY]
    if stored is not None:
        rows = _missing(rows, stored)
        by = by if BUCKET in stored.columns else [DAY]
    if BUCKET in by:
        rows = rows.withColumn(BUCKET, id_bucket(F.col("report_id")))
    writer = rows.write.mode("append").partitionBy(*by).format(fmt)
    writer.saveAsTable(table) if table else writer.save(path)


def read_reports(spark: SparkSession, path: str | None = None, table: str | None = None,
                 fmt: str | None = None) -> DataFrame:
    """The stored rows, documents as JSON."""
    if table:
        return spark.table(table)
    fmt = fmt or ("delta" if path_exists(spark, path.rstrip("/") + "/_delta_log") else "parquet")
    if fmt != "parquet":
        return spark.read.format(fmt).load(path)
    bucketed = any(d.startswith(f"{BUCKET}=") for d in list_dirs(spark, path))
    # declared, so that no file is opened for a schema and a bucket like 012 stays text
    return spark.read.schema(STORED + f", {BUCKET} string" * bucketed).parquet(path)


def load_reports(spark: SparkSession, path: str | None = None, table: str | None = None) -> DataFrame:
    """The stored reports as typed rows (:data:`REPORT_SCHEMA`), for queries over columns, statistics, findings and hints.
    Fields that a document of another version lacks are null."""
    stored = read_reports(spark, path, table)
    doc = stored.select("profiled_at", F.from_json("report_json", REPORT_SCHEMA).alias("r"))
    # the row's own time is exact; JSON rounds it
    return doc.select("r.*", F.col("profiled_at").alias("_at")).withColumn("profiled_at", F.col("_at")).drop("_at")


def report_by_id(spark: SparkSession, report_id: str, path: str | None = None, table: str | None = None) -> DataFrame:
    """Stored rows of one report: the id's bucket prunes the files, the equality filter reaches the Parquet scan."""
    stored = read_reports(spark, path, table)
    if BUCKET in stored.columns:
        stored = stored.where(F.col(BUCKET) == id_bucket(F.lit(report_id)))
    return stored.where(F.col("report_id") == F.lit(report_id)).select("report_id", "source_table", "profiled_at", "report_json")


def get_report(spark: SparkSession, report_id: str, path: str | None = None, table: str | None = None) -> dict | None:
    """The report document as a dict (of several with the id, the latest), or None when the id is unknown."""
    if table is None and (path is None or not path_exists(spark, path)):
        return None
    rows = report_by_id(spark, report_id, path, table).orderBy(F.desc("profiled_at"), "report_json").limit(1).collect()
    return json.loads(rows[0]["report_json"]) if rows else None
