"""Readers, the report store and whole-table / batch profiling."""
import os

import pytest
from pyspark.sql import functions as F

import tabscope as ts
from tabscope.sources.readers import discover_siblings, infer_format
from tabscope.plans.profile import batch_summary, summarize

from conftest import SF_SMALL


def test_csv_round_trip_with_options(spark, scratch):
    p = os.path.join(scratch, "csv", "accounts.csv")
    spark.createDataFrame([(1, "a;b"), (2, "c")], "id int, note string").coalesce(1).write.option(
        "header", True).option("sep", "|").csv(p)
    df = ts.read_source(spark, ts.SourceSpec(table="accounts", connection_type="csv", options={"sep": "|"}),
                        data_root=scratch)
    assert sorted(df.collect()) == [(1, "a;b"), (2, "c")]
    assert dict(df.dtypes)["id"] == "int"


def test_parquet_by_path_and_format_inference(spark, scratch):
    p = os.path.join(scratch, "parquet", "t")
    spark.range(3).write.parquet(p)
    assert infer_format(spark, p) == "parquet"
    assert ts.read_source(spark, ts.SourceSpec(table="t", path=p)).count() == 3
    assert ts.read_source(spark, ts.SourceSpec(table="t", connection_type="parquet"), data_root=scratch).count() == 3
    with pytest.raises(ValueError):
        ts.read_source(spark, ts.SourceSpec(table="t", connection_type="file"))
    with pytest.raises(ValueError):
        infer_format(spark, os.path.join(scratch, "nothing.txt"))
    with pytest.raises(ValueError):
        ts.read_source(spark, ts.SourceSpec(table="t", connection_type="duckdb"), data_root=scratch)


def test_catalog_table(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS banking")
    spark.range(4).write.mode("overwrite").saveAsTable("banking.acct")
    assert ts.read_source(spark, ts.SourceSpec(table="acct", database="banking", connection_type="catalog")).count() == 4


def test_sibling_discovery_skips_store_and_broken(spark, scratch):
    root = os.path.join(scratch, "delta")
    for t in ("a", "b", "profiling_reports"):
        spark.range(2).write.parquet(os.path.join(root, t))
    os.makedirs(os.path.join(root, "broken"))
    open(os.path.join(root, "broken", "x.parquet"), "w").write("not parquet")
    found, failed = discover_siblings(spark, root, exclude=["a"])
    assert sorted(found) == ["b"] and list(failed) == ["broken"] and failed["broken"]


def test_catalog_siblings(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS siblings")
    for name in ("one", "two", "profiling_reports"):
        spark.range(2).write.mode("overwrite").saveAsTable(f"siblings.{name}")
    assert {k: df.count() for k, df in ts.catalog_tables(spark, "siblings", exclude=["TWO"]).items()} == {"one": 2}


def test_report_store_round_trip(spark, scratch):
    frames = {t: spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("labels", "documents")}
    batch = ts.profile_tables(frames)
    store = os.path.join(scratch, "profiling_reports")
    ts.write_reports(batch.report, path=store)
    ts.write_reports(batch.report, path=store)  # a rerun adds nothing
    rid = batch.report.where("source_table = 'labels'").first()["report_id"]
    q = ts.report_by_id(spark, rid, path=store)
    assert "EqualTo(report_id" in q._jdf.queryExecution().executedPlan().toString()
    doc = ts.get_report(spark, rid, path=store)
    assert doc["source_table"] == "labels" and doc["schema_version"] == "1.1.0"
    assert doc["fk_hints"][0]["target_table"] == "documents"
    assert doc["stats"][0]["q1"] is not None and "max_str" in doc["stats"][0] and doc["stats"][0]["max_str"] is None  # nulls are kept
    later = batch.report.where("source_table = 'labels'").withColumn("profiled_at", F.expr("profiled_at + INTERVAL 1 DAY")).withColumn("source_system", F.lit("new"))
    ts.write_reports(later, path=store)
    assert ts.get_report(spark, rid, path=store)["source_system"] == "new"
    assert ts.get_report(spark, "missing", path=store) is None
    assert ts.read_reports(spark, store).count() == 3


def test_batch_isolates_a_failing_table(spark):
    frames = {t: spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("nation", "labels", "documents")}
    frames["bad"] = spark.range(3).selectExpr("raise_error('boom') AS x", "CAST(raise_error('boom') AS BIGINT) AS doc_id")
    frames["worse"] = spark.range(3).where("raise_error('lost') IS NULL").selectExpr("id AS doc_id")
    reports = {r.source_table: r for r in ts.profile_tables(frames, failed={"gone": "no such file"}).report.collect()}
    assert set(reports) == {*frames, "gone"}
    assert all(reports[t].errors == [] for t in ("nation", "labels", "documents"))
    assert reports["bad"].row_count == 3 and reports["bad"].columns == []
    assert any("column x" in e and "boom" in e for e in reports["bad"].errors) and any("foreign keys" in e for e in reports["bad"].errors)
    assert reports["worse"].row_count is None and "lost" in reports["worse"].errors[0]
    assert reports["gone"].errors == ["reading gone: no such file"]
    assert [h.target_table for h in reports["labels"].fk_hints] == ["documents"]


def test_a_bad_column_costs_that_column_only(spark):
    df = spark.range(50).selectExpr("id AS ok_id", "CASE WHEN id = 7 THEN raise_error('broken cell') ELSE concat('a', id, '@x.com') END AS bad_id", "concat('ACC-', 100000 + id) AS account")
    p = ts.profile_table(df, "t")
    assert [r["column"] for r in p.profile.orderBy("ordinal").collect()] == ["ok_id", "account"]
    assert {r["column"] for r in p.pattern_findings.collect()} >= {"ok_id", "account"} - {"ok_id"}
    assert p.row_count == 50 and all("bad_id" in e and "broken cell" in e for e in p.errors) and len(p.errors) == 3


def test_sources_as_specs_with_siblings_and_an_unreadable_one(spark, scratch):
    for t in ("labels", "documents"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").write.parquet(os.path.join(scratch, "parquet", t))
    os.makedirs(os.path.join(scratch, "parquet", "broken"))
    open(os.path.join(scratch, "parquet", "broken", "x.parquet"), "w").write("not parquet")
    specs = [ts.SourceSpec(table="labels", name="doc_labels", source_system="crm"), ts.SourceSpec(table="missing")]
    batch = ts.profile_sources(spark, specs, data_root=scratch)
    reports = {r.source_table: r for r in batch.report.collect()}
    assert set(reports) == {"labels", "missing", "broken"}
    assert reports["labels"].interpretation.suggested_entity_name == "Doc Labels" and reports["labels"].source_system == "crm"
    assert reports["labels"].fk_hints[0].target_table == "documents"  # a sibling, not profiled itself
    assert reports["missing"].errors and reports["broken"].errors and reports["missing"].row_count is None


def test_full_batch_report_shape(spark):
    tables = ["region", "nation", "customer", "orders", "documents", "labels", "embeddings"]
    frames = {t: spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in tables}
    batch = ts.profile_tables(frames, display_names={"orders": "sales_orders"})
    rep = {r.source_table: r for r in batch.report.collect()}
    assert set(rep) == set(tables)
    assert rep["orders"].interpretation.suggested_entity_name == "Sales Orders"
    assert rep["orders"].interpretation.confidence == 0.25
    assert [c.name for c in rep["customer"].columns] == ["c_custkey", "c_name", "c_nationkey", "c_acctbal",
                                                         "c_mktsegment"]
    assert rep["labels"].fk_hints[0].target_col == "doc_id"
    summary = batch_summary(batch.report).collect()
    assert {r.source_table: r.row_count for r in summary}["region"] == 5
    top = summarize(batch).where("source_table = 'orders'").collect()
    assert len(top) == 6


def test_report_store_catalog_table(spark):
    frames = {"region": spark.read.parquet(f"{SF_SMALL}/region.parquet")}
    batch = ts.profile_tables(frames)
    spark.sql("CREATE DATABASE IF NOT EXISTS profiling")
    ts.write_reports(batch.report, table="profiling.reports", fmt="parquet")
    rid = batch.report.first()["report_id"]
    doc = ts.get_report(spark, rid, table="profiling.reports")
    assert doc["source_table"] == "region" and doc["columns"][0]["name"] == "r_regionkey"
    assert set(spark.table("profiling.reports").columns) >= {"report_id", "report_json", "profiled_date"}
