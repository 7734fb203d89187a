"""Failure isolation by group testing, constant report plans, pruned foreign keys, the report store and declared schemas."""
import dataclasses
import datetime
import math
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import tabscope as ts
from tabscope.functions.exprs import sql_credit_card
from tabscope.functions.frames import local_rows
from tabscope.operators import relations
from tabscope.operators.scan import FusedScan
from tabscope.plans import profile as P
from tabscope.sources import store
from tabscope.sources.readers import catalog_siblings

from conftest import SF, SF_SMALL

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


# -- failures ---------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65])
@pytest.mark.parametrize("f", [1, 2, 3])
def test_group_testing_finds_every_failure_in_few_runs(n, f):
    import random

    for seed in range(20):
        bad, runs = set(random.Random(seed).sample(range(n), min(f, n))), []

        def run(items):
            runs.append(items)
            if own := bad & set(items):
                raise ValueError(f"item {min(own)}")
            return items

        good, found = P.failing_items(run, list(range(n)), ValueError(f"item {min(bad)}"))
        assert {i for i, _ in found} == bad and sorted(x for g in good for x in g) == sorted(set(range(n)) - bad)
        assert len(runs) <= 2 * len(bad) * max(1, math.ceil(math.log2(n)))
        assert all(str(e) == f"item {i}" for i, e in found)


def test_one_bad_column_of_22_costs_few_scans(spark, monkeypatch):
    scans = []
    collect = FusedScan.collect

    def counted(self):
        if self._values is None:
            scans.append(self)
        return collect(self)

    df = spark.range(50).selectExpr(*[f"id * {i} AS c{i}" for i in range(21)], "CASE WHEN id = 7 THEN raise_error('broken cell') ELSE 'a' END AS bad")
    monkeypatch.setattr(FusedScan, "collect", counted)
    errors = []
    scan, done = P._first_pass(df, ts.ProfileOptions(), errors)
    assert len(scans) <= 2 * 3 * math.log2(22 * 3) + 2 and len(scans) < 20
    assert len(errors) == 3 and all("column bad" in e and "broken cell" in e for e in errors)
    assert [s.name for s in done["statistics"]] == [f"c{i}" for i in range(21)] and scan.rows == 50


def test_an_unreadable_table_costs_two_scans(spark, monkeypatch):
    runs = []
    monkeypatch.setattr(FusedScan, "aggregate", lambda self, f=FusedScan.aggregate: runs.append(1) or f(self))
    p = ts.profile_table(spark.range(3).where("raise_error('lost') IS NULL"), "gone")
    assert p.row_count is None and "lost" in p.errors[0] and len(runs) == 2


def test_foreign_keys_leave_out_columns_that_fail(spark):
    ids = spark.range(100).selectExpr("id AS doc_id")
    frames = {"docs": ids, "notes": spark.range(50).selectExpr("id AS doc_id", "CAST(raise_error('boom') AS BIGINT) AS other_id", "id AS other_doc_id")}
    frames |= {f"bad{i}": spark.range(3).selectExpr(f"CAST(raise_error('boom {i}') AS BIGINT) AS doc_id") for i in range(3)}
    reports = {r.source_table: r for r in ts.profile_tables(frames).report.collect()}
    assert {(h.source_col, h.target_table) for h in reports["notes"].fk_hints} == {("doc_id", "docs"), ("other_doc_id", "docs")}
    for i in range(3):
        assert any("foreign keys" in e and f"boom {i}" in e for e in reports[f"bad{i}"].errors)
    assert reports["docs"].errors == []


# -- reports ----------------------------------------------------------------------------------------------------

def _size_of_plan(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString())


def test_report_of_500_tables_has_the_plan_of_five(spark):
    p = ts.profile_table(spark.read.parquet(f"{SF_SMALL}/nation.parquet"), "nation")
    none = local_rows(spark, [], relations.FK_SCHEMA).drop("is_hint")

    def batch(n):
        tables = [dataclasses.replace(p, source_table=f"t{i}", report_id=str(i), rows={k: [(f"t{i}", *r[1:]) for r in v] for k, v in p.rows.items()}) for i in range(n)]
        return P.assembled(spark, tables, none, p.opts)

    many = batch(500)
    assert _size_of_plan(many.report) <= 1.05 * _size_of_plan(batch(5).report)
    rows = many.report.collect()
    assert len(rows) == 500 and all(len(r.columns) == 3 and r.row_count == 25 for r in rows)
    assert many.union("profile").count() == 1500 and ts.summarize(many).count() == 1500


def test_lazy_and_fetched_long_forms_agree(spark):
    df = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
    opts = ts.ProfileOptions()
    assert sorted(map(tuple, ts.pii_scores(df, opts, "c").collect())) == sorted(map(tuple, ts.profile_table(df, "c", opts).pii_scores.collect()))
    assert sorted(map(tuple, ts.pattern_scores(df, opts, "c").collect())) == sorted(map(tuple, ts.profile_table(df, "c", opts).pattern_scores.collect()))


# -- foreign keys -----------------------------------------------------------------------------------------------

def test_sketches_keep_every_hint_and_drop_hopeless_pairs(spark):
    a = spark.range(20_000).selectExpr("concat('a', id) AS note_id", "id AS num_id")
    frames = {
        "left": a, "same": a.where("num_id % 10 > 0"), "apart": spark.range(20_000).selectExpr("concat('b', id) AS note_id", "id + 15000 AS num_id"),
        "tiny": spark.range(10).selectExpr("concat('a', id) AS note_id", "id AS num_id"), "none": spark.range(5).selectExpr("CAST(NULL AS STRING) AS note_id", "CAST(NULL AS BIGINT) AS num_id")}
    pairs = relations.candidate_pairs(frames)
    sketches = {}
    for t, keys in relations.attributes(pairs).items():
        sketches |= relations.key_sketches(frames[t], keys)
    kept = {(x.table, x.spec.name, y.table) for x, y in relations.hopeful(spark, pairs, sketches)}
    every = {(r.source_table, r.source_col, r.target_table): r for r in relations.containment(frames).collect()}
    assert {k for k, r in every.items() if r.is_hint} <= kept
    assert not kept & {("left", "note_id", "apart"), ("apart", "note_id", "left"), ("left", "num_id", "apart")} and not any(s == "none" for s, _, _ in kept)
    got = sorted(map(tuple, relations.fk_hints(frames).collect()))
    assert got == sorted(map(tuple, relations.containment(frames).where("is_hint").drop("is_hint").collect())) and len(got) > 4


def test_wide_unrelated_text_keys_are_not_shuffled(spark, scratch):
    """Neither their columns nor their values are in the plan that counts."""
    for t, mark in (("x", "left"), ("y", "right")):
        spark.range(30_000).selectExpr(f"concat('{mark}', repeat('k', 200), id) AS text_id", "id % 1000 AS num_id").write.parquet(f"{scratch}/{t}")
    frames = {t: spark.read.parquet(f"{scratch}/{t}") for t in "xy"}
    plan = relations.fk_hints(frames)._jdf.queryExecution().executedPlan().toString()
    assert "num_id" in plan and "text_id" not in plan
    assert "text_id" in relations.containment(frames)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rule", ["default", "star"])
def test_hints_of_the_given_tables_are_those_of_the_full_counts(spark, rule):
    frames = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("customer", "orders", "lineitem", "supplier", "part", "nation", "documents", "labels", "events")}
    full = relations.containment(frames, rule=rule).where("is_hint").drop("is_hint")
    assert sorted(map(tuple, relations.fk_hints(frames, rule=rule).collect())) == sorted(map(tuple, full.collect()))


# -- sources ----------------------------------------------------------------------------------------------------

def test_declared_csv_is_one_scan_and_counts_broken_lines(spark, scratch):
    path = f"{scratch}/t.csv"
    open(path, "w").write("id,amount,note\n1,2.5,a\nx,1.0,b\n3,oops,c\n4,4.0\n5,5.0,d\n")
    spec = ts.SourceSpec(table="t", path=path, schema="id bigint, amount double, note string")
    began = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    df = ts.read_source(spark, spec)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == began  # nothing is read for a schema
    p = ts.profile_table(df, "t")
    assert p.row_count == 5 and p.errors == ["3 rows don't fit the declared schema"]
    rows = {r.column: r for r in p.profile.collect()}
    assert set(rows) == {"id", "amount", "note"} and rows["id"].null_count == 1 and rows["amount"].max_num == 5.0
    clean = ts.profile_table(ts.read_source(spark, dataclasses.replace(spec, schema="id string, amount string, note string")), "t")
    assert clean.errors == ["1 rows don't fit the declared schema"]  # a field short


def test_declared_parquet(spark, scratch):
    spark.range(5).selectExpr("id", "id * 2 AS other").write.parquet(f"{scratch}/p")
    assert ts.read_source(spark, ts.SourceSpec(table="p", path=f"{scratch}/p", schema="other bigint")).columns == ["other"]


def test_catalog_siblings_are_targets(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS kin")
    for t in ("labels", "documents"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").write.mode("overwrite").saveAsTable(f"kin.{t}")
    spark.range(3).write.mode("overwrite").saveAsTable("kin.profiling_reports")
    assert sorted(catalog_siblings(spark, "kin", exclude=["LABELS"])[0]) == ["documents"]
    spec = ts.SourceSpec(table="labels", database="kin", connection_type="catalog")
    report = ts.profile_sources(spark, [spec]).report.collect()
    assert [(r.source_table, [h.target_table for h in r.fk_hints]) for r in report] == [("labels", ["documents"])]
    alone = ts.profile_sources(spark, [spec], siblings=False).report.first()
    assert alone.fk_hints == []


@pytest.mark.skipif("not __import__('importlib.util').util.find_spec('delta')", reason="the Delta package is not installed")
def test_delta_round_trip(spark, scratch):
    spark.range(3).write.format("delta").save(f"{scratch}/delta/t")
    for kind in ("delta", "duckdb"):
        assert ts.read_source(spark, ts.SourceSpec(table="t", connection_type=kind), data_root=scratch).count() == 3


# -- report store -----------------------------------------------------------------------------------------------

def _reports(spark, days):
    one = ts.profile_tables({"region": spark.read.parquet(f"{SF_SMALL}/region.parquet")}).report.drop("report_id", "profiled_at").limit(1)
    return spark.range(days).selectExpr("concat('report-', id) AS report_id", "timestamp'2020-01-01 10:11:12.345678' + make_interval(0, 0, 0, CAST(id AS INT)) AS profiled_at").crossJoin(one)


def test_lookup_reads_one_file_of_many_days(spark, scratch):
    path = f"{scratch}/store"
    ts.write_reports(_reports(spark, 300).coalesce(1), path=path)
    ts.write_reports(_reports(spark, 310).coalesce(1), path=path)  # ten are new
    assert ts.read_reports(spark, path).count() == 310
    found = ts.report_by_id(spark, "report-17", path)
    assert found.count() == 1 and ts.get_report(spark, "report-309", path)["source_table"] == "region"
    df = ts.report_by_id(spark, "report-17", path)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    shared = spark.range(310).where(F.expr("substring(sha2(concat('report-', id), 256), 1, 3) = substring(sha2('report-17', 256), 1, 3)")).count()
    assert leaf.metrics().apply("numFiles").value() == shared <= 3


def test_a_store_by_day_stays_as_it_is(spark, scratch):
    path, reports = f"{scratch}/old", _reports(spark, 4)
    store.report_rows(reports.limit(2)).write.partitionBy("profiled_date").parquet(path)
    ts.write_reports(reports, path=path)
    ts.write_reports(reports, path=path)
    assert ts.read_reports(spark, path).count() == 4 and ts.report_by_id(spark, "report-1", path).count() == 1
    assert all(d.startswith("profiled_date=") for d in os.listdir(path) if "=" in d)


def test_typed_reports_equal_what_was_written(spark, scratch):
    frames = {t: spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("customer", "orders", "labels", "documents", "embeddings")}
    frames["odd"] = spark.range(3).selectExpr("CAST('NaN' AS DOUBLE) AS x", "CAST('Infinity' AS DOUBLE) AS y", "'a\"b\\\\c' AS `we\"ird`", "CASE WHEN id = 1 THEN raise_error('b') ELSE 1 END AS bad")
    reports = ts.profile_tables(frames).report.cache()
    path = f"{scratch}/typed"
    ts.write_reports(reports, path=path)
    back = ts.load_reports(spark, path)
    assert back.schema.simpleString() == reports.schema.simpleString()
    key = lambda r: r.source_table
    assert [repr(r) for r in sorted(back.collect(), key=key)] == [repr(r) for r in sorted(reports.collect(), key=key)]


def test_catalog_store_is_written_once(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS once")
    spark.sql("DROP TABLE IF EXISTS once.reports")
    for _ in range(2):
        ts.write_reports(_reports(spark, 3), table="once.reports", fmt="parquet")
    assert spark.table("once.reports").count() == 3 and ts.report_by_id(spark, "report-2", table="once.reports").first().profiled_at == datetime.datetime(2020, 1, 3, 10, 11, 12, 345678)
    assert ts.load_reports(spark, table="once.reports").where("row_count = 5").count() == 3


# -- cards and registration -------------------------------------------------------------------------------------

def _card(text):
    """Brute force over all pieces."""
    import re

    for a in range(len(text)):
        for b in range(a + 13, min(len(text), a + 37) + 1):
            t = text[a:b]
            d = re.sub("[ -]", "", t)
            if re.fullmatch(r"\d+([ -]\d+)*", t) and 13 <= len(d) <= 19 and not text[a - 1:a].isdigit() and not text[b:b + 1].isdigit():
                if sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0:
                    return True
    return False


def test_cards_are_those_of_brute_force(spark):
    import random

    r = random.Random(4)
    texts = ["order 12 4111 1111 1111 1111", "41111111111111110", "4111 1111 1111 1111 12 x", "9" * 40 + " 4111111111111111", "", "5500-0000-0000-0004/12", "4111  1111 1111 1111"]
    for _ in range(400):
        groups = ["".join(r.choice("0123456789") for _ in range(r.randint(1, 8))) for _ in range(r.randint(1, 6))]
        texts.append("".join(x for g in groups for x in (g, r.choice([" ", "-", " ", "-", "  ", "a"]))))
    got = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr(f"{sql_credit_card('t')} AS c").collect()
    assert [x.c for x in got] == [_card(t) for t in texts] and 20 < sum(x.c for x in got) < 300


def test_the_rest_works_without_the_training_data_operators(scratch):
    """In a copy without both folders the queries register, with and without the pipeline's file."""
    copy = os.path.join(scratch, "copy")
    shutil.copytree(REPO, copy, ignore=lambda d, names: [n for n in names if n in (".git", "llm", "__pycache__")])
    import __spark_entry__ as here

    rest = sorted(k for k in here.queries() if not k.startswith(("op", "pipeline")))
    said = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()), *sorted(e.queries()))"
    out = subprocess.run([sys.executable, "-c", said], cwd=copy, capture_output=True, text=True, check=True).stdout.split()
    assert out == ["True", *rest] and len(rest) > 40
