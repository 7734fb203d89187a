"""Estimates against exact values, the distributed exact quartiles against
percentile_disc, and foreign keys on the driver tables."""
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import tabscope as ts
from tabscope.functions.exprs import sql_matches
from tabscope.functions.families import column_specs
from tabscope.functions.patterns_fixed import NEEDS, PII_PATTERNS, UNIVERSAL_PATTERNS
from tabscope.operators import distinct, patterns, pii, relations, stats
from tabscope.operators import quantiles as Q
from tabscope.operators.scan import FusedScan, reads_columns_apart

from conftest import SF, by_col

KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "events": "event_id", "documents": "doc_id",
        "nation": "n_nationkey", "part": "p_partkey", "supplier": "s_suppkey", "benchmark": "item_id",
        "labels": "doc_id", "region": "r_regionkey"}


@pytest.mark.parametrize("table", sorted(KEYS))
def test_gate_finds_every_true_key(spark, table):
    df = spark.read.parquet(f"{SF}/{table}.parquet")
    p = by_col(ts.column_profile(df, ts.ProfileOptions(), table))
    assert p[KEYS[table]]["is_pk_candidate"] is True
    exact = by_col(ts.column_profile(df, ts.ProfileOptions(exact=True), table))
    for c, r in p.items():
        assert r["is_pk_candidate"] == exact[c]["is_pk_candidate"], c
        if r["cardinality_est"] is not None:
            assert abs(r["cardinality_est"] - exact[c]["distinct_exact"]) <= 3 * 0.01 * exact[c]["distinct_exact"] + 1


def test_strict_gate_misses_keys_like_the_reference(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet")
    p = by_col(ts.column_profile(df, ts.ProfileOptions(pk_gate="strict")))
    assert p["o_orderkey"]["is_pk_candidate"] is False


def _disc(values, p):
    import math
    v = sorted(x for x in values if x is not None)
    return float(v[max(1, math.ceil(p * len(v))) - 1]) if v else None


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("rank_rows", [0, 20, 1 << 20])
def test_exact_quartiles_match_percentile_disc(spark, seed, rank_rows, monkeypatch):
    """``rank_rows`` 0: brackets are narrowed to the end; hot values, ties, nulls and a coarse first bracket."""
    monkeypatch.setattr(Q, "RANK_ROWS", rank_rows)
    rnd = random.Random(seed)
    n = rnd.randint(50, 400)
    hot = rnd.randint(0, 5)
    rows = [(rnd.choice([hot] * 30 + list(range(100))) if rnd.random() < 0.9 else None,
             rnd.gauss(0, 1), rnd.randint(-5, 5)) for _ in range(n)]
    df = spark.createDataFrame(rows, "a int, b double, c long").repartition(5)
    specs = column_specs(df.schema)
    scan = FusedScan(df, specs)
    for s in specs:
        Q.add_bracket_aggs(scan, s)
    for width in (None, 0.2, 9.0):  # as sketched; wide brackets; brackets beside the quartile, as if the sketch had missed
        if width == 9.0:
            for s in specs:
                scan.put(s, "qb", [1e9, 2e9, 1e9, 2e9])
        elif width:
            for s in specs:
                b = scan.get(s, "qb")
                scan.put(s, "qb", [b[0] - 30, b[1] + 30, b[2] - 30, b[3] + 30])
        got = Q.exact_quartiles(df, specs, scan)
        for s in specs:
            vals = [r[s.ordinal - 1] for r in rows]
            assert got[s.ordinal] == (_disc(vals, 0.25), _disc(vals, 0.75))


def test_hot_value_holding_a_third_of_rows(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS v")
    p = by_col(ts.column_profile(df, ts.ProfileOptions(exact=True)))
    assert p["v"]["distinct_exact"] == 2001
    assert p["v"]["q1"] == float(df.agg(F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY v)")).first()[0])


def test_default_fk_hint_and_star_rule(spark):
    frames = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ["documents", "labels", "orders", "lineitem",
                                                                   "customer", "supplier"]}
    hints = relations.fk_hints(frames).collect()
    assert [(h.source_table, h.source_col, h.target_table, h.target_col) for h in hints] == [
        ("labels", "doc_id", "documents", "doc_id")]
    star = {(h.source_table, h.source_col, h.target_table): h for h in relations.fk_hints(frames, rule="star").collect()}
    h = star[("lineitem", "l_orderkey", "orders")]
    assert (h.match_count, h.source_distinct, h.match_ratio, h.target_is_unique) == (14743, 14743, 1.0, True)
    assert star[("orders", "o_custkey", "customer")].match_count == 1500


def test_fk_plan_has_no_cartesian_product(spark):
    frames = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ["documents", "labels"]}
    plan = relations.containment(frames)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_semi_containment(spark):
    l = spark.read.parquet(f"{SF}/lineitem.parquet")
    o = spark.read.parquet(f"{SF}/orders.parquet")
    r = relations.semi_containment(l, "l_orderkey", o, "o_orderkey").first()
    assert (r.match_count, r.source_distinct, r.match_ratio) == (14743, 14743, 1.0)


def test_default_mode_is_within_its_bounds(spark):
    df = spark.read.parquet(f"{SF}/events.parquet")
    approx = by_col(ts.column_profile(df))["value"]
    exact = by_col(ts.column_profile(df, ts.ProfileOptions(exact=True)))["value"]
    assert exact["outlier_count"] == 463 and (exact["q1"], exact["q3"]) == (14.56, 69.14)
    for k, p in (("q1", 0.25), ("q3", 0.75)):
        assert abs(df.where(F.col("value") <= approx[k]).count() / df.count() - p) <= 0.05
    assert approx["outlier_count"] == df.where((F.col("value") < approx["lower_bound"]) | (F.col("value") > approx["upper_bound"])).count()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _first_pass_plan(df):
    scan = FusedScan(df, column_specs(df.schema))
    for add in (stats.add_stats_aggs, pii.add_pii_aggs, patterns.add_pattern_aggs):
        add(scan, ts.ProfileOptions())
    return _plan(scan.aggregate())


def test_first_pass_is_one_scan_without_shuffle(spark, scratch):
    plan = _first_pass_plan(spark.read.parquet(f"{SF}/lineitem.parquet"))
    assert plan.count("FileScan parquet") == 1 and "hashpartitioning" not in plan
    path = f"{scratch}/wide.csv"
    spark.range(30).selectExpr(*[f"id * {i} AS c{i}" for i in range(300)]).write.option("header", True).csv(path)
    wide = spark.read.options(header=True, inferSchema=True).csv(path)
    plan = _first_pass_plan(wide)
    assert plan.count("FileScan csv") == 1 and "hashpartitioning" not in plan
    p = by_col(ts.column_profile(wide))
    assert len(p) == 300 and p["c299"]["max_num"] == 29 * 299 and p["c1"]["is_pk_candidate"] and not p["c0"]["is_pk_candidate"]


def test_scores_are_lazy_and_one_scan(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    for scores in (ts.pii_scores(df), ts.pattern_scores(df)):
        assert _plan(scores).count("FileScan parquet") == 1
    boom = spark.range(3).selectExpr("raise_error('boom') AS x")
    ts.pii_scores(boom)  # nothing runs until it is used


def test_profile_reads_local_rows_only(spark):
    p = ts.profile_table(spark.read.parquet(f"{SF}/labels.parquet"), "labels")
    for df in (p.profile, p.pii_scores, p.pattern_scores, p.pii_findings, p.pattern_findings):
        assert "FileScan" not in _plan(df) and "ExistingRDD" not in _plan(df)


def test_foreign_keys_of_wide_numbers(spark):
    big = 2 ** 53
    keys = spark.range(1000).selectExpr(f"id + {big} AS acct_id")
    frames = {"a": keys, "b": keys, "other": spark.range(5).selectExpr("CAST(id AS DOUBLE) AS acct_id")}
    got = {(r.source_table, r.target_table): r for r in relations.containment(frames).collect()}
    assert (got["a", "b"].match_count, got["a", "b"].source_distinct, got["a", "b"].target_is_unique) == (1000, 1000, True)
    assert got["a", "other"].match_count == 0
    dec = lambda lo, typ: spark.range(1000).selectExpr(f"CAST(CAST(id + {lo} AS DECIMAL(38,0)) + CAST('1e25' AS DECIMAL(38,0)) AS {typ}) AS acct_id")
    frames = {"x": dec(0, "DECIMAL(38,0)"), "y": dec(1000, "DECIMAL(38,0)"), "z": dec(0, "DECIMAL(38,4)"), "w": spark.range(3).selectExpr("CAST(id AS DECIMAL(5,2)) AS acct_id"),
              "v": spark.range(3).selectExpr("id AS acct_id")}
    got = {(r.source_table, r.target_table): r for r in relations.containment(frames).collect()}
    assert got["x", "y"].match_count == 0 and not got["x", "y"].is_hint
    assert got["x", "z"].match_count == 1000 and got["w", "v"].match_count == 3 and got["v", "w"].is_hint


def test_foreign_keys_of_200_tables_plan_in_seconds(spark):
    frames = {f"t{i}": spark.range(3).selectExpr("id", "id AS a_id", "id * 2 AS b_id", f"id + {i} AS c_id") for i in range(200)}
    began = time.time()
    pairs = relations.candidate_pairs(frames)
    df = relations.containment(frames)
    df._jdf.queryExecution().optimizedPlan()
    assert len(pairs) > 300_000 and time.time() - began < 90


def test_distinct_counts_in_bounded_blocks(spark, monkeypatch):
    """Many columns are counted without a row for each cell, in blocks and buckets of any size, repeats across tasks and blocks included."""
    df = spark.range(0, 6000, 1, 5).selectExpr(
        "id", "id % 7 AS few", "CAST(id % 900 AS DOUBLE) / 4 - 3 AS d", "CASE WHEN id % 3 > 0 THEN concat('k', CAST(id * id % 5000 AS STRING)) END AS s",
        "repeat(CAST(id % 40 AS STRING), 50) AS long", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id % 300 AS INT)) AS at",
        "CAST(NULL AS STRING) AS no", "array(id % 11) AS nested", "'hot' AS hot")
    want = list(df.agg(*[F.countDistinct(c) for c in df.columns]).first())
    specs = column_specs(df.schema)
    plan = stats.exact_distinct(df.drop("nested"), column_specs(df.drop("nested").schema), 6000)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    for rows, kept, size, block in ((6000, 1 << 18, 1 << 27, 1 << 16), (10 ** 7, 200, 1 << 27, 64), (10 ** 7, 1 << 18, 5000, 50)):
        for name, value in (("KEPT_VALUES", kept), ("KEPT_BYTES", size), ("BLOCK_VALUES", block)):
            monkeypatch.setattr(distinct, name, value)
        got = {r["ordinal"]: r["distinct_exact"] for r in stats.exact_distinct(df, specs, rows).collect()}
        assert [got.get(s.ordinal, 0) for s in specs] == want
    # a text whose distinct values fill a bucket evenly: no bucket holds much more than its share
    held = distinct._buckets(pa.array([b"\x00key%d" % i for i in range(20000)]), 20)
    assert max(np.bincount(held)) < 1300
    assert max(np.bincount(distinct._buckets(pa.array(range(0, 2000000, 100), pa.int64()), 20))) < 1300


def test_distinct_keys_of_one_type_travel_as_one_array(spark):
    """Every other column would be measured with every row; and texts of any length fall into a bucket by all their bytes."""
    df = spark.range(0, 2000, 1, 3).selectExpr(
        "id", "IF(id % 3 = 0, NULL, id % 5) AS n", "CAST(id % 9 AS SMALLINT) AS small", "id % 2 = 0 AS b", "date_add(DATE'2024-01-01', CAST(id % 31 AS INT)) AS day", "id / 7 AS x",
        "CASE id % 4 WHEN 0 THEN 0.0D WHEN 1 THEN -0.0D WHEN 2 THEN CAST('NaN' AS DOUBLE) END AS z", "repeat('a', CAST(id % 70 AS INT)) AS t", "IF(id % 2 = 0, '', NULL) AS e",
        "CAST(id % 17 AS DECIMAL(20,2)) AS m", "repeat(CAST(id AS STRING), 30) AS long", "CAST(sha2(repeat('a', 65), 256) AS BINARY) AS bin", "unhex(sha2(repeat('a', 65), 256)) AS raw")
    specs = column_specs(df.schema)
    for rows in (2000, 10 ** 7):
        counts = stats.exact_distinct(df, specs, rows)
        assert {r["ordinal"]: r["distinct_exact"] for r in counts.collect()} == dict(zip(range(1, 14), (2000, 5, 9, 2, 31, 2000, 2, 70, 1, 17, 2000, 1, 1)))
        assert _plan(counts).count("_keys") and all(f"{kind}_keys" in _plan(counts) for kind in ("bigint", "double", "bytes"))
    texts = [b"", b"a", b"\x00", b"\x00\x00", b"x" * 8, b"x" * 9, b"x" * 64, b"x" * 65, b"y" + b"x" * 64, b""]
    whole = pa.array([b"left out", *texts], pa.binary()).slice(1)
    alone = [distinct._buckets(pa.array([t], pa.binary()), 1 << 30)[0] for t in texts]
    assert list(distinct._buckets(whole, 1 << 30)) == alone and len(set(alone)) == 9
    assert list(distinct._buckets(pa.array([b"", b""], pa.binary()), 7)) == [0, 0]


def test_conditions_before_regexes_lose_no_match(spark):
    texts = ["123 456 7890", "123-456-7890", "x123.456.7890", "123-45-6789", "é123-45-6789", "2024-01-02", "2024-1-02", "+1 (123) 456-7890", "123 456 789", "", "\n2024-01-02", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for _, regex in (*PII_PATTERNS, *UNIVERSAL_PATTERNS):
        plain = df.where(F.col("t").rlike(regex)).count()
        assert df.where(sql_matches("t", regex, NEEDS.get(regex, ""))).count() == plain
    assert all(regex in NEEDS for _, regex in (*PII_PATTERNS, *UNIVERSAL_PATTERNS))  # every regex has one


def test_wide_scans_in_groups_of_columns(spark, scratch):
    """Where columns can be read apart, no scan of a wide table has more aggregates than Spark compiles; the results are those of one scan."""
    cols = ["id"]
    for i in range(8):
        cols += [f"IF(id % 5 = {i}, NULL, id * {i + 1} % 97) AS n{i}", f"CASE WHEN id % 11 = {i} THEN CAST('NaN' AS DOUBLE) WHEN id % 7 > 0 THEN id / {i + 3} END AS d{i}",
                 f"IF(id % 4 = 0, NULL, concat('u', CAST(id % {i + 2} AS STRING), '@x.com')) AS s{i}"]
    spark.range(0, 900, 1, 3).selectExpr(*cols, "CAST(NULL AS DOUBLE) AS no", "CAST('NaN' AS DOUBLE) AS nan", "timestamp_micros(id * id) AS at", "array(id % 3) AS nested").write.parquet(f"{scratch}/wide")
    apart = spark.read.parquet(f"{scratch}/wide").where("id < 800")
    together = spark.createDataFrame(apart.collect(), apart.schema)
    assert reads_columns_apart(apart) and reads_columns_apart(apart.selectExpr("id + 1 AS x")) and not reads_columns_apart(together)
    assert not reads_columns_apart(apart.distinct()) and not reads_columns_apart(apart.join(together, "id"))
    rows = lambda df: sorted(repr(r) for r in df.withColumn("mean_val", F.round("mean_val", 9)).withColumn("stddev_val", F.round("stddev_val", 9)).collect())
    for opts in (ts.ProfileOptions(exact=True), ts.ProfileOptions()):
        sketched = [] if opts.exact else ["q1", "q3", "lower_bound", "upper_bound", "outlier_count", "has_outliers"]  # they depend on the rows' order
        assert rows(ts.column_profile(apart, opts).drop(*sketched)) == rows(ts.column_profile(together, opts).drop(*sketched))
        scan = FusedScan(apart, column_specs(apart.schema))
        stats.add_stats_aggs(scan, opts)
        scan.count_corrupt("s1")
        asked = []
        scan._part = lambda names: asked.append(list(names)) or FusedScan._part(scan, names)
        scan.collect()
        assert len(asked) > 3 and max(map(len, asked)) <= 40 and sorted(sum(asked, [])) == sorted(scan._exprs) and scan.corrupt == 600
    for scores in (ts.pii_scores, ts.pattern_scores):
        assert sorted(map(repr, scores(apart).collect())) == sorted(map(repr, scores(together).collect()))
    assert _plan(ts.pattern_scores(apart)).count("FileScan parquet") > 1
    counted = stats.exact_distinct(apart.drop("nested"), column_specs(apart.drop("nested").schema), 800)
    assert _plan(counted).count("FileScan parquet") == 2  # the texts, and the others
