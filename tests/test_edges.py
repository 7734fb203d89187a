"""Edge fixtures: empty, all-null, one row, nested, dotted names, small ints, decimals,
and every threshold at and just beyond its boundary."""
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import tabscope as ts
from tabscope.operators import interpret, patterns, pii, relations, stats, summary

from conftest import by_col

EXACT = ts.ProfileOptions(exact=True)


def test_empty_table(spark):
    df = spark.createDataFrame([], "x int, name string")
    for opts in (ts.ProfileOptions(), EXACT):
        assert ts.column_profile(df, opts).count() == 0
        assert ts.pii_scores(df, opts).count() == 0
    b = ts.profile_tables({"empty": df})
    rep = b.report.collect()[0]
    assert rep.row_count == 0 and rep.columns == [] and rep.errors == []


def test_all_null_column(spark):
    df = spark.createDataFrame([(None, None)] * 5, "x int, name string")
    for opts in (ts.ProfileOptions(), EXACT):
        p = by_col(ts.column_profile(df, opts))
        assert p["x"]["q1"] is None and p["x"]["outlier_count"] is None and p["x"]["has_outliers"] is False
        assert p["x"]["null_pct"] == 1.0
    f = by_col(pii.pii_findings(pii.pii_scores(df)))
    assert f["name"]["pii_type"] == "NAME" and f["name"]["confidence"] == 0.75


def test_one_row(spark):
    p = by_col(ts.column_profile(spark.createDataFrame([(7,)], "x int"), EXACT))
    assert p["x"]["stddev_val"] is None and p["x"]["mean_val"] == 7.0 and p["x"]["is_pk_candidate"]


def test_nested_columns_do_not_spoil_the_rest(spark):
    df = spark.createDataFrame(
        [(["a"], {"k": 1}, (1, "t"), 1), (["b"], {"k": 2}, (2, "u"), 2), (None, None, None, 3)],
        "a array<string>, m map<string,int>, s struct<i:int,t:string>, n int",
    )
    for opts in (ts.ProfileOptions(), EXACT):
        p = by_col(ts.column_profile(df, opts))
        assert p["a"]["type_family"] == "nested" and p["a"]["null_count"] == 1
        assert p["m"]["cardinality_est"] is None
        assert p["n"]["max_num"] == 3.0 and p["n"]["is_pk_candidate"]
    assert ts.pii_scores(df).count() == 0


def test_dotted_name(spark):
    df = spark.createDataFrame([(1,), (2,)], "`a.b` int")
    p = by_col(ts.column_profile(df, EXACT))
    assert p["a.b"]["max_num"] == 2.0 and p["a.b"]["is_pk_candidate"]


def test_small_ints_follow_the_type_rule(spark):
    df = spark.createDataFrame([(1, 2), (3, 4)], "b tinyint, s smallint")
    p = by_col(ts.column_profile(df))
    assert p["b"]["type_family"] == "other" and p["b"]["min_num"] is None
    p = by_col(ts.column_profile(df, ts.ProfileOptions(extended_types=True)))
    assert p["b"]["type_family"] == "numeric" and p["s"]["max_num"] == 4.0


def test_timestamps_extended(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-02 03:04:05' AS t")
    assert by_col(ts.column_profile(df))["t"]["min_str"] is None
    assert by_col(ts.column_profile(df, ts.ProfileOptions(extended_types=True)))["t"]["min_str"].startswith("2024-01-02")


def test_decimals_become_double(spark):
    df = spark.createDataFrame([(Decimal("1.25"),), (Decimal("3.50"),)], "d decimal(10,2)")
    p = by_col(ts.column_profile(df, EXACT))
    assert p["d"]["min_num"] == 1.25 and p["d"]["max_num"] == 3.5 and p["d"]["mean_val"] == 2.375


def _strings(spark, values, name="v"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_pii_threshold_is_strict(spark):
    at = ["a@b.com"] + ["plain"] * 9          # exactly 10 %
    above = ["a@b.com"] * 2 + ["plain"] * 9   # 18 %
    assert pii.pii_findings(pii.pii_scores(_strings(spark, at))).count() == 0
    f = pii.pii_findings(pii.pii_scores(_strings(spark, above))).collect()
    assert f[0]["pii_type"] == "EMAIL"


def test_pii_tie_goes_to_earlier_type(spark):
    vals = ["x@y.com"] * 3 + ["123-45-6789"] * 3 + ["n"] * 4
    f = pii.pii_findings(pii.pii_scores(_strings(spark, vals))).collect()
    assert f[0]["pii_type"] == "EMAIL" and f[0]["confidence"] == 0.3


def test_credit_card_opt_in(spark):
    vals = ["card 4111 1111 1111 1111"] * 3 + ["card 4111 1111 1111 1112"]
    opts = ts.ProfileOptions(credit_card=True)
    s = {r["pii_type"]: r for r in pii.pii_scores(_strings(spark, vals), opts).collect()}
    assert s["CREDIT_CARD"]["match_count"] == 3
    later = ["order 1234567890123 card 4111 1111 1111 1111", "1234567890123 only", "5500-0000-0000-0004"]
    s = {r["pii_type"]: r for r in pii.pii_scores(_strings(spark, later), opts).collect()}
    assert s["CREDIT_CARD"]["match_count"] == 2
    assert "CREDIT_CARD" not in {r["pii_type"] for r in pii.pii_scores(_strings(spark, vals)).collect()}


def test_pattern_threshold_is_strict(spark):
    opts = ts.ProfileOptions(exact=True)
    half = _strings(spark, ["EUR", "USD", "x1", "y2"], "notes")
    df = half
    f = patterns.pattern_findings(patterns.pattern_scores(df, opts), stats.column_profile(df, opts)).collect()
    assert all("ISO_4217" not in r["patterns"] for r in f)
    more = _strings(spark, ["EUR", "USD", "GBP", "y2"], "notes")
    f = patterns.pattern_findings(patterns.pattern_scores(more, opts), stats.column_profile(more, opts)).collect()
    assert "ISO_4217" in f[0]["patterns"]


def test_custom_pattern_replaces_universal_in_place(spark):
    order = patterns.all_patterns((("EMAIL", "@"), ("ZIP", r"^\d{5}$")))
    assert [n for n, _, _ in order] == ["IBAN", "SWIFT_BIC", "ISO_8601", "ISO_4217", "EMAIL", "ZIP"]
    assert order[4][1:] == ("@", "custom")


def test_fk_boundary(spark):
    target = spark.createDataFrame([(i,) for i in range(90)], "ref_id bigint")
    src90 = spark.createDataFrame([(i,) for i in range(100)], "ref_id bigint")
    src89 = spark.createDataFrame([(i,) for i in range(11, 111)], "ref_id bigint")
    h = relations.fk_hints({"src": src90, "tgt": target}, sources=["src"]).collect()
    assert len(h) == 1 and h[0]["match_ratio"] == 0.9
    assert relations.fk_hints({"src": src89, "tgt": target}, sources=["src"]).count() == 0


def test_wide_table_ranks_every_column_and_marks_30(spark):
    df = spark.range(20).selectExpr(*[f"id * {i} AS c{i:02d}" for i in range(60)])
    prof = stats.column_profile(df, EXACT, "w")
    pf = pii.pii_findings(pii.pii_scores(df, EXACT, "w"))
    ptf = patterns.pattern_findings(patterns.pattern_scores(df, EXACT, "w"), prof)
    top = summary.top_columns(summary.column_scores(prof, pf, ptf)).orderBy("rank").collect()
    # c01..c59 are unique keys (interesting); c00 is constant 0 and comes last
    assert [r["column"] for r in top] == [f"c{i:02d}" for i in [*range(1, 60), 0]]
    assert [r["in_top"] for r in top] == [True] * 30 + [False] * 30


def test_small_table_keeps_all_columns_in_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, t string")
    prof = stats.column_profile(df, EXACT, "s")
    top = summary.top_columns(summary.column_scores(prof, pii.pii_findings(pii.pii_scores(df, EXACT, "s")),
                                                    patterns.pattern_findings(patterns.pattern_scores(df, EXACT, "s"), prof)))
    assert [(r["column"], r["in_top"]) for r in top.orderBy("rank").collect()] == [("k", True), ("t", True)]


def test_dq_flags_and_key_candidates_are_complete(spark):
    exprs = [f"CASE WHEN id < 5 THEN NULL ELSE id END AS n{i}" for i in range(14)]
    exprs.append("CASE WHEN id < 5 THEN NULL WHEN id = 19 THEN 1000 ELSE id END AS both")
    exprs += [f"id + {i} AS k{i}" for i in range(5)]
    df = spark.range(20).selectExpr(*exprs)
    prof = stats.column_profile(df, EXACT, "f")
    flags = interpret.dq_flags(prof).collect()[0]["dq_flags"]
    assert flags[:14] == [f"n{i} has high null rate (25%)." for i in range(14)]
    assert flags[14:] == ["both has high null rate (25%).", "both shows outliers (IQR heuristic)."]
    keys = interpret.bk_candidates(prof).collect()[0]["bk_candidates"]
    assert [k["column"] for k in keys] == [f"k{i}" for i in range(5)]


def test_odd_names_and_types_through_the_batch(spark):
    df = spark.sql("""SELECT id AS `my id`, CAST(id % 2 = 0 AS BOOLEAN) AS `flag's`, CAST('ab' AS BINARY) AS `b``x`,
      DATE'2024-01-01' + CAST(id AS INT) AS d, map('k', id) AS m, concat('x', id) AS `a.b`,
      CAST(id AS DECIMAL(20,2)) AS dec, CAST(NULL AS STRING) AS contact_name FROM range(50)""")
    for opts in (ts.ProfileOptions(), ts.ProfileOptions(exact=True)):
        rep = ts.profile_tables({"weird": df}, opts).report.collect()[0]
        assert rep.errors == []
        cols = {c.name: c for c in rep.columns}
        assert cols["my id"].is_pk_candidate and cols["d"].is_pk_candidate and not cols["flag's"].is_pk_candidate
        st = {s.column: s for s in rep.stats}
        assert st["dec"].max_num == 49.0 and st["a.b"].min_str == "x0"
        assert [p.column for p in rep.pii_info] == ["contact_name"]


def test_guards_change_no_match(spark):
    from tabscope.functions.exprs import literal_prefix
    assert [literal_prefix(x) for x in (r"ACC-\d{6}", "ab?c", "a|b", r"^x", "", "abc", "ab*", "a+", "(?i)ab", r"a\.b")] == [
        "ACC-", "a", "", "", "", "abc", "a", "a", "", "a"]
    vals = ["EUR", "EUR\n", "EUR\r\n", "EURO", "DEUTDEFF", "DEUTDEFFXXX\r\n", "DE12345678901234\n", "DE1234567890123", "DE123456789012", "2024-01-02T", "20240102",
            "a@b.com", "ab.com", "a@b.com\n", "xACC-123456", "ACC-12345", None, ""]
    df = _strings(spark, vals)
    got = {r["pattern"]: r["match_count"] for r in patterns.pattern_scores(df).collect()}
    plain = {n: df.selectExpr(f"count_if(v RLIKE r'{rx}')").first()[0] for n, rx, _ in patterns.all_patterns(ts.ProfileOptions().custom_patterns)}
    assert got == plain


def test_patterns_from_a_table(spark):
    table = spark.createDataFrame([("ZIP", r"^\d{5}$"), ("EMAIL", "@"), (None, "x")], "name string, regex string")
    custom = ts.patterns_from(table)
    assert custom == (("EMAIL", "@"), ("ZIP", r"^\d{5}$"))
    got = {r["pattern"]: r for r in ts.pattern_scores(_strings(spark, ["12345", "1", "a@"]), ts.ProfileOptions(custom_patterns=custom)).collect()}
    assert got["ZIP"]["match_count"] == 1 and (got["EMAIL"]["match_count"], got["EMAIL"]["layer"]) == (1, "custom")
    with pytest.raises(ValueError):
        ts.patterns_from(spark.createDataFrame([("a", "x"), ("a", "y")], "name string, regex string"))


def test_nan_in_both_modes(spark):
    nan = float("nan")
    df = spark.createDataFrame([(float(i), nan if i % 10 < 3 else float(i), nan, nan if i == 7 else 1.0) for i in range(1000)], "a double, b double, c double, d double")
    for opts in (ts.ProfileOptions(quantile_error=0.001), EXACT):
        p = by_col(ts.column_profile(df, opts))
        assert abs(p["b"]["q1"] - 249) <= 3 and abs(p["b"]["q3"] - 749) <= 3 and p["b"]["outlier_count"] == 300  # NaN is above any fence
        assert p["c"]["q1"] is None and p["c"]["outlier_count"] is None and p["c"]["distinct_exact"] in (1, None)
        assert (p["d"]["q1"], p["d"]["upper_bound"], p["d"]["outlier_count"]) == (1.0, 1.0, 1)
    assert by_col(ts.column_profile(df, EXACT))["b"]["q1"] == df.selectExpr("percentile_disc(0.25) WITHIN GROUP (ORDER BY nanvl(b, NULL))").first()[0]


def test_whole_numbers_beyond_double_precision(spark):
    big = 2 ** 53
    df = spark.createDataFrame([(big, Decimal("1" + "0" * 30)), (big + 1, Decimal("1" + "0" * 29 + "1"))], "k bigint, d decimal(38,0)")
    for opts in (ts.ProfileOptions(), EXACT):
        p = by_col(ts.column_profile(df, opts))
        assert p["k"]["distinct_exact"] == 2 and p["k"]["is_pk_candidate"]
        assert p["d"]["distinct_exact"] == 2 and p["d"]["is_pk_candidate"]


def test_distinct_counts_of_every_type(spark):
    long = "x" * 100
    df = spark.createDataFrame([(0.0, "a", long + "1", b"a", True, [1]), (-0.0, "a", long + "2", b"b", False, [1]), (float("nan"), None, long + "2", b"", None, [2]),
                                (float("nan"), "", long + "1", None, True, None)], "f double, s string, l string, b binary, t boolean, r array<int>")
    df = df.selectExpr("*", "DATE'2024-01-01' + CAST(f > 0 AS INT) AS day", "TIMESTAMP'2024-01-01 00:00:00' AS at", "CAST(f AS FLOAT) AS g", "named_struct('x', s) AS st")
    got = {r["ordinal"]: r["distinct_exact"] for r in stats.exact_distinct(df, ts.column_specs(df.schema)).collect()}
    want = df.agg(*[F.countDistinct(F.when(F.col(c).isNotNull(), F.struct(c))) for c in df.columns]).first()
    assert [got.get(i + 1, 0) for i in range(len(df.columns))] == list(want)
