"""

``entry(spark)`` profiles every table at sf0.001 and returns the nested
reports.  ``queries()`` maps every checked operator to a callable
(spark, sf_dir) -> DataFrame over the whole given tables (or views Spark
derives from them); ``oracle_sql()`` gives the same result as DuckDB SQL.

Exact mode is used wherever a result is compared value by value; the default mode's
sketches are compared with their promised bounds (``default_profile_bounds``).
Mean and deviation are rounded to 4 places on both sides (summation order differs
between engines).  The SQL takes nothing from the package: its rules and values are
written out here.
"""
from __future__ import annotations

import importlib
import importlib.util
import os
import re
import sys
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tabscope import ProfileOptions  # noqa: E402
from tabscope.functions.exprs import sql_double, sql_id  # noqa: E402
from tabscope.functions.families import column_specs  # noqa: E402
from tabscope.operators import interpret, patterns, pii, relations, stats, summary  # noqa: E402
from tabscope.operators.scan import FusedScan  # noqa: E402
from tabscope.functions.frames import shared_folder  # noqa: E402
from tabscope.plans.profile import batch_summary, profile_sources, profile_table, profile_tables  # noqa: E402
from tabscope.sources.readers import read_source  # noqa: E402
from tabscope.sources.spec import SourceSpec  # noqa: E402
from tabscope.sources.store import load_reports, read_reports, report_by_id, write_reports  # noqa: E402

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Schemas of the driver's test tables as Spark reads them (used to write the oracle SQL).
TABLE_COLUMNS = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
               ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "bigint")],
    "embeddings": [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "bigint"), ("text", "string")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")],
}

# ---------------------------------------------------------------------------
# Derived views: SELECT lists valid in both Spark SQL and DuckDB, so both
# engines see the same derived table.  They add what the raw test tables lack
# (nulls, personal data above the threshold, pattern-shaped values).
# ---------------------------------------------------------------------------
_K9 = "lpad(CAST(c_custkey AS STRING), 9, '0')"
PII_VIEW = ("customer", [
    ("customer_id", "bigint", "c_custkey"),
    ("customer_name", "string", "c_name"),
    ("contact_email", "string", "concat('user', CAST(c_custkey AS STRING), '@example.com')"),
    ("tax_ref", "string", f"concat(substring({_K9}, 1, 3), '-', substring({_K9}, 4, 2), '-', substring({_K9}, 6, 4))"),
    ("contact_info", "string", "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN "
                               f"concat('(555) ', substring({_K9}, 3, 3), '-', substring({_K9}, 6, 4)) "
                               "ELSE concat('user', CAST(c_custkey AS STRING), '@example.com') END"),
    ("owner_name", "string", "CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_name END"),
    ("segment", "string", "c_mktsegment"),
    ("notes", "string", "CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN "
                        f"concat('call +1 555 ', substring({_K9}, 3, 3), ' ', substring({_K9}, 6, 4)) END"),
    ("acct_bal", "double", "CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE c_acctbal END"),
])

PATTERN_VIEW = ("customer", [
    ("account_id", "string", "concat('ACC-', lpad(CAST(c_custkey AS STRING), 6, '0'))"),
    ("iban", "string", "concat('DE', lpad(CAST(c_custkey AS STRING), 20, '0'))"),
    ("email", "string", "concat(lower(replace(c_name, '#', '.')), '@bank.com')"),
    ("currency", "string", "CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'EUR' "
                           "WHEN c_mktsegment = 'MACHINERY' THEN 'USD' ELSE 'GBP' END"),
    ("open_date", "string", "concat('2024-01-', lpad(CAST(c_nationkey + 1 AS STRING), 2, '0'))"),
    ("bic", "string", "concat(upper(substring(c_mktsegment, 1, 4)), 'DEFF', "
                      "CASE WHEN c_nationkey < 12 THEN 'XXX' ELSE '' END)"),
    ("branch_code", "string", "concat('BR-', lpad(CAST(c_nationkey AS STRING), 3, '0'))"),
    ("balance_amt", "string", "c_mktsegment"),
    ("notes", "string", "c_name"),
    ("c_custkey", "bigint", "c_custkey"),
])


def _wide_view():
    """60 columns over lineitem: the 11 originals and 49 derived by a rule."""
    cols = [(c, t, c) for c, t in TABLE_COLUMNS["lineitem"]]
    kinds = [
        ("x{k}_amt", "double", "l_extendedprice * {m}"),
        ("x{k}_qty", "double", "CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity + {m} END"),
        ("x{k}_ref", "string", "concat('ACC-', lpad(CAST(l_orderkey AS STRING), 6, '0'))"),
        ("x{k}_mail", "string", "concat('u', CAST(l_partkey AS STRING), '@shop{k}.com')"),
        ("x{k}_flag", "string", "concat(l_returnflag, l_linestatus)"),
        ("x{k}_disc", "double", "CASE WHEN l_discount > 0.08 THEN l_discount * 100 ELSE l_discount END"),
        ("x{k}_key", "bigint", "l_orderkey * 8 + l_linenumber"),
    ]
    for k in range(49):
        name, typ, expr = kinds[k % len(kinds)]
        cols.append((name.format(k=k), typ, expr.format(k=k, m=k + 1)))
    return ("lineitem", cols)


WIDE_VIEW = _wide_view()

# NaN in a third, in one row and in all rows of a column.
NAN_VIEW = ("lineitem", [
    ("some_nan", "double", "CASE WHEN l_linenumber % 3 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_extendedprice END"),
    ("one_nan", "double", "CASE WHEN l_orderkey = 1 AND l_linenumber = 1 THEN CAST('NaN' AS DOUBLE) ELSE l_quantity END"),
    ("all_nan", "double", "CAST('NaN' AS DOUBLE)"),
    ("nan_or_null", "double", "CASE WHEN l_linenumber < 3 THEN CAST('NaN' AS DOUBLE) WHEN l_linenumber < 5 THEN NULL ELSE l_tax END"),
])

# Cards beside other numbers, and digit groups that are none.
CARD_VIEW = ("customer", [
    ("note", "string", "CASE WHEN c_custkey % 8 = 0 THEN concat('order 1234567890123 card 4111 1111 1111 1111 ', CAST(c_custkey AS STRING)) "
                       "WHEN c_custkey % 8 = 1 THEN concat('5500-0000-0000-0004/', CAST(c_custkey AS STRING)) "
                       "WHEN c_custkey % 8 = 2 THEN concat('4111 1111 1111 1112 x 378282246310006 ', CAST(c_custkey AS STRING)) "
                       "WHEN c_custkey % 8 = 3 THEN concat('378282246310005, ', CAST(c_custkey AS STRING)) "
                       "WHEN c_custkey % 8 = 4 THEN concat(CAST(c_custkey AS STRING), ' 4111 1111 1111 1111') "
                       "WHEN c_custkey % 8 = 5 THEN concat('99', CAST(c_custkey AS STRING), '4111111111111111') "
                       "WHEN c_custkey % 8 = 6 THEN concat('4111-1111-1111-1111-', CAST(c_custkey AS STRING), ' ', CAST(c_custkey AS STRING)) END"),
    ("number", "string", "concat('40000000', lpad(CAST(c_custkey AS STRING), 8, '0'))"),
    ("groups", "string", "concat(CAST(c_custkey AS STRING), ' ', substring(CAST(4000000000000000 + c_custkey * 7919 AS STRING), 1, 4), ' ', "
                         "substring(CAST(4000000000000000 + c_custkey * 7919 AS STRING), 5, 6), '-', substring(CAST(4000000000000000 + c_custkey * 7919 AS STRING), 11, 6))"),
])

# Keys beyond 2^53 as bigint and decimal, beside a floating one that must not change how they compare.
_BIG, _HUGE = "9007199254740992", "1000000000000000000000000000000"
WIDE_KEYS = {
    "wk_orders": ("orders", [("acct_id", "bigint", f"o_orderkey + {_BIG}")]),
    "wk_lines": ("lineitem", [("acct_id", "bigint", f"l_orderkey + {_BIG}")]),
    "wk_far": ("orders", [("acct_id", "bigint", f"o_orderkey + {_BIG} + 20000")]),
    "wk_double": ("customer", [("acct_id", "double", f"CAST(c_custkey + {_BIG} AS DOUBLE)")]),
    "wk_dec": ("orders", [("acct_id", "decimal(38,0)", f"CAST(CAST(o_orderkey AS DECIMAL(38,0)) + CAST({_HUGE} AS DECIMAL(38,0)) AS DECIMAL(38,0))")]),
    "wk_dec_next": ("orders", [("acct_id", "decimal(38,0)", f"CAST(CAST(o_orderkey + 15000 AS DECIMAL(38,0)) + CAST({_HUGE} AS DECIMAL(38,0)) AS DECIMAL(38,0))")]),
    "wk_dec_cents": ("customer", [("acct_id", "decimal(20,2)", f"CAST(CAST(c_custkey + {_BIG} AS DECIMAL(18,0)) AS DECIMAL(20,2))")]),
}
VIEWS = {"pii_view": PII_VIEW, "pattern_view": PATTERN_VIEW, "wide_view": WIDE_VIEW, "nan_view": NAN_VIEW, "card_view": CARD_VIEW, **WIDE_KEYS}


def _columns(name: str) -> list[tuple[str, str]]:
    if name in VIEWS:
        return [(c, t) for c, t, _ in VIEWS[name][1]]
    return TABLE_COLUMNS[name]


def _load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in VIEWS:
        base, cols = VIEWS[name]
        return _load(spark, sf_dir, base).selectExpr(*[f"{e} AS {c}" for c, _, e in cols])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EXACT = ProfileOptions(exact=True)


def _if_here(package: str, module: str):
    """``module``, if ``package`` is here at all; import errors inside it show."""
    spec = importlib.util.find_spec(package)
    return importlib.import_module(module) if spec and spec.origin else None


def _llm_queries():
    return _if_here("tabscope.llm", "tabscope.llm.entry_queries")


def _pipeline():
    """The pipeline needs the training-data operators: without them its file alone is of no use."""
    return _llm_queries() and _if_here("corpus_pipeline", "corpus_pipeline")


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------


def _profile(spark, sf_dir, name) -> DataFrame:
    return stats.column_profile(_load(spark, sf_dir, name), EXACT, name)


def _rounded(p: DataFrame) -> DataFrame:
    return p.withColumn("mean_val", F.round("mean_val", 4)).withColumn("stddev_val", F.round("stddev_val", 4))


def _q_profile(name):
    return lambda spark, sf_dir: _rounded(_profile(spark, sf_dir, name))


def _union(dfs):
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def _q_pii_scores(spark, sf_dir):
    return _union([pii.pii_scores(_load(spark, sf_dir, t), EXACT, t) for t in TABLES])


def _q_pattern_scores(spark, sf_dir):
    return _union([patterns.pattern_scores(_load(spark, sf_dir, t), EXACT, t) for t in TABLES])


def _q_pii_findings(spark, sf_dir):
    return pii.pii_findings(pii.pii_scores(_load(spark, sf_dir, "pii_view"), EXACT, "pii_view"))


def _pattern_findings(spark, sf_dir, name):
    df = _load(spark, sf_dir, name)
    return patterns.pattern_findings(patterns.pattern_scores(df, EXACT, name), _profile(spark, sf_dir, name))


def _q_pattern_findings(spark, sf_dir):
    f = _pattern_findings(spark, sf_dir, "pattern_view")
    return f.select("source_table", "ordinal", "column", F.array_join("patterns", ",").alias("patterns"),
                    F.array_join("heuristics", ",").alias("heuristics"), "uniqueness_score")


def _q_column_schema(spark, sf_dir):
    """Key candidates with the default (estimate-gated) mode: every true key must pass the gate."""
    parts = [stats.column_schema(stats.column_profile(_load(spark, sf_dir, t), ProfileOptions(), t))
             .drop("uniqueness_ratio") for t in TABLES]
    return _union(parts)


def _frames(spark, sf_dir):
    return {t: _load(spark, sf_dir, t) for t in TABLES}


def _q_fk(rule, hints_only):
    def q(spark, sf_dir):
        c = relations.containment(_frames(spark, sf_dir), rule=rule)
        return c.where("is_hint").drop("is_hint") if hints_only else c
    return q


def _q_semi(spark, sf_dir):
    return relations.semi_containment(_load(spark, sf_dir, "lineitem"), "l_orderkey",
                                      _load(spark, sf_dir, "orders"), "o_orderkey")


def _scores(spark, sf_dir, name):
    df = _load(spark, sf_dir, name)
    prof = _profile(spark, sf_dir, name)
    pf = pii.pii_findings(pii.pii_scores(df, EXACT, name))
    ptf = patterns.pattern_findings(patterns.pattern_scores(df, EXACT, name), prof)
    return prof, pf, ptf


def _q_top_columns(name):
    def q(spark, sf_dir):
        prof, pf, ptf = _scores(spark, sf_dir, name)
        return summary.top_columns(summary.column_scores(prof, pf, ptf))
    return q


INTERP_TABLES = [*TABLES, "pii_view", "pattern_view", "wide_view"]
REPORT_TABLES = [*TABLES, "pii_view", "pattern_view"]


def _q_interpretation(spark, sf_dir):
    with ThreadPoolExecutor(4) as pool:  # tables that don't fill the cores run beside others
        profs = list(pool.map(lambda t: _profile(spark, sf_dir, t), INTERP_TABLES))
    pfs = [pii.pii_findings(pii.pii_scores(_load(spark, sf_dir, t), EXACT, t)) for t in INTERP_TABLES]
    tables = spark.createDataFrame([(t,) for t in INTERP_TABLES], "source_table string")
    it = interpret.interpretation(tables, _union(profs), _union(pfs), {t: t for t in INTERP_TABLES})
    i = F.col("interpretation")
    return it.select(
        "source_table",
        i["suggested_entity_name"].alias("entity"),
        F.array_join(F.transform(i["bk_candidates"], lambda x: x["column"]), ",").alias("bk_columns"),
        F.size(i["bk_candidates"]).alias("bk_count"),
        F.array_max(F.transform(i["bk_candidates"], lambda x: x["confidence"])).alias("bk_confidence"),
        F.array_join(i["pii_summary"], " | ").alias("pii_summary"),
        F.array_join(i["dq_flags"], " | ").alias("dq_flags"),
        i["confidence"].alias("confidence"),
    )


def _q_batch_summary(spark, sf_dir):
    batch = profile_tables(_frames(spark, sf_dir), ProfileOptions())
    return batch_summary(batch.report)


def _q_nan_profile(spark, sf_dir):
    return _profile(spark, sf_dir, "nan_view").select(
        "source_table", "ordinal", "column", "null_count", "non_null_count", "distinct_exact", "min_num", "q1", "q3",
        "lower_bound", "upper_bound", "outlier_count", "has_outliers")


def _q_credit_card(spark, sf_dir):
    scores = pii.pii_scores(_load(spark, sf_dir, "card_view"), ProfileOptions(credit_card=True), "card_view")
    return scores.where("pii_type = 'CREDIT_CARD'").select("source_table", "ordinal", "column", "non_null_count", "match_count", "confidence")


def _q_fk_wide_numeric(spark, sf_dir):
    return relations.containment({t: _load(spark, sf_dir, t) for t in WIDE_KEYS})


def _q_default_bounds(spark, sf_dir):
    """The default mode over whole tables: are the quartiles within 0.05 of their rank and the distinct
    estimates within three standard errors, and are the keys the true ones?"""
    parts, opts = [], ProfileOptions()
    for t in TABLES:
        df = _load(spark, sf_dir, t)
        specs = column_specs(df.schema)
        rows = {r["ordinal"]: r for r in stats.column_profile(df, opts, t).collect()}
        ranks = FusedScan(df, specs)
        for s in specs:
            for k in ("q1", "q3"):
                if rows[s.ordinal][k] is not None:
                    q = sql_id(s.name)
                    ranks.add(s, f"{k}lt", f"count_if({q} < {sql_double(rows[s.ordinal][k])})")
                    ranks.add(s, f"{k}le", f"count_if({q} <= {sql_double(rows[s.ordinal][k])})")
        exact = {r[0]: r[1] for r in stats.exact_distinct(df, [s for s in specs if s.distinct_capable], ranks.rows).collect()}

        def near(s, k, p):
            if rows[s.ordinal][k] is None:
                return None
            n = rows[s.ordinal]["non_null_count"]
            return ranks.get(s, f"{k}lt") <= (p + 0.05) * n and ranks.get(s, f"{k}le") >= (p - 0.05) * n

        parts.append(spark.createDataFrame(
            [(t, s.ordinal, s.name, rows[s.ordinal]["profiled_rows"], near(s, "q1", 0.25), near(s, "q3", 0.75),
              abs(rows[s.ordinal]["cardinality_est"] - exact.get(s.ordinal, 0)) <= 3 * opts.rsd * exact.get(s.ordinal, 0) + 1,
              rows[s.ordinal]["is_pk_candidate"]) for s in specs],
            "source_table string, ordinal int, column string, profiled_rows long, q1_near boolean, q3_near boolean, distinct_near boolean, "
            "is_pk_candidate boolean"))
    return _union(parts)


def _report(spark, sf_dir):
    """The exact-mode batch report of all tables and two views."""
    return profile_tables({t: _load(spark, sf_dir, t) for t in REPORT_TABLES}, EXACT, fk_sources=TABLES).report


def _exploded(field):
    return lambda spark, sf_dir: _report(spark, sf_dir).select("source_table", F.inline(field))


def _q_report_stats(spark, sf_dir):
    r = _exploded("stats")(spark, sf_dir)
    return r.withColumn("mean_val", F.round("mean_val", 4)).withColumn("stddev_val", F.round("stddev_val", 4))


def _q_report_patterns(spark, sf_dir):
    r = _exploded("detected_patterns")(spark, sf_dir)
    return r.select("source_table", "ordinal", "column", F.array_join("patterns", ",").alias("patterns"),
                    F.array_join("heuristics", ",").alias("heuristics"), "uniqueness_score")


def _q_profile_sources(spark, sf_dir):
    """The 14 tables as source descriptors, beside one that can't be read."""
    specs = [SourceSpec(table=t, path=f"{sf_dir}/{t}.parquet", format="parquet") for t in TABLES]
    batch = profile_sources(spark, [*specs, SourceSpec(table="no_such_table", path=f"{sf_dir}/no_such_table.parquet", format="parquet")])
    return batch.report.select("source_table", "source_system", "row_count", F.size("columns").alias("n_columns"),
                               (F.size("errors") > 0).alias("failed"), F.size("fk_hints").alias("n_fk_hints"))


STORED_TABLES = ["region", "nation", "customer", "supplier", "orders", "labels", "documents", "pii_view"]


def _stored_reports(spark, sf_dir) -> str:
    """A new store with the exact-mode reports of eight tables, written twice (each must be there once)."""
    path = shared_folder(spark)
    reports = profile_tables({t: _load(spark, sf_dir, t) for t in STORED_TABLES}, EXACT).report
    write_reports(reports, path=path)
    write_reports(reports, path=path)
    return path


def _q_stored_stats(spark, sf_dir):
    """Statistics of reports read back as typed rows."""
    r = load_reports(spark, _stored_reports(spark, sf_dir)).select("source_table", F.inline("stats"))
    return r.withColumn("mean_val", F.round("mean_val", 4)).withColumn("stddev_val", F.round("stddev_val", 4))


def _q_stored_lookup(spark, sf_dir):
    """Every report looked up by its id, with what its document says."""
    path = _stored_reports(spark, sf_dir)
    ids = [r[0] for r in read_reports(spark, path).select("report_id").collect()]
    found = _union([report_by_id(spark, i, path) for i in ids])
    doc = F.from_json("report_json", "row_count bigint, columns array<struct<name:string>>, schema_version string, fk_hints array<struct<target_table:string>>")
    return found.select("source_table", doc.alias("d")).select(
        "source_table", "d.row_count", F.array_join("d.columns.name", ",").alias("columns"), "d.schema_version", F.array_join("d.fk_hints.target_table", ",").alias("targets"))


def _q_csv_declared(spark, sf_dir):
    """Orders written as CSV lines with one that doesn't fit, read with a declared schema: the profile and the error."""
    path, orders = shared_folder(spark), _load(spark, sf_dir, "orders")
    lines = orders.select(F.to_csv(F.struct(*orders.columns)).alias("value"))
    lines.union(spark.createDataFrame([("not a number,x",)], "value string")).write.text(path)
    spec = SourceSpec(table="orders", path=path, format="csv", schema=", ".join(f"{c} {t}" for c, t in TABLE_COLUMNS["orders"]), options={"header": "false"})
    t = profile_table(read_source(spark, spec), "orders", EXACT)
    return _rounded(t.profile).select(
        "ordinal", "column", "spark_type", "row_count", "null_count", "distinct_exact", "min_num", "max_num", "min_str", "max_str", "mean_val", "q1", "q3", "outlier_count",
        F.lit(" | ".join(t.errors)).alias("errors"))


def _q_named_sources(spark, sf_dir):
    """Sources by name: a catalog table whose sibling in the database is a foreign-key target, a typed Parquet folder, a CSV with
    inferred columns, and a catalog table that isn't there."""
    root, db = shared_folder(spark), f"tabscope_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {db}")
    for t in ("labels", "documents"):
        _load(spark, sf_dir, t).write.saveAsTable(f"{db}.{t}")
    _load(spark, sf_dir, "orders").write.parquet(f"{root}/parquet/orders")
    _load(spark, sf_dir, "customer").write.option("header", True).csv(f"{root}/csv/customer.csv")
    specs = [SourceSpec(table="labels", database=db, connection_type="catalog", source_system="catalog"), SourceSpec(table="orders"),
             SourceSpec(table="customer", connection_type="csv", source_system="files"), SourceSpec(table="absent", database=db, connection_type="catalog")]
    r = profile_sources(spark, specs, data_root=root).report
    return r.select("source_table", "source_system", "row_count", F.array_join("columns.name", ",").alias("columns"), F.array_join("columns.spark_type", ",").alias("types"),
                    (F.size("errors") > 0).alias("failed"),
                    F.array_join(F.transform("fk_hints", lambda h: F.concat(h["source_col"], F.lit(">"), h["target_table"], F.lit("."), h["target_col"])), ",").alias("hints"))


def _q_empty_tables(spark, sf_dir):
    """Tables of which no row is left: a report without columns, and no failure."""
    none = {"customer": "c_custkey < 0", "orders": "o_orderkey < 0", "documents": "doc_id < 0", "embeddings": "vec_id < 0", "events": "event_id < 0"}
    r = profile_tables({t: _load(spark, sf_dir, t).where(w) for t, w in none.items()}).report
    return r.select("source_table", "row_count", *[F.size(c).alias(f"n_{c}") for c in ("columns", "stats", "pii_info", "detected_patterns", "fk_hints", "errors")])


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: profile all tables at sf0.001 and return one nested report per table."""
    sf_dir = "/root/testdata/sf0.001"
    return profile_tables(_frames(spark, sf_dir), ProfileOptions()).report


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for t in TABLES:
        q[f"column_profile_{t}"] = _q_profile(t)
    q["column_profile_pii_view"] = _q_profile("pii_view")
    q["column_schema_keys"] = _q_column_schema
    q["pii_scores"] = _q_pii_scores
    q["pii_findings"] = _q_pii_findings
    q["pattern_scores"] = _q_pattern_scores
    q["pattern_findings"] = _q_pattern_findings
    q["fk_containment_default"] = _q_fk("default", False)
    q["fk_hints_default"] = _q_fk("default", True)
    q["fk_hints_star"] = _q_fk("star", True)
    q["fk_semi_lineitem_orders"] = _q_semi
    q["top_columns_wide"] = _q_top_columns("wide_view")
    q["top_columns_pii_view"] = _q_top_columns("pii_view")
    q["interpretation"] = _q_interpretation
    q["batch_summary"] = _q_batch_summary
    q["column_profile_nan_view"] = _q_nan_profile
    q["pii_credit_card"] = _q_credit_card
    q["fk_wide_numeric"] = _q_fk_wide_numeric
    q["default_profile_bounds"] = _q_default_bounds
    q["report_columns"] = _exploded("columns")
    q["report_stats"] = _q_report_stats
    q["report_pii"] = _exploded("pii_info")
    q["report_patterns"] = _q_report_patterns
    q["report_fk"] = _exploded("fk_hints")
    q["profile_sources"] = _q_profile_sources
    q["stored_report_stats"] = _q_stored_stats
    q["stored_report_lookup"] = _q_stored_lookup
    q["csv_declared_schema"] = _q_csv_declared
    q["profile_named_sources"] = _q_named_sources
    q["empty_tables"] = _q_empty_tables
    if llm := _llm_queries():
        q.update(llm.queries())
    if pipeline := _pipeline():
        q["pipeline"] = pipeline.run
    return q


# ---------------------------------------------------------------------------
# DuckDB side
# ---------------------------------------------------------------------------
# FIXED VALUES - the regexes and names of the behaviour to match, written out: the SQL must not share code with what it checks.
PII_PATTERNS = [
    ("EMAIL", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("SSN", r"\d{3}-\d{2}-\d{4}"),
    ("PHONE", r"(\+\d{1,2}\s)?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}"),
]
VALUE_PATTERNS = [
    ("IBAN", r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$", "universal"),
    ("SWIFT_BIC", r"^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$", "universal"),
    ("ISO_8601", r"^\d{4}-\d{2}-\d{2}", "universal"),
    ("ISO_4217", r"^[A-Z]{3}$", "universal"),
    ("EMAIL", r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", "universal"),
    ("ACCOUNT_ID", r"ACC-\d{6}", "custom"),
    ("CUSTOMER_ID", r"CUST-\d{6}", "custom"),
    ("LOAN_ID", r"LOAN-\d{6}", "custom"),
    ("BRANCH_CODE", r"BR-\d{3}", "custom"),
]
PERSON_NAME = (
    r"^(?:(?:first|last|full|given|middle|sur|family|"
    r"customer|person|employee|client|owner|contact)_)?name$"
)
_ENTITY = "array_to_string(list_transform(string_split({0}, '_'), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"
_NUMERIC = {"int", "bigint", "double", "float"}
#: Columns that Spark knows to hold no null: a CASE whose branches are all literals.
NEVER_NULL = {("pattern_view", "currency")}


def _family(typ: str) -> str:
    if typ in _NUMERIC or typ.startswith("decimal"):
        return "numeric"
    if typ == "string":
        return "string"
    if typ.startswith(("timestamp", "date")):
        return "temporal"
    if typ.startswith(("array", "map", "struct")):
        return "nested"
    return "other"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _id(c: str) -> str:
    return '"' + c.replace('"', '""') + '"'


def _re2(rx: str) -> str:
    """Java's ``$`` (no MULTILINE) also matches before one final line terminator."""
    if rx.endswith("$") and not rx.endswith("\\$"):
        rx = rx[:-1] + r"(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])?\z"
    return rx


def _src(name: str) -> str:
    if name in VIEWS:
        base, cols = VIEWS[name]
        return "(SELECT " + ", ".join(f"{e} AS {c}" for c, _, e in cols) + f" FROM {base})"
    return name


def sql_profile(name: str) -> str:
    src = _src(name)
    parts = []
    for i, (c, typ) in enumerate(_columns(name), 1):
        fam = _family(typ)
        q = _id(c)
        num = fam == "numeric"
        distinct = f"count(DISTINCT {q})" if not typ.startswith("map") else "NULL"
        mm_num = f"CAST(min({q}) AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"
        mx_num = f"CAST(max({q}) AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"
        mm_str = f"CAST(min({q}) AS VARCHAR)" if fam == "string" else "CAST(NULL AS VARCHAR)"
        mx_str = f"CAST(max({q}) AS VARCHAR)" if fam == "string" else "CAST(NULL AS VARCHAR)"
        mean = f"round(avg({q}), 4)" if num else "CAST(NULL AS DOUBLE)"
        std = f"round(stddev_samp({q}), 4)" if num else "CAST(NULL AS DOUBLE)"
        q1 = f"CAST(quantile_disc({q}, 0.25) AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"
        q3 = f"CAST(quantile_disc({q}, 0.75) AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"
        lb = f"(a.q1 - 1.5 * (a.q3 - a.q1))"
        ub = f"(a.q3 + 1.5 * (a.q3 - a.q1))"
        outl = (f"CASE WHEN a.q1 IS NULL THEN NULL ELSE (SELECT count(*) FROM {src} z "
                f"WHERE z.{q} < {lb} OR z.{q} > {ub}) END") if num else "CAST(NULL AS BIGINT)"
        parts.append(f"""
SELECT {_lit(name)} AS source_table, CAST({i} AS INTEGER) AS ordinal, {_lit(c)} AS "column",
  {_lit(typ)} AS spark_type, {_lit(fam)} AS type_family, {str((name, c) not in NEVER_NULL).lower()} AS nullable,
  a.n AS row_count, a.n AS profiled_rows, a.nulls AS null_count,
  CAST(a.nulls AS DOUBLE) / a.n AS null_pct, a.nn AS non_null_count,
  a.d AS cardinality_est, a.d AS distinct_exact, CAST(a.d AS DOUBLE) / a.n AS uniqueness_ratio,
  coalesce(a.nulls = 0 AND a.d = a.n, false) AS is_pk_candidate,
  a.min_num, a.max_num, a.min_str, a.max_str, a.mean_val, a.stddev_val, a.q1, a.q3,
  {lb} AS lower_bound, {ub} AS upper_bound, {outl} AS outlier_count,
  coalesce({outl} > 0, false) AS has_outliers
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE {q} IS NULL) AS nulls, count({q}) AS nn,
        {distinct} AS d, {mm_num} AS min_num, {mx_num} AS max_num, {mm_str} AS min_str, {mx_str} AS max_str,
        {mean} AS mean_val, {std} AS stddev_val, {q1} AS q1, {q3} AS q3 FROM {src}) a
WHERE a.n > 0""")
    return "\nUNION ALL\n".join(parts)


def sql_pii_scores(name: str) -> str:
    src = _src(name)
    parts = []
    for i, (c, typ) in enumerate(_columns(name), 1):
        if _family(typ) != "string":
            continue
        q = _id(c)
        for j, (ptype, rx) in enumerate(PII_PATTERNS):
            hit = f"count(*) FILTER (WHERE regexp_matches({q}, {_lit(_re2(rx))}))"
            parts.append(f"""
SELECT {_lit(name)} AS source_table, CAST({i} AS INTEGER) AS ordinal, {_lit(c)} AS "column",
  {_lit(ptype)} AS pii_type, CAST({j} AS INTEGER) AS priority, a.nn AS non_null_count, a.m AS match_count,
  coalesce(CAST(a.m AS DOUBLE) / nullif(a.nn, 0), 0.0) AS confidence
FROM (SELECT count(*) AS n, count({q}) AS nn, {hit} AS m FROM {src}) a WHERE a.n > 0""")
    if not parts:
        return ("SELECT CAST(NULL AS VARCHAR) AS source_table, CAST(NULL AS INTEGER) AS ordinal, "
                "CAST(NULL AS VARCHAR) AS \"column\", CAST(NULL AS VARCHAR) AS pii_type, "
                "CAST(NULL AS INTEGER) AS priority, CAST(NULL AS BIGINT) AS non_null_count, "
                "CAST(NULL AS BIGINT) AS match_count, CAST(NULL AS DOUBLE) AS confidence WHERE false")
    return "\nUNION ALL\n".join(parts)


def sql_pattern_scores(name: str) -> str:
    src = _src(name)
    parts = []
    for i, (c, typ) in enumerate(_columns(name), 1):
        if _family(typ) != "string":
            continue
        q = _id(c)
        for j, (pname, rx, layer) in enumerate(VALUE_PATTERNS):
            hit = f"count(*) FILTER (WHERE regexp_matches({q}, {_lit(_re2(rx))}))"
            parts.append(f"""
SELECT {_lit(name)} AS source_table, CAST({i} AS INTEGER) AS ordinal, {_lit(c)} AS "column",
  {_lit(pname)} AS pattern, {_lit(layer)} AS layer, CAST({j} AS INTEGER) AS priority,
  a.nn AS non_null_count, a.m AS match_count, CAST(a.m AS DOUBLE) / nullif(a.nn, 0) AS match_ratio
FROM (SELECT count(*) AS n, count({q}) AS nn, {hit} AS m FROM {src}) a WHERE a.n > 0""")
    return "\nUNION ALL\n".join(parts)


def sql_pii_findings(name: str) -> str:
    is_name = f"regexp_matches(lower(s.\"column\"), {_lit(PERSON_NAME)})"
    return f"""
WITH sc AS ({sql_pii_scores(name)}),
w AS (SELECT *, row_number() OVER (PARTITION BY source_table, ordinal, "column"
                                   ORDER BY confidence DESC, priority ASC) AS rk
      FROM sc WHERE confidence > 0.1),
s AS (SELECT DISTINCT source_table, ordinal, "column" FROM sc)
SELECT s.source_table, s.ordinal, s."column",
  (w.pii_type IS NOT NULL OR {is_name}) AS is_pii,
  coalesce(w.pii_type, CASE WHEN {is_name} THEN 'NAME' END) AS pii_type,
  coalesce(w.confidence, CASE WHEN {is_name} THEN CAST(0.75 AS DOUBLE) END) AS confidence
FROM s LEFT JOIN (SELECT * FROM w WHERE rk = 1) w
  ON s.source_table = w.source_table AND s.ordinal = w.ordinal AND s."column" = w."column"
WHERE w.pii_type IS NOT NULL OR {is_name}"""


def sql_pattern_findings(name: str, joined: bool = True) -> str:
    ends = lambda *suffixes: " OR ".join(f"ends_with(lower(p.\"column\"), '{x}')" for x in suffixes)
    name_sql = (f"CASE WHEN {ends('_id', '_pk', '_key')} THEN 'LIKELY_KEY' END, "
                f"CASE WHEN {ends('_date', '_dt', '_timestamp')} THEN 'LIKELY_TEMPORAL' END, "
                f"CASE WHEN {ends('_amt', '_amount', '_bal', '_balance')} THEN 'LIKELY_MEASURE' END")
    d, n, nn = "p.distinct_exact", "p.profiled_rows", "p.non_null_count"
    uniq = f"coalesce(CAST({d} AS DOUBLE) / nullif({n}, 0), 0.0)"
    data_hint = (f"CASE WHEN {uniq} > 0.95 AND {nn} = {n} THEN 'HIGH_UNIQUENESS_CANDIDATE' "
                 f"WHEN {d} < 50 AND CAST({d} AS DOUBLE) / {nn} < "
                 f"0.1 THEN 'LOW_CARDINALITY_CATEGORICAL' END")
    heur = f"concat_ws(',', {name_sql}, {data_hint})"
    return f"""
WITH sc AS ({sql_pattern_scores(name)}),
p AS ({sql_profile(name)}),
m AS (SELECT source_table, ordinal, "column", string_agg(pattern, ',' ORDER BY priority) AS patterns
      FROM sc WHERE match_ratio > 0.5 GROUP BY source_table, ordinal, "column"),
s AS (SELECT DISTINCT source_table, ordinal, "column" FROM sc),
f AS (SELECT s.source_table, s.ordinal, s."column", coalesce(m.patterns, '') AS patterns,
        {heur} AS heuristics, {uniq} AS uniqueness_score
      FROM s JOIN p ON s.source_table = p.source_table AND s.ordinal = p.ordinal
      LEFT JOIN m ON s.source_table = m.source_table AND s.ordinal = m.ordinal
      WHERE {nn} > 0)
SELECT * FROM f WHERE patterns <> '' OR heuristics <> ''"""


def sql_scores(name: str) -> str:
    score = (f"CASE WHEN pi.ordinal IS NOT NULL THEN CAST(2.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END"
             f" + CASE WHEN p.is_pk_candidate THEN CAST(1.5 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END"
             f" + CASE WHEN pt.ordinal IS NOT NULL THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END"
             f" + coalesce(p.null_pct, 0.0)"
             f" + CASE WHEN p.has_outliers THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END")
    return f"""
WITH p AS ({sql_profile(name)}),
pi AS ({sql_pii_findings(name)}),
pt AS ({sql_pattern_findings(name)})
SELECT p.source_table, p.ordinal, p."column", pi.ordinal IS NOT NULL AS is_pii, p.is_pk_candidate,
  pt.ordinal IS NOT NULL AS has_pattern, coalesce(p.null_pct, 0.0) AS null_pct, p.has_outliers,
  {score} AS score,
  (pi.ordinal IS NOT NULL OR pt.ordinal IS NOT NULL OR p.is_pk_candidate
   OR coalesce(p.null_pct, 0.0) >= 0.10 OR p.has_outliers) AS interesting
FROM p LEFT JOIN pi ON p.ordinal = pi.ordinal LEFT JOIN pt ON p.ordinal = pt.ordinal"""


def sql_top_columns(name: str) -> str:
    return f"""
WITH sc AS ({sql_scores(name)}),
r AS (SELECT *, count(*) OVER (PARTITION BY source_table) AS n_,
        row_number() OVER (PARTITION BY source_table ORDER BY ordinal) AS r0,
        row_number() OVER (PARTITION BY source_table ORDER BY interesting DESC, score DESC, ordinal) AS r1
      FROM sc)
SELECT source_table, ordinal, "column", is_pii, is_pk_candidate, has_pattern, null_pct, has_outliers, score,
  interesting, CASE WHEN n_ <= 50 THEN r0 ELSE r1 END AS rank, (n_ <= 50 OR r1 <= 30) AS in_top
FROM r"""


def sql_interpretation_one(name: str) -> str:
    return f"""
SELECT {_lit(name)} AS source_table, {_ENTITY.format(_lit(name))} AS entity,
  coalesce(bk.cols, '') AS bk_columns, CAST(coalesce(bk.k, 0) AS INTEGER) AS bk_count,
  CASE WHEN coalesce(bk.k, 0) > 0 THEN CAST(0.65 AS DOUBLE) END AS bk_confidence,
  coalesce(ps.txt, '') AS pii_summary, coalesce(dq.txt, '') AS dq_flags, CAST(0.25 AS DOUBLE) AS confidence
FROM (SELECT 1) one
LEFT JOIN (
  SELECT string_agg("column", ',' ORDER BY ordinal) AS cols, count(*) AS k
  FROM (SELECT *, bool_or(is_pk_candidate) OVER () AS any_key FROM ({sql_profile(name)}))
  WHERE CASE WHEN any_key THEN is_pk_candidate ELSE contains(lower("column"), 'id') END) bk ON true
LEFT JOIN (
  SELECT string_agg(printf('%s: detected %s (confidence %.2f).', "column", coalesce(pii_type, 'PII'), confidence), ' | ' ORDER BY ordinal) AS txt
  FROM ({sql_pii_findings(name)})) ps ON true
LEFT JOIN (
  SELECT array_to_string(flatten(list(f ORDER BY ordinal)), ' | ') AS txt FROM (
    SELECT ordinal, list_filter([
            CASE WHEN null_pct >= 0.20 THEN printf('%s has high null rate (%.0f%%).', "column", null_pct * 100) END,
            CASE WHEN has_outliers THEN printf('%s shows outliers (IQR heuristic).', "column") END],
            lambda x: x IS NOT NULL) AS f
    FROM ({sql_profile(name)}))) dq ON true"""


def _key_like(rule: str, column: str) -> bool:
    return "id" in column.lower() if rule == "default" else column.lower().endswith("key")


def _similar(rule: str, a: str, b: str) -> bool:
    a, b = ((re.sub(r"^[a-z]+_", "", x.lower()) if rule == "star" else x.lower()).replace("_", "") for x in (a, b))
    return a in b or b in a


def _compared(column: str, typ: str, other: str) -> str:
    """A floating number on either side makes both floating."""
    floating = {"double", "float"} & {typ, other}
    return f"CAST({_id(column)} AS DOUBLE)" if floating else _id(column)


def sql_fk(rule: str, hints_only: bool, tables=tuple(TABLES)) -> str:
    def fam(typ):
        f = _family(typ)
        return f if f in ("numeric", "string") else None

    keyed = {t: [(c, typ) for c, typ in _columns(t) if _key_like(rule, c)] for t in tables}
    parts = []
    for st in tables:
        for a, at in keyed[st]:
            if fam(at) is None:
                continue
            for tt in tables:
                if tt == st:
                    continue
                for b, bt in keyed[tt]:
                    if fam(at) == fam(bt) and _similar(rule, a, b):
                        parts.append(f"""
SELECT {_lit(st)} AS source_table, {_lit(a)} AS source_col, {_lit(tt)} AS target_table, {_lit(b)} AS target_col,
  (SELECT count(*) FROM (SELECT DISTINCT {_compared(a, at, bt)} AS v FROM {_src(st)} WHERE {_id(a)} IS NOT NULL) x
   WHERE x.v IN (SELECT {_compared(b, bt, at)} FROM {_src(tt)} WHERE {_id(b)} IS NOT NULL)) AS match_count,
  (SELECT count(DISTINCT {_compared(a, at, bt)}) FROM {_src(st)}) AS source_distinct,
  (SELECT count(DISTINCT {_compared(b, bt, at)}) FROM {_src(tt)}) AS target_distinct,
  (SELECT count({_id(b)}) = count(DISTINCT {_compared(b, bt, at)}) FROM {_src(tt)}) AS target_is_unique""")
    body = "\nUNION ALL\n".join(parts)
    sql = f"""
SELECT source_table, source_col, target_table, target_col, match_count, source_distinct, target_distinct,
  coalesce(CAST(match_count AS DOUBLE) / nullif(source_distinct, 0), 0.0) AS match_ratio, target_is_unique,
  (source_distinct > 0 AND CAST(match_count AS DOUBLE) / nullif(source_distinct, 0) >= 0.90
   AND target_distinct >= match_count) AS is_hint
FROM ({body}) c"""
    if hints_only:
        return f"SELECT * EXCLUDE (is_hint) FROM ({sql}) h WHERE is_hint"
    return sql


def sql_nan_profile() -> str:
    src, parts = _src("nan_view"), []
    for i, (c, _) in enumerate(_columns("nan_view"), 1):
        q = _id(c)
        parts.append(f"""
SELECT 'nan_view' AS source_table, CAST({i} AS INTEGER) AS ordinal, {_lit(c)} AS "column", a.nulls AS null_count, a.nn AS non_null_count,
  a.d AS distinct_exact, a.lo AS min_num, a.q1, a.q3, a.q1 - 1.5 * (a.q3 - a.q1) AS lower_bound, a.q3 + 1.5 * (a.q3 - a.q1) AS upper_bound,
  CASE WHEN a.q1 IS NOT NULL THEN (SELECT count(*) FROM {src} z WHERE z.{q} < a.q1 - 1.5 * (a.q3 - a.q1) OR z.{q} > a.q3 + 1.5 * (a.q3 - a.q1)) END
    AS outlier_count,
  coalesce((SELECT count(*) FROM {src} z WHERE z.{q} < a.q1 - 1.5 * (a.q3 - a.q1) OR z.{q} > a.q3 + 1.5 * (a.q3 - a.q1)) > 0, false) AS has_outliers
FROM (SELECT count(*) FILTER (WHERE {q} IS NULL) AS nulls, count({q}) AS nn, count(DISTINCT {q}) AS d, min({q}) AS lo,
        quantile_disc(CASE WHEN NOT isnan({q}) THEN {q} END, 0.25) AS q1, quantile_disc(CASE WHEN NOT isnan({q}) THEN {q} END, 0.75) AS q3 FROM {src}) a""")
    return "\nUNION ALL\n".join(parts)


def _keyed(column: str) -> str:
    """A column of the card view with the row's key."""
    expr = next(e for c, _, e in CARD_VIEW[1] if c == column)
    return f"(SELECT c_custkey AS id, {expr} AS t FROM customer)"


def sql_credit_card_scores() -> str:
    """By brute force: every piece of the text from 13 to 37 characters that is digits with single spaces or hyphens, not beside a digit."""
    src, parts = _src("card_view"), []
    for i, (c, _) in enumerate(_columns("card_view"), 1):
        digit = "CAST(d[k:k] AS INTEGER)"
        luhn = (f"list_sum(list_transform(range(1, length(d) + 1), lambda k: CASE WHEN (length(d) - k) % 2 = 0 THEN {digit} "
                f"WHEN {digit} * 2 > 9 THEN {digit} * 2 - 9 ELSE {digit} * 2 END)) % 10 = 0")
        parts.append(f"""
SELECT 'card_view' AS source_table, CAST({i} AS INTEGER) AS ordinal, {_lit(c)} AS "column", a.nn AS non_null_count, coalesce(b.m, 0) AS match_count,
  CAST(coalesce(b.m, 0) AS DOUBLE) / a.nn AS confidence
FROM (SELECT count({_id(c)}) AS nn FROM {src}) a, (
  SELECT count(DISTINCT id) AS m FROM (
    SELECT id, regexp_replace(t[p:p + n - 1], '[ -]', '', 'g') AS d
    FROM (SELECT id, t, p, unnest(range(13, 38)) AS n FROM (
      SELECT id, t, unnest(range(1, length(t) - 11)) AS p FROM {_keyed(c)}))
    WHERE p + n - 1 <= length(t) AND regexp_matches(t[p:p], '[0-9]') AND regexp_matches(t[p + n - 1:p + n - 1], '[0-9]')
      AND (p = 1 OR NOT regexp_matches(t[p - 1:p - 1], '[0-9]')) AND NOT regexp_matches(t[p + n:p + n], '[0-9]')
      AND regexp_full_match(t[p:p + n - 1], '[0-9]+([ -][0-9]+)*'))
  WHERE length(d) BETWEEN 13 AND 19 AND {luhn}) b""")
    return "\nUNION ALL\n".join(parts)


def sql_empty_tables() -> str:
    zeros = ", ".join(f"CAST(0 AS INTEGER) AS n_{c}" for c in ("columns", "stats", "pii_info", "detected_patterns", "fk_hints", "errors"))
    none = {"customer": "c_custkey < 0", "orders": "o_orderkey < 0", "documents": "doc_id < 0", "embeddings": "vec_id < 0", "events": "event_id < 0"}
    return "\nUNION ALL\n".join(f"SELECT {_lit(t)} AS source_table, (SELECT count(*) FROM {t} WHERE {w}) AS row_count, {zeros}" for t, w in none.items())


def sql_named_sources() -> str:
    def one(table, system, columns, hints="''", rows=None):
        said = ", ".join(_lit(",".join(x)) for x in zip(*columns)) if columns else "'', ''"
        return (f"SELECT {_lit(table)} AS source_table, {_lit(system)} AS source_system, {rows or f'(SELECT count(*) FROM {table})'} AS row_count, "
                + "{0} AS columns, {1} AS types, ".format(*said.split(", ", 1)) + f"{str(not columns).lower()} AS failed, {hints} AS hints")

    # a CSV's columns are typed by what they look like
    seen = [(c, {"bigint": "int"}.get(t, t)) for c, t in TABLE_COLUMNS["customer"]]
    held = "(SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)) >= 0.9 * (SELECT count(DISTINCT doc_id) FROM labels)"
    return "\nUNION ALL\n".join([
        one("labels", "catalog", TABLE_COLUMNS["labels"], f"CASE WHEN {held} THEN 'doc_id>documents.doc_id' ELSE '' END"), one("orders", "unknown", TABLE_COLUMNS["orders"]),
        one("customer", "files", seen), one("absent", "unknown", [], rows="CAST(NULL AS BIGINT)")])


def sql_csv_declared() -> str:
    nulls = ", ".join(f"CAST(NULL AS {'TIMESTAMP' if t.startswith('timestamp') else 'VARCHAR' if t == 'string' else t.upper()}) AS {c}" for c, t in TABLE_COLUMNS["orders"])
    profile = sql_profile("orders").replace("FROM orders", f"FROM (SELECT * FROM orders UNION ALL SELECT {nulls})")
    return (f"SELECT ordinal, \"column\", spark_type, row_count, null_count, distinct_exact, min_num, max_num, min_str, max_str, mean_val, q1, q3, outlier_count, "
            f"'1 rows don''t fit the declared schema' AS errors FROM ({profile})")


def sql_stored_lookup() -> str:
    hints = sql_fk("default", True, tuple(STORED_TABLES))
    return "\nUNION ALL\n".join(
        f"SELECT {_lit(t)} AS source_table, (SELECT count(*) FROM {_src(t)}) AS row_count, {_lit(','.join(c for c, _ in _columns(t)))} AS columns, '1.1.0' AS schema_version, "
        f"coalesce((SELECT string_agg(target_table, ',' ORDER BY source_col, target_table, target_col) FROM ({hints}) WHERE source_table = {_lit(t)}), '') AS targets" for t in STORED_TABLES)


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    for t in TABLES:
        o[f"column_profile_{t}"] = sql_profile(t)
    o["column_profile_pii_view"] = sql_profile("pii_view")
    o["column_schema_keys"] = "\nUNION ALL\n".join(
        f"SELECT source_table, ordinal, \"column\" AS name, spark_type, nullable, is_pk_candidate "
        f"FROM ({sql_profile(t)})" for t in TABLES)
    o["pii_scores"] = "\nUNION ALL\n".join(sql_pii_scores(t) for t in TABLES if any(
        _family(ty) == "string" for _, ty in _columns(t)))
    o["pii_findings"] = sql_pii_findings("pii_view")
    o["pattern_scores"] = "\nUNION ALL\n".join(sql_pattern_scores(t) for t in TABLES if any(
        _family(ty) == "string" for _, ty in _columns(t)))
    o["pattern_findings"] = sql_pattern_findings("pattern_view")
    o["fk_containment_default"] = sql_fk("default", False)
    o["fk_hints_default"] = sql_fk("default", True)
    o["fk_hints_star"] = sql_fk("star", True)
    o["fk_semi_lineitem_orders"] = """
SELECT count(*) FILTER (WHERE hit) AS match_count, count(*) AS source_distinct,
  coalesce(CAST(count(*) FILTER (WHERE hit) AS DOUBLE) / nullif(count(*), 0), 0.0) AS match_ratio
FROM (SELECT DISTINCT l_orderkey, l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL) AS hit
      FROM lineitem WHERE l_orderkey IS NOT NULL) s"""
    o["top_columns_wide"] = sql_top_columns("wide_view")
    o["top_columns_pii_view"] = sql_top_columns("pii_view")
    o["interpretation"] = "\nUNION ALL\n".join(sql_interpretation_one(t) for t in INTERP_TABLES)
    o["batch_summary"] = "\nUNION ALL\n".join(
        f"SELECT {_lit(t)} AS source_table, {_ENTITY.format(_lit(t))} AS entity, count(*) AS row_count, "
        f"CAST(0.25 AS DOUBLE) AS confidence FROM {t}" for t in TABLES)
    o["column_profile_nan_view"] = sql_nan_profile()
    o["pii_credit_card"] = sql_credit_card_scores()
    o["fk_wide_numeric"] = sql_fk("default", False, tuple(WIDE_KEYS))
    o["default_profile_bounds"] = "\nUNION ALL\n".join(
        f"SELECT source_table, ordinal, \"column\", profiled_rows, CASE WHEN q1 IS NOT NULL THEN true END AS q1_near, "
        f"CASE WHEN q3 IS NOT NULL THEN true END AS q3_near, true AS distinct_near, is_pk_candidate FROM ({sql_profile(t)})" for t in TABLES)
    profiles = {t: sql_profile(t) for t in REPORT_TABLES}
    o["report_columns"] = "\nUNION ALL\n".join(
        f"SELECT source_table, ordinal, \"column\" AS name, spark_type, nullable, is_pk_candidate, uniqueness_ratio FROM ({p})" for p in profiles.values())
    o["report_stats"] = "\nUNION ALL\n".join(
        f"SELECT source_table, ordinal, \"column\", null_pct, cardinality_est, min_num, max_num, min_str, max_str, mean_val, stddev_val, q1, q3, "
        f"outlier_count, has_outliers FROM ({p})" for p in profiles.values())
    o["report_pii"] = "\nUNION ALL\n".join(f"SELECT * FROM ({sql_pii_findings(t)})" for t in REPORT_TABLES)
    o["report_patterns"] = "\nUNION ALL\n".join(f"SELECT * FROM ({sql_pattern_findings(t)})" for t in REPORT_TABLES if any(
        _family(ty) == "string" for _, ty in _columns(t)))
    o["report_fk"] = (f"SELECT source_table, source_col, target_table, target_col, match_ratio FROM "
                      f"({sql_fk('default', True, tuple(REPORT_TABLES))}) WHERE source_table NOT IN ('pii_view', 'pattern_view')")
    hints = sql_fk("default", True)
    o["profile_sources"] = "\nUNION ALL\n".join(
        f"SELECT {_lit(t)} AS source_table, 'unknown' AS source_system, (SELECT count(*) FROM {t}) AS row_count, "
        f"CAST({len(TABLE_COLUMNS[t])} AS INTEGER) AS n_columns, false AS failed, "
        f"(SELECT CAST(count(*) AS INTEGER) FROM ({hints}) WHERE source_table = {_lit(t)}) AS n_fk_hints" for t in TABLES
    ) + "\nUNION ALL\nSELECT 'no_such_table', 'unknown', CAST(NULL AS BIGINT), 0, true, 0"
    o["stored_report_stats"] = "\nUNION ALL\n".join(
        f"SELECT source_table, ordinal, \"column\", null_pct, cardinality_est, min_num, max_num, min_str, max_str, mean_val, stddev_val, q1, q3, "
        f"outlier_count, has_outliers FROM ({sql_profile(t)})" for t in STORED_TABLES)
    o["stored_report_lookup"] = sql_stored_lookup()
    o["csv_declared_schema"] = sql_csv_declared()
    o["profile_named_sources"] = sql_named_sources()
    o["empty_tables"] = sql_empty_tables()
    if llm := _llm_queries():
        o.update(llm.oracle_sql())
    if (pipeline := _pipeline()) and pipeline.ORACLE_SQL:
        o["pipeline"] = pipeline.ORACLE_SQL
    return o
