"""Column schema, statistics, primary-key candidates and IQR outliers.

``column_profile`` returns one row per column of the profiled table, over all its
rows.  The first pass is the fused aggregate (null and non-null counts, distinct
estimate, extremes, mean, deviation, quartile sketch).  The second pass depends on
the first only through a few values per column:

* outlier counts, with the fences as literals;
* exact distinct counts: in exact mode of every column, else of the columns that
  pass the key gate, so that a key is only claimed when it has been proved.

In exact mode the quartiles are exact too, see :mod:`tabscope.operators.quantiles`.
NaN is left out of the quartiles; it lies above every fence, as in any comparison.
"""
from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ratio, sql_double, sql_id
from ..functions.families import ColumnSpec, column_specs
from ..options import ProfileOptions
from . import quantiles as Q
from .distinct import exact_distinct
from .scan import PLAIN, ROWS, SKETCH, TEXT, FusedScan, Ref

STATS_LONG = (
    "source_table string, ordinal int, column string, spark_type string, type_family string, nullable boolean, "
    "profiled_rows bigint, null_count bigint, non_null_count bigint, cardinality_est bigint, "
    "distinct_exact bigint, min_num double, max_num double, min_str string, max_str string, "
    "mean_val double, stddev_val double, q1 double, q3 double, lower_bound double, upper_bound double, "
    "outlier_count bigint"
)

#: How far below the row count the estimate of a key may be (the sketch's error is 0.01 by default).
KEY_SLACK = 0.15


def add_stats_aggs(scan: FusedScan, opts: ProfileOptions) -> None:
    for s in scan.specs:
        q = sql_id(s.name)
        scan.add(s, "nulls", f"count_if({q} IS NULL)")
        scan.add(s, "nn", f"count({q})")
        if not opts.exact and s.distinct_capable:
            scan.add(s, "adist", f"hll_sketch_estimate(hll_sketch_agg(CASE WHEN {q} IS NOT NULL THEN xxhash64({q}) END, {opts.sketch_lg_k}))", SKETCH)
        # results are cast to their report types inside the aggregate
        if s.minmax_kind is not None:
            typ = "DOUBLE" if s.minmax_kind == "num" else "STRING"
            kind = TEXT if s.is_string else PLAIN
            scan.add(s, "min", f"CAST(min({q}) AS {typ})", kind)
            scan.add(s, "max", f"CAST(max({q}) AS {typ})", kind)
        if s.is_numeric:
            scan.add(s, "mean", f"CAST(avg({q}) AS DOUBLE)")
            scan.add(s, "std", f"CAST(stddev_samp({q}) AS DOUBLE)")
            if opts.exact:
                Q.add_bracket_aggs(scan, s)
            else:
                scan.add(s, "qa", f"percentile_approx({s.sql_number}, array(0.25D, 0.75D), {opts.sketch_accuracy})", SKETCH)


def passes_key_gate(n: int, nulls, est, opts: ProfileOptions) -> bool:
    """Is a column worth an exact distinct count (no nulls, estimate near the rows)?"""
    if not n or (nulls or 0) != 0 or est is None:
        return False
    return opts.pk_gate == "none" or (est == n if opts.pk_gate == "strict" else est >= n * (1.0 - KEY_SLACK))


def outlier_counts(df: DataFrame, specs: list[ColumnSpec], bounds: dict[int, tuple[float, float]]) -> dict[int, int]:
    """Rows outside the fence, per column: one scan."""
    scan = FusedScan(df, [s for s in specs if s.ordinal in bounds])
    for s in scan.specs:
        lo, hi = bounds[s.ordinal]
        q = sql_id(s.name)
        scan.add(s, "out", f"count_if({q} < {sql_double(lo)} OR {q} > {sql_double(hi)})")
    return {s.ordinal: scan.get(s, "out") for s in scan.specs}


def second_pass(scan: FusedScan, opts: ProfileOptions, specs: list[ColumnSpec]) -> None:
    """Quartiles, fences, outliers and exact distinct counts, added to the first pass's row."""
    df, n = scan.df, scan.rows
    if not n:
        return
    numeric = [s for s in specs if s.is_numeric]
    if opts.exact:
        quartiles = Q.exact_quartiles(df, numeric, scan)
        counted = [s for s in specs if s.distinct_capable]
    else:
        sketched = {s.ordinal: scan.get(s, "qa") for s in numeric}
        quartiles = {o: tuple(qa) for o, qa in sketched.items() if qa and None not in qa}
        counted = [s for s in specs if s.distinct_capable and passes_key_gate(n, scan.get(s, "nulls"), scan.get(s, "adist"), opts)]
    bounds = {o: Q.fence(*q) for o, q in quartiles.items()}
    outliers = outlier_counts(df, numeric, bounds)
    distinct = {r[0]: r[1] for r in exact_distinct(df, counted, n).collect()} if counted else {}
    for s in specs:
        if s in counted:
            scan.put(s, "dexact", distinct.get(s.ordinal, 0))
        if s.ordinal in bounds:
            for key, x in zip(("q1", "q3", "lb", "ub"), (*quartiles[s.ordinal], *bounds[s.ordinal])):
                scan.put(s, key, float(x))
            scan.put(s, "outl", outliers[s.ordinal])


def stats_rows(source_table: str):
    """Long-form rows of a column."""
    def build(s: ColumnSpec) -> list[tuple]:
        num, text = s.minmax_kind == "num", s.minmax_kind == "str"

        def of(key, wanted=True):
            return Ref(key, s) if wanted else None

        return [(
            source_table, s.ordinal, s.name, s.spark_type, s.family, s.nullable, Ref(ROWS),
            *map(of, ("nulls", "nn", "adist", "dexact")), of("min", num), of("max", num), of("min", text), of("max", text),
            *map(of, ("mean", "std", "q1", "q3", "lb", "ub", "outl")),
        )]

    return build


def profile_of(long: DataFrame, opts: ProfileOptions) -> DataFrame:
    """The column profile from the long form, of any number of tables."""
    rows = F.col("profiled_rows")
    card = F.col("distinct_exact") if opts.exact else F.col("cardinality_est")
    is_pk = (F.col("null_count") == 0) & (F.col("distinct_exact") == rows)
    return long.where(rows > 0).select(
        "source_table", "ordinal", "column", "spark_type", "type_family", "nullable",
        rows.alias("row_count"), "profiled_rows", "null_count",
        ratio(F.col("null_count"), rows).alias("null_pct"),
        "non_null_count",
        card.cast("bigint").alias("cardinality_est"),
        "distinct_exact",
        ratio(F.coalesce(F.col("distinct_exact"), card), rows).alias("uniqueness_ratio"),
        F.coalesce(is_pk, F.lit(False)).alias("is_pk_candidate"),
        "min_num", "max_num", "min_str", "max_str", "mean_val", "stddev_val",
        "q1", "q3", "lower_bound", "upper_bound", "outlier_count",
        F.coalesce(F.col("outlier_count") > 0, F.lit(False)).alias("has_outliers"),
    )


def profile_from(scan: FusedScan, opts: ProfileOptions, source_table: str, specs: list[ColumnSpec]) -> DataFrame:
    """The column profile of a scan that has been through :func:`second_pass`."""
    return profile_of(scan.long(specs, stats_rows(source_table), STATS_LONG), opts)


def column_profile(df: DataFrame, opts: ProfileOptions | None = None, source_table: str = "table") -> DataFrame:
    """One row per column: schema, key candidacy and statistics over all rows."""
    opts = opts or ProfileOptions()
    scan = FusedScan(df, column_specs(df.schema, opts.extended_types))
    add_stats_aggs(scan, opts)
    second_pass(scan, opts, scan.specs)
    return profile_from(scan, opts, source_table, scan.specs)


def column_schema(profile: DataFrame) -> DataFrame:
    """Schema view of a column profile: name, type, nullability, key candidacy."""
    return profile.select(
        "source_table", "ordinal", F.col("column").alias("name"), "spark_type", "nullable",
        "is_pk_candidate", "uniqueness_ratio",
    )


def column_stats(profile: DataFrame) -> DataFrame:
    """Statistics view of a column profile."""
    return profile.select(
        "source_table", "ordinal", "column", "null_pct", "cardinality_est",
        "min_num", "max_num", "min_str", "max_str", "mean_val", "stddev_val",
        "q1", "q3", "lower_bound", "upper_bound", "outlier_count", "has_outliers",
    )
