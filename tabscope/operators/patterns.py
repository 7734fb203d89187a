"""Value patterns and column heuristics on string columns.

Layer 1: universal patterns, layer 2: user patterns (a user pattern with a
universal name replaces that regex in place), layer 3: heuristics from the
column name and from distinct/row ratios.  A pattern is assigned when more
than half of the non-null values match.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ratio, sql_id, sql_matches
from ..functions.families import ColumnSpec, column_specs
from ..functions.patterns_fixed import (
    HIGH_UNIQUENESS, HIGH_UNIQUENESS_RATIO, LOW_CARDINALITY, LOW_CARDINALITY_MAX_DISTINCT,
    LOW_CARDINALITY_MAX_RATIO, NAME_HEURISTICS, NEEDS, PATTERN_MIN_RATIO, UNIVERSAL_PATTERNS,
)
from ..options import ProfileOptions
from .scan import ROWS, FusedScan, Ref

PATTERN_LONG = (
    "source_table string, ordinal int, column string, pattern string, layer string, priority int, "
    "non_null_count bigint, match_count bigint, profiled_rows bigint"
)


def all_patterns(custom=()) -> list[tuple[str, str, str]]:
    """(name, regex, layer) in reporting order."""
    merged = {name: (rx, "universal") for name, rx in UNIVERSAL_PATTERNS}
    for name, rx in (custom or ()):
        merged[name] = (rx, "custom")
    return [(name, rx, layer) for name, (rx, layer) in merged.items()]


def patterns_from(df: DataFrame, name: str = "name", regex: str = "regex") -> tuple[tuple[str, str], ...]:
    """Custom patterns from a small table, in name order (later rows of one name win nothing: names must be unique)."""
    rows = sorted((r[0], r[1]) for r in df.select(name, regex).where(F.col(name).isNotNull() & F.col(regex).isNotNull()).distinct().collect())
    if len({n for n, _ in rows}) < len(rows):
        raise ValueError("a pattern name has two regexes")
    return tuple(rows)


def add_pattern_aggs(scan: FusedScan, opts: ProfileOptions) -> None:
    for s in scan.specs:
        if not s.is_string:
            continue
        q = sql_id(s.name)
        scan.add(s, "nn", f"count({q})")
        for j, (_, rx, _) in enumerate(all_patterns(opts.custom_patterns)):
            scan.add(s, f"pat{j}", f"count_if({sql_matches(q, rx, NEEDS.get(rx, ''))})")


def pattern_rows(opts: ProfileOptions, source_table: str):
    """Long-form rows of a string column; none of others."""
    pats = all_patterns(opts.custom_patterns)

    def build(s: ColumnSpec) -> list[tuple]:
        return [(source_table, s.ordinal, s.name, name, layer, j, Ref("nn", s), Ref(f"pat{j}", s), Ref(ROWS))
                for j, (name, _, layer) in enumerate(pats) if s.is_string]

    return build


def pattern_scores_of(long: DataFrame) -> DataFrame:
    """Scores from the long form, of any number of tables."""
    return long.where(F.col("profiled_rows") > 0).select(
        "source_table", "ordinal", "column", "pattern", "layer", "priority", "non_null_count", "match_count",
        ratio(F.col("match_count"), F.col("non_null_count")).alias("match_ratio"),
    )


def pattern_scores_from(scan: FusedScan, opts: ProfileOptions, source_table: str, specs: list[ColumnSpec]) -> DataFrame:
    return pattern_scores_of(scan.long(specs, pattern_rows(opts, source_table), PATTERN_LONG))


def pattern_scores(df: DataFrame, opts: ProfileOptions | None = None, source_table: str = "table") -> DataFrame:
    """(source_table, ordinal, column, pattern, layer, priority, non_null_count, match_count, match_ratio); lazy, one scan."""
    opts = opts or ProfileOptions()
    scan = FusedScan(df, column_specs(df.schema, opts.extended_types))
    add_pattern_aggs(scan, opts)
    return pattern_scores_from(scan, opts, source_table, scan.specs)


def _name_hints(column: Column) -> Column:
    low = F.lower(column)
    hints = []
    for label, suffixes in NAME_HEURISTICS:
        cond = None
        for suf in suffixes:
            c = low.endswith(suf)
            cond = c if cond is None else (cond | c)
        hints.append(F.when(cond, F.lit(label)))
    return F.filter(F.array(*hints), lambda x: x.isNotNull())


def pattern_findings(scores: DataFrame, profile: DataFrame) -> DataFrame:
    """(source_table, ordinal, column, patterns, heuristics, uniqueness_score).

    ``profile`` supplies per column profiled_rows, non_null_count and
    cardinality_est (an estimate, or exact in exact mode)."""
    keys = ["source_table", "ordinal", "column"]
    hit = F.when(F.col("match_ratio") > PATTERN_MIN_RATIO, F.struct("priority", "pattern"))
    matched = scores.groupBy(*keys).agg(F.array_sort(F.collect_list(hit)).alias("_m")).select(
        *keys, F.transform("_m", lambda x: x["pattern"]).alias("patterns"))
    p = profile.select(*keys, "profiled_rows", "non_null_count", "cardinality_est")
    rows, nn, dist = F.col("profiled_rows"), F.col("non_null_count"), F.col("cardinality_est")
    uniq = F.coalesce(ratio(dist, rows), F.lit(0.0))
    data_hint = (
        F.when((uniq > HIGH_UNIQUENESS_RATIO) & (nn == rows), F.lit(HIGH_UNIQUENESS))
        .when((dist < LOW_CARDINALITY_MAX_DISTINCT) & (ratio(dist, nn) < LOW_CARDINALITY_MAX_RATIO),
              F.lit(LOW_CARDINALITY))
    )
    heur = F.concat(_name_hints(F.col("column")), F.filter(F.array(data_hint), lambda x: x.isNotNull()))
    return (
        matched.join(p, keys)
        .where(nn > 0)
        .select(
            *keys,
            F.coalesce(F.col("patterns"), F.array().cast("array<string>")).alias("patterns"),
            heur.alias("heuristics"),
            uniq.alias("uniqueness_score"),
        )
        .where((F.size("patterns") > 0) | (F.size("heuristics") > 0))
    )
