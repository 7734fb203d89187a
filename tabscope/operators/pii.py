"""Personal-data detection on string columns.

``pii_scores``: one row per (string column, PII type) with the share of
non-null values that contain a match.  ``pii_findings``: per column the best
type above the threshold (ties go to the earlier type), otherwise the
person-name rule on the column name; only columns judged personal are kept.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ratio0, sql_credit_card, sql_id, sql_matches
from ..functions.families import ColumnSpec, column_specs
from ..functions.patterns_fixed import (
    NEEDS, PERSON_NAME_CONFIDENCE, PERSON_NAME_REGEX, PERSON_NAME_TYPE, PII_MIN_CONFIDENCE, PII_PATTERNS,
)
from ..options import ProfileOptions
from .scan import ROWS, FusedScan, Ref

PII_LONG = (
    "source_table string, ordinal int, column string, pii_type string, priority int, "
    "non_null_count bigint, match_count bigint, profiled_rows bigint"
)
CREDIT_CARD = "CREDIT_CARD"


def pii_types(opts: ProfileOptions) -> list[str]:
    names = [n for n, _ in PII_PATTERNS]
    return names + [CREDIT_CARD] if opts.credit_card else names


def add_pii_aggs(scan: FusedScan, opts: ProfileOptions) -> None:
    for s in scan.specs:
        if not s.is_string:
            continue
        q = sql_id(s.name)
        scan.add(s, "nn", f"count({q})")
        for j, (_, pattern) in enumerate(PII_PATTERNS):
            scan.add(s, f"pii{j}", f"count_if({sql_matches(q, pattern, NEEDS.get(pattern, ''))})")
        if opts.credit_card:
            scan.add(s, "piicc", f"count_if(coalesce({sql_credit_card(q)}, false))")


def pii_rows(opts: ProfileOptions, source_table: str):
    """Long-form rows of a string column; none of others."""
    keys = [f"pii{j}" for j in range(len(PII_PATTERNS))] + (["piicc"] if opts.credit_card else [])

    def build(s: ColumnSpec) -> list[tuple]:
        return [(source_table, s.ordinal, s.name, name, j, Ref("nn", s), Ref(key, s), Ref(ROWS))
                for j, (name, key) in enumerate(zip(pii_types(opts), keys)) if s.is_string]

    return build


def pii_scores_of(long: DataFrame) -> DataFrame:
    """Scores from the long form, of any number of tables."""
    return long.where(F.col("profiled_rows") > 0).select(
        "source_table", "ordinal", "column", "pii_type", "priority", "non_null_count", "match_count",
        ratio0(F.col("match_count"), F.col("non_null_count")).alias("confidence"),
    )


def pii_scores_from(scan: FusedScan, opts: ProfileOptions, source_table: str, specs: list[ColumnSpec]) -> DataFrame:
    return pii_scores_of(scan.long(specs, pii_rows(opts, source_table), PII_LONG))


def pii_scores(df: DataFrame, opts: ProfileOptions | None = None, source_table: str = "table") -> DataFrame:
    """(source_table, ordinal, column, pii_type, priority, non_null_count, match_count, confidence); lazy, one scan."""
    opts = opts or ProfileOptions()
    scan = FusedScan(df, column_specs(df.schema, opts.extended_types))
    add_pii_aggs(scan, opts)
    return pii_scores_from(scan, opts, source_table, scan.specs)


def pii_findings(scores: DataFrame) -> DataFrame:
    """(source_table, ordinal, column, is_pii, pii_type, confidence) for personal columns.

    One grouping over the scores: ``max_by`` keeps the type with the highest
    confidence above the threshold, ties to the lower priority (earlier type)."""
    keys = ["source_table", "ordinal", "column"]
    above = F.col("confidence") > PII_MIN_CONFIDENCE
    order = F.when(above, F.struct(F.col("confidence"), (-F.col("priority")).alias("p")))
    best = scores.groupBy(*keys).agg(
        F.max_by(F.struct("pii_type", "confidence"), order).alias("_best"))
    by_name = F.lower(F.col("column")).rlike(PERSON_NAME_REGEX)
    found = F.col("_best").isNotNull()
    return best.select(
        *keys,
        (found | by_name).alias("is_pii"),
        F.when(found, F.col("_best.pii_type")).when(by_name, F.lit(PERSON_NAME_TYPE)).alias("pii_type"),
        F.when(found, F.col("_best.confidence")).when(by_name, F.lit(PERSON_NAME_CONFIDENCE)).alias("confidence"),
    ).where("is_pii")
