"""Which columns deserve a look: interest score, rank and the top-columns mark."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns_fixed import (
    INTERESTING_NULL_PCT, SCORE_OUTLIER, SCORE_PATTERN, SCORE_PII, SCORE_PK, TABLE_ORDER_UP_TO, TOP_COLUMNS,
)

_KEYS = ["source_table", "ordinal", "column"]


def _flag(df: DataFrame, name: str) -> DataFrame:
    return df.select(*_KEYS).distinct().withColumn(name, F.lit(True))


def column_scores(profile: DataFrame, pii_findings: DataFrame, pattern_findings: DataFrame) -> DataFrame:
    """Per column: flags, interest score and whether the column is interesting."""
    j = (
        profile.select(*_KEYS, "null_pct", "has_outliers", "is_pk_candidate")
        .join(_flag(pii_findings, "is_pii"), _KEYS, "left")
        .join(_flag(pattern_findings, "has_pattern"), _KEYS, "left")
    )
    pii = F.coalesce(F.col("is_pii"), F.lit(False))
    pat = F.coalesce(F.col("has_pattern"), F.lit(False))
    pk = F.col("is_pk_candidate")
    outl = F.col("has_outliers")
    nullp = F.coalesce(F.col("null_pct"), F.lit(0.0))
    w = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    score = w(pii, SCORE_PII) + w(pk, SCORE_PK) + w(pat, SCORE_PATTERN) + nullp + w(outl, SCORE_OUTLIER)
    return j.select(
        *_KEYS,
        pii.alias("is_pii"), pk.alias("is_pk_candidate"), pat.alias("has_pattern"),
        nullp.alias("null_pct"), outl.alias("has_outliers"),
        score.alias("score"),
        (pii | pat | pk | (nullp >= INTERESTING_NULL_PCT) | outl).alias("interesting"),
    )


def top_columns(scores: DataFrame, table_order_up_to: int = TABLE_ORDER_UP_TO, top: int = TOP_COLUMNS) -> DataFrame:
    """Every column with ``rank`` and ``in_top``.  Tables of up to ``table_order_up_to`` columns rank them in table
    order, all in the top; wider ones rank interesting columns first, then by score, ties in table order, and the
    first ``top`` are marked."""
    per_table = Window.partitionBy("source_table")
    by_score = per_table.orderBy(F.desc("interesting"), F.desc("score"), F.asc("ordinal"))
    narrow = F.count("*").over(per_table) <= table_order_up_to
    ranked = scores.select("*", narrow.alias("_narrow"), F.row_number().over(per_table.orderBy("ordinal")).alias("_nth"),
                           F.row_number().over(by_score).alias("_best"))
    ranked = ranked.withColumn("rank", F.when(F.col("_narrow"), F.col("_nth")).otherwise(F.col("_best")))
    return ranked.withColumn("in_top", F.col("_narrow") | (F.col("rank") <= top)).drop("_narrow", "_nth", "_best")
