"""Deterministic interpretation of a profile (no model call).

Per table: a display name, the business-key candidates, a line for each column of
personal data and the data-quality flags, all complete and in table order (a reader
who wants the first few takes a slice).  The pieces are aggregate expressions over a
per-column frame so that a report needs a single grouping per table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import local_rows
from ..functions.names import entity_name
from ..functions.patterns_fixed import (
    BK_CONFIDENCE, BK_REASONING, DQ_NULL_PCT, DQ_NULL_TEXT, DQ_OUTLIER_TEXT, INTERPRETATION_CONFIDENCE, PII_TEXT,
)

BK_TYPE = "array<struct<column:string,confidence:double,reasoning:string>>"
_KEYS = ["source_table", "ordinal", "column"]


def with_dq_flags(per_col: DataFrame) -> DataFrame:
    """Add ``_dq``: the column's flags (high null rate, outliers)."""
    null_flag = F.when(F.col("null_pct") >= DQ_NULL_PCT,
                       F.format_string(DQ_NULL_TEXT, F.col("column"), F.bround(F.col("null_pct") * 100.0, 0)))
    out_flag = F.when(F.col("has_outliers"), F.format_string(DQ_OUTLIER_TEXT, F.col("column")))
    return per_col.withColumn("_dq", F.filter(F.array(null_flag, out_flag), lambda x: x.isNotNull()))


def interpretation_aggs() -> list[Column]:
    """Aggregates over the per-column frame (columns ``_pi`` and ``_dq`` included)."""
    item = F.struct("ordinal", "column")
    line = F.format_string(
        PII_TEXT, F.col("_pi.column"), F.coalesce(F.col("_pi.pii_type"), F.lit("PII")), F.bround(F.col("_pi.confidence"), 2),
    )
    return [
        F.array_sort(F.collect_list(F.when(F.col("is_pk_candidate"), item))).alias("_pk"),
        F.array_sort(F.collect_list(F.when(F.lower("column").contains("id"), item))).alias("_id"),
        F.array_sort(F.collect_list(F.when(F.col("_pi").isNotNull(), F.struct(
            F.col("ordinal"), line.alias("line"))))).alias("_pil"),
        F.array_sort(F.collect_list(F.when(F.col("_dq").isNotNull(), F.struct("ordinal", "_dq")))).alias("_dql"),
    ]


def entity_names(spark: SparkSession, names: dict[str, str] | None) -> DataFrame:
    """(source_table, entity): display names, computed on the driver from table names (metadata), a row per table."""
    return local_rows(spark, [(t, entity_name(shown)) for t, shown in (names or {}).items()], "source_table string, entity string")


def interpretation_struct() -> Column:
    """The interpretation from the columns of :func:`interpretation_aggs` and ``entity``."""
    chosen = F.when(F.size(F.coalesce("_pk", F.array())) > 0, F.col("_pk")).otherwise(F.col("_id"))
    bk = F.transform(
        chosen,
        lambda x: F.struct(x["column"].alias("column"), F.lit(BK_CONFIDENCE).alias("confidence"),
                           F.lit(BK_REASONING).alias("reasoning")),
    )
    pii = F.transform("_pil", lambda x: x["line"])
    dq = F.flatten(F.transform("_dql", lambda x: x["_dq"]))
    return F.struct(
        F.coalesce("entity", F.initcap(F.translate("source_table", "_", " "))).alias("suggested_entity_name"),
        F.coalesce(bk, F.array().cast(BK_TYPE)).alias("bk_candidates"),
        F.coalesce(pii, F.array().cast("array<string>")).alias("pii_summary"),
        F.coalesce(dq, F.array().cast("array<string>")).alias("dq_flags"),
        F.lit(INTERPRETATION_CONFIDENCE).alias("confidence"),
    )


def _pi_struct(pii_findings: DataFrame) -> DataFrame:
    return pii_findings.select(*_KEYS, F.struct("ordinal", "column", "is_pii", "pii_type", "confidence").alias("_pi"))


def bk_candidates(profile: DataFrame) -> DataFrame:
    """(source_table, bk_candidates): first key candidates, else first id-like columns."""
    g = profile.groupBy("source_table").agg(*interpretation_aggs()[:2])
    chosen = F.when(F.size("_pk") > 0, F.col("_pk")).otherwise(F.col("_id"))
    return g.select("source_table", F.transform(
        chosen,
        lambda x: F.struct(x["column"].alias("column"), F.lit(BK_CONFIDENCE).alias("confidence"),
                           F.lit(BK_REASONING).alias("reasoning")),
    ).alias("bk_candidates"))


def dq_flags(profile: DataFrame) -> DataFrame:
    """(source_table, dq_flags) for every profiled table."""
    g = with_dq_flags(profile).groupBy("source_table").agg(
        F.array_sort(F.collect_list(F.when(F.col("_dq").isNotNull(), F.struct("ordinal", "_dq")))).alias("_dql"))
    return g.select("source_table", F.flatten(F.transform("_dql", lambda x: x["_dq"])).alias("dq_flags"))


def interpretation(tables: DataFrame, profile: DataFrame, pii_findings: DataFrame,
                   display_names: dict[str, str] | None = None) -> DataFrame:
    """(source_table, interpretation struct) for every table in ``tables`` (source_table column)."""
    per_col = with_dq_flags(profile.join(_pi_struct(pii_findings), _KEYS, "left"))
    g = per_col.groupBy("source_table").agg(*interpretation_aggs())
    named = tables.select("source_table").join(entity_names(tables.sparkSession, display_names), "source_table", "left")
    return named.join(g, "source_table", "left").select("source_table", interpretation_struct().alias("interpretation"))
