"""tabscope - profile unknown tables with Spark.

Every operator is a function from DataFrames to DataFrames built from
built-in Spark expressions; see README for the operator list.
"""
from .options import ProfileOptions
from .functions.families import column_specs, type_family
from .functions.names import DEFAULT_NAME_RULE, STAR_NAME_RULE, NameRule
from .operators.stats import column_profile, column_schema, column_stats, exact_distinct
from .operators.pii import pii_findings, pii_scores
from .operators.patterns import pattern_findings, pattern_scores, patterns_from
from .operators.relations import candidate_pairs, containment, fk_hints, semi_containment
from .operators.summary import column_scores, top_columns
from .operators.interpret import interpretation
from .plans.profile import (
    BatchProfile, TableProfile, batch_summary, build_report, profile_sources, profile_table, profile_tables,
    summarize,
)
from .sources.spec import SourceSpec
from .sources.readers import catalog_tables, discover_siblings, read_source
from .sources.store import get_report, load_reports, read_reports, report_by_id, write_reports

__all__ = [n for n in dir() if not n.startswith("_")]
