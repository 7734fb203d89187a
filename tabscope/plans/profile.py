"""Whole-table and batch profiling.

Per table the work is the first pass (the fused aggregate of all operators: one scan,
one row comes back) and the second (outliers and exact distinct counts of key
candidates).  Foreign keys of all tables of a batch are found together.  The reports are
built from one-row relations, lazily, and all rows of every table are profiled.

Failures stay where they happen.  If the first pass fails, the (column, operator) pairs are tested in groups: halves of a
failing group, down to the pairs that fail alone, which are missing then, with an entry in ``errors``.  So f failures among
n pairs cost about 2 f log2(n) scans, and every scan that succeeds is kept.  A table that can't be read at all still has a
report, and foreign keys are searched among the other tables and columns.

What the passes fetch stays as plain rows; a batch's long forms are one local relation a kind, whatever the number of tables.
"""
from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.families import ColumnSpec, column_specs
from ..functions.frames import local_rows
from ..functions.patterns_fixed import DEFAULT_SOURCE_SYSTEM, REPORT_SCHEMA_VERSION
from ..operators import interpret, patterns, pii, relations, stats, summary
from ..operators.scan import FusedScan
from ..options import ProfileOptions
from ..sources.readers import CORRUPT_RECORD, catalog_siblings, discover_siblings, read_source
from ..sources.spec import SourceSpec

_META = (
    "report_id string, source_table string, source_system string, display_name string, "
    "profiled_at_us bigint, row_count bigint, errors array<string>"
)
_TOOLS = (("statistics", stats.add_stats_aggs), ("personal data", pii.add_pii_aggs), ("patterns", patterns.add_pattern_aggs))
#: Schema of a kind's long form, and how its columns are derived.
_KINDS = {
    "profile": (stats.STATS_LONG, lambda long, opts: stats.profile_of(long, opts)),
    "pii_scores": (pii.PII_LONG, lambda long, opts: pii.pii_scores_of(long)),
    "pattern_scores": (patterns.PATTERN_LONG, lambda long, opts: patterns.pattern_scores_of(long)),
}
_Item = tuple[str, ColumnSpec]


@dataclass
class TableProfile:
    """The results of one table as long-form rows; each frame reads a local relation, not the table."""

    spark: SparkSession
    opts: ProfileOptions
    source_table: str
    display_name: str
    source_system: str
    row_count: int | None
    rows: dict[str, list[tuple]] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)
    timings: dict[str, float] = field(default_factory=dict)
    report_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    profiled_at_us: int = field(default_factory=lambda: time.time_ns() // 1000)

    @property
    def profile(self) -> DataFrame:
        return _long(self.spark, [self], "profile", self.opts)

    @property
    def pii_scores(self) -> DataFrame:
        return _long(self.spark, [self], "pii_scores", self.opts)

    @property
    def pattern_scores(self) -> DataFrame:
        return _long(self.spark, [self], "pattern_scores", self.opts)

    @property
    def pii_findings(self) -> DataFrame:
        return pii.pii_findings(self.pii_scores)

    @property
    def pattern_findings(self) -> DataFrame:
        return patterns.pattern_findings(self.pattern_scores, self.profile)


def _long(spark: SparkSession, tables: list[TableProfile], kind: str, opts: ProfileOptions) -> DataFrame:
    schema, derive = _KINDS[kind]
    return derive(local_rows(spark, [r for t in tables for r in t.rows.get(kind, [])], schema), opts)


def _said(e: Exception) -> str:
    return next((x for x in str(e).splitlines() if x.strip()), type(e).__name__)


def _scan_of(df: DataFrame, opts: ProfileOptions, items: list[_Item]) -> FusedScan:
    scan = FusedScan(df, [])
    for tool, add in _TOOLS:
        scan.specs = [s for t, s in items if t == tool]
        add(scan, opts)
    return scan


def failing_items(run: Callable[[list], object], items: list, why: Exception) -> tuple[list, list[tuple[object, Exception]]]:
    """Group testing: ``items`` together failed with ``why``.  The results of ``run`` over groups that succeed, which
    cover all items but those that fail alone; these, with their exceptions."""
    if len(items) == 1:
        return [], [(items[0], why)]
    half = len(items) // 2
    left, right = items[:half], items[half:]
    try:
        good, bad = [run(left)], []
    except Exception as e:  # noqa: BLE001 - searched further
        good, bad = failing_items(run, left, e)
        try:
            return [*good, run(right)], bad
        except Exception as f:  # noqa: BLE001
            why = f
    # either the left half is sound, so that the failure is in the right one, or the right half has just failed too
    more_good, more_bad = failing_items(run, right, why)
    return good + more_good, bad + more_bad


def _first_pass(df: DataFrame, opts: ProfileOptions, errors: list[str]) -> tuple[FusedScan, dict[str, list[ColumnSpec]]]:
    """The scan with its row, and the columns that each operator got through."""
    specs = [s for s in column_specs(df.schema, opts.extended_types) if s.name != CORRUPT_RECORD]
    items = [(tool, s) for s in specs for tool, _ in _TOOLS if not _scan_of(df, opts, [(tool, s)]).is_empty]
    scan = _scan_of(df, opts, items)
    scan.specs = specs
    failed: set[_Item] = set()
    if CORRUPT_RECORD in df.columns:
        scan.count_corrupt(CORRUPT_RECORD)
    try:
        scan.collect()
    except Exception as e:  # noqa: BLE001 - find out below which column or operator it was
        rows = FusedScan(df, []).collect()  # if the rows alone fail too, the table can't be read
        parts, bad = failing_items(lambda own: _scan_of(df, opts, own).collect(), items, e) if items else ([], [])
        scan.adopt([rows, *parts])
        errors += [f"{tool} of column {s.name}: {_said(x)}" for (tool, s), x in bad]
        failed = {item for item, _ in bad}
    if scan.corrupt:
        errors.append(f"{scan.corrupt} rows don't fit the declared schema")
    return scan, {tool: [s for s in specs if (tool, s) not in failed] for tool, _ in _TOOLS}


def _unread(spark: SparkSession, opts: ProfileOptions, table: str, display_name: str | None, source_system: str, errors: list[str]) -> TableProfile:
    return TableProfile(spark, opts, table, display_name or table, source_system, None, errors=errors)


def profile_table(df: DataFrame, table: str, opts: ProfileOptions | None = None, display_name: str | None = None,
                  source_system: str = DEFAULT_SOURCE_SYSTEM) -> TableProfile:
    """Profile one table, over all its rows; what fails is in ``errors``."""
    opts = opts or ProfileOptions()
    errors: list[str] = []
    began = time.perf_counter()
    try:
        scan, done = _first_pass(df, opts, errors)
    except Exception as e:  # noqa: BLE001 - recorded
        return _unread(df.sparkSession, opts, table, display_name, source_system, [*errors, f"reading {table}: {_said(e)}"])
    first = time.perf_counter()
    try:
        stats.second_pass(scan, opts, done["statistics"])
    except Exception as e:  # noqa: BLE001 - recorded; the first pass stands
        errors.append(f"second pass: {_said(e)}")
    timings = {"pass1": round(first - began, 3), "pass2": round(time.perf_counter() - first, 3)}
    rows = {
        "profile": scan.rows_of(done["statistics"], stats.stats_rows(table)),
        "pii_scores": scan.rows_of(done["personal data"], pii.pii_rows(opts, table)),
        "pattern_scores": scan.rows_of(done["patterns"], patterns.pattern_rows(opts, table)),
    }
    return TableProfile(df.sparkSession, opts, table, display_name or table, source_system, scan.rows, rows, errors, timings)


@dataclass
class BatchProfile:
    """The profiles of many tables; the frames of all tables are one local relation a kind."""

    tables: list[TableProfile]
    fk: DataFrame
    report: DataFrame
    opts: ProfileOptions

    def union(self, kind: str) -> DataFrame:
        """``profile``, ``pii_scores`` or ``pattern_scores`` of all tables."""
        return _long(self.fk.sparkSession, self.tables, kind, self.opts)


def build_report(meta: DataFrame, profile: DataFrame, pii_findings: DataFrame,
                 pattern_findings: DataFrame, fk: DataFrame, names: dict[str, str]) -> DataFrame:
    """One nested report row per table, by one grouping per table of inputs that hold a row per column,
    finding or key pair.  Lazy."""
    keys = ["source_table", "ordinal", "column"]
    pi = pii_findings.select(*keys, F.struct("ordinal", "column", "is_pii", "pii_type", "confidence").alias("_pi"))
    pt = pattern_findings.select(*keys, F.struct("ordinal", "column", "patterns", "heuristics",
                                                 "uniqueness_score").alias("_pt"))
    per_col = interpret.with_dq_flags(profile.join(pi, keys, "left").join(pt, keys, "left"))
    grouped = per_col.groupBy("source_table").agg(
        F.array_sort(F.collect_list(F.struct(
            "ordinal", F.col("column").alias("name"), "spark_type", "nullable", "is_pk_candidate",
            "uniqueness_ratio"))).alias("columns"),
        F.array_sort(F.collect_list(F.struct(
            "ordinal", "column", "null_pct", "cardinality_est", "min_num", "max_num", "min_str", "max_str",
            "mean_val", "stddev_val", "q1", "q3", "outlier_count", "has_outliers"))).alias("stats"),
        F.array_sort(F.collect_list("_pi")).alias("pii_info"),
        F.array_sort(F.collect_list("_pt")).alias("detected_patterns"),
        *interpret.interpretation_aggs(),
    )
    fh = fk.groupBy("source_table").agg(F.array_sort(F.collect_list(F.struct(
        "source_col", "target_table", "target_col", "match_ratio"))).alias("fk_hints"))
    named = meta.join(interpret.entity_names(meta.sparkSession, names), "source_table", "left")
    j = named.join(grouped, "source_table", "left").join(fh, "source_table", "left")

    def arr(c):
        return F.coalesce(F.col(c), F.array().cast(j.schema[c].dataType))

    return j.select(
        "report_id", "source_table", "source_system", F.timestamp_micros("profiled_at_us").alias("profiled_at"), "row_count",
        arr("columns").alias("columns"), arr("stats").alias("stats"), arr("pii_info").alias("pii_info"),
        arr("detected_patterns").alias("detected_patterns"), arr("fk_hints").alias("fk_hints"),
        interpret.interpretation_struct().alias("interpretation"),
        "errors", F.lit(REPORT_SCHEMA_VERSION).alias("schema_version"),
    )


def _readable_keys(df: DataFrame, keys: list, said: list[str]) -> dict:
    """Sketches of a table's key columns; of those that can't be read, the reasons go to ``said``."""
    try:
        return relations.key_sketches(df, keys)
    except Exception as e:  # noqa: BLE001 - find the column
        parts, bad = failing_items(lambda own: relations.key_sketches(df, own), keys, e)
        said += dict.fromkeys(f"foreign keys: column {a.spec.name}: {_said(x)}" for (a, _), x in bad)
        return {k: v for part in parts for k, v in part.items()}


def _foreign_keys(frames: dict[str, DataFrame], sources: list[str], rule, opts: ProfileOptions, parallelism: int) -> tuple[DataFrame, dict[str, list[str]]]:
    """Hints among the key columns that can be read, and, by table, what was wrong with the others."""
    spark = next(iter(frames.values())).sparkSession
    none = local_rows(spark, [], relations.FK_SCHEMA).drop("is_hint")
    pairs = relations.candidate_pairs(frames, sources, rule, opts.extended_types)
    wrong: dict[str, list[str]] = {t: [] for t in frames}
    keys = relations.attributes(pairs)
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        found = pool.map(lambda t: _readable_keys(frames[t], keys[t], wrong[t]), keys)
    sketches = {k: v for part in found for k, v in part.items()}
    known = {a for a, _ in sketches}
    pairs = [p for p in pairs if known.issuperset(p)]
    pairs = relations.hopeful(spark, pairs, sketches) if pairs else []
    while pairs:
        try:
            hints = relations.containment(frames, pairs=pairs).where("is_hint").drop("is_hint")
            return local_rows(spark, [tuple(r) for r in hints.collect()], hints.schema), wrong
        except Exception as e:  # noqa: BLE001 - readable a moment ago: leave out the tables that no longer are
            lost = {t: said for t, own in relations.attributes(pairs).items() for said in [[]] if len(_readable_keys(frames[t], own, said)) < len(own)}
            for t in lost or relations.attributes(pairs):
                wrong[t] += lost.get(t) or [f"foreign keys: {_said(e)}"]
            pairs = [p for p in pairs if not {x.table for x in p} & set(lost)] if lost else []
    return none, wrong


def profile_tables(frames: dict[str, DataFrame], opts: ProfileOptions | None = None,
                   display_names: dict[str, str] | None = None,
                   source_systems: dict[str, str] | None = None,
                   fk_sources=None, fk_targets: dict[str, DataFrame] | None = None,
                   fk_rule="default", parallelism: int = 4, failed: dict[str, str] | None = None) -> BatchProfile:
    """Profile many tables.  Tables run concurrently from a bounded thread pool (each is its own
    Spark jobs).  Foreign keys of every table against every other (plus ``fk_targets``) are found
    together.  ``failed``: tables that couldn't be loaded, with the reason; they get reports too."""
    opts = opts or ProfileOptions()
    names, systems = display_names or {}, source_systems or {}
    spark = next((df.sparkSession for df in frames.values()), None) or SparkSession.active()

    def one(item):
        t, df = item
        return profile_table(df, t, opts, names.get(t), systems.get(t, DEFAULT_SOURCE_SYSTEM))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        tables = list(pool.map(one, frames.items()))
    tables += [_unread(spark, opts, t, names.get(t), systems.get(t, DEFAULT_SOURCE_SYSTEM), [f"reading {t}: {why}"]) for t, why in (failed or {}).items()]
    readable = {t: df for t, df in frames.items() if next(x for x in tables if x.source_table == t).row_count is not None}
    everything = {**{t: df for t, df in (fk_targets or {}).items() if t not in frames}, **readable}
    fk = local_rows(spark, [], relations.FK_SCHEMA).drop("is_hint")
    if everything:
        fk, wrong = _foreign_keys(everything, list(fk_sources if fk_sources is not None else readable), fk_rule, opts, parallelism)
        for t in tables:
            t.errors += wrong.get(t.source_table, [])
    return assembled(spark, tables, fk, opts)


def assembled(spark: SparkSession, tables: list[TableProfile], fk: DataFrame, opts: ProfileOptions) -> BatchProfile:
    """The batch's report from its tables' rows.  The plan doesn't grow with the tables."""
    meta = local_rows(spark, [(t.report_id, t.source_table, t.source_system, t.display_name, t.profiled_at_us, t.row_count, t.errors) for t in tables], _META)
    batch = BatchProfile(tables, fk, meta, opts)
    profile = batch.union("profile")
    batch.report = build_report(meta, profile, pii.pii_findings(batch.union("pii_scores")),
                                patterns.pattern_findings(batch.union("pattern_scores"), profile), fk, {t.source_table: t.display_name for t in tables})
    return batch


def _siblings(spark: SparkSession, specs: list[SourceSpec], known: set[str], data_root: str) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The other tables in the folders of typed sources and in the databases of catalog sources; what can't be read, with the reason."""
    folders = dict.fromkeys(f"{data_root.rstrip('/')}/{s.connection_type}" for s in specs if not s.path and s.connection_type in ("parquet", "delta"))
    databases = dict.fromkeys(s.database or spark.catalog.currentDatabase() for s in specs if not s.path and s.connection_type in ("catalog", "databricks"))
    targets: dict[str, DataFrame] = {}
    failed: dict[str, str] = {}
    places = [(f, lambda f=f: discover_siblings(spark, f, exclude=known, fmt=f.rsplit("/", 1)[1])) for f in folders]
    places += [(d, lambda d=d: catalog_siblings(spark, d, exclude=known)) for d in databases]
    for place, look in places:
        found, skipped = look()
        for own, into in ((found, targets), (skipped, failed)):
            into.update({t if t not in into else f"{place}.{t}": x for t, x in own.items()})
    return targets, failed


def profile_sources(spark: SparkSession, specs: Iterable[SourceSpec], opts: ProfileOptions | None = None, data_root: str = "data",
                    siblings: bool = True, **batch) -> BatchProfile:
    """Load and profile the tables that the specs name.  With ``siblings`` the other tables in the folder of a typed source,
    or in the database of a catalog source, serve as foreign-key targets.  A source that can't be read gets a report with the reason."""
    specs = list(specs)
    frames, failed, names, systems = {}, {}, {}, {}
    for s in specs:
        names[s.table], systems[s.table] = s.display_name, s.source_system
        try:
            frames[s.table] = read_source(spark, s, data_root)
            frames[s.table].schema  # noqa: B018 - an unreadable source fails here
        except Exception as e:  # noqa: BLE001 - recorded
            frames.pop(s.table, None)
            failed[s.table] = _said(e)
    targets: dict[str, DataFrame] = {}
    if siblings:
        targets, skipped = _siblings(spark, [s for s in specs if s.table in frames], {*frames, *failed}, data_root)
        failed = {**skipped, **failed}
    return profile_tables(frames, opts, names, systems, fk_targets=targets, failed=failed, **batch)


def batch_summary(reports: DataFrame) -> DataFrame:
    """Table, entity, rows and confidence per report."""
    return reports.select(
        "source_table",
        F.col("interpretation.suggested_entity_name").alias("entity"),
        "row_count",
        F.col("interpretation.confidence").alias("confidence"),
    )


def summarize(batch: BatchProfile) -> DataFrame:
    """Interest scores and ranks for every profiled table."""
    profile = batch.union("profile")
    scores = summary.column_scores(profile, pii.pii_findings(batch.union("pii_scores")),
                                   patterns.pattern_findings(batch.union("pattern_scores"), profile))
    return summary.top_columns(scores)
