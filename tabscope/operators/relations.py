"""Foreign-key discovery by value containment, all candidate pairs at once.

1. Candidate pairs come from the schemas alone: key-like names, compatible type
   families (numeric/numeric or string/string) and similar names.  They are a
   DataFrame, not expressions, so the plan doesn't grow with them.
2. Each pair is compared in the narrowest class that is exact for both types: whole
   numbers as bigint, decimals (with decimals or whole numbers) as canonical text,
   floating numbers as double, strings as they are.  An attribute is read in each class that
   one of its pairs needs.
3. ``groupBy(value, attribute)`` counts how often each attribute holds each value; the
   partial aggregate before the shuffle collapses repeats, so a value that fills a third
   of a table costs one row per task.
4. ``groupBy(value)`` turns that into the set of attributes that hold the value, and
   ``groupBy(set)`` counts the sets, of which there are few.  Joined to the pairs, they give
   every pair's shared values.

No pair of rows is ever made; the work is one shuffle of distinct values per class.

Who only asks for hints needs no counts of hopeless pairs: a theta sketch of every attribute, from one scan
of the key columns without a shuffle, bounds each pair's containment, and the values of attributes without a
pair that may reach ``min_ratio`` are never shuffled.
This is the value-grouped form of inclusion-dependency discovery (Kruse,
Papenbrock, Naumann, BTW 2015).
"""
from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import ratio
from ..functions.families import ColumnSpec, column_specs, quote
from ..functions.frames import local_rows
from ..functions.names import NameRule, name_rule
from ..functions.patterns_fixed import FK_MIN_RATIO

FK_SCHEMA = (
    "source_table string, source_col string, target_table string, target_col string, "
    "match_count bigint, source_distinct bigint, target_distinct bigint, match_ratio double, "
    "target_is_unique boolean, is_hint boolean"
)


@dataclass(frozen=True)
class Attr:
    table: str
    spec: ColumnSpec

    @property
    def family(self) -> str | None:
        if self.spec.reference_numeric:
            return "numeric"
        if self.spec.is_string:
            return "string"
        return None


def comparison_class(a: ColumnSpec, b: ColumnSpec) -> str:
    """In which form values of the two types are equal exactly when they are the same number or text."""
    if a.is_string:
        return "text"
    if a.is_integral and b.is_integral:
        return "whole"
    floating = (T.FloatType, T.DoubleType)
    return "double" if isinstance(a.dtype, floating) or isinstance(b.dtype, floating) else "decimal"


def _key(spec: ColumnSpec, cls: str) -> Column:
    if cls == "whole":
        return spec.col.cast("bigint")
    if cls == "double":
        return spec.col.cast("double")
    text = spec.col.cast("string")
    if cls == "decimal" and isinstance(spec.dtype, T.DecimalType) and spec.dtype.scale > 0:
        text = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
        return F.when(text == "-0", "0").otherwise(text)
    return text


def candidate_pairs(frames: dict[str, DataFrame], sources=None, rule: "str | NameRule" = "default",
                    extended: bool = False) -> list[tuple[Attr, Attr]]:
    """Ordered (source, target) column pairs worth a containment check (schema only)."""
    r = name_rule(rule)
    keyed = {
        t: [Attr(t, s) for s in column_specs(df.schema, extended) if r.is_key_like(s.name)]
        for t, df in frames.items()
    }
    similar: dict[tuple[str, str], bool] = {}

    def alike(x: str, y: str) -> bool:
        if (x, y) not in similar:
            similar[x, y] = r.similar(x, y)
        return similar[x, y]

    return [(a, b) for st in (sources if sources is not None else frames) for a in keyed.get(st, []) if a.family
            for tt, attrs in keyed.items() if tt != st for b in attrs if a.family == b.family and alike(a.spec.name, b.spec.name)]


def _per_value(frames: dict[str, DataFrame], attrs: list[Attr], ids: dict[Attr, int], cls: str) -> DataFrame:
    """(v, a, n): how often attribute ``a`` holds value ``v``; each table is read once."""
    by_table: dict[str, list[Attr]] = {}
    for a in attrs:
        by_table.setdefault(a.table, []).append(a)
    parts = []
    for t, cols in by_table.items():
        cells = [F.struct(F.lit(ids[a]).alias("a"), _key(a.spec, cls).alias("v")) for a in cols]
        parts.append(frames[t].select(F.inline(F.array(*cells))).where(F.col("v").isNotNull()))
    return reduce(lambda x, y: x.unionByName(y), parts).groupBy("v", "a").agg(F.count("*").alias("n"))


#: Size of a sketch (powers of two), and how surely a dropped pair is hopeless: chance exp(-SURE) of an error.
SKETCH_LG_K, SURE = 12, 40.0
Sketches = dict[tuple[Attr, str], bytes]


def attributes(pairs: Iterable[tuple[Attr, Attr]]) -> dict[str, list[tuple[Attr, str]]]:
    """By table, the attributes of the pairs with the classes in which they are compared."""
    out: dict[str, list[tuple[Attr, str]]] = {}
    for x in dict.fromkeys((x, comparison_class(a.spec, b.spec)) for a, b in pairs for x in (a, b)):
        out.setdefault(x[0].table, []).append(x)
    return out


def key_sketches(df: DataFrame, keys: list[tuple[Attr, str]], lg_k: int = SKETCH_LG_K) -> Sketches:
    """A theta sketch of the distinct values of each attribute of one table: one scan, a row of bounded sketches."""
    if not keys:
        return {}
    row = df.select(*[F.theta_sketch_agg(_key(a.spec, cls), lg_k).alias(f"k{i}") for i, (a, cls) in enumerate(keys)]).first()
    return dict(zip(keys, map(bytes, row)))


def hopeful(spark, pairs: list[tuple[Attr, Attr]], sketches: Sketches, min_ratio: float = FK_MIN_RATIO, lg_k: int = SKETCH_LG_K) -> list[tuple[Attr, Attr]]:
    """The pairs whose containment may reach ``min_ratio``.

    The two sketches sample values by one hash up to the smaller of their thresholds, so the source's sampled values that are in the
    target are a random sample's hits.  A pair goes if Hoeffding's bound says that so few hits have a chance below exp(-SURE)."""
    ids = {x: i for i, x in enumerate(sketches)}
    own = local_rows(spark, [(i, sketches[x]) for x, i in ids.items()], "i int, s binary")
    asked = local_rows(spark, [(n, ids[a, c], ids[b, c]) for n, (a, b) in enumerate(pairs) for c in [comparison_class(a.spec, b.spec)]], "n int, a int, b int")
    both = asked.join(own.select(F.col("i").alias("a"), F.col("s").alias("x")), "a").join(own.select(F.col("i").alias("b"), F.col("s").alias("y")), "b")
    met, source, target = (F.theta_sketch_estimate(e) for e in (F.theta_intersection("x", "y"), F.col("x"), F.col("y")))
    missed = F.theta_sketch_estimate(F.theta_difference("x", "y"))
    share = F.coalesce(met / F.nullif(met + missed, F.lit(0).cast("bigint")), F.lit(0.0))
    sampled = 0.8 * source * F.least(F.lit(1.0), (1 << lg_k) / F.greatest(source, target, F.lit(1)))
    gap = F.lit(min_ratio) - share
    keep = both.where((source > 0) & ((gap <= 0) | (2 * sampled * gap * gap < SURE))).select("n").collect()
    return [pairs[r[0]] for r in sorted(keep)]


def containment(frames: dict[str, DataFrame], sources=None, rule: "str | NameRule" = "default",
                min_ratio: float = FK_MIN_RATIO, extended: bool = False, pairs: list[tuple[Attr, Attr]] | None = None) -> DataFrame:
    """Containment statistics for every candidate pair, or for ``pairs`` (see FK_SCHEMA); lazy."""
    spark = next(iter(frames.values())).sparkSession
    pairs = candidate_pairs(frames, sources, rule, extended) if pairs is None else pairs
    if not pairs:
        return local_rows(spark, [], FK_SCHEMA)
    by_class: dict[str, list[tuple[Attr, Attr]]] = {}
    for a, b in pairs:
        by_class.setdefault(comparison_class(a.spec, b.spec), []).append((a, b))
    results = []
    for cls, own in by_class.items():
        attrs = sorted({x for p in own for x in p}, key=lambda x: (x.table, x.spec.ordinal))
        ids = {a: i for i, a in enumerate(attrs)}
        counted = _per_value(frames, attrs, ids, cls)
        per_attr = counted.groupBy("a").agg(F.count("*").alias("distinct"), F.max("n").alias("most"))
        sets = counted.groupBy("v").agg(F.sort_array(F.collect_list("a")).alias("held")).groupBy("held").agg(F.count("*").alias("k"))
        wanted = local_rows(spark, [(ids[a], ids[b], a.table, a.spec.name, b.table, b.spec.name) for a, b in own],
                            "s int, t int, source_table string, source_col string, target_table string, target_col string")
        shared = (sets.where(F.size("held") > 1).select(F.explode("held").alias("s"), "held", "k")
                  .join(wanted.select("s", "t"), "s").where(F.array_contains("held", F.col("t")))
                  .groupBy("s", "t").agg(F.sum("k").alias("match_count")))
        source = per_attr.select(F.col("a").alias("s"), F.col("distinct").alias("source_distinct"))
        target = per_attr.select(F.col("a").alias("t"), F.col("distinct").alias("target_distinct"), F.col("most").alias("target_most"))
        results.append(wanted.join(shared, ["s", "t"], "left").join(source, "s", "left").join(target, "t", "left").select(
            "source_table", "source_col", "target_table", "target_col",
            *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("match_count", "source_distinct", "target_distinct")],
            F.coalesce(F.col("target_most") <= 1, F.lit(True)).alias("target_is_unique")))
    out = reduce(lambda x, y: x.unionByName(y), results)
    mr = ratio(F.col("match_count"), F.col("source_distinct"))
    return out.select(
        "source_table", "source_col", "target_table", "target_col", "match_count",
        "source_distinct", "target_distinct",
        F.coalesce(mr, F.lit(0.0)).alias("match_ratio"),
        "target_is_unique",
        F.coalesce((F.col("source_distinct") > 0) & (mr >= F.lit(min_ratio))
                   & (F.col("target_distinct") >= F.col("match_count")), F.lit(False)).alias("is_hint"),
    )


def fk_hints(frames: dict[str, DataFrame], sources=None, rule: "str | NameRule" = "default",
             min_ratio: float = FK_MIN_RATIO, extended: bool = False) -> DataFrame:
    """(source_table, source_col, target_table, target_col, match_count, source_distinct,
    target_distinct, match_ratio, target_is_unique) for likely foreign keys.  A scan of the key columns of each
    table runs at once; the rest, of the pairs that their sketches leave, is lazy."""
    pairs = candidate_pairs(frames, sources, rule, extended)
    sketches: Sketches = {}
    for t, keys in attributes(pairs).items():
        sketches |= key_sketches(frames[t], keys)
    if pairs:
        pairs = hopeful(next(iter(frames.values())).sparkSession, pairs, sketches, min_ratio)
    return containment(frames, min_ratio=min_ratio, pairs=pairs).where("is_hint").drop("is_hint")


def semi_containment(source: DataFrame, source_col: str, target: DataFrame, target_col: str) -> DataFrame:
    """Single pair: distinct source values found among distinct target values."""
    s = source.select(F.col(quote(source_col)).alias("k")).where(F.col("k").isNotNull()).distinct()
    t = target.select(F.col(quote(target_col)).alias("k")).where(F.col("k").isNotNull()).distinct()
    counts = s.join(t.withColumn("_hit", F.lit(True)), "k", "left").agg(
        F.count_if(F.col("_hit")).alias("match_count"), F.count(F.lit(1)).alias("source_distinct"))
    return counts.select(
        "match_count", "source_distinct",
        F.coalesce(ratio(F.col("match_count"), F.col("source_distinct")), F.lit(0.0)).alias("match_ratio"),
    )
