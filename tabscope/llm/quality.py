"""Quality rules with adaptive thresholds, in DataFrame functions only.

One scan gives each text's counts; mergeable KLL sketches per language and source
give quantiles of four ratios; a document that the fixed base rules keep is kept
if every ratio is within its group's fences: ``spread`` times the distance from the median to the upper (lower)
tenth beyond that tenth, so they are as wide as the group's own rows spread.  What a text may hold by chance, two symbols, two
repeated lines or one repeated sentence, is left out of its ratios, and a fence has no other floor than a rounding margin.
A group of fewer than ``min_group`` documents takes the fences of its language, from the merged sketches of its
sources (or of all languages, if that too is small).

Edge cases: null and empty texts have no words and fail the base rule; null
languages and sources are groups of their own; repeated rows are separate
documents; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, text_or_empty, written

#: ratio: (numerator, how much of it is chance, denominator, rounding margin, also a lower fence)
RATIOS = {
    "symbols_per_word": ("n_symbols", 2, "n_words", 0.02, False),
    "dup_lines_per_line": ("n_dup_lines", 2, "n_lines", 0.02, False),
    "repeats_per_word": ("n_repeat_words", 40, "n_words", 0.02, False),
    "chars_per_word": ("word_chars", 0, "n_words", 0.1, True),
}
#: The quantiles from which the fences are drawn.
LOW, MIDDLE, HIGH = 0.1, 0.5, 0.9
_POS = (1 << 24) - 1


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _repeated_starts(w: str) -> Column:
    """Starts, in order, of the 3-word windows of the array ``w`` that occur twice or more.

    Hash and position share one long each, so the first sort is one of plain
    numbers; windows whose 40-bit hashes meet are compared by their words."""
    packed = f"transform(sequence(0, size({w}) - 3), i -> (xxhash64({w}[i], {w}[i + 1], {w}[i + 2]) & ~{_POS}L) | i)"
    met = f"(shiftright(x, 24) = shiftright(get(p, k - 1), 24) OR shiftright(x, 24) = shiftright(get(p, k + 1), 24))"
    maybe = f"flatten(transform(array(sort_array({packed})), p -> transform(filter(p, (x, k) -> {met}), x -> CAST(x & {_POS}L AS INT))))"
    every = f"sequence(0, size({w}) - 3)"
    words = f"named_struct('a', {w}[i], 'b', {w}[i + 1], 'c', {w}[i + 2], 'i', i)"
    same = "(x.a = get(q, k {0} 1).a AND x.b = get(q, k {0} 1).b AND x.c = get(q, k {0} 1).c)"
    starts = (f"sort_array(flatten(transform(array(sort_array(transform(if(size({w}) <= {_POS}, {maybe}, {every}), i -> {words}))), "
              f"q -> transform(filter(q, (x, k) -> {same.format('-')} OR {same.format('+')}), x -> x.i))))")
    return F.expr(f"if(size({w}) >= 3, {starts}, array())")


def text_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) of ``text``."""
    text = text_or_empty()
    base = docs.select(*keep, text.alias("_t"))
    lines = F.filter(F.split("_t", "\n"), lambda x: _without(x, SPACES) > 0)
    base = base.select(
        *keep, (_without(F.col("_t"), SPACES)).cast("long").alias("word_chars"),
        (F.length("_t") - _without(F.col("_t"), "#*$%&|<>")).cast("long").alias("n_symbols"),
        lines.alias("_lines"), F.array_remove(F.split("_t", r"[\x20\x09-\x0D]+"), "").alias("_w"))
    base = base.withColumn("_starts", _repeated_starts("_w"))
    covered = F.expr("aggregate(transform(_starts, (p, k) -> least(3, coalesce(get(_starts, k + 1) - p, 3))), 0L, (a, x) -> a + x)")
    return base.select(*keep, F.size("_w").cast("long").alias("n_words"), "word_chars", "n_symbols",
                       F.size("_lines").cast("long").alias("n_lines"),
                       (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                       covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratio(name: str) -> Column:
    """A ratio from the columns of :func:`text_counts`."""
    above, chance, below, _, _ = RATIOS[name]
    return F.greatest(F.col(above) - chance, F.lit(0)) / F.col(below)


def fences(counts: DataFrame, spread: float = 3.0, min_group: int = 50, k: int = 800) -> DataFrame:
    """One row per (lang, source): ``<ratio>_low`` and ``<ratio>_high``, from the quantiles of the
    group's documents that pass the base rules."""
    sketches = written(counts.where(~base_failed()).groupBy("lang", "source").agg(
        F.count("*").alias("n"), *[F.kll_sketch_agg_double(ratio(r), F.lit(k)).alias(r) for r in RATIOS]))
    merged = [F.kll_merge_agg_double(r).alias(r) for r in RATIOS]
    by_lang = sketches.groupBy(F.col("lang").alias("l")).agg(F.sum("n").alias("l_n"), *merged)
    by_lang = by_lang.select("l", "l_n", *[F.col(r).alias(f"l_{r}") for r in RATIOS])
    of_all = {r: sketches.agg(F.kll_merge_agg_double(r)).scalar() for r in RATIOS}
    groups = sketches.join(by_lang, F.col("lang").eqNullSafe(F.col("l")))
    out = [F.col("lang"), F.col("source")]
    for r, (_, _, _, margin, both) in RATIOS.items():
        s = F.when(F.col("n") >= min_group, F.col(r)).when(F.col("l_n") >= min_group, F.col(f"l_{r}")).otherwise(of_all[r])
        low, middle, high = (F.kll_sketch_get_quantile_double(s, F.lit(q)) for q in (LOW, MIDDLE, HIGH))
        least = low - spread * (middle - low) - margin if both else F.lit(None).cast("double")
        out += [least.alias(f"{r}_low"), (high + spread * (high - middle) + margin).alias(f"{r}_high")]
    return groups.select(*out)


def quality_rules(docs: DataFrame, spread: float = 3.0, min_group: int = 50, k: int = 800) -> DataFrame:
    """One row per document: doc_id, lang, source, the counts of :func:`text_counts`, base_failed and
    kept (the base rules and all fences)."""
    counts = written(text_counts(docs))
    limits = fences(counts, spread, min_group, k).withColumnsRenamed({"lang": "l", "source": "s"})
    joined = counts.join(limits, counts.lang.eqNullSafe(limits.l) & counts.source.eqNullSafe(limits.s), "left")
    ok = F.lit(True)
    for r in RATIOS:
        ok = ok & F.coalesce(ratio(r) <= F.col(f"{r}_high"), F.lit(True)) & F.coalesce(ratio(r) >= F.col(f"{r}_low"), F.lit(True))
    failed = base_failed()
    return joined.select(*counts.columns, failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(ok).alias("kept"))
