"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key ``-ln(u) / w``: ``u`` from a hash of its
id and text, ``w`` its quality weight.  Within a source the documents are sorted by key
and their sizes prefix-summed; those before the source's budget are taken.  A
target of more than the source takes complete epochs first and only the rest by
key.

The prefix sum has levels, so no task holds a source: keys fall into about
``n / bucket_rows`` buckets of their source, the sums of buckets and of blocks of
1000 buckets give each bucket's offset, and only a bucket's rows are sorted together.

Edge cases: null text has size 0; a null source is a source of its own, last in
order; rows with equal ids, null ones too, are separate documents with keys of their own unless
their texts are equal as well; an empty table gives no rows; sources of size 0 get target 0; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACES, text_or_empty, written

#: Characters that quality_weight() counts against a document.
MARKUP = "#*$%&|<>{}[]=_~^\\"
#: Distinct words that a text of ``n`` words has for each square root of ``n``, at least, if it doesn't repeat itself.
VOCABULARY = 4.0


def quality_weight(text: Column, words: Column) -> Column:
    """1 to 4 (prose), from counts of a text and the array of its words: the product of the squared share of characters that aren't markup,
    the share of lines that differ, and how far its distinct words come up to ``VOCABULARY``."""
    joined = F.array_join(words, "")
    n = F.length(joined)
    clean = n - F.regexp_count(joined, F.lit("[" + "".join("\\" + c for c in MARKUP) + "]"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit(SPACES)) != "")
    differ = F.size(F.array_distinct(lines)) / F.size(lines)
    rich = F.least(F.lit(1.0), F.size(F.array_distinct(words)) / (VOCABULARY * F.sqrt(F.size(words))))
    return F.when(n > 0, 1 + 3 * (F.pow(clean / n, F.lit(2.0)) * differ * rich)).otherwise(F.lit(1.0))


def source_targets(sizes: DataFrame, share: float, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """``sizes``: (source, source_size, ...), one row per source.  Adds ``target``.

    ``least(w * x, cap)`` with the ``x`` that spends ``share`` of all sizes: with the
    sources by rising cap / weight, it is the largest of (budget - caps before) /
    (weights from here on).  The windows see one row per source."""
    nth = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    by_name = sizes.select("*", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(nth, F.lit(len(weights)))).alias("w"),
                           (F.lit(float(max_epochs)) * F.col("source_size")).alias("cap"))
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    whole = Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing))
    steps = by_name.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(whole))
    steps = steps.withColumn("x", (F.col("budget") - before) / rest)
    return steps.withColumn("target", F.least(F.col("w") * F.max("x").over(whole), "cap")).drop("w", "cap", "budget", "x")


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 2,
        quality: Column | None = None, bucket_rows: int = 500, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs, taken, and the columns ``keep`` of ``docs``.

    ``taken`` is the number of words that the mix takes of the document, repeats
    counted: ``epochs`` whole copies and, by key order, the rest of the target; the
    last document of a source is taken only up to the target.  ``quality``: weights
    from 1 to 4 (others are clipped), by default :func:`quality_weight` of the text."""
    text, kept = text_or_empty(), [f"_kept{i}" for i in range(len(keep))]
    read = docs.select("doc_id", "source", text.alias("_text"), F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("_words"),
                       *[] if quality is None else [quality.alias("_quality")], *[F.col(c).alias(k) for c, k in zip(keep, kept)])
    own = quality_weight(F.col("_text"), F.col("_words")) if quality is None else F.col("_quality")
    w = F.least(F.lit(4.0), F.greatest(F.lit(1.0), own))
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "_text", F.lit(seed)), 11) + 0.5) / float(1 << 53)
    rows = written(read.select("doc_id", "source", F.size("_words").cast("long").alias("size"), (-F.log(u) / w).alias("key"), *kept))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    words = F.floor(F.col("target") + 0.5)
    plan = (source_targets(sizes, share, weights, max_epochs)
            .withColumn("buckets", F.ceil(F.col("n") / bucket_rows))
            .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)))
            .withColumn("rest", words - F.col("epochs") * F.col("source_size")).drop("n"))
    plan = written(plan.withColumnRenamed("source", "s"))
    placed = rows.join(plan, rows.source.eqNullSafe(plan.s)).drop("s")
    placed = placed.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets")))
    sums = written(placed.groupBy(F.col("source").alias("s"), F.col("bucket").alias("b")).agg(F.sum("size").alias("in_bucket"))
                   .withColumn("block", F.floor(F.col("b") / 1000)))
    before_rows = lambda *by: Window.partitionBy("s", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.groupBy(F.col("s").alias("bs"), "block").agg(F.sum("in_bucket").alias("in_block")).withColumnRenamed("bs", "s")
    blocks = blocks.select(F.col("s").alias("bs"), F.col("block").alias("bb"), F.coalesce(F.sum("in_block").over(before_rows("block")), F.lit(0)).alias("past"))
    inside = sums.withColumn("inside", F.coalesce(F.sum("in_bucket").over(before_rows("block", "b")), F.lit(0)))
    offsets = (inside.join(blocks, F.col("s").eqNullSafe(F.col("bs")) & (F.col("block") == F.col("bb")))
               .select("s", "b", (F.col("past") + F.col("inside")).alias("offset")))
    in_bucket = (Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")
                 .rowsBetween(Window.unboundedPreceding, -1))
    before = F.col("offset") + F.coalesce(F.sum("size").over(in_bucket), F.lit(0))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - before))
    ordered = placed.join(offsets, placed.source.eqNullSafe(offsets.s) & (placed.bucket == offsets.b)).drop("s", "b")
    return ordered.select("doc_id", "source", "size", "source_size", "target", F.col("epochs").cast("long").alias("epochs"),
                          (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), *[F.col(f"_kept{i}").alias(c) for i, c in enumerate(keep)])
