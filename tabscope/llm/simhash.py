"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit position ``i`` has a nonzero vector ``m(i)`` over GF(2) of ``radius + 1``
coordinates; table ``v`` (every nonzero vector) keys a fingerprint by its bits with
``<m(i), v> = 1``.  At most ``radius`` differing positions give at most ``radius``
equations, which some nonzero ``v`` solves: in that table the pair has one key, so no
pair within the radius is lost.

Equal fingerprints are collapsed first.  Buckets of up to ``pair_limit`` distinct
fingerprints are compared pair by pair.  In larger ones, which may hold any share of
the rows, every fingerprint goes to the points at up to ``radius / 2`` flips of its
free bits; those that meet in a point are within the radius of each other and are
linked to the least of them, so no pairs are made and no bucket is gathered.

Edge cases: null and empty texts and texts of white space have fingerprint zero and
are linked like others; fewer words than a shingle are one shingle; repeated rows get
one fingerprint; null ids get a component like others but never name one (a
component of null ids only is named null); an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import fresh, signed, text_bytes, text_or_empty, written

BITS = 64


def masks(radius: int) -> list[int]:
    """The bits that each table's key takes, as unsigned numbers."""
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(BITS) if ((i % vectors + 1) & v).bit_count() & 1) for v in range(1, vectors + 1)]


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all ``words``-word shingles (A-Z lower-cased)."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined, n = b" ".join(parts), min(words, len(parts))
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(parts) - n + 1].tolist()
    stops = ends[n - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for k in range(0, len(starts), 1 << 15):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[k:k + (1 << 15)], stops[k:k + (1 << 15)])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, text_hash: bool = False) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long), one row per document; with ``text_hash`` also h, a hash of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [signed(fingerprint(t, words, seed)) for t in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])

    kind, text = docs.schema["doc_id"].dataType.simpleString(), text_or_empty()
    also = [F.xxhash64(text).alias("h")] if text_hash else []
    return docs.select("doc_id", text.alias("text"), *also).mapInArrow(run, f"doc_id {kind}, fp long" + ", h long" * text_hash)


def links(distinct: DataFrame, radius: int = 2, pair_limit: int = 16) -> DataFrame:
    """``distinct``: a column fp without repeats.  Edges (a, b) that connect exactly what pairs
    of at most ``radius`` differing bits connect."""
    if radius not in (0, 1, 2):
        raise ValueError("the radius is 0, 1 or 2")
    tables = masks(radius)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in tables])).alias("t", "key"))
    full = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(keyed.join(full, ["t", "key"]))
    pairs = (members.where(F.col("n") <= pair_limit).groupBy("t", "key").agg(F.collect_list("fp").alias("l"))
             .select(F.explode(F.expr(f"flatten(transform(l, a -> transform(filter(l, b -> b < a AND bit_count(a ^ b) <= {radius}), "
                                      "b -> named_struct('a', a, 'b', b))))")).alias("p")).select("p.a", "p.b"))
    hot = members.where(F.col("n") > pair_limit)
    free = F.element_at(F.array(*[F.array(*[F.lit(signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in tables]), F.col("t") + 1)
    points = hot.select("t", "fp", F.explode(F.concat(F.array("fp"), F.transform(free, lambda bit: F.col("fp").bitwiseXOR(bit)))).alias("z"))
    if radius == 2:
        hub = points.groupBy("t", "z").agg(F.min("fp").alias("m"), F.count("*").alias("k")).where("k > 1")
        stars = points.join(hub, ["t", "z"]).select(F.col("fp").alias("a"), F.col("m").alias("b")).where("a != b")
    else:  # the neighbours of a point may be two flips apart, so only points that are fingerprints link
        z = distinct.select(F.col("fp").alias("z"))
        stars = points.join(z, "z", "left_semi").select(F.col("fp").alias("a"), F.col("z").alias("b")).where(f"a != b AND {radius} = 1")
    return pairs.union(stars)


def _components(fps: DataFrame, radius: int, pair_limit: int) -> DataFrame:
    """Rows of fp, component_id (the smallest doc_id that chains of links reach) and label (one fingerprint of the component)."""
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    labels = components(links(distinct.select("fp"), radius, pair_limit))
    named = distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return named.join(least, "label").select("fp", "component_id", "label")


def simhash_groups(docs: DataFrame, words: int = 3, radius: int = 2, seed: int = 42, pair_limit: int = 16) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that
    chains of links of at most ``radius`` differing bits reach)."""
    fps = written(fingerprints(docs, words, seed))
    by_fp = _components(fps, radius, pair_limit).drop("label")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, words: int = 3, radius: int = 2, seed: int = 42, pair_limit: int = 16) -> DataFrame:
    """``docs`` without the near-duplicates: of each component one row stays, whole, that with the smallest doc_id (null last)
    and, of several rows with that id, the smallest fingerprint and text hash.  Rows whose id and text are equal are
    one, and any of them stays; rows of one id with unrelated texts are in different components and stay both."""
    fps = written(fingerprints(docs, words, seed, text_hash=True))
    rows = fps.join(_components(fps, radius, pair_limit).drop("component_id"), "fp")
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp", "h")).alias("x"))
    stay = first.select(F.col("x.doc_id").alias("_id"), F.col("x.h").alias("_h"))
    id_name, h_name = fresh(docs, "_id_of"), fresh(docs, "_text_hash")
    marked = docs.withColumns({id_name: F.col("doc_id"), h_name: F.xxhash64(text_or_empty())})
    kept = marked.join(stay, marked[id_name].eqNullSafe(stay["_id"]) & (marked[h_name] == stay["_h"]), "left_semi")
    return kept.dropDuplicates([id_name, h_name]).drop(id_name, h_name)
