"""Line de-duplication by range-partitioned hashes.

Every line of at least ``min_chars`` code points (its key: ASCII white space stripped,
A-Z lower-cased) gives a row of hash, document and position.  The rows are range
partitioned and sorted by (hash, document, position); one pass over each sorted
partition streams the first document of every run of equal hashes and marks the
lines of all later ones.  The range covers the document and the position too, so a
line that fills a third of the table spreads over many partitions; what a
partition can't know, whether its first run began before it, is settled with one
row per partition, the first document of its last run.

The result is a compressed bitmap per document that loses lines, not text:
:func:`keep_bitmaps`; :func:`apply_bitmaps` reads it.

Edge cases: null and empty texts are one empty line and lose nothing; rows that share a
doc_id are one document for counting and each lose the lines that it loses; rows
without a doc_id stay whole and count for nothing; ids are of any type that sorts and
keep it ("smallest" is Spark's order of that type); an empty table gives no rows; other columns pass :func:`dedup_lines` unchanged.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, map_whole_rows, text_bytes, text_or_empty, written

_SPACE = b" \t\n\x0b\x0c\r"


def _line_schema(docs: DataFrame) -> str:
    return f"h1 long, h2 long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, tag long, pos int, n_lines int"


def _ids(column: pa.Array) -> np.ndarray:
    """Whole numbers as they are, ids of any other type as Python values."""
    if pa.types.is_integer(column.type):
        return column.to_numpy()
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def line_key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


def _code_points(b: bytes) -> int:
    return len(b) if b.isascii() else len(b.decode("utf-8", "replace"))


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for every line with a key of ``min_chars`` or more: 128-bit hash, doc_id, a hash of the
    text (``tag``, which tells rows of one doc_id apart), position, number of lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            hashes, row, pos, count = [], [], [], []
            for i, t in enumerate(text_bytes(b.column(2))):
                lines = t.split(b"\n")
                for k, line in enumerate(lines):
                    key = line.strip(_SPACE)
                    if len(key) >= min_chars and _code_points(key) >= min_chars:
                        hashes.append(digest(key.lower()))
                        row.append(i)
                        pos.append(k)
                        count.append(len(lines))
            h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), b.column(0).take(at), b.column(1).take(at), pa.array(pos, pa.int32()), pa.array(count, pa.int32())],
                ["h1", "h2", "doc_id", "tag", "pos", "n_lines"])

    text = text_or_empty()
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64(text).alias("tag"), text.alias("text"))
    return rows.mapInArrow(run, _line_schema(docs))


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by (hash, document, position): the lines of a run's later documents
    (kind 0), those of the first document of the partition's first run (kind 1), and the first
    document of its last run (kind 2)."""
    run_hash, first, in_first_run, any_rows = None, 0, True, False
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, doc = b.column(0).to_numpy(), b.column(1).to_numpy(), _ids(b.column(2))
        new = np.ones(len(doc), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = any_rows and (h1[0], h2[0]) != run_hash
        if not any_rows:
            first = doc[0]
        any_rows = True
        run = np.cumsum(new)
        firsts = np.concatenate([np.array([first], doc.dtype), doc[new]])
        early = (run == 0) if in_first_run else np.zeros(len(doc), bool)
        in_first_run = in_first_run and run[-1] == 0
        kind = np.where(doc != firsts[run], 0, np.where(early, 1, -1)).astype(np.int32)
        run_hash, first = (h1[-1], h2[-1]), firsts[-1]
        some = pa.array(kind >= 0)
        yield pa.RecordBatch.from_arrays([*[c.filter(some) for c in b.columns], pa.array(kind[kind >= 0])], [*b.schema.names, "kind"])
    if any_rows:
        values = [[run_hash[0]], [run_hash[1]], [first], [0], [0], [0], [2]]
        kinds = [*b.schema.types, pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["h1", "h2", "doc_id", "tag", "pos", "n_lines", "kind"])


def dropped_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """The lines to drop: doc_id, tag, pos, n_lines."""
    order = ["h1", "h2", "doc_id", "pos"]
    ranged = line_rows(docs, min_chars).repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(ranged.mapInArrow(_first_occurrences, f"{_line_schema(docs)}, kind int"))
    begun = found.where("kind = 2").groupBy("h1", "h2").agg(F.min("doc_id").alias("begun"))
    later = found.where("kind = 1").join(begun, ["h1", "h2"]).where("begun < doc_id")
    cols = ["doc_id", "tag", "pos", "n_lines"]
    return found.where("kind = 0").select(*cols).union(later.select(*cols))


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """One row per document that loses lines: doc_id, tag, n_lines, n_dropped, keep (zlib of one bit a line, 1: stays)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for n, pos in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                bits = np.ones(n, bool)
                bits[pos] = False
                keep.append(zlib.compress(np.packbits(bits).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), pa.array(keep, pa.binary())],
                                             ["doc_id", "tag", "n_lines", "n_dropped", "keep"])

    rows = dropped_lines(docs, min_chars).groupBy("doc_id", "tag").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("pos"))
    rows = rows.select("doc_id", "tag", "n_lines", "pos", F.size("pos").alias("n_dropped"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, tag long, n_lines int, n_dropped int, keep binary")


def kept_text(text: bytes, keep: bytes | None) -> bytes:
    if keep is None:
        return text
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return b"\n".join([x for x, stays in zip(lines, bits.tolist()) if stays])


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and, as the last column, each row's bitmap or null; that column's name."""
    keep = fresh(docs, "keep")
    names = [fresh(docs, n) for n in ("bitmap_id", "bitmap_tag")]
    b = bitmaps.select(F.col("doc_id").alias(names[0]), F.col("tag").alias(names[1]), F.col("keep").alias(keep))
    joined = docs.join(b, (docs["doc_id"] == b[names[0]]) & (F.xxhash64(text_or_empty()) == b[names[1]]), "left")
    return joined.drop(*names), keep


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the dropped lines gone from ``text``; n_chars, if there, follows a changed text."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keeps = b.column(b.num_columns - 1).to_pylist()
            if any(k is not None for k in keeps):
                texts = b.column(at).to_pylist()
                new = [t if k is None else kept_text(t.encode(), k).decode() for t, k in zip(texts, keeps)]
                b = b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
            yield b

    joined, keep = _with_bitmaps(docs, bitmaps)
    out = map_whole_rows(joined, run)
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(keep).isNotNull(), size).otherwise(F.col("n_chars")))
    return out.drop(keep)


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` with every line that is in at least two documents left only in the one with the smallest doc_id."""
    return apply_bitmaps(docs, written(keep_bitmaps(docs, min_chars)))


def line_report(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, dropped, sha = [], [], []
            for t, keep in zip(text_bytes(b.column(1)), b.column(2).to_pylist()):
                n.append(t.count(b"\n") + 1)
                kept = kept_text(t, keep)
                dropped.append(0 if keep is None else n[-1] - int(np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n[-1]).sum()))
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha)],
                                             ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    slim = docs.select("doc_id", text_or_empty().alias("text"))
    joined, _ = _with_bitmaps(slim, written(keep_bitmaps(docs, min_chars)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")
