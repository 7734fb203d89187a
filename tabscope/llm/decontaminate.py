"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by size (number of distinct shingles, by powers of two).  An
item's sketch is its ``k`` shingles of least hash, with ``k`` one more than the
shingles that the largest item of its partition may miss at the threshold; so a
document that contains an item to the threshold holds at least one shingle of its
sketch, however long the document is, and no match is lost.  Documents' shingles
are looked up among the sketches, and every (document, item) that meets is
verified by exact containment of the shingles themselves.

The items are the query set: they go to the tasks in blocks of at most
``block_bytes`` of text (and ``block_items`` items), one scan of the documents a
block, whatever their number.  Documents are never shuffled for the search.

An item of fewer than ``words`` words is one shingle of its own length, looked up in documents at that length.

Edge cases: null and empty texts and items have no shingles and match nothing; repeated rows match alike; an empty
benchmark or table gives no matches; other columns are ignored, or pass
:func:`decontaminate` unchanged.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .shared import map_whole_rows, text_or_empty
from .tokens import LOWER, SPACE, shingle_hashes, slices, span_hashes, utf8, word_spans


def _shingles(text: bytes, words: int) -> set[bytes]:
    parts = text.lower().split()
    return {b" ".join(parts[i:i + words]) for i in range(len(parts) - words + 1)}


def sketch_size(n: int, threshold: float) -> int:
    """Shingles to keep of an item of ``n``: one more than the largest of its size partition may miss."""
    largest = (1 << n.bit_length()) - 1
    return min(n, largest - math.ceil(threshold * largest - 1e-9) + 1)


def hashed_shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every shingle of a column of texts."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends = word_spans(data, offsets, SPACE)
    text_of = np.searchsorted(offsets, starts, side="right") - 1
    hashes, at = shingle_hashes(span_hashes(data, starts, ends), text_of, words)
    return hashes, text_of[at]


def _word_counts(column: pa.Array) -> np.ndarray:
    data, offsets = utf8(column)
    return np.diff(np.searchsorted(word_spans(data, offsets, SPACE)[0], offsets))


def sketches(ids: list, texts: list[str | None], words: int, threshold: float):
    """The block's index: for each length of shingle the sketch hashes, sorted, and the item of each; the items' shingles."""
    column = pa.array(texts, pa.string())
    lengths, exact, by_length = np.minimum(_word_counts(column), words), {}, {}
    for length in np.unique(lengths[lengths > 0]).tolist():
        hashes, item = hashed_shingles(column, length)
        order = np.lexsort((hashes, item))
        hashes, item = hashes[order], item[order]
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (item[1:] != item[:-1])])
        hashes, item = hashes[new], item[new]
        cuts, h, of = np.searchsorted(item, np.arange(len(texts) + 1)), [], []
        for i in np.flatnonzero(lengths == length).tolist():
            own = hashes[cuts[i]:cuts[i + 1]]
            exact[i] = (ids[i], length, _shingles(texts[i].encode(), length))
            h.append(own[: sketch_size(len(own), threshold)])
            of.append(np.full(len(h[-1]), i))
        h, of = np.concatenate(h), np.concatenate(of)
        order = np.argsort(h, kind="stable")
        by_length[length] = h[order], of[order]
    return (by_length, exact) if exact else None


def _blocks(items: DataFrame, block_bytes: int, block_items: int) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1] or "")
        if size >= block_bytes or len(ids) >= block_items:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _find(column: pa.Array, index, words: int, threshold: float) -> tuple[list[int], list, list[float]]:
    """Rows of a column of texts, the items that they contain, and how much of them."""
    by_length, exact = index
    row, item, share = [], [], []
    low, maybe = np.uint64((1 << 22) - 1), {}
    for length, (h, _) in by_length.items():
        maybe[length] = np.zeros(1 << 22, bool)
        maybe[length][(h & low).astype(np.int64)] = True
    for k, n in slices(column):
        part = column.slice(k, n)
        candidates: dict[int, set[int]] = {}
        for length, (h, of) in by_length.items():
            hashes, text_of = hashed_shingles(part, length)
            some = maybe[length][(hashes & low).astype(np.int64)]
            hashes, text_of = hashes[some], text_of[some]
            first, last = np.searchsorted(h, hashes), np.searchsorted(h, hashes, side="right")
            met = np.flatnonzero(first < last)
            for t, x, y in zip(text_of[met].tolist(), first[met].tolist(), last[met].tolist()):
                candidates.setdefault(t, set()).update(of[x:y].tolist())
        for t, near in sorted(candidates.items()):
            text, own = part[t].as_py().encode(), {}
            for i in sorted(near):
                item_id, length, wanted = exact[i]
                if length not in own:
                    own[length] = _shingles(text, length)
                c = len(wanted & own[length]) / len(wanted)
                if c >= threshold:
                    row.append(k + t)
                    item.append(item_id)
                    share.append(c)
    return row, item, share


def _indexes(items: DataFrame, words: int, threshold: float, block_bytes: int, block_items: int):
    for ids, block in _blocks(items, block_bytes, block_items):
        if index := sketches(ids, block, words, threshold):
            yield items.sparkSession.sparkContext.broadcast(index)


def matches(docs: DataFrame, items: DataFrame, words: int = 5, threshold: float = 0.8,
            block_bytes: int = 4 << 20, block_items: int = 20_000) -> DataFrame:
    """One row per (document row, item) with containment of the item's distinct shingles in the
    document's of at least ``threshold``: doc_id, item_id, containment."""
    kinds = [x.schema[c].dataType for x, c in ((docs, "doc_id"), (items, "item_id"))]
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, containment double"
    item_type = to_arrow_type(kinds[1])
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    found = docs.sparkSession.createDataFrame([], schema)
    for sent in _indexes(items, words, threshold, block_bytes, block_items):
        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                row, item, share = _find(b.column(1), sent.value, words, threshold)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(item, item_type), pa.array(share, pa.float64())],
                                                 ["doc_id", "item_id", "containment"])

        found = found.union(texts.mapInArrow(run, schema))
    return found


def decontaminate(docs: DataFrame, items: DataFrame, words: int = 5, threshold: float = 0.8,
                  block_bytes: int = 4 << 20, block_items: int = 20_000) -> DataFrame:
    """``docs`` without the rows whose text contains an item; a scan, no shuffle."""
    at = docs.columns.index("text")
    for sent in _indexes(items, words, threshold, block_bytes, block_items):
        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                stays = np.ones(b.num_rows, bool)
                stays[_find(b.column(at), sent.value, words, threshold)[0]] = False
                yield b.filter(pa.array(stays))

        docs = map_whole_rows(docs, run)
    return docs
