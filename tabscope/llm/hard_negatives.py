"""Hard negatives from an inverted multi-index.

Vectors (components ``floor(scale * x)``) are cut into two halves; a codebook for each, fitted on a bounded
sample, gives every row one of K x K cells.  A row's score against an anchor is at most the sum of two half-scores,
each the anchor's product with the codeword plus its norm times the codeword's radius (the farthest row's distance).
A multi-sequence heap takes an anchor's cells in falling order of that sum.  Cells whose own radii show that
they can't hold a wanted score aren't read.  An anchor is done as soon as each of its windows is certified: it has its
``k`` best and the next cell's bound is below the last of them, or below the window.  So the search is exact, and
every row is indexed; where bounds don't part the cells (directions at random), it reads them all.

The positives (the best of the same label) are searched first, without limits; their scores set the windows of the
negatives.  Both searches go in rounds that visit four times as many cells, each round a join of the open
anchors with the cells' rows, in blocks of bounded size on both sides, whatever a cell or its demand holds.

Rows of one label and vector have one score, so of those only the ``positives + 1`` smallest ids can be among the first
and are indexed; anchors of one label and vector are searched once.

Edge cases: rows with a null id, label or vector, or a null or non-finite component take no part, nor do vectors
of another length than the most frequent (of two such, the longer); rows repeated in full are one; rows that share
an id but not the vector or label take part separately, and those of an anchor's own id are set aside from its first
``positives + 1`` rows; ties of score go
to the smaller id; an empty table, or one label only, gives no rows; other columns are ignored.  Scores are exact up to 2**53.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Rows a cell is meant to hold, and most codewords of a half.
CELL, CODEWORDS = 1024, 256
#: Most anchors, and rows, that meet in one call.
BLOCK = 1024
#: Cells visited in the first round.
FIRST = 4
_LEAST, _MOST = -(1 << 62), 1 << 62


def _packed(rows: DataFrame, scale: int) -> tuple[DataFrame, str, int]:
    """vec_id, label, vec (little-endian numbers) of the rows that take part; numpy's name of the number; the length."""
    x = F.transform("embedding", lambda v: F.floor(F.lit(scale) * v.cast("double")))
    fine = F.forall("embedding", lambda v: F.coalesce(~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")), F.lit(False)))
    valid = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(fine).select("vec_id", "label", x.alias("x"))
    sizes = valid.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max("x")).alias("top"), F.min(F.array_min("x")).alias("bottom"))
    best = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    dim, most = (best["d"], max(best["top"] or 0, -1 - (best["bottom"] or 0))) if best else (0, 0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(2).flatten().to_numpy().reshape(b.num_rows, dim).astype(kind)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in flat], pa.binary())], ["vec_id", "label", "vec"])

    id_kind, label_kind = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    packed = valid.where(F.size("x") == dim).mapInArrow(run, f"vec_id {id_kind}, label {label_kind}, vec binary")
    return written(packed), kind, dim


def _numbers(column: pa.Array, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), dim).astype(float)


def codebook(points: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """``k`` means (fewer, if there are fewer distinct points) by Lloyd's steps from spread starts."""
    if not points.size:
        return np.zeros((1, points.shape[1]))
    points = np.unique(points, axis=0)
    centres = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)]
    for _ in range(rounds):
        own = _closest(points, centres)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, points)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _closest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((centres * centres).sum(1) - 2 * points[i:i + 8192] @ centres.T, axis=1)
                           for i in range(0, max(1, len(points)), 8192)])


def build_index(packed: DataFrame, kind: str, dim: int, keep: int, max_sample: int = 20_000) -> tuple[DataFrame, dict]:
    """(vec_id, label, vec, cell, block) of the rows that can be among the first, and the codebooks with cells' radii (bounded by the codewords)."""
    w = Window.partitionBy("label", "vec").orderBy("vec_id")
    rows = packed.withColumn("r", F.dense_rank().over(w)).where(F.col("r") <= keep).drop("r").dropDuplicates()
    n, half = packed.count(), dim // 2
    share = min(1.0, max_sample / max(1, n))
    u = F.shiftrightunsigned(F.xxhash64("vec", F.lit("codebook")), 11) / float(1 << 53)
    sample = _numbers(packed.where(u < share).select("vec").dropDuplicates().toArrow().column(0), kind, dim)
    k = int(np.clip(np.sqrt(n / CELL), 2, CODEWORDS))
    books = [codebook(sample[:, :half], k), codebook(sample[:, half:], k)]
    width = len(books[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, cell, far = _numbers(b.column(2), kind, dim), np.zeros(b.num_rows, np.int64), []
            for part, book in ((x[:, :half], books[0]), (x[:, half:], books[1])):
                own = _closest(part, book)
                cell = cell * width + own
                far.append(np.sqrt(np.square(part - book[own]).sum(1)) * (1 + 1e-9))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), *map(pa.array, far)], [*b.schema.names, "cell", "r1", "r2"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema)
    placed = written(rows.mapInArrow(run, f"{kinds}, cell int, r1 double, r2 double"))
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).orderBy("cell").toArrow()
    cell, n, r1, r2 = (c.to_numpy() for c in cells.columns)
    radii = [np.zeros(len(books[0])), np.zeros(width)]
    np.maximum.at(radii[0], cell // width, r1)
    np.maximum.at(radii[1], cell % width, r2)
    model = {"books": books, "radii": radii, "cell": cell, "r1": r1, "r2": r2, "kind": kind, "dim": dim}
    spark = packed.sparkSession
    blocks = spark.createDataFrame([(int(c), int(-(-m // BLOCK))) for c, m in zip(cell, n)], "cell int, blocks int")
    index = placed.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id", "vec"), "blocks").cast("int"))
    return written(index.select("vec_id", "label", "vec", "cell", "block", "blocks")), model


def in_order(u1: np.ndarray, u2: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Pairs of positions in falling order of the sum of their half-bounds: the multi-sequence heap."""
    a, b = np.argsort(-u1, kind="stable"), np.argsort(-u2, kind="stable")
    s1, s2, a, b = u1[a].tolist(), u2[b].tolist(), a.tolist(), b.tolist()
    heap = [(-(s1[0] + s2[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, a[i], b[j]
        if j + 1 < len(b):
            heapq.heappush(heap, (-(s1[i] + s2[j + 1]), i, j + 1))
        if not j and i + 1 < len(a):
            heapq.heappush(heap, (-(s1[i + 1] + s2[0]), i + 1, 0))


def visits(x: np.ndarray, low: int, high: int, model: dict, start: int, stop: int) -> tuple[list[int], float]:
    """The cells from rank ``start`` to ``stop`` of an anchor's order that may hold scores from ``low`` to ``high``; the bound of what follows."""
    half, (c1, c2), width = model["dim"] // 2, model["books"], len(model["books"][1])
    d1, d2, n1, n2 = c1 @ x[:half], c2 @ x[half:], np.linalg.norm(x[:half]), np.linalg.norm(x[half:])
    slack, cells, rank = 1e-9 * (n1 + 1) * (n2 + 1) + 1e-6, [], 0
    for bound, i, j in in_order(d1 + n1 * model["radii"][0], d2 + n2 * model["radii"][1]):
        bound += slack + abs(bound) * 1e-12
        if bound < low:
            return cells, bound
        at = np.searchsorted(model["cell"], i * width + j)
        if at == len(model["cell"]) or model["cell"][at] != i * width + j:
            continue
        if rank >= stop:
            return cells, bound
        rank += 1
        if rank > start:
            reach = n1 * model["r1"][at] + n2 * model["r2"][at] + slack + abs(bound) * 1e-12
            if d1[i] + d2[j] + reach >= low and d1[i] + d2[j] - reach <= high:
                cells.append(i * width + j)
    return cells, float("-inf")


def best_of(units: pa.Table, rows: pa.Table, kind: str, dim: int, same: bool, k: int) -> pa.Table:
    """The ``k`` best rows in each window of each anchor of a block, by score and smaller id."""
    rows = rows.sort_by("vec_id")
    x, y = _numbers(units["vec"].combine_chunks(), kind, dim), _numbers(rows["vec"].combine_chunks(), kind, dim)
    score = x @ y.T
    labels = np.unique(np.concatenate([units["label"].to_numpy(), rows["label"].to_numpy()]), return_inverse=True)[1]
    score[(labels[:len(x), None] == labels[None, len(x):]) != same] = -np.inf
    low, high = (np.array(units[c].to_pylist(), float) for c in ("low", "high"))
    out = []
    for w in range(low.shape[1]):
        open_ = np.where((score >= low[:, w:w + 1]) & (score <= high[:, w:w + 1]), score, -np.inf)
        for _ in range(min(k, len(y))):
            at = open_.argmax(1)
            s = open_[np.arange(len(x)), at]
            hit = np.flatnonzero(s > -np.inf)
            if not len(hit):
                break
            out.append((hit, np.full(len(hit), w, np.int32), at[hit], s[hit]))
            open_[hit, at[hit]] = -np.inf
    unit, w, at, s = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))
    return pa.table([units["unit"].combine_chunks().take(pa.array(unit)), pa.array(w), rows["vec_id"].combine_chunks().take(pa.array(at)), pa.array(np.clip(s, _LEAST, _MOST).astype(np.int64))],
                    ["unit", "w", "vec_id", "score"])


def search(units: DataFrame, index: DataFrame, model: dict, same: bool, k: int) -> DataFrame:
    """``units``: unit, label, vec, low and high (arrays: its windows).  Of the rows of the same (or of any other) label the ``k`` best in
    each window: unit, w (the window's place), vec_id, score."""
    kind, dim = model["kind"], model["dim"]
    id_kind, label_kind, unit_kind = index.schema["vec_id"].dataType.simpleString(), index.schema["label"].dataType.simpleString(), units.schema["unit"].dataType.simpleString()
    unit_schema = f"unit {unit_kind}, label {label_kind}, vec binary, low array<bigint>, high array<bigint>"
    sent = units.sparkSession.sparkContext.broadcast(model)
    found, opened, start, stop = None, units, 0, FIRST

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return best_of(left, right, kind, dim, same, k)

    while True:
        def plan(batches: Iterator[pa.RecordBatch], start=start, stop=stop) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _numbers(b.column(2), kind, dim)
                got = [visits(v, min(lo), max(hi), sent.value, start, stop) for v, lo, hi in zip(x, b.column(3).to_pylist(), b.column(4).to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c for c, _ in got], pa.list_(pa.int32())), pa.array([d for _, d in got], pa.float64())],
                                                 [*b.schema.names, "cells", "bound"])

        asked = written(opened.select("unit", "label", "vec", "low", "high").mapInArrow(plan, f"{unit_schema}, cells array<int>, bound double"))
        each = asked.withColumn("cell", F.explode("cells")).drop("cells", "bound")
        demand = each.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
        left = (each.join(F.broadcast(demand), "cell").join(F.broadcast(index.select("cell", "blocks").distinct()), "cell")
                .withColumn("part", F.pmod(F.xxhash64("unit", "vec"), "parts").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                .select("cell", "block", "part", "unit", "label", "vec", "low", "high"))
        right = (index.join(F.broadcast(demand), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                 .select("cell", "block", "part", "vec_id", "label", "vec"))
        key = ["cell", "block", "part"]
        hits = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, f"unit {unit_kind}, w int, vec_id {id_kind}, score bigint")
        ranked = (hits if found is None else found.unionByName(hits)).withColumn(
            "r", F.row_number().over(Window.partitionBy("unit", "w").orderBy(F.desc("score"), "vec_id")))
        found = written(ranked.where(F.col("r") <= k).drop("r"))
        have = found.groupBy("unit", "w").agg(F.count("*").alias("n"), F.min("score").alias("last"))
        wanting = (asked.select("unit", "bound", F.posexplode("low").alias("w", "least")).join(have, ["unit", "w"], "left")
                   .where(f"NOT (bound < least OR coalesce(n = {k} AND last > bound, false))").select("unit").distinct())
        # a full window asks no more for scores below its last
        floors = have.where(F.col("n") == k).groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("w", "last"))).alias("floor"))
        raised = F.transform("low", lambda low, w: F.greatest(low, F.coalesce(F.try_element_at("floor", w), low)))
        opened = written(asked.join(wanting, "unit", "left_semi").join(floors, "unit", "left").withColumn("low", raised).drop("floor"))
        if opened.isEmpty():
            return found
        start, stop = stop, stop * 4


def hard_negatives(rows: DataFrame, is_anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 3,
                   low_pct: int = 50, high_pct: int = 95) -> DataFrame:
    """``rows``: vec_id, label, embedding.  For every anchor and each of its first ``positives`` other rows of its label the first ``negatives``
    rows of other labels whose score is from ``low_pct`` to ``high_pct`` percent of the positive's: anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score."""
    packed, kind, dim = _packed(rows, scale)
    index, model = build_index(packed, kind, dim, max(positives + 1, negatives))
    anchors = packed.where(is_anchor).dropDuplicates()
    units = written(anchors.groupBy("label", "vec").agg(F.min("vec_id").alias("unit")))
    units = units.withColumn("unit", F.struct("unit", F.xxhash64("label", "vec").alias("h")))  # ids may repeat
    free = units.withColumns({"low": F.array(F.lit(_LEAST)), "high": F.array(F.lit(_MOST))})
    near = search(free, index, model, True, positives + 1)
    wide = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "vec_id", "score")))
    first = written(near.groupBy("unit").agg(wide.alias("near")).join(units, "unit"))
    # windows in whole numbers; where low exceeds high (a negative score) nothing can be in it
    lows = F.expr(f"transform(near, p -> if(p.score < 0, {_MOST}L, ({low_pct} * p.score + 99) div 100))")
    highs = F.expr(f"transform(near, p -> {high_pct} * p.score div 100)")
    far = search(first.select("unit", "label", "vec", lows.alias("low"), highs.alias("high")), index, model, False, negatives)
    lists = far.groupBy("unit", "w").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "vec_id", "score"))).alias("far"))
    per_unit = (first.select("label", "vec", "unit", F.posexplode("near").alias("w", "p")).join(lists, ["unit", "w"], "left")
                .groupBy("label", "vec").agg(F.array_sort(F.collect_list(F.struct("w", F.col("p.vec_id").alias("id"), F.col("p.score").alias("score"), "far"))).alias("pairs")))
    own = anchors.join(per_unit, ["label", "vec"]).select(
        F.col("vec_id").alias("anchor_id"),
        F.explode(F.slice(F.filter("pairs", lambda p: p["id"] != F.col("vec_id")), 1, positives)).alias("p"))
    return own.select("anchor_id", F.col("p.id").alias("positive_id"), F.posexplode("p.far").alias("k", "n"), F.col("p.score").alias("positive_score")).select(
        "anchor_id", "positive_id", (F.col("k") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"), "positive_score",
        F.col("n.score").alias("negative_score"))


def mined(embeddings: DataFrame) -> DataFrame:
    """The registered query: labels of ids divisible by 7 move on by one, ids divisible by 50 are anchors."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(embeddings.select("vec_id", moved.cast(embeddings.schema["label"].dataType).alias("label"), "embedding"), F.col("vec_id") % 50 == 0)
