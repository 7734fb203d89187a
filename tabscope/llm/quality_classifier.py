"""Quality scores by random Fourier features and ridge regression, isotonically calibrated.

Each text gives a fixed list of statistics (lengths, shares of kinds of characters, repetition, line shapes), found in
numpy over whole batches.  They are standardized by their mean and deviation over all documents, and mapped by
``features`` random cosines, whose products approximate a Gaussian kernel.  Every partition adds up its labelled rows' normal
equations, in whole numbers, so that the order of the sums changes nothing; Spark adds up the partitions', one row per cell of the
equations, partition and fold.  A ridge is solved without each fold, and one from all.  The folds' rows, scored by the model that hasn't
seen them, fall into narrow bins, whose rates pooling of adjacent violators makes a rising curve; straight lines between its
steps keep scores of one step apart.  What reaches the driver has the size of the equations and of the bins.

Edge cases: null and empty texts have the statistics of no words and get a score like others; labels that are null or
whose document is missing aren't learned from, several labels of one doc_id count as their mean; without labelled rows every score is
0.5, with one label only that label; repeated rows get equal scores; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty, written
from .tokens import LOWER, SPACE, shingle_hashes, slices, span_hashes, utf8, word_spans

#: The statistics, in order.
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "word_bytes_deviation", "log_longest_word", "upper", "digits", "marks", "symbols", "commas_stops", "exclamations",
    "spaces", "beyond_ascii", "distinct_words", "repeated_trigrams", "same_as_last_word", "most_frequent_word", "capitalized_words", "words_ending_in_marks",
    "words_of_marks", "words_per_line", "distinct_lines", "lines_ending_in_marks")
#: Sums are kept in units of this fraction.
_UNIT = 1 << 24
#: Width of a bin of raw scores, and the bins' ends.
_BIN, _ENDS = 1000, (-1000, 2000)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_CLASSES = np.stack([
    _class(bytes(range(65, 91))), _class(b"0123456789"), _class(bytes(b for b in range(33, 127) if not chr(b).isalnum())), _class(b"#*$%&|<>"), _class(b".,;:"),
    _class(b"!"), SPACE, _class(bytes(range(128, 256)))])
_MARKS, _LINE = _CLASSES[2], _class(b"\n")


def _per_text(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (of words or bytes) for the texts that begin at ``cuts`` (one more than texts)."""
    sums = np.concatenate([np.zeros(1), np.cumsum(values, dtype=float)])
    return sums[cuts[1:]] - sums[cuts[:-1]]


def _distinct(text_of: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: distinct hashes, occurrences of those that occur twice or more, and of the most frequent."""
    order = np.lexsort((hashes, text_of))
    t, h = text_of[order], hashes[order]
    first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
    count, own, most = np.diff(np.append(first, len(h))), t[first], np.zeros(n)
    np.maximum.at(most, own, count)
    return np.bincount(own, minlength=n).astype(float), np.bincount(own, weights=count * (count > 1), minlength=n), most


def statistics(column: pa.Array) -> np.ndarray:
    """A row of :data:`STATISTICS` for every text of a column."""
    data, offsets = utf8(column)
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)
    some = np.maximum(size, 1)
    shares = [_per_text(kind[data], offsets) / some for kind in _CLASSES]
    starts, ends = word_spans(data, offsets, SPACE)
    cuts = np.searchsorted(starts, offsets)
    words, length, text_of = np.diff(cuts).astype(float), (ends - starts).astype(float), np.repeat(np.arange(n), np.diff(cuts))
    each, mean = np.maximum(words, 1), _per_text(length, cuts) / np.maximum(words, 1)
    longest = np.zeros(n)
    np.maximum.at(longest, text_of, length)
    h = span_hashes(LOWER[data], starts, ends)
    distinct, _, most = _distinct(text_of, h, n)
    trigrams, at = shingle_hashes(h, text_of, 3)
    repeated = _distinct(text_of[at], trigrams, n)[1]
    same = np.concatenate([[False], (h[1:] == h[:-1]) & (text_of[1:] == text_of[:-1])]) if len(h) else np.zeros(0, bool)
    marked = np.concatenate([np.zeros(1, np.int64), np.cumsum(_MARKS[data])])
    begin, finish = word_spans(data, offsets, _LINE)
    lines_at = np.searchsorted(begin, offsets)
    lines, line_text = np.maximum(np.diff(lines_at), 1).astype(float), np.repeat(np.arange(n), np.diff(lines_at))
    line_distinct = _distinct(line_text, span_hashes(data, begin, finish), n)[0]
    out = [
        np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(_per_text(length * length, cuts) / each - mean * mean, 0)), np.log1p(longest), *shares,
        distinct / each, repeated / each, _per_text(same, cuts) / each, most / each, _per_text(_CLASSES[0][data[starts]], cuts) / each, _per_text(_MARKS[data[ends - 1]], cuts) / each,
        _per_text(marked[ends] - marked[starts] == ends - starts, cuts) / each, np.log1p(words / lines), line_distinct / lines, _per_text(_MARKS[data[finish - 1]], lines_at) / lines]
    return np.stack(out, 1)


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x (array of :data:`STATISTICS`), one row per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, n in slices(b.column(1)):
                part = b.slice(k, n)
                x = statistics(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, x array<double>")


def fourier(m: dict, x: np.ndarray) -> np.ndarray:
    """Random cosines of standardized statistics, and a constant."""
    z = np.clip((x - m["mean"]) / m["deviation"], -m["clip"], m["clip"])
    return np.hstack([np.sqrt(2.0 / m["w"].shape[1]) * np.cos(z @ m["w"] + m["b"]), np.ones((len(x), 1))])


def _lists(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), width)


def _standard(stats: DataFrame, features: int, width: float, clip: float, seed: int) -> dict:
    """Means and deviations over all documents, and the cosines."""
    d = len(STATISTICS)
    row = stats.agg(*[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(d) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean, deviation = (np.array([row[f"{k}{i}"] or 0.0 for i in range(d)]).round(9) for k in "ms")
    random = np.random.default_rng(seed)
    return {"mean": mean, "deviation": np.where(deviation > 1e-9, deviation, 1.0), "clip": clip,
            "w": random.standard_normal((d, features)) / (width * np.sqrt(d)), "b": random.uniform(0, 2 * np.pi, features)}


def _equations(known: DataFrame, m: dict, folds: int) -> np.ndarray:
    """The normal equations of each fold: sums of products of the features and the target (the last column)."""
    size = m["w"].shape[1] + 2
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((folds, size, size))
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                y = part.column(2).to_numpy()
                z = np.hstack([fourier(m, _lists(part.column(0), len(STATISTICS))), y[:, None]])
                fold = part.column(1).to_numpy()
                for f in np.unique(fold):
                    own = z[fold == f]
                    sums[f] += own.T @ own
        for f in range(folds):
            v = np.rint(sums[f][upper] * _UNIT).astype(np.int64)
            if v.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), f, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["fold", "cell", "v"])

    got = known.select("x", "fold", "y").mapInArrow(run, "fold int, cell int, v bigint").groupBy("fold", "cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((folds, size, size))
    fold, cell, v = (c.to_numpy() for c in got.columns)
    out[fold, upper[0][cell], upper[1][cell]] = v / _UNIT
    return out + np.transpose(np.triu(out, 1), (0, 2, 1))


def _ridge(sums: np.ndarray, damping: float) -> np.ndarray:
    a, y = sums[:-1, :-1], sums[:-1, -1]
    damp = np.eye(len(a)) * damping
    damp[-1, -1] = 1e-6
    return np.linalg.solve(a + damp, y)


def isotonic(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and rates of the steps of the rising curve nearest to the sums ``y`` of ``n`` points at rising ``x``."""
    steps: list[list[float]] = []
    for a, b, c in zip(x.tolist(), n.tolist(), y.tolist()):
        steps.append([a * b, b, c])
        while len(steps) > 1 and steps[-2][2] * steps[-1][1] >= steps[-1][2] * steps[-2][1]:
            last = steps.pop()
            steps[-1] = [p + q for p, q in zip(steps[-1], last)]
    s = np.array(steps)
    return s[:, 0] / s[:, 1], s[:, 2] / s[:, 1]


def fit(stats: DataFrame, labels: DataFrame, features: int = 128, width: float = 0.5, clip: float = 4.0, damping: float = 1.0, folds: int = 5, seed: int = 13) -> dict:
    """The model from :func:`text_statistics` of all documents and ``labels`` (doc_id, quality)."""
    m = _standard(stats, features, width, clip, seed)
    target = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds)).cast("int")
    known = written(stats.join(target, "doc_id").select("x", "y", fold.alias("fold")))
    sums = _equations(known, m, folds)
    whole = sums.sum(0)
    rows, positive = whole[-2, -2], whole[-2, -1]
    if not 0 < positive < rows:
        return m | {"flat": 0.5 if not rows else float(positive > 0)}
    without = np.stack([_ridge(whole - s, damping) for s in sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = (fourier(m, _lists(b.column(0), len(STATISTICS))) * without[b.column(1).to_numpy()]).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.floor(raw * _BIN), *_ENDS).astype(np.int32)), b.column(2)], ["bin", "y"])

    bins = known.select("x", "fold", "y").mapInArrow(run, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y")).orderBy("bin").toArrow()
    x, n, y = (c.to_numpy().astype(float) for c in bins.columns)
    at, rate = isotonic((x + 0.5) / _BIN, n, y)
    return m | {"beta": _ridge(whole, damping), "at": at, "rate": rate}


def score(stats: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every row of :func:`text_statistics`."""
    m = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if "flat" in m:
                s = np.full(b.num_rows, m["flat"])
            else:
                raw = fourier(m, _lists(b.column(1), len(STATISTICS))) @ m["beta"]
                s = np.clip(np.interp(raw, m["at"], m["rate"]), 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    scored = stats.select("doc_id", "x").mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    stats = written(text_statistics(docs))
    return score(stats, fit(stats, labels.where(~held_out()))).select("doc_id", held_out().alias("held_out"), "score", "predicted")
