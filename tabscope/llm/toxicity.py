"""Toxicity scores from the nearest labelled examples.

The examples are a bounded sample of the labelled documents (about ``max_examples`` by a hash of
the id).  Vectors are TF-IDF over all words of the examples, which the sample bounds; a word weighs more the
larger its damped chi-square against the label is among the examples, and none is dropped.  Texts are hashed once: the
rows of (word, count) are written, document frequencies are counted over all of them, and the search reads them.  Words that
no example has can meet none and aren't part of a document's norm.  Each document's ``k`` nearest examples by exact
cosine come from a block-max index: examples in blocks of ``BLOCK``, postings of the rarer words, and for the
frequent ones a matrix and each block's largest weights.  A block whose bound is below the k-th best
score found is skipped, so the search is exact.

Votes are weighted by distance (the cosine); a vote becomes a score by logistic calibration on votes of the
examples: each half is searched among the other half's examples, with word weights that only those have set, so no
example's label has a part in its own vote.  The neighbours come along as evidence.

Edge cases: null and empty texts, and texts without any word of the examples, are near to no example
and get the calibrated rate of such examples; without labelled rows, or with one label only,
every score is that label's rate (0 without rows); null labels are not learned from; ids may be of any type that orders; ties of
cosine go to the example with the smaller doc_id; repeated rows get equal scores; an empty table gives no
rows; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import text_or_empty, written
from .tokens import LOWER, NOT_ALNUM, slices, span_hashes, utf8, word_spans

BLOCK = 64
#: So many of the most frequent terms are held as a matrix.
DENSE = 512
#: Documents searched together.
QUERIES = 128
#: More than single precision can lose in a cosine.
ROUNDING = 1e-4


def term_counts(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of the words of a column of texts, by text and term; ``wanted``: sorted hashes of the terms to keep,
    then a term is its place there, else its hash."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends = word_spans(data, offsets, NOT_ALNUM)
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    h = span_hashes(data, starts, ends)
    if wanted is not None:
        if not len(wanted):
            return (np.zeros(0, np.int64),) * 3
        low = np.uint64((1 << 16) - 1)
        maybe = np.zeros(1 << 16, bool)
        maybe[(wanted & low).astype(np.int64)] = True
        some = np.flatnonzero(maybe[(h & low).astype(np.int64)])
        place = np.minimum(np.searchsorted(wanted, h[some]), len(wanted) - 1)
        hit = wanted[place] == h[some]
        text_of, h = text_of[some[hit]], place[hit].astype(np.uint64)
    order = np.lexsort((h, text_of))
    text_of, h = text_of[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (text_of[1:] != text_of[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
    return text_of[first], h[first].view(np.int64), np.diff(np.append(first, len(h)))


def term_rows(docs: DataFrame, vocabulary=None) -> DataFrame:
    """doc_id, terms and counts of every document; ``vocabulary``: a broadcast of sorted hashes, of which the terms are places then."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, n in slices(b.column(1)):
                part = b.slice(k, n)
                text, term, count = term_counts(part.column(1), None if vocabulary is None else vocabulary.value)
                cuts = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (term if vocabulary is None else term.astype(np.int32), count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], ["doc_id", "terms", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, terms array<{'bigint' if vocabulary is None else 'int'}>, counts array<int>")


def _weights(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF weights of one text's terms (places in the vocabulary)."""
    w = (1 + np.log(counts)) * idf[terms]
    norm = np.sqrt(w @ w)
    return w / norm if norm else w


def _document_counts(terms: list[np.ndarray], n_terms: int) -> np.ndarray:
    """The number of examples with each term."""
    out = np.zeros(n_terms, np.int64)
    for t in terms:
        out[t] += 1
    return out


def build_index(vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> dict:
    """Block-max index of examples (terms, unit weights): the ``DENSE`` most frequent terms as a matrix with the largest
    weight of each block, all others as postings by term.  Weights are rounded to single precision."""
    blocks, often = max(1, -(-len(vectors) // BLOCK)), _document_counts([t for t, _ in vectors], n_terms)
    frequent = np.argsort(-often, kind="stable")[:DENSE]
    place = np.full(n_terms, -1, np.int32)
    place[frequent] = np.arange(len(frequent))
    starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.where(place < 0, often, 0))])
    dense, following = np.zeros((blocks * BLOCK, len(frequent)), np.float32), starts[:-1].copy()
    example, weight = np.zeros(starts[-1], np.int32), np.zeros(starts[-1], np.float32)
    for i, (terms, weights) in enumerate(vectors):  # one by one: the driver needs no second copy of the postings
        at = place[terms]
        dense[i, at[at >= 0]] = weights[at >= 0]
        cells = following[terms[at < 0]]
        example[cells], weight[cells] = i, weights[at < 0]
        following[terms[at < 0]] += 1
    return {"blocks": blocks, "place": place, "dense": dense, "largest": dense.reshape(blocks, BLOCK, -1).max(1),
            "starts": starts, "example": example, "weight": weight, "n": len(vectors)}


def nearest_of(index: dict, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (terms, weights) the ``k`` examples of largest cosine above 0 (ties: the first), and the cosines.

    A block is scored for the queries whose bound there reaches their k-th best score in their two best blocks; what
    comes within the rounding of single precision of the k-th best is scored again in double."""
    none = np.zeros(0, np.int64), np.zeros(0)
    if not index["n"]:
        return [none] * len(queries)
    blocks, dense, starts = index["blocks"], index["dense"], index["starts"]
    q, rest = np.zeros((len(queries), dense.shape[1])), np.zeros((len(queries), len(dense)))
    for i, (terms, weights) in enumerate(queries):
        at = index["place"][terms]
        q[i, at[at >= 0]] = weights[at >= 0]
        terms, weights = terms[at < 0], weights[at < 0]
        sizes = starts[terms + 1] - starts[terms]
        cells = np.repeat(starts[terms] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        rest[i] = np.bincount(index["example"][cells], weights=index["weight"][cells] * np.repeat(weights, sizes), minlength=len(dense))
    single = q.astype(np.float32)
    bound = rest.reshape(len(queries), blocks, BLOCK).max(2) + single @ index["largest"].T
    score, least = np.full(rest.shape, -1.0), np.zeros(len(queries))
    for i, best in enumerate(np.argsort(-bound, axis=1, kind="stable")[:, :2]):
        for b in best:
            rows = slice(b * BLOCK, (b + 1) * BLOCK)
            score[i, rows] = rest[i, rows] + dense[rows] @ single[i]
        some = np.concatenate([score[i, b * BLOCK:(b + 1) * BLOCK] for b in best])
        least[i] = np.partition(some, -k)[-k] if len(some) >= k else -1.0
    for b in range(blocks):
        rows = slice(b * BLOCK, (b + 1) * BLOCK)
        open_ = np.flatnonzero((bound[:, b] > 0) & (bound[:, b] >= least - ROUNDING))
        score[open_, rows] = rest[open_, rows] + single[open_] @ dense[rows].T
    found = []
    for i, s in enumerate(score):
        kth = np.partition(s, -k)[-k] if len(s) >= k else -1.0
        best = np.flatnonzero((s > 0) & (s >= kth - ROUNDING))
        cosine = rest[i, best] + dense[best].astype(float) @ q[i]
        order = np.lexsort((best, -np.round(cosine, 12)))[:k]
        found.append((best[order], cosine[order]))
    return found


def nearest(index: dict, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`nearest_of` for one query."""
    return nearest_of(index, [(terms, weights)], k)[0]


def _vote(labels: np.ndarray, best: np.ndarray, cosine: np.ndarray, alone: float, shrink: float = 0.5) -> float:
    """Distance-weighted share of label 1 among the neighbours, drawn towards ``alone`` by ``shrink`` neighbours' weight."""
    return float((cosine @ labels[best] + shrink * alone) / (cosine.sum() + shrink))


def calibration(votes: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of a lightly damped logistic regression of the label on the vote."""
    x, w = np.stack([votes, np.ones_like(votes)], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 0.1
        w = w + np.clip(np.linalg.solve(h, x.T @ (labels - p) - 0.1 * w), -2, 2)
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = 10_000, k: int = 15) -> dict:
    """The model, but for document frequencies (``idf``), which :func:`score` counts over all documents.

    ``labels``: doc_id, toxic.  Examples come to the driver with all their terms; these are the vocabulary."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, max_examples / max(1, known.count()))
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("toxicity")), 11) / float(1 << 53)
    sample = known.where(u < share).withColumnRenamed("doc_id", "_id")
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample.select("_id")), F.col("doc_id") == F.col("_id"))
    rows = term_rows(chosen).join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "toxic", "terms", "counts").toArrow()
    ids, toxic = rows.column(0).to_pylist(), np.array(rows.column(1).to_pylist(), float)
    vocabulary = np.zeros(0, np.uint64)
    for part in rows.column(2).chunks:
        vocabulary = np.union1d(vocabulary, part.flatten().to_numpy().view(np.uint64))
    places, counts = [], []
    for terms, numbers in zip(rows.column(2).chunks, rows.column(3).chunks):
        cuts = np.diff(terms.offsets.to_numpy()).cumsum()[:-1]
        places += np.split(np.searchsorted(vocabulary, terms.flatten().to_numpy().view(np.uint64)).astype(np.int32), cuts) if len(terms) else []
        counts += [x.astype(np.min_scalar_type(x.max(initial=0))) for x in np.split(numbers.flatten().to_numpy(), cuts)] if len(terms) else []
    terms = numbers = part = rows = None
    pa.default_memory_pool().release_unused()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], places[i].tobytes(), counts[i].tobytes()))
    return {"vocabulary": vocabulary, "examples": [(ids[i], int(toxic[i]), places[i], counts[i]) for i in order], "k": k}


def association(places: list[np.ndarray], labels: np.ndarray, n_terms: int, most: float = 20.0, half: float = 10.0, damping: float = 5.0) -> np.ndarray:
    """Weight of each term by its chi-square against the label among the examples (each one's terms, and the labels): 1 without
    association, up to 1 + ``most``; ``half`` is the chi-square that gives half of that.  ``damping`` examples more are expected of
    every term, so that one met once or twice tells little."""
    n, n1, c, c1 = float(len(labels)), float(labels.sum()), np.zeros(n_terms), np.zeros(n_terms)
    for terms, label in zip(places, labels):
        c[terms] += 1
        c1[terms] += label
    expected = c * (n1 / max(n, 1.0))
    x = np.square((c1 - expected) * n) / ((expected + damping) * (n - n1) * (n - c) + 1e-9)
    return 1 + most * np.square(x) / (np.square(x) + half * half)


def _indexed(examples: list, chosen: list[int], idf: np.ndarray) -> tuple[dict, np.ndarray, list[int], np.ndarray]:
    """Index of the chosen examples, their labels and places in its order, and the terms' weights that they set."""
    labels = np.array([examples[i][1] for i in chosen], float)
    weight = idf * association([examples[i][2] for i in chosen], labels, len(idf))
    vectors = [(examples[i][2], _weights(examples[i][2], examples[i][3].astype(float), weight).astype(np.float32)) for i in chosen]
    # examples of one leading frequent term share blocks, so that a block's bound is close
    often = _document_counts([t for t, _ in vectors], len(idf))
    often = often >= np.sort(often)[-min(DENSE, len(often))] if len(often) else often
    lead = [int(t[(w * often[t]).argmax()]) if len(t) else -1 for t, w in vectors]
    order = sorted(range(len(vectors)), key=lambda i: (lead[i], i))
    return build_index([vectors[i] for i in order], len(idf)), labels[order], [chosen[i] for i in order], weight


def _votes(examples: list, idf: np.ndarray, k: int, alone: float) -> np.ndarray:
    """Each example's vote from the other half of the examples."""
    votes = np.zeros(len(examples))
    for half in (0, 1):
        asked = list(range(half, len(examples), 2))
        index, labels, _, weight = _indexed(examples, list(range(1 - half, len(examples), 2)), idf)
        for i in range(0, len(asked), QUERIES):
            part = asked[i:i + QUERIES]
            found = nearest_of(index, [(examples[j][2], _weights(examples[j][2], examples[j][3].astype(float), weight)) for j in part], k)
            votes[part] = [_vote(labels, *x, alone) for x in found]
    return votes


def _finished(model: dict, frequency: np.ndarray, n_docs: int) -> dict:
    """The model with weights, index and calibration."""
    idf, examples = np.log((1 + n_docs) / (1 + frequency)) + 1, model["examples"]
    index, labels, order, weight = _indexed(examples, list(range(len(examples))), idf)
    empty = np.array([not len(examples[i][2]) for i in order], bool)
    rate = float(labels.mean()) if len(labels) else 0.0
    alone = float((labels[empty].sum() + rate) / (empty.sum() + 1))
    done = {"weight": weight, "index": index, "labels": labels, "ids": [examples[i][0] for i in order], "alone": alone, "k": model["k"], "line": None, "rate": rate}
    if 0 < labels.sum() < len(labels):
        done["line"] = calibration(_votes(examples, idf, model["k"], alone), np.array([x[1] for x in examples], float))
    return done


def _scores(m: dict, queries: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list, list]]:
    if m["line"] is None:
        return [(m["rate"], [], [])] * len(queries)
    out = []
    for best, cosine in nearest_of(m["index"], queries, m["k"]):
        z = m["line"][0] * _vote(m["labels"], best, cosine, m["alone"]) + m["line"][1]
        out.append((float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), [m["ids"][i] for i in best], cosine.tolist()))
    return out


def known_terms(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, terms (places in ``vocabulary``) and counts of every document, written."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = written(term_rows(docs, sent))
    sent.destroy()
    return rows


def frequencies(rows: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """The number of documents with each term, and of all documents; a task gives a row per term at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_terms + 1, np.int64)  # the last: documents
        for b in batches:
            counts[:-1] += np.bincount(b.column(0).flatten().to_numpy(), minlength=n_terms)
            counts[-1] += b.num_rows
        met = np.flatnonzero(counts)
        for i in range(0, len(met), 1 << 16):
            part = met[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], ["t", "n"])

    counted = rows.select("terms").mapInArrow(run, "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_terms + 1, np.int64)
    out[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    return out[:-1], int(out[-1])


def score(docs: DataFrame, model: dict, evidence: int = 5) -> DataFrame:
    """One row per document: doc_id, score, predicted, and the ``evidence`` nearest examples' doc_ids, with their cosines."""
    rows = known_terms(docs, model["vocabulary"])
    sent = docs.sparkSession.sparkContext.broadcast(_finished(model, *frequencies(rows, len(model["vocabulary"]))))
    kind = docs.schema["doc_id"].dataType
    ids_type = pa.list_(to_arrow_type(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for k in range(0, b.num_rows, QUERIES):
                part = b.slice(k, QUERIES)
                terms, counts = (c.flatten().to_numpy() for c in (part.column(1), part.column(2)))
                cuts = np.cumsum(pc.list_value_length(part.column(1)).to_numpy())[:-1]
                out = _scores(m, [(t, _weights(t, c.astype(float), m["weight"])) for t, c in zip(np.split(terms, cuts), np.split(counts, cuts))])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1][:evidence] for x in out], ids_type),
                     pa.array([x[2][:evidence] for x in out], pa.list_(pa.float64()))],
                    ["doc_id", "score", "evidence", "cosines"])

    name = kind.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {name}, score double, evidence array<{name}>, cosines array<double>")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence."""
    found = score(docs, fit(docs, labels.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")
