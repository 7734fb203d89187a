"""Language identification by hierarchical discrimination.

First the language family, by multinomial naive Bayes over hashed character
n-grams; then, within the chosen family, one-versus-one linear support vector machines
over the same n-grams, trained in numpy, separate the related languages: the language
with most pairwise wins is predicted (ties: the larger sum of margins).

Texts are read whole: every n-gram of every text is hashed and scored in numpy.  The
model is fitted on a bounded sample: about ``per_language`` documents of each language
(by a hash of doc_id) and at most ``max_rows`` in all, each as a vector of ``BUCKETS`` counts.

Edge cases: null texts and texts without a letter are ``und`` with score 0; rows without
a label, or held out, are never learned from; with no labelled row everything is ``und``; with one
language that is predicted; repeated rows get one prediction each; an empty table gives no
rows; other columns are ignored, or pass :func:`known_language` unchanged.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_whole_rows, text_or_empty
from .tokens import LOWER, slices, utf8

UNDETERMINED = "und"
BUCKETS = 1 << 13
#: Lengths, in bytes, of the n-grams.
GRAMS = (2, 3, 4)
#: Bytes scored together.
_CHUNK = 1 << 21
#: Family of each language code; others are families of their own.  Fixed values.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("an", "ast", "ca", "co", "es", "fr", "gl", "it", "la", "oc", "pt", "rm", "ro", "sc"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "celtic": ("br", "cy", "ga", "gd"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "semitic": ("am", "ar", "he", "mt"),
    "malayic": ("id", "jv", "ms", "su", "tl"),
}
_FOLD = LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def family_of(language: str, families: dict[str, tuple[str, ...]] = FAMILIES) -> str:
    code = language.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in families.items() if code in codes), language)


def gram_ids(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte (the last n - 1 have none)."""
    m = len(data) - n + 1
    code = np.full(max(0, m), n, np.uint32)
    for j in range(n):
        code *= np.uint32(0x01000193)
        code ^= data[j:j + m]
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    return code >> np.uint32(32 - BUCKETS.bit_length() + 1)


def _chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(folded bytes, text of each byte, first byte of the next chunk's share) pieces that overlap by the longest n-gram."""
    data, offsets = utf8(column)
    data = _FOLD[data]
    for k in range(0, len(data), _CHUNK):
        part = data[k:k + _CHUNK + max(GRAMS) - 1]
        clipped = np.clip(offsets, k, k + len(part))
        text_of = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(clipped))
        yield part, text_of, min(_CHUNK, len(part))


def _grams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of every n-gram that lies in one text and isn't white space only at its start."""
    for part, text_of, own in _chunks(column):
        for n in GRAMS:
            ids = gram_ids(part, n)[:own]
            m = len(ids)
            ok = (text_of[:m] == text_of[n - 1:n - 1 + m]) & ~((part[:m] == 32) & (part[1:1 + m] == 32))
            yield ids[ok], text_of[:m][ok]


def gram_counts(column: pa.Array) -> np.ndarray:
    counts = np.zeros(len(column) * BUCKETS, np.float32)
    for ids, text_of in _grams(column):
        counts += np.bincount(text_of.astype(np.int64) * BUCKETS + ids, minlength=len(counts)).astype(np.float32)
    return counts.reshape(len(column), BUCKETS)


def linear_svm(x: np.ndarray, y: np.ndarray, epochs: int = 40, reg: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM by Pegasos; ``y`` is -1 or 1."""
    rng, w, step = np.random.default_rng(seed), np.zeros(x.shape[1] + 1), 0
    mean = np.zeros_like(w)
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 16)):
            step += 1
            wrong = rows[y[rows] * (x[rows] @ w) < 1]
            w *= 1 - 1 / (step + 10)
            if len(wrong):
                w += (y[wrong, None] * x[wrong]).sum(axis=0) / (reg * (step + 10) * len(rows))
        if epoch >= epochs // 2:
            mean += w
    return mean / (epochs - epochs // 2)


def train(counts: np.ndarray, langs: list[str], families: dict[str, tuple[str, ...]] = FAMILIES) -> dict:
    """The model, as plain data: ``weights`` has a row over the n-gram buckets for each family
    (log-probabilities) and each pair of related languages (SVM weights)."""
    known = sorted(set(langs))
    of = {lang: family_of(lang, families) for lang in known}
    members = {f: [x for x in known if of[x] == f] for f in sorted(set(of.values()))}
    pairs = [(f, a, b) for f, own in members.items() for a, b in combinations(own, 2)]
    labels = np.array(langs)
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    columns, bias = [], [0.0] * len(members)
    for own in members.values():
        total = share[np.isin(labels, own)].sum(axis=0) + 0.5 / BUCKETS
        columns.append(np.log(total / total.sum()))
    # scoring stays linear in the shares: each bucket is scaled by its usual size, not each text by its norm
    scale = 1 / np.sqrt(share.mean(axis=0) + 1e-6) if len(share) else np.ones(BUCKETS)
    for _, a, b in pairs:
        rows = np.isin(labels, (a, b))
        w = linear_svm((share[rows] * scale).astype(np.float32), np.where(labels[rows] == b, 1.0, -1.0))
        columns.append(w[:-1] * scale)
        bias.append(w[-1])
    weights = np.array(columns, np.float32) if columns else np.zeros((0, BUCKETS), np.float32)
    return {"members": members, "pairs": pairs, "weights": weights, "bias": np.array(bias, np.float32)}


def predict(model: dict, column: pa.Array) -> tuple[list[str], np.ndarray]:
    members, weights = model["members"], model["weights"]
    sums, n = np.zeros((len(column), len(weights))), np.zeros(len(column))
    out, score = np.full(len(column), UNDETERMINED, object), np.zeros(len(column))
    if not members or not len(column):
        return out.tolist(), score
    for ids, text_of in _grams(column):
        if len(ids):
            first = np.flatnonzero(np.diff(text_of, prepend=-1))
            which = text_of[first]
            n[which] += np.diff(np.append(first, len(ids)))
            for c, w in enumerate(weights):
                sums[which, c] += np.add.reduceat(w[ids], first, dtype=np.float64)
    scores = sums / np.maximum(n, 1)[:, None] + model["bias"]
    f = len(members)
    logits = scores[:, :f] * np.minimum(n, 60)[:, None]  # beyond 60 n-grams, dependent as they are, no surer
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    for k, (family, own) in enumerate(members.items()):
        rows = np.flatnonzero(best == k)
        wins, margin, sure = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own))), np.ones((len(rows), len(own)))
        for j, (g, a, b) in enumerate(model["pairs"]):
            if g == family:
                s, a, b = scores[rows, f + j], own.index(a), own.index(b)
                wins[:, b] += s > 0
                wins[:, a] += s <= 0
                margin[:, b] += s
                margin[:, a] -= s
                q = 1 / (1 + np.exp(-np.clip(2 * s, -30, 30)))
                sure[:, b] = np.minimum(sure[:, b], q)
                sure[:, a] = np.minimum(sure[:, a], 1 - q)
        top = (wins + 1e-3 * np.tanh(margin)).argmax(axis=1)
        out[rows] = np.array(own, object)[top]
        score[rows] = p[rows, k] * sure[np.arange(len(rows)), top]
    return out.tolist(), score


def has_letter(column: pa.Array) -> np.ndarray:
    data, offsets = utf8(column)
    letter = _FOLD[data] != 32
    ascii_letter = letter & (data < 128)
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
    out = sums(ascii_letter) > 0
    for i in np.flatnonzero(~out & (sums(letter) > 0)):
        out[i] = any(c.isalpha() for c in column[int(i)].as_py())
    return out


def fit(labelled: DataFrame, per_language: int = 300, max_rows: int = 2000, max_languages: int = 1000,
        families: dict[str, tuple[str, ...]] = FAMILIES) -> dict:
    """``labelled``: doc_id, text, lang (rows without one are left out).  Learns the ``max_languages`` most frequent
    labels.  The sample's rows come to the driver as count vectors: at most about ``max_rows`` x ``BUCKETS`` floats."""
    rows = labelled.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).select(F.col("lang").alias("l"), "n")
    wanted = min(per_language, max(1, max_rows // max(1, sizes.count())))
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("language")), 11)) / float(1 << 53)
    sample = rows.withColumn("_u", u).join(F.broadcast(sizes), F.col("lang") == F.col("l")).where(F.col("_u") * F.col("n") < wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, n in slices(b.column(1), 64):
                part = b.slice(k, n)
                counts = gram_counts(part.column(1))
                ok = counts.sum(axis=1) > 0
                blobs = [c.tobytes() for c in counts[ok]]
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(ok)), pa.array(blobs, pa.binary())], ["lang", "counts"])

    got = sample.select("lang", "text", "_u").mapInArrow(run, "lang string, counts binary").collect()
    got = sorted((r[0], bytes(r[1])) for r in got)
    counts = np.frombuffer(b"".join(c for _, c in got), np.float32).reshape(-1, BUCKETS) if got else np.zeros((0, BUCKETS), np.float32)
    return train(counts, [lang for lang, _ in got], families)


def _predict_rows(column: pa.Array, model: dict) -> tuple[list[str], np.ndarray]:
    langs, score = predict(model, column)
    known = has_letter(column)
    return [x if k else UNDETERMINED for x, k in zip(langs, known)], np.where(known, score, 0.0)


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (0 to 1)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, n in slices(b.column(1)):
                part = b.slice(k, n)
                langs, score = _predict_rows(part.column(1), sent.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def known_language(docs: DataFrame, model: dict, min_score: float = 0.0) -> DataFrame:
    """``docs`` without the rows whose language is undetermined or less certain than ``min_score``.  A model that
    knows no language can't tell: then every text with a letter stays."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, n in slices(b.column(at)):
                part = b.slice(k, n)
                if not sent.value["members"]:
                    yield part.filter(pa.array(has_letter(part.column(at))))
                    continue
                langs, score = _predict_rows(part.column(at), sent.value)
                yield part.filter(pa.array([x != UNDETERMINED and s >= min_score for x, s in zip(langs, score)], pa.bool_()))

    return map_whole_rows(docs, run)


def held_out() -> Column:
    """Rows that the registered query and the pipeline never learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    found = identify(docs, fit(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
