"""Tokenizer alignment, hard negatives and the quality classifier against plain Python."""
import bisect
import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabscope.llm import alignment, hard_negatives, quality_classifier

from .plain import SF, words

# -- tokenizer alignment ----------------------------------------------------------------------------------------

TEXTS = [None, "", " ", "  a b▁c", "<s> <|endoftext|> <unk> x", "日本語のテキスト 😀👩‍👩‍👧 ok", "\n\n\t tab   spaces     \r\n" + "=" * 100, "a" * 3000, "x\x00y é́ ​ ﻿",
         "ﬁ ① Ω  № ", " leading", " nb\u0085 x　y", "١٢٣ ४५ ⅷ", "ǅ ſ ŉ", "the same", "the same", "0x" + "9f3a" * 500]


def plain_alignment(rows):
    """The contract's columns by token loops, from the libraries that the files are for."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{alignment.TOKENIZERS}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.TOKENIZERS}/piece_bpe_32k.model")
    chars = alignment._byte_of_char()

    def bytes_a(i):
        return bytes(chars[c] for c in a.id_to_token(i))

    def bytes_b(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    links, out, held = [], [], Counter()
    for i, t in rows:
        ia, ib = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        if not t or b"".join(map(bytes_a, ia)) != (" " + t).encode() or b"".join(map(bytes_b, ib)) != (" " + t).encode():
            ia = ib = []
        ea, eb = (np.cumsum([len(f(x)) for x in ids]).tolist() for f, ids in ((bytes_a, ia), (bytes_b, ib)))
        cuts = sorted(set(ea) & set(eb))
        groups = [([], []) for _ in cuts]
        for side, ids, ends in ((0, ia, ea), (1, ib, eb)):
            for x, e in zip(ids, ends):
                groups[bisect.bisect_left(cuts, e)][side].append(x)
        own = Counter((x, y) for p, q in groups for x in p for y in q)
        held.update(own.keys())
        links.append(own)
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append([i, len(ia), len(ib), len(groups), sum(own.values()), hashlib.sha256(said.encode()).hexdigest() if ia else ""])
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return sorted((*o[:5], sum(t for k, t in own.items() if held[k] == best[k[0]]), sum(t * held[k] for k, t in own.items()), o[5]) for o, own in zip(out, links))


@pytest.mark.parametrize("chunk_bytes", [500, alignment.CHUNK_BYTES])
def test_alignment_is_the_plain_one(spark, chunk_bytes):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    d = d.union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"))
    got = alignment.align_report(d.withColumns({"n_a": F.lit("clash"), "chunk": F.lit(1), "pairs": F.lit(2)}), chunk_bytes=chunk_bytes)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == plain_alignment([tuple(r) for r in d.collect()])


def test_pairs_of_small_and_large_groups():
    """Groups of one token on either side, of one and many, and of many, against all pairs of tokens one by one."""
    spelt = pa.array([b" ", b"a", b"b", b" a", b"ab", b"bb"], pa.binary())
    code = {x: i for i, x in enumerate([" ", "a", "b", " a", "ab", "bb"])}

    def greedy(*tokens):
        def one(t):
            out = []
            while t:
                x = next(x for x in tokens if t.startswith(x))
                out.append(code[x])
                t = t[len(x):]
            return out
        return lambda texts: [one(" " + t) for t in texts]

    a, b = (greedy(" ", "a", "b"), spelt), (greedy(" a", "ab", "bb", " ", "a", "b"), spelt)
    texts = ["b b b b", "ab", "bbb", "b", None, "", "aab abb"]

    def pairs(c):
        pair, held = (x.to_pylist() for x in c["pairs"])
        return [sorted((pair[i], n) for i, n in zip(x, y)) for x, y in zip(c["at"].to_pylist(), c["times"].to_pylist())], sorted(zip(pair, held))

    got = pairs(alignment.align(texts, a, b))
    per, docs = [], Counter()
    for t in texts:
        links = Counter()
        if t:
            ends = []
            for enc, _ in (a, b):
                at, own = 0, []
                for i in enc([t])[0]:
                    at += len(spelt[i].as_py())
                    own.append((at, i))
                ends.append(own)
            cuts = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
            for x, i in ends[0]:
                for y, j in ends[1]:
                    if bisect.bisect_left(cuts, x) == bisect.bisect_left(cuts, y):
                        links[(i << 32) + j] += 1
        per.append(sorted(links.items()))
        docs.update(links.keys())
    assert got == (per, sorted(docs.items()))


def test_alignment_edges(spark):
    rows = [(None, "one two"), ("k", "one two"), ("k", "one two"), ("e", None), ("f", "")]
    got = alignment.align_report(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r.doc_id or "", r.n_a, r.count_sum) for r in got) == [("", 2, 6), ("e", 0, 0), ("f", 0, 0), ("k", 2, 6), ("k", 2, 6)]
    assert alignment.align_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_text_aligns_whole(spark):
    text = " ".join(random.Random(1).choice(["alpha", "Beta,", "γάμμα", "12345", "\n"]) for _ in range(60_000))
    got = alignment.align_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert tuple(got) == plain_alignment([(1, text)])[0]


def test_both_libraries_split_latin_texts_alike():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(f"{alignment.TOKENIZERS}/byte_bpe_50k.json")
    whole.encode_special_tokens = True
    encode, _ = alignment.byte_level(f"{alignment.TOKENIZERS}/byte_bpe_50k.json")
    texts = [f.replace("%", chr(c)) for c in range(alignment._ALIKE + 1) for f in ("a%b", "1%2", " % ", "%% x", "\n%a", "  %", "'%s", "s'% ")]
    assert encode(texts) == [e.ids for e in whole.encode_batch([" " + t for t in texts], add_special_tokens=False)]


# -- hard negatives ---------------------------------------------------------------------------------------------

def plain_negatives(rows, every, positives=5, negatives=3):
    """rows: (id, label, vector or None); as the contract reads."""
    v = [(i, lab, [math.floor(256 * x) for x in vec]) for i, lab, vec in rows
         if i is not None and lab is not None and vec is not None and all(x is not None and math.isfinite(x) for x in vec)]
    out = []
    for i, lab, vec in {(i, lab, tuple(x)): (i, lab, x) for i, lab, x in v}.values():
        if i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(vec, w)), j, same == lab) for j, same, w in v if j != i)
        for ps, p, _ in [s for s in scored if s[2]][:positives]:
            near = [s for s in scored if not s[2] and -50 * ps <= -100 * s[0] <= -95 * ps][:negatives]
            out += [(i, p, k, n, -ps, -ns) for k, (ns, n, _) in enumerate(near, 1)]
    return sorted(out)


def mine(spark, rows, every=5, **k):
    d = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({"unit": F.lit("clash"), "cell": F.lit(0)})
    return sorted(map(tuple, hard_negatives.hard_negatives(d, F.col("vec_id") % every == 0, **k).collect()))


def clustered(n=400, dim=8, seed=3):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((6, dim))
    return [(i, int(r.integers(4)), [float(np.float32(x)) for x in centres[r.integers(6)] + 0.2 * r.standard_normal(dim)]) for i in range(n)]


@pytest.mark.parametrize("cell", [1024, 8])
def test_negatives_are_the_plain_ones(spark, monkeypatch, cell):
    """Also with many small cells, blocks of a few rows, and several rounds."""
    if cell == 8:
        for name, value in (("CELL", 4), ("BLOCK", 7), ("FIRST", 1)):
            monkeypatch.setattr(hard_negatives, name, value)
    rows = clustered()
    assert mine(spark, rows, 10) == plain_negatives(rows, 10)


def test_a_vector_held_by_a_third_of_the_rows(spark):
    rows = clustered(150)
    hot = rows[0][2]
    rows = [(i, i % 2 if i % 3 == 0 else lab, hot if i % 3 == 0 else vec) for i, lab, vec in rows]
    assert mine(spark, rows, 5) == plain_negatives(rows, 5)


def test_negative_edges(spark):
    good = clustered(60)
    odd = [(None, 1, [1.0] * 8), (70, None, [1.0] * 8), (71, 1, None), (72, 1, [None] + [1.0] * 7), (73, 1, [float("nan")] * 8), (74, 1, [float("inf")] * 8), (75, 1, [1.0] * 3), (76, 2, [])]
    assert mine(spark, good + odd + good[:10]) == plain_negatives(good, 5)
    assert mine(spark, odd) == [] and mine(spark, []) == []
    assert mine(spark, [(i, 1, [1.0, 2.0]) for i in range(20)]) == []
    assert mine(spark, [(i, i % 2, [1.0]) for i in range(6)]) == plain_negatives([(i, i % 2, [1.0]) for i in range(6)], 5)
    huge = [(i, i % 2, [float(np.float32(3e38)), float(i)]) for i in range(6)]
    assert all(r[4] > 0 for r in mine(spark, huge))


def test_cells_come_in_falling_order_of_their_bounds():
    r = np.random.default_rng(0)
    a, b = r.standard_normal(9), r.standard_normal(7)
    got = list(hard_negatives.in_order(a, b))
    assert len({(i, j) for _, i, j in got}) == 63 and [x for x, _, _ in got] == sorted((x for x, _, _ in got), reverse=True)
    assert all(x == a[i] + b[j] for x, i, j in got)


def test_bounds_part_clustered_cells(spark):
    """On clusters the search reads a part of the cells and still certifies every window."""
    r = np.random.default_rng(1)
    centres = 4 * r.standard_normal((8, 16))
    x = np.rint(256 * (centres[np.arange(800) % 8] + 0.01 * r.standard_normal((800, 16))))
    books = [hard_negatives.codebook(x[:, :8], 8), hard_negatives.codebook(x[:, 8:], 8)]
    own = [hard_negatives._closest(p, b) for p, b in zip((x[:, :8], x[:, 8:]), books)]
    far = [np.sqrt(np.square(p - b[o]).sum(1)) for p, b, o in zip((x[:, :8], x[:, 8:]), books, own)]
    radii = [np.array([f[o == k].max() for k in range(8)]) for f, o in zip(far, own)]
    cell = own[0] * 8 + own[1]
    present = np.unique(cell)
    m = {"dim": 16, "books": books, "radii": radii, "cell": present, "r1": np.array([far[0][cell == c].max() for c in present]), "r2": np.array([far[1][cell == c].max() for c in present])}
    scores = x[0] @ x.T
    need = np.sort(scores)[-50]
    cells, bound = hard_negatives.visits(x[0], int(need), 1 << 62, m, 0, 100)
    assert set(cell[scores >= need]) <= set(cells) and len(cells) < len(present)


# -- quality classifier -----------------------------------------------------------------------------------------

def test_statistics_are_the_plain_ones():
    texts = ["", "The cat, THE cat.\nThe end!\nThe end!", " \t\n", "a", "### a# $1 é ß\n\nx y z x y z x y z", "Ünïcode über alles 123 123 123"]
    got = quality_classifier.statistics(pa.array(texts))
    for t, row in zip(texts, got):
        s, b, w = dict(zip(quality_classifier.STATISTICS, row)), t.encode(), [x.encode() for x in words(t)]
        low = [x.lower() for x in w]
        marks = set(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        lines = [x for x in b.split(b"\n") if x]
        grams = Counter(zip(low, low[1:], low[2:]))
        n, size, rows = max(1, len(w)), max(1, len(b)), max(1, len(lines))
        want = {
            "log_bytes": math.log1p(len(b)), "log_words": math.log1p(len(w)), "word_bytes": sum(map(len, w)) / n, "word_bytes_deviation": float(np.std([len(x) for x in w] or [0])),
            "log_longest_word": math.log1p(max(map(len, w), default=0)), "upper": sum(65 <= c <= 90 for c in b) / size, "digits": sum(48 <= c <= 57 for c in b) / size,
            "marks": sum(c in marks for c in b) / size, "symbols": sum(c in b"#*$%&|<>" for c in b) / size, "commas_stops": sum(c in b".,;:" for c in b) / size,
            "exclamations": b.count(b"!") / size, "spaces": sum(c in b" \t\n\x0b\x0c\r" for c in b) / size, "beyond_ascii": sum(c > 127 for c in b) / size,
            "distinct_words": len(set(low)) / n, "repeated_trigrams": sum(c for c in grams.values() if c > 1) / n, "same_as_last_word": sum(x == y for x, y in zip(low, low[1:])) / n,
            "most_frequent_word": max(Counter(low).values(), default=0) / n, "capitalized_words": sum(65 <= x[0] <= 90 for x in w) / n, "words_ending_in_marks": sum(x[-1] in marks for x in w) / n,
            "words_of_marks": sum(all(c in marks for c in x) for x in w) / n, "words_per_line": math.log1p(len(w) / rows), "distinct_lines": len(set(lines)) / rows,
            "lines_ending_in_marks": sum(x[-1] in marks for x in lines) / rows}
        assert list(want) == list(quality_classifier.STATISTICS) and s == pytest.approx(want, abs=1e-9), t


def plain_isotonic(n, y):
    """Least squares under order, by the greatest of the least averages."""
    out = []
    for i in range(len(n)):
        out.append(max(min(sum(y[a:b]) / sum(n[a:b]) for b in range(i + 1, len(n) + 1)) for a in range(i + 1)))
    return out


def test_isotonic_is_the_plain_one():
    r = random.Random(2)
    for _ in range(50):
        n = [r.randint(1, 5) for _ in range(r.randint(1, 12))]
        y = [r.randint(0, k) for k in n]
        x = np.arange(len(n), dtype=float)
        at, rate = quality_classifier.isotonic(x, np.array(n, float), np.array(y, float))
        want = plain_isotonic(n, y)
        assert sorted(set(np.round(rate, 9))) == sorted(set(np.round(want, 9))) and (np.diff(rate) > 0).all() and (np.diff(at) > 0).all()


def test_equations_and_ridge_are_the_plain_ones(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    stats = quality_classifier.text_statistics(docs).cache()
    m = quality_classifier._standard(stats, 16, 0.5, 4.0, 13)
    rows = stats.join(labels.groupBy("doc_id").agg(F.avg("quality").alias("y")), "doc_id").withColumn("fold", (F.col("doc_id") % 3).cast("int")).collect()
    got = quality_classifier._equations(spark.createDataFrame([(r.x, r.y, r.fold) for r in rows], "x array<double>, y double, fold int").repartition(5), m, 3)
    everything = np.array([r.x for r in stats.collect()])
    assert np.allclose(m["mean"], everything.mean(0), atol=1e-6)
    for f in range(3):
        own = [r for r in rows if r.fold == f]
        z = np.hstack([quality_classifier.fourier(m, np.array([r.x for r in own])), np.array([[r.y] for r in own])])
        assert np.allclose(got[f], z.T @ z, atol=1e-4)
    whole = got.sum(0)
    z = np.hstack([quality_classifier.fourier(m, np.array([r.x for r in rows])), np.array([[r.y] for r in rows])])
    damp = np.diag([1.0] * 16 + [1e-6])
    assert np.allclose(quality_classifier._ridge(whole, 1.0), np.linalg.solve(z[:, :-1].T @ z[:, :-1] + damp, z[:, :-1].T @ z[:, -1]), atol=1e-4)


def test_cosines_approximate_the_gaussian_kernel():
    r = np.random.default_rng(5)
    d, features, width = len(quality_classifier.STATISTICS), 20_000, 0.5
    m = {"mean": np.zeros(d), "deviation": np.ones(d), "clip": 9.0, "w": r.standard_normal((d, features)) / (width * np.sqrt(d)), "b": r.uniform(0, 2 * np.pi, features)}
    x = 0.3 * r.standard_normal((10, d))
    z = quality_classifier.fourier(m, x)[:, :-1]
    assert np.allclose(z @ z.T, np.exp(-np.square(x[:, None] - x[None]).sum(2) / (2 * width * width * d)), atol=0.05)


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    report = quality_classifier.quality_report(docs, labels).cache()
    assert report.count() == docs.count() and report.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    rows = report.where("held_out").join(labels, "doc_id").collect()
    low, high = [r for r in rows if not r.quality], [r for r in rows if r.quality]
    assert sum(r.predicted == 0 for r in low) >= 0.8 * len(low) and sum(r.predicted == 0 for r in high) <= 0.02 * len(high)
    again = {r.doc_id: r.score for r in quality_classifier.quality_report(docs.repartition(7), labels).collect()}
    assert max(abs(again[r.doc_id] - r.score) for r in report.collect()) < 1e-3


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "a b c"), (4, "a b c"), (None, "x"), (5, "y " * 50_000)], "doc_id long, text string")
    docs = docs.withColumns({"quality": F.lit("clash"), "x": F.lit(0), "y": F.lit(0)})
    for rows, want in (([], 0.5), ([(1, None), (None, 1), (77, 0)], 0.5), ([(4, 1), (1, 1), (2, 1), (3, 1), (5, 1)], 1.0)):
        got = quality_classifier.quality_report(docs, spark.createDataFrame(rows, "doc_id long, quality int")).collect()
        assert len(got) == 7 and {r.score for r in got} == {want} and {r.predicted for r in got} == {1}
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4, 5) for _ in range(2)], "doc_id long, quality int")
    stats = quality_classifier.text_statistics(docs)
    got = quality_classifier.score(stats, quality_classifier.fit(stats, labels)).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.quality_report(docs.limit(0), labels).collect() == []
