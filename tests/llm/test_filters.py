"""Mixing, quality rules, language ID, decontamination and the pipeline against plain Python."""
import math
import random
import zlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tabscope.llm import decontaminate, langid, mixing, quality

from .plain import DOCS, SF, docs_of, keep_lines, plain_counts, plain_fingerprint, plain_groups, shingles


# -- mixing ---------------------------------------------------------------------------------------------------

def plain_targets(sizes, share=1.5, weights=(5, 2, 1), epochs=2):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    left = share * sum(sizes.values())
    while open_ and left > 1e-9:
        total, over = sum(w[s] for s in open_), set()
        for s in open_:
            if left * w[s] / total > epochs * sizes[s]:
                over.add(s)
        if not over:
            for s in open_:
                target[s] = left * w[s] / total
            break
        for s in over:
            target[s] = float(epochs * sizes[s])
        left = share * sum(sizes.values()) - sum(target[s] for s in names if s not in open_ - over)
        open_ -= over
    return target


def plain_mix(rows):
    sizes = defaultdict(int)
    n_words = lambda t: len((t or "").encode().split())
    for _, s, t in rows:
        sizes[s] += n_words(t)
    target, out = plain_targets(sizes), []
    for s in sizes:
        def key(r):
            t = r[2] or ""
            n = sum(c not in mixing.SPACES for c in t)
            clean = sum(c not in mixing.SPACES + mixing.MARKUP for c in t)
            own, lines = t.encode().split(), [x for x in t.split("\n") if x.encode().split()]
            w = 1.0
            if n:
                w += 3 * ((clean / n) ** 2 * (len(set(lines)) / len(lines)) * min(1.0, len(set(own)) / (4.0 * math.sqrt(len(own)))))
            # Spark's hash of a long, a string and an int: each takes the one before as its seed
            h = xxhash.xxh64_intdigest(r[0].to_bytes(8, "little", signed=True), 42)
            h = xxhash.xxh64_intdigest(t.encode(), h)
            h = xxhash.xxh64_intdigest((42).to_bytes(4, "little"), h)
            return -math.log(((h >> 11) + 0.5) / (1 << 53)) / w
        budget = math.floor(target[s] + 0.5)
        epochs, rest = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        for r in sorted((r for r in rows if r[1] == s), key=lambda r: (key(r), r[0])):
            part = min(n_words(r[2]), max(0, rest))
            rest -= part
            out.append((r[0], n_words(r[2]), sizes[s], epochs * n_words(r[2]) + part))
    return target, sorted(out)


@pytest.mark.parametrize("bucket_rows", [3, 500])
def test_mix_is_the_plain_one(spark, bucket_rows):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", "b", "b", "c", "d", None]), " ".join(["w#", "x"][:1 + i % 2] * rng.choice([0, 1, 3, 40]))) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), bucket_rows=bucket_rows)
    target, want = plain_mix(rows)
    assert sorted((r.doc_id, r["size"], r.source_size, r.taken) for r in got.collect()) == want
    for r in got.select("source", "target").distinct().collect():
        assert r.target == pytest.approx(target[r.source], rel=1e-9)


def test_rows_of_one_id_have_keys_of_their_own(spark):
    """Null ids that fill most of a source: the mix takes some of their rows, not all or none by one key."""
    rows = [(None if i % 3 else i, "s" if i < 3000 else "t", f"own words number {i} here") for i in range(3600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), max_epochs=1, share=0.5, weights=(1,), bucket_rows=100)
    taken = got.where("source = 's' AND doc_id IS NULL").groupBy((F.col("taken") > 0).alias("t")).count().collect()
    assert len(taken) == 2 and min(r["count"] for r in taken) > 200
    sums = got.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("w")).collect()
    assert all(abs(r.t - r.w) <= 0.5 for r in sums)


def test_weights_put_prose_first(spark):
    prose = " ".join(f"word{i}" for i in range(120))
    texts = [prose, "spam ham " * 60, "same line of words\n" * 40, "# $ | < > " * 30 + prose, "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("w", F.array_remove(F.split(F.coalesce("text", F.lit("")), r"\s+"), ""))
    got = [r[0] for r in d.orderBy("doc_id").select(mixing.quality_weight(F.coalesce("text", F.lit("")), F.col("w"))).collect()]
    assert got[0] == 4.0 and all(1.0 <= x < 3.5 for x in got[1:]) and got[4:] == [1.0, 1.0]


def test_quality_weight_reads_no_text_character_by_character(spark):
    """The weights of a translation to nothing, without one."""
    texts = ["", " \n\t\n", "a\\b^[x] é#€ \x1c  \n \n \x0b\nq", "\n\n[[]]\n[[]]", "".join(mixing.MARKUP), "plain words\nplain words\r\nplain words", "😀 {x} \x85 _~"]
    t = F.col("t")
    d = spark.createDataFrame([(x,) for x in texts], "t string").withColumn("w", F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), ""))
    own = mixing.quality_weight(t, F.col("w"))
    assert "translate(" not in d.select(own)._jdf.queryExecution().analyzed().toString()
    n, clean = F.length(F.translate(t, mixing.SPACES, "")), F.length(F.translate(t, mixing.SPACES + mixing.MARKUP, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, mixing.SPACES, "")) > 0)
    rich = F.least(F.lit(1.0), F.size(F.array_distinct("w")) / (mixing.VOCABULARY * F.sqrt(F.size("w"))))
    want = F.when(n > 0, 1 + 3 * (F.pow(clean / n, F.lit(2.0)) * (F.size(F.array_distinct(lines)) / F.size(lines)) * rich)).otherwise(F.lit(1.0))
    assert all(a == b for a, b in d.select(own, want).collect())


def test_mix_edges(spark):
    d = spark.createDataFrame([(1, None, None), (2, "s", ""), (3, "s", "a b"), (3, "s", "a b"), (None, "t", "x y z")], "doc_id long, source string, text string")
    got = mixing.mix(d.withColumn("target", F.lit("clash")).withColumn("bucket", F.lit(1)))
    assert got.count() == 5
    sums = {r.source: (r.t, r.w) for r in got.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("w")).collect()}
    assert all(abs(t - w) <= 0.5 for t, w in sums.values()) and sums[None] == (0.0, 0)
    assert got.where("taken > 2 * size").count() == 0
    assert mixing.mix(d.limit(0)).collect() == []


# -- quality ------------------------------------------------------------------------------------------------

def test_counts_are_the_plain_ones(spark):
    rng = random.Random(1)
    texts = [None, "", " \t ", "a", "a b", "a b c", "a b c a b c", "x " * 5000, "é\x0bé é\né é é\né é é\n\n", "# $\n# $\n", "a b c\r\nd"]
    texts += [" ".join(rng.choice("ab\nc#é") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("x")).withColumn("source", F.lit("y"))
    got = {r.doc_id: r for r in quality.text_counts(d).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, repeat = plain_counts(t or "")
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), t


def test_quality_keeps_prose_and_drops_junk(spark):
    rng = random.Random(2)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(120))
    rows = [(i, prose(), "en", "s" if i % 2 else None) for i in range(200)]
    rows += [(200 + i, " ".join(w + "###$$$" for w in prose().split()), "en", "s") for i in range(5)]
    rows += [(300, "one two", "en", "s"), (301, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_words", F.lit("clash"))
    got = {r.doc_id: r for r in quality.quality_rules(d).collect()}
    assert len(got) == 207 and all(got[i].kept for i in range(200))
    assert not any(got[i].kept or got[i].base_failed for i in range(200, 205))
    assert got[300].base_failed and got[301].base_failed and not got[301].kept
    assert quality.quality_rules(d.limit(0)).collect() == []


def test_each_ratio_rejects_its_junk_and_verdicts_are_the_plain_ones(spark):
    """Groups of fewer than the sketch's size have exact quantiles; junk of each of the four kinds, clean rows with what chance brings."""
    rng = random.Random(9)
    word = lambda a, b: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(a, b)))
    prose = lambda n=120, a=2, b=9: [word(a, b) for _ in range(n)]
    rows = []
    for g, n in (("s", 150), ("t", 150), (None, 12)):
        for i in range(n):
            w = prose()
            text = " ".join(w[:60]) + "\n" + " ".join(w[60:])
            text += {0: " $5 100%", 1: "\n" + " ".join(w[:12]), 2: "\nsame line here\nsame line here"}.get(i % 20, "")
            rows.append((text, g, True))
    for g in ("s", "t"):
        rows += [(" ".join(x + "#$" for x in prose()), g, False), ("\n".join(["home page", "log in"] * 9 + [" ".join(prose(90))]), g, False),
                 (" ".join([*prose(100), *((prose(30)) * 3)]), g, False), (" ".join(prose(80, 14, 18)), g, False), (" ".join(prose(120, 1, 1)), g, False)]
    d = spark.createDataFrame([(i, t, "en", g) for i, (t, g, _) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.quality_rules(d).collect()}
    assert all(got[i].kept for i, (_, _, clean) in enumerate(rows) if clean)
    assert not any(got[i].kept for i, (_, _, clean) in enumerate(rows) if not clean) and sum(not r.base_failed and not r.kept for r in got.values()) >= 8

    def ratios(t):
        n, chars, symbols, dup, repeat = plain_counts(t)
        lines = len([x for x in t.split("\n") if x.strip()])
        return max(0, symbols - 2) / n, max(0, dup - 2) / lines, max(0, repeat - 40) / n, chars / n

    def quantile(v, q):
        return sorted(v)[max(0, -(-int(q * 1000) * len(v) // 1000) - 1)]

    passed = [i for i in got if not got[i].base_failed]
    everything = [ratios(rows[i][0]) for i in passed]
    for i in passed:
        own = [x for x, j in zip(everything, passed) if rows[j][1] == rows[i][1]]
        own = own if len(own) >= 50 else everything
        ok = True
        for k, (x, margin) in enumerate(zip(ratios(rows[i][0]), (0.02, 0.02, 0.02, 0.1))):
            low, middle, high = (quantile([o[k] for o in own], q) for q in (0.1, 0.5, 0.9))
            ok &= x <= high + 3 * (high - middle) + margin and (k < 3 or x >= low - 3 * (middle - low) - margin)
        assert ok == got[i].kept, rows[i]


# -- language ID ----------------------------------------------------------------------------------------------

def test_languages_of_held_out_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.language_report(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == d.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "123 ... €", "en"), (4, "the cat sat on the mat and the dog", "en"), (5, "der Hund und die Katze sind im Haus", "de"),
            (6, "你好", None), (4, "the cat sat on the mat and the dog", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("clash"), "a.b": F.lit(1)})
    model = langid.fit(d)
    got = sorted((r.doc_id, r.lang_pred) for r in langid.identify(d, model).collect())
    assert got[0] == (1, "und") and got[1] == (2, "und") and got[2] == (3, "und") and got[3] == got[4] == (4, "en") and got[5] == (5, "de")
    assert got[6][1] in ("en", "de")
    kept = langid.known_language(d, model)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [4, 4, 5, 6]
    nothing = langid.fit(d.limit(0))
    assert {r.lang_pred for r in langid.identify(d, nothing).collect()} == {"und"}
    assert sorted(r.doc_id for r in langid.known_language(d, nothing).collect()) == [4, 4, 5, 6]  # what can't be told stays
    assert langid.identify(d.limit(0), model).collect() == []


def test_ngrams_do_not_depend_on_chunks(monkeypatch):
    import numpy as np
    import pyarrow as pa
    texts = pa.array(["Grüße aus dem Süden, 12 Äpfel", None, "x", "", "the end of it all " * 50])
    whole = langid.gram_counts(texts)
    monkeypatch.setattr(langid, "_CHUNK", 37)
    assert np.array_equal(whole, langid.gram_counts(texts))


def plain_buckets(text):
    """The buckets of a text's n-grams, one by one."""
    folded = [b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalpha() else b for b in (text or "").encode()]
    out = []
    for n in langid.GRAMS:
        for k in range(len(folded) - n + 1):
            if folded[k:k + 2] != [32, 32]:
                code = n
                for b in folded[k:k + n]:
                    code = (code * 0x01000193 & 0xFFFFFFFF) ^ b
                code ^= code >> 15
                out.append((code * 0x2C1B3C6D & 0xFFFFFFFF) >> (32 - 13))
    return out


def plain_language(model, text):
    """Family by the largest posterior, then the language with most pairwise wins (ties: the larger sum of margins)."""
    grams = plain_buckets(text)
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    mean = [sum(float(w[g]) for g in grams) / max(1, len(grams)) + float(b) for w, b in zip(model["weights"], model["bias"])]
    families = list(model["members"])
    logits = [x * min(len(grams), 60) for x in mean[:len(families)]]
    odds = [math.exp(x - max(logits)) for x in logits]
    best = max(range(len(families)), key=lambda k: odds[k])
    own = model["members"][families[best]]
    wins, margins, sure = {x: 0 for x in own}, {x: 0.0 for x in own}, {x: 1.0 for x in own}
    for (family, a, b), s in zip(model["pairs"], mean[len(families):]):
        if family == families[best]:
            wins[b if s > 0 else a] += 1
            for lang, side in ((a, -s), (b, s)):
                margins[lang] += side
                sure[lang] = min(sure[lang], 1 / (1 + math.exp(-max(-30, min(30, 2 * side)))))
    lang = max(own, key=lambda x: (wins[x], margins[x]))
    return lang, odds[best] / sum(odds) * sure[lang]


def test_predictions_are_the_plain_ones(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "12 ... 34"), (-4, "A"), (-5, "  the   END \t of it  "), (-6, "Größe " * 3000)], "doc_id long, text string")
    # three languages of one family, so that votes and margins decide
    model = langid.fit(d.where(~langid.held_out()), families={"all": ("en", "de", "fr", "es", "it")})
    assert len(model["pairs"]) >= 3
    for m in (model, langid.fit(d.where(~langid.held_out()))):
        rows = d.select("doc_id", "text").union(odd)
        got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(rows, m).collect()}
        short = [r for r in rows.collect() if len(r.text or "") < 20_000]
        for r in short:
            lang, score = plain_language(m, r.text)
            assert got[r.doc_id][0] == lang and got[r.doc_id][1] == pytest.approx(score, rel=1e-3, abs=1e-6), r.doc_id


# -- decontamination --------------------------------------------------------------------------------------------

def test_matches_are_the_plain_ones(spark):
    d, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    wanted = {(r.item_id): shingles(r.text) for r in items.collect()}
    want = set()
    for doc, text in docs_of(d):
        own = shingles(text)
        want |= {(doc, i) for i, s in wanted.items() if s and len(s & own) / len(s) >= 0.8}
    got = decontaminate.matches(d, items, block_items=7)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and want
    clean = decontaminate.decontaminate(d, items)
    assert clean.columns == d.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs_of(d)} - {a for a, _ in want}


def test_short_items_are_looked_up_at_their_length(spark):
    items = spark.createDataFrame([(1, "Two plus\ttwo"), (2, "yes"), (3, "a b c d"), (4, ""), (5, None), (6, "one two three four five")], "item_id long, text string")
    rows = [(1, "so two plus two is four"), (2, "two plus"), (3, "YES"), (4, "a b c e"), (5, "x a  b\nc d y"), (6, "One two three four five six"), (7, None), (8, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.containment) for r in decontaminate.matches(d, items, block_items=2).collect()) == [(1, 1, 1.0), (3, 2, 1.0), (5, 3, 1.0), (6, 6, 1.0)]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(d, items).collect()) == [2, 4, 7, 8]


def test_sql_of_decontamination_knows_short_items(spark):
    import duckdb

    from tabscope.llm.entry_queries import oracle_sql

    items = [(1, "two plus two"), (2, "yes"), (3, "a b c d"), (4, ""), (5, None), (6, "one two three four five six seven")]
    rows = [(1, "so two plus two is four"), (2, "two plus"), (3, "YES"), (4, "a b c e"), (5, "x a  b\nc d y"), (6, "One two three four five six"), (7, None), (8, "yes two plus two yes")]
    con = duckdb.connect()
    for name, key, data in (("documents", "doc_id", rows), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", data)
    want = sorted(con.execute(oracle_sql()["op6_benchmark_decontamination"]).fetchall())
    got = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == want and len(want) == 5


def test_partial_containment_is_exact(spark):
    rng = random.Random(3)
    item = [f"w{i}" for i in range(24)]  # 20 shingles
    rows = []
    for i in range(200):
        cut = rng.randint(0, 12)
        filler = [f"f{rng.randint(0, 10**6)}" for _ in range(rng.choice([0, 5000]))]
        rows.append((i, " ".join([*filler, *item[cut:], "x", *item[: rng.randint(0, 8)], *filler])))
    rows += [(900, None), (901, ""), (902, "w0 w1"), (None, " ".join(item).upper())]
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "w0 w0")], "item_id long, text string")
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item_id": F.lit("clash"), "a.b": F.lit(1)})
    s = shingles(" ".join(item))
    want = sorted((str(i), 1, len(s & shingles(t or "")) / len(s)) for i, t in rows if len(s & shingles(t or "")) / len(s) >= 0.8)
    assert sorted((str(r.doc_id), r.item_id, r.containment) for r in decontaminate.matches(d, items).collect()) == want
    assert 0 < len(want) < 200
    assert decontaminate.decontaminate(d, items).count() == len(rows) - len(want)
    assert decontaminate.matches(d, items.limit(0)).count() == 0 == decontaminate.matches(d.limit(0), items).count()


# -- the pipeline ----------------------------------------------------------------------------------------------

def test_pipeline_stages_are_the_plain_ones(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12345", None, None, 5), (10**6 + 2, DOCS, "en", "src0", len(DOCS))],
                                "doc_id long, text string, lang string, source string, n_chars long")
    docs = d.union(odd)
    by_name = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]
    one = by_name["language_id"](spark, docs, SF).cache()
    assert set(docs_of(docs)) - set(docs_of(one)) == {(10**6, None), (10**6 + 1, "12345")}
    two = by_name["line_dedup"](spark, one, SF).cache()
    assert dict(docs_of(two)) == keep_lines(dict(docs_of(one)))
    assert two.where("n_chars != length(text)").count() == 0
    three = by_name["simhash_near_dedup"](spark, two, SF).cache()
    groups = plain_groups({i: plain_fingerprint(t) for i, t in docs_of(two)})
    assert {i for i, _ in docs_of(three)} == {i for i, g in groups.items() if i == g}
    four = by_name["benchmark_decontamination"](spark, three, SF).cache()
    wanted = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {i for i, t in docs_of(three) if any(s and len(s & shingles(t)) / len(s) >= 0.8 for s in wanted)}
    assert {i for i, _ in docs_of(four)} == {i for i, _ in docs_of(three)} - dirty and dirty
    for x in (one, two, three, four):
        assert x.columns == d.columns
    five = by_name["source_mixing"](spark, four, SF)
    _, want = plain_mix([(r.doc_id, r.source, r.text) for r in four.collect()])
    assert sorted((r.doc_id, r["size"], r.source_size, r.taken) for r in five.collect()) == [x for x in want if x[3]]
    assert set(docs_of(five)) <= set(docs_of(four)) and set(d.columns) < set(five.columns)  # a corpus with its texts


def test_pipeline_runs_and_reruns_alike(spark):
    a = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert a == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) and a


@pytest.mark.parametrize("name", ["line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "language_id"])
def test_stages_of_an_empty_table(spark, name):
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, d, SF).collect() == []
