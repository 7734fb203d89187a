"""Alignment of two tokenizers over the same texts.

Texts go through both tokenizers in chunks of bounded bytes, and all that follows is Arrow: the lists of ids are
flattened with their parents' indices; a running sum of the tokens' byte lengths, less its value where the text began,
gives each token's end; a hash join of both sides' (text, end) keys finds the offsets where tokens of both end, which cut
the tokens into groups; grouped by (group, id) on either side and joined on the group they give the linked pairs with how often
they occur, so that no group's pairs are made one by one; a group of one token on either side is a pair as it stands.  Each chunk counts its pairs' documents; Spark adds the
counts up, finds each id's best, and sends them back to the chunks that hold the pair.

A document's links stay in its row as places in its chunk's list of pairs.  Pairs travel once a chunk, not once a
document, and a pair that is everywhere costs a row a chunk; an id of one tokenizer has no more partners than the other has ids.

Edge cases: null and empty texts, and texts that the tokens of either side don't spell byte by byte (a mark that B reads as a space),
have no tokens: zeros, and an empty ``groups_sha256``; special tokens' strings are plain text; repeated rows are documents of
their own, and ids may be null or repeat; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.acero  # noqa: F401 - Table.join needs it
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .tokens import slices

TOKENIZERS = "/opt/tokenizers"
#: Bytes of text, and rows, of a chunk.
CHUNK_BYTES, CHUNK_ROWS = 2 << 20, 4000
#: Byte-level BPE splits texts by this before merging.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Both libraries' character classes agree on code points up to here (``tests/llm`` goes through them).
_ALIKE = 0x24F


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others, in order, as the characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def byte_level(path: str) -> tuple[Callable[[list[str]], list[list[int]]], pa.Array]:
    """Encoder and token bytes of a byte-level BPE file.

    Texts of Latin characters go through a faster library of the same merges, if ids follow the order of merges."""
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    chars = _byte_of_char()
    special = {t.content for t in whole.get_added_tokens_decoder().values()}
    spelt = [b""] * whole.get_vocab_size()
    for token, i in whole.get_vocab().items():
        spelt[i] = token.encode() if token in special else bytes(chars[c] for c in token)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ranks = {spelt[i]: i for t, i in model["vocab"].items() if t not in special}
    made = [model["vocab"].get(a + b) for a, b in merges]
    quick = None
    if None not in made and made == sorted(made) and len(ranks) == 256 + len(set(made)):
        quick = tiktoken.Encoding("byte-level", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        for i, t in enumerate(texts):
            if quick is not None and (t.isascii() or ord(max(t)) <= _ALIKE):
                out[i] = quick.encode_ordinary(" " + t)
        rest = [i for i, ids in enumerate(out) if ids is None]
        for k in range(0, len(rest), 20):
            for i, e in zip(rest[k:k + 20], whole.encode_batch_fast([" " + texts[i] for i in rest[k:k + 20]], add_special_tokens=False)):
                out[i] = e.ids
        return out

    return encode, pa.array(spelt, pa.binary())


def pieces(path: str) -> tuple[Callable[[list[str]], list[list[int]]], pa.Array]:
    """Encoder and token bytes of a piece model with byte fallback, which adds the leading space itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelt = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
             for i in range(model.get_piece_size())]
    return lambda texts: model.encode(texts, num_threads=1), pa.array(spelt, pa.binary())


def _ends(ids: pa.ListArray, lengths: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The flat ids, the (text, byte end) key of each token, and the text of each."""
    flat, parent = pc.list_flatten(ids), pc.list_parent_indices(ids).cast(pa.int64())
    running = pc.cumulative_sum(lengths.take(flat))
    before = pa.concat_arrays([pa.array([0], pa.int64()), running]).take(ids.offsets.slice(0, len(ids)))
    end = pc.subtract(running, before.take(parent))
    return flat, pc.bit_wise_or(pc.shift_left(parent, pa.scalar(40, pa.int64())), end), parent


def _spells(ids: pa.ListArray, spelt: pa.Array, texts: list[bytes]) -> list[bool]:
    """Do the tokens' bytes, joined, equal each text?"""
    tokens = spelt.cast(pa.large_binary()).take(pc.list_flatten(ids))
    at = np.frombuffer(tokens.buffers()[1], np.int64)[ids.offsets.to_numpy()] if len(tokens) else np.zeros(len(ids) + 1, np.int64)
    joined = memoryview(tokens.buffers()[2]).cast("B") if len(tokens) else b""
    return [joined[a:b] == t for a, b, t in zip(at[:-1].tolist(), at[1:].tolist(), texts)]


def _lists(texts: list[list[int]]) -> pa.ListArray:
    return pa.array(texts, pa.list_(pa.int32()))


def _cut(values: pa.Array, owner: np.ndarray, n: int) -> pa.ListArray:
    """``values`` as ``n`` lists, by their owners (rising)."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), values)


def _written_out(ids: pa.Array, group: np.ndarray, n: int) -> pa.Array:
    """The ids of each group in decimal, comma-joined."""
    return pc.binary_join(_cut(ids.cast(pa.string()), group, n), ",")


def align(texts: list[str | None], a: tuple, b: tuple) -> dict:
    """The columns of a chunk of texts: a value per text, and the chunk's pairs."""
    live = [i for i, t in enumerate(texts) if t]
    plain = [" " + texts[i] for i in live]
    sides = []
    for encode, spelt in (a, b):
        own: list = [[]] * len(texts)
        for i, ids in zip(live, encode([t[1:] for t in plain])):
            own[i] = ids
        sides.append(own)
    raw = [b""] * len(texts)
    for i, t in zip(live, plain):
        raw[i] = t.encode()
    lists = [_lists(own) for own in sides]
    right = np.logical_and(*[_spells(ids, spelt, raw) for ids, (_, spelt) in zip(lists, (a, b))]) if texts else np.zeros(0, bool)
    if not all(right):
        sides = [[ids if ok else [] for ids, ok in zip(own, right)] for own in sides]
        lists = [_lists(own) for own in sides]
    (ida, keya, _), (idb, keyb, _) = [_ends(ids, pc.binary_length(spelt).cast(pa.int64())) for ids, (_, spelt) in zip(lists, (a, b))]
    both = pa.table({"k": keya, "x": np.arange(len(keya))}).join(pa.table({"k": keyb, "y": np.arange(len(keyb))}), "k", join_type="inner", use_threads=False)
    ends = [np.zeros(len(key), bool) for key in (keya, keyb)]  # does a cut lie at a token's end
    for at_end, place in zip(ends, ("x", "y")):
        at_end[both[place].to_numpy()] = True
    doc_of = pc.shift_right(keya.filter(pa.array(ends[0])), pa.scalar(40, pa.int64()))
    groups = [np.cumsum(at_end) - at_end for at_end in ends]  # how many cuts lie before a token's end
    n, g = len(texts), len(doc_of)
    single = np.logical_and(*[np.bincount(grp, minlength=g + 1) == 1 for grp in groups])  # groups of one token and one
    one, many = zip(*[(pa.array(single[grp]), pa.array(~single[grp])) for grp in groups])
    counts = [pa.table({"g": groups[k], name: ids}).filter(many[k]).group_by(["g", name], use_threads=False).aggregate([([], "count_all")])
              .rename_columns(["g", name, f"n{name}"]) for k, ids, name in ((0, ida, "a"), (1, idb, "b"))]
    links = counts[0].join(counts[1], "g", join_type="inner", use_threads=False)

    def code(x, y):
        return pc.bit_wise_or(pc.shift_left(x.cast(pa.int64()), pa.scalar(32, pa.int64())), y.cast(pa.int64()))

    def doc(group):
        return doc_of.take(group) if g else pa.array([], pa.int64())

    own = pa.array(np.flatnonzero(single[:g]))
    linked = pa.concat_tables([
        pa.table({"d": doc(own), "pair": code(ida.filter(one[0]), idb.filter(one[1])), "t": pa.array(np.ones(len(own), np.int64))}),
        pa.table({"d": doc(links["g"].combine_chunks()), "pair": code(links["a"], links["b"]), "t": pc.multiply(links["na"], links["nb"])})])
    per_doc = linked.group_by(["d", "pair"], use_threads=False).aggregate([("t", "sum")]).sort_by("d")
    coded = per_doc["pair"].combine_chunks().dictionary_encode() if per_doc.num_rows else pa.array([], pa.int64()).dictionary_encode()
    held = pa.table({"i": coded.indices}).group_by("i", use_threads=False).aggregate([([], "count_all")]).sort_by("i")["count_all"]
    owner, at_cut = per_doc["d"].to_numpy(), doc_of.to_numpy()
    ga, gb = groups
    spoken = pc.binary_join_element_wise(_written_out(ida, ga, g), _written_out(idb, gb, g), "|")
    spoken = pc.binary_join(_cut(spoken, at_cut, n), ";").to_pylist()
    times = per_doc["t_sum"].combine_chunks() if per_doc.num_rows else pa.array([], pa.int64())
    return {
        "n_a": pc.list_value_length(lists[0]).cast(pa.int64()), "n_b": pc.list_value_length(lists[1]).cast(pa.int64()),
        "n_groups": pa.array(np.bincount(at_cut, minlength=n)[:n] if n else [], pa.int64()),
        "n_links": pa.array(np.diff(np.concatenate([[0], np.cumsum(times.to_numpy())])[np.searchsorted(owner, np.arange(n + 1))]), pa.int64()),
        "groups_sha256": pa.array([hashlib.sha256(s.encode()).hexdigest() if ids else "" for s, ids in zip(spoken, sides[0])], pa.string()),
        "at": _cut(coded.indices.cast(pa.int32()), owner, n), "times": _cut(times, owner, n),
        "pairs": (coded.dictionary, held.combine_chunks() if len(coded) else pa.array([], pa.int64()))}


_COUNTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def links(docs: DataFrame, folder: str = TOKENIZERS, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model",
          chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: chunk, doc_id, the counts, its links (``at``: places in the chunk's pairs; ``times``: how often); the
    first row of a chunk has its pairs (A's id times 2**32 plus B's) with the number of its documents that hold each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, done = (byte_level(f"{folder}/{a}"), pieces(f"{folder}/{b}")), 0
        for batch in batches:
            for k, n in slices(batch.column(1), CHUNK_ROWS, chunk_bytes):
                part = batch.slice(k, n)
                c = align(part.column(1).to_pylist(), *sides)
                pair, held = c.pop("pairs")
                both = pa.StructArray.from_arrays([pair, held], ["pair", "n"])
                at = pa.array([0] + [len(both)] * n, pa.int32())
                chunk = pa.array(np.full(n, (TaskContext.get().partitionId() << 32) + done))
                yield pa.RecordBatch.from_arrays([chunk, part.column(0), *c.values(), pa.ListArray.from_arrays(at, both)], ["chunk", "doc_id", *c, "pairs"])
                done += 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"chunk bigint, doc_id {kind}, {_COUNTS}, at array<int>, times array<bigint>, pairs array<struct<pair:bigint,n:bigint>>")


def pair_counts(found: DataFrame) -> DataFrame:
    """From :func:`links`: pair, n (documents that hold it), best (no pair of its A id has more)."""
    n = found.select(F.inline("pairs")).groupBy("pair").agg(F.sum("n").alias("n"))
    n = written(n.withColumn("a", F.shiftright("pair", 32)))
    return n.join(n.groupBy("a").agg(F.max("n").alias("most")), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _valued(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """A chunk's documents with the sums over their links."""
    pairs = pairs.sort_by("i")
    n, best = pairs["n"].combine_chunks(), pairs["best"].combine_chunks().cast(pa.int64())
    at, times = docs["at"].combine_chunks(), docs["times"].combine_chunks()
    flat, t = pc.list_flatten(at), pc.list_flatten(times)
    parent = pc.list_parent_indices(at).to_numpy()
    cuts = np.searchsorted(parent, np.arange(len(docs) + 1))
    sums = []
    for v in (best, n):
        running = np.concatenate([[0], pc.cumulative_sum(pc.multiply(t, v.take(flat))).to_numpy()]) if len(flat) else np.zeros(1, np.int64)
        sums.append(pa.array(np.diff(running[cuts]), pa.int64()))
    return pa.table([docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [*sums, docs["groups_sha256"]],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align_report(docs: DataFrame, folder: str = TOKENIZERS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is among its A id's most frequent),
    count_sum (of the links' document counts), groups_sha256."""
    found = written(links(docs, folder, chunk_bytes=chunk_bytes))
    asked = found.select("chunk", F.posexplode("pairs").alias("i", "p")).select("chunk", "i", "p.pair")
    told = asked.join(pair_counts(found), "pair").select(F.col("chunk").alias("c"), "i", "n", "best")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.drop("pairs").groupBy("chunk").cogroup(told.groupBy("c")).applyInArrow(
        _valued, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
