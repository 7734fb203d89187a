"""Exact distinct counts of many columns: one scan, one shuffle (of some columns each, where columns can be read apart).

Each task keeps its columns' distinct values as Arrow arrays and sends them on in blocks when they reach
a bound, so its memory doesn't grow with its rows, and repeats (a hot value, a flag) mostly end there.  A block
holds values of one column and one bucket of their hash; the blocks of a bucket meet after the shuffle, where repeats
are dropped for good.  Buckets grow with the rows: none holds more than about ``BUCKET_ROWS`` values, whatever the column.

Whole numbers, dates, times and booleans travel as bigint, floating numbers as their bits (-0.0 is 0.0 and all NaN
are one), texts, bytes and decimals as bytes (long ones as their SHA-256, told apart by its length).  The columns of a type
reach Python as one array, as Spark measures a batch's columns with every row.  Nested and other types have no such form: Spark groups them.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import sql_id
from ..functions.families import ColumnSpec
from .scan import in_groups, reads_columns_apart

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

#: Rows for which there is a bucket more.
BUCKET_ROWS = 500_000
#: Columns of a scan, texts and others, where columns can be read apart: more would make its code too long to be compiled.
TEXTS, OTHERS = 8, 40
#: Distinct values that a task keeps of a column, bytes that it keeps in all, and values of a block.
KEPT_VALUES, KEPT_BYTES, BLOCK_VALUES = 1 << 18, 128 << 20, 1 << 16
#: Long texts' SHA-256 is filled up to a byte more than a text that stays as it is.
LONG = 64
_FILL = "00" * (LONG + 1 - 32)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _type(s: ColumnSpec) -> str:
    """The kind of key that :func:`_key` makes."""
    if isinstance(s.dtype, T.TimestampNTZType):
        return "timestamp"
    if isinstance(s.dtype, (T.FloatType, T.DoubleType)):
        return "double"
    return "bytes" if isinstance(s.dtype, (T.StringType, T.BinaryType, T.DecimalType)) else "bigint"


def _key(s: ColumnSpec) -> str | None:
    """The column as SQL of a type that Arrow can compare, equal for equal values only."""
    q, dt = sql_id(s.name), s.dtype
    if s.is_integral or isinstance(dt, T.BooleanType):
        return f"CAST({q} AS BIGINT)"
    if isinstance(dt, T.DateType):
        return f"CAST(unix_date({q}) AS BIGINT)"
    if isinstance(dt, T.TimestampType):
        return f"unix_micros({q})"
    if isinstance(dt, T.TimestampNTZType):
        return q
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return f"CAST({q} AS DOUBLE)"
    if isinstance(dt, (T.StringType, T.BinaryType, T.DecimalType)):
        b = q if isinstance(dt, T.BinaryType) else f"CAST(CAST({q} AS STRING) AS BINARY)"
        return f"CASE WHEN octet_length({b}) > {LONG} THEN concat(unhex(sha2({b}, 256)), X'{_FILL}') ELSE {b} END"
    return None


def _plain(values: pa.Array) -> pa.Array:
    """Without nulls, and as bigint if not as bytes."""
    values = values.drop_null()
    if pa.types.is_timestamp(values.type):
        return values.cast(pa.int64())
    if pa.types.is_floating(values.type):
        x = values.to_numpy(zero_copy_only=False) + 0.0  # -0.0 becomes 0.0
        return pa.array(np.where(np.isnan(x), np.nan, x).view(np.int64))
    return values


def _unique(parts: list[pa.Array]) -> pa.Array:
    """The values without repeats; whole numbers are sorted, which is faster than a hash table."""
    if not pa.types.is_integer(parts[0].type):
        return pc.unique(pa.chunked_array(parts))
    x = np.sort(np.concatenate([p.to_numpy() for p in parts]))
    return pa.array(x[np.append(True, x[1:] != x[:-1])] if len(x) else x)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _buckets(values: pa.Array, n: int) -> np.ndarray:
    """The bucket of each value, by a hash of it: of a whole number, or of bytes by words of eight."""
    if pa.types.is_integer(values.type):
        return (_mixed(values.to_numpy().view(np.uint64)) % np.uint64(n)).astype(np.int32)
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + len(values) + 1].astype(np.int64)
    held = values.buffers()[2]
    data = (held[int(ends[0]):int(ends[-1])].to_pybytes() if held is not None else b"") + bytes(8)
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # the eight bytes from each byte on
    starts, sizes = ends[:-1] - ends[0], np.diff(ends)
    h = sizes.astype(np.uint64) * _ODD
    for at in range(0, int(sizes.max(initial=0)), 8):
        some = slice(None) if at + 1 <= sizes.min() else np.flatnonzero(sizes > at)
        left = np.minimum(sizes[some] - at, 8).astype(np.uint64)
        word = words[starts[some] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8)))
        x = (h[some] ^ word) * _ODD
        h[some] = x ^ (x >> np.uint64(29))
    return (_mixed(h) % np.uint64(n)).astype(np.int32)


def _blocks(ordinal: int, values: pa.Array, n: int) -> Iterator[pa.RecordBatch]:
    """The values as blocks of a bucket each."""
    if n > 1:
        of = _buckets(values, n)
        order = np.argsort(of.astype(np.uint16) if n <= 1 << 16 else of, kind="stable")  # short numbers are sorted by radix
        values, of = values.take(pa.array(order)), of[order]
        cuts = np.unique(np.concatenate([np.flatnonzero(np.diff(of)) + 1, np.arange(0, len(of), BLOCK_VALUES)]))
    else:
        of, cuts = np.zeros(len(values), np.int32), np.arange(0, len(values), BLOCK_VALUES)
    lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(values)), pa.int32()), values)
    no = pa.nulls(len(cuts), pa.list_(pa.binary() if pa.types.is_integer(values.type) else pa.int64()))
    sides = (lists, no) if pa.types.is_integer(values.type) else (no, lists)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cuts), ordinal, np.int32)), pa.array(of[cuts]), *sides], ["ordinal", "bucket", "n", "s"])


def _counted(blocks: pa.Table) -> pa.Table:
    """How many values a bucket holds."""
    found = sum(len(_unique([pc.list_flatten(c) for c in blocks[side].chunks])) for side in ("n", "s") if blocks[side].null_count < len(blocks))
    return pa.table({"ordinal": blocks["ordinal"].slice(0, 1), "held": pa.array([found], pa.int64())})


def _keyed_counts(df: DataFrame, specs: list[ColumnSpec], buckets: int) -> DataFrame:
    most_values, most_bytes = KEPT_VALUES, KEPT_BYTES
    of_type: dict[str, list[ColumnSpec]] = {}
    for s in specs:
        of_type.setdefault(_type(s), []).append(s)
    layout = [len(own) for own in of_type.values()]  # columns in each array
    ordinals = [s.ordinal for own in of_type.values() for s in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[pa.Array]] = [[] for _ in ordinals]
        # values and bytes kept of a column, and the values that were left of it when repeats were last dropped
        values, size, left = ([0] * len(ordinals) for _ in range(3))
        few = [False] * len(ordinals)  # were there few repeats when they were last dropped?

        def columns(batch: pa.RecordBatch) -> Iterator[pa.Array]:
            for packed, k in zip(batch.columns, layout):
                cells = pc.list_flatten(packed)
                for j in range(k):
                    yield cells.take(pa.array(np.arange(j, len(cells), k))) if k > 1 else cells

        def drop(i: int) -> None:
            kept[i] = [_unique(kept[i])]
            few[i] = len(kept[i][0]) > 0.9 * values[i]
            values[i] = left[i] = len(kept[i][0])
            size[i] = kept[i][0].nbytes

        def flush(i: int) -> Iterator[pa.RecordBatch]:
            if values[i]:
                yield from _blocks(ordinals[i], kept[i][0], buckets)
            kept[i], values[i], size[i], left[i] = [], 0, 0, 0

        for batch in batches:
            for i, column in enumerate(columns(batch)):
                own = _plain(column)
                own = own if few[i] else _unique([own])
                if len(own):
                    kept[i].append(own)
                    values[i] += len(own)
                    size[i] += own.nbytes
                    if values[i] > max(2 * left[i], most_values >> 2):
                        drop(i)
                        if few[i] or values[i] > most_values >> 1:
                            yield from flush(i)
            while sum(size) > most_bytes:
                i = max(range(len(size)), key=size.__getitem__)
                drop(i)
                yield from flush(i)
        for i in range(len(ordinals)):
            if values[i]:
                drop(i)
                yield from flush(i)

    cells = df.selectExpr(*[f"array({', '.join(_key(s) for s in own)}) AS {kind}_keys" for kind, own in of_type.items()])
    blocks = cells.mapInArrow(run, "ordinal int, bucket int, n array<bigint>, s array<binary>")
    held = blocks.groupBy("ordinal", "bucket").applyInArrow(_counted, "ordinal int, held bigint")
    return held.groupBy("ordinal").agg(F.sum("held").alias("distinct_exact"))


def _grouped_counts(df: DataFrame, specs: list[ColumnSpec]) -> DataFrame:
    """Columns of types that Spark groups, a slot of the key for each type."""
    slots = {s.spark_type: f"x{i}" for i, s in enumerate(specs)}
    rows = []
    for s in specs:
        cells = ", ".join(f"'{slot}', {sql_id(s.name) if typ == s.spark_type else f'CAST(NULL AS {typ})'}" for typ, slot in slots.items())
        rows.append(f"named_struct('ordinal', {s.ordinal}, {cells})")
    some = " OR ".join(f"{n} IS NOT NULL" for n in slots.values())
    keys = df.selectExpr(f"inline(array({', '.join(rows)}))").where(some).groupBy("ordinal", *slots.values()).agg(F.lit(1).alias("_"))
    return keys.groupBy("ordinal").agg(F.count("*").alias("distinct_exact"))


def exact_distinct(df: DataFrame, specs: list[ColumnSpec], rows: int | None = None) -> DataFrame:
    """(ordinal, distinct_exact) of the columns that have a value; ``rows``: how many there are, if known."""
    keyed = [s for s in specs if _key(s) is not None]
    other = [s for s in specs if _key(s) is None]
    if not specs:
        return df.sparkSession.createDataFrame([], "ordinal int, distinct_exact bigint")
    parts = []
    if keyed:
        buckets = 1 + (df.count() if rows is None else rows) // BUCKET_ROWS
        groups = [keyed]
        if len(keyed) > TEXTS and reads_columns_apart(df):
            texts = [s for s in keyed if _type(s) == "bytes"]
            groups = [*in_groups((s for s in keyed if _type(s) != "bytes"), OTHERS), *in_groups(texts, TEXTS)]
        parts += [_keyed_counts(df, group, buckets) for group in groups]
    if other:
        parts.append(_grouped_counts(df, other))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
