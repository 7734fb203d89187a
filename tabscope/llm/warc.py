"""WARC archives with an index first.

:func:`write_archives` writes one gzipped WARC file per task (one gzip member per
record) to the shared folder and returns the index, a written table with file,
offset, length, URL and digest of every record.  :func:`read_records` selects from
the index, range-partitions the selected records by (file, offset) and sorts
them, so that each task coalesces neighbouring records into few byte-range reads.

Equal payloads of at least ``min_revisit_bytes`` are stored once: the record with the
smallest page_id is the response, the others are revisits of it, which hold the
HTTP headers but no payload.  File names are unique per task attempt and only the
index of attempts that count is kept, so a lost executor leaves at most a file that no
index names.

Edge cases: null html is an empty payload; a null URL is empty, control characters in
URLs are percent-encoded; rows that share the smallest page_id of a payload are all
responses; rows without a page_id are responses if no row with one has their payload; a
table without rows gives an empty index; other columns are ignored.
"""
from __future__ import annotations

import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, text_or_empty, written

_INDEX = "file string, offset long, length long, url string, digest string, record_type string"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    uri = re.sub(r"^file:/+", "/", uri)
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


def record(page_id, url: str, payload: bytes, size: int, digest: str, refers_to, date: str) -> bytes:
    """One WARC record; ``refers_to`` makes it a revisit, without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        payload = b""
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """A record's WARC headers, HTTP headers (names in lower case) and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda lines: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    warc = fields(head.decode().split("\r\n")[1:])
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http.decode().split("\r\n")[1:]), payload


def _payload_roles(pages: DataFrame, min_revisit_bytes: int, broadcast_bytes: int) -> DataFrame:
    """``pages`` as (page_id, url, payload, size, digest, refers_to); payload only where it is stored.

    The digests that several pages share are found first, from ids and digests alone.  Up to ``broadcast_bytes`` of them
    are sent to the tasks, so no payload is shuffled; beyond that the pages that can be revisits are joined, and the
    smaller ones, many of which have one digest, are left where they are."""
    text = text_or_empty("html")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), text.alias("payload"),
                        F.octet_length(text).cast("long").alias("size"), F.sha2(text, 256).alias("digest"))
    large = F.col("size") >= min_revisit_bytes
    shared = written(rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
                     .where("n > 1").select(F.col("digest").alias("d"), "first"))
    weight = F.octet_length("d") + F.coalesce(F.octet_length(F.col("first").cast("string")), F.lit(0))
    if (shared.agg(F.sum(weight)).first()[0] or 0) <= broadcast_bytes:
        joined = rows.join(F.broadcast(shared), F.col("digest") == F.col("d"), "left")
    else:
        nothing = [F.lit(None).cast(shared.schema[c].dataType).alias(c) for c in ("d", "first")]
        joined = rows.where(large).join(shared, F.col("digest") == F.col("d"), "left").union(rows.where(~large).select("*", *nothing))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.withColumn("refers_to", refers).select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "size", "digest", "refers_to")


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 100, level: int = 6,
                   broadcast_bytes: int = 8 << 20) -> DataFrame:
    """Writes the WARC files below ``folder`` (by default a new one in the shared folder); returns the index."""
    folder = folder or shared_dir(pages.sparkSession)
    date = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(f"{folder}/warc")
        out, name, offset = None, "", 0
        for b in batches:
            cols = [[] for _ in range(6)]
            for r in b.to_pylist():
                if out is None:
                    store.create_dir(path, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", r["url"])
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = z.compress(record(r["page_id"], url, (r["payload"] or "").encode(), r["size"], r["digest"], r["refers_to"], date)) + z.flush()
                out.write(member)
                for c, x in zip(cols, (name, offset, len(member), url, r["digest"], "response" if r["refers_to"] is None else "revisit")):
                    c.append(x)
                offset += len(member)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["file", "offset", "length", "url", "digest", "record_type"])
        if out is not None:
            out.close()

    index = _payload_roles(pages, min_revisit_bytes, broadcast_bytes).mapInArrow(run, _INDEX)
    return written(index.withColumn("file", F.concat(F.lit(f"{folder}/warc/"), "file")), f"{folder}/index")


def _ranges(rows: list[dict], gap: int, most: int) -> Iterator[list[dict]]:
    """Neighbours in one file at most ``gap`` bytes apart, up to ``most`` bytes together."""
    group: list[dict] = []
    for r in rows:
        if group and (r["file"] != group[0]["file"] or r["offset"] - group[-1]["offset"] - group[-1]["length"] > gap
                      or r["offset"] + r["length"] - group[0]["offset"] > most):
            yield group
            group = []
        group.append(r)
    if group:
        yield group


def read_records(index: DataFrame, payloads: bool = True, gap: int = 64 << 10, most: int = 8 << 20, task_bytes: int = 16 << 20) -> DataFrame:
    """The records that the rows of ``index`` (or of a selection of it) name: page_id (string, null if it had none), url, record_type,
    refers_to (string), payload_bytes, payload_digest and, if asked for, payload (null for revisits).  A stored payload
    must match its record's digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [[] for _ in range(7)]
            for group in _ranges(b.to_pylist(), gap, most):
                store, path = _store(group[0]["file"])
                start = group[0]["offset"]
                with store.open_input_file(path) as f:
                    data = f.read_at(group[-1]["offset"] + group[-1]["length"] - start, start)
                for r in group:
                    at = r["offset"] - start
                    warc, http, payload = parsed(zlib.decompress(data[at:at + r["length"]], 31))
                    digest, kind = warc["warc-payload-digest"].removeprefix("sha256:"), warc["warc-type"]
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{r['file']} at {r['offset']}: the payload doesn't match its digest")
                    ident = lambda x: None if x is None else x[len("<urn:page:"):-1] or None
                    size = len(payload) if kind == "response" else int(http["content-length"])
                    for c, x in zip(cols, (ident(warc["warc-record-id"]), warc["warc-target-uri"], kind, ident(warc.get("warc-refers-to")), size, digest,
                                           payload if payloads and kind == "response" else None)):
                        c.append(x)
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    chosen = index.select("file", "offset", "length")
    tasks = 1 + int(chosen.agg(F.sum("length")).first()[0] or 0) // task_bytes  # the index is small; what it names isn't
    chosen = chosen.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    out = chosen.mapInArrow(run, "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary")
    return out if payloads else out.drop("payload")


def archive_report(pages: DataFrame) -> DataFrame:
    """Writes all pages, reads all records back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    kind = pages.schema["page_id"].dataType
    back = read_records(write_archives(pages), payloads=False)
    return back.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
