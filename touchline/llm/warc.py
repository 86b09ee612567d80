"""WARC archives: a deduplicating writer and a salvage reader."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialise, new_path, shared_dir

VERSION = b"WARC/1.1\r\n"
GZIP = b"\x1f\x8b\x08"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = re.compile(r"<urn:page:(-?\d+|none)>\Z")
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
CHUNK = 1 << 20
#: Bytes that a record may hold in memory, inflated; a longer one is damaged for the reader.
RECORD_MAX = 1 << 30

RECORD_SCHEMA = (
    "file string, start bigint, stop bigint, reason string, record_type string, page_id bigint, url string, "
    "payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The bytes of one response or, with refers_to, revisit record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE),
        ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", PROFILE)]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one whole record; ValueError says which check it fails."""
    if not _VERSION_LINE.match(raw):
        raise ValueError("no version line")
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("header without end")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    if not fields.get("Content-Length", "").isdigit():
        raise ValueError("no content length")
    n = int(fields["Content-Length"])
    block = rest[:n]
    if len(block) < n or rest[n:] != b"\r\n\r\n":
        raise ValueError("wrong content length")
    if f"sha256:{hashlib.sha256(block).hexdigest()}" != fields.get("WARC-Block-Digest", ""):
        raise ValueError("wrong block digest")
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("WARC-Type") == "response" else None
    digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha256:")
    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("wrong payload digest")
    number = lambda k: int(m[1]) if (m := _ID.match(fields.get(k, ""))) and m[1] != "none" else None
    return {
        "record_type": fields.get("WARC-Type"), "page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"),
        "payload_bytes": int(fields["X-Payload-Length"]) if fields.get("X-Payload-Length", "").isdigit() else None,
        "payload_digest": digest or None, "refers_to": number("WARC-Refers-To"), "payload": payload,
    }


class Window:
    """A forward view of a stream that forgets what lies before the reader's place."""

    def __init__(self, stream):
        self.stream, self.data, self.at, self.ended = stream, bytearray(), 0, False

    def more(self) -> bool:
        chunk = b"" if self.ended else self.stream.read(CHUNK)
        self.ended = not chunk
        self.data += chunk
        return bool(chunk)

    def need(self, n: int) -> bool:
        while len(self.data) < n and self.more():
            pass
        return len(self.data) >= n

    def skip(self, n: int) -> None:
        del self.data[:n]
        self.at += n


def _member(w: Window) -> tuple[bytes, int]:
    """The gzip member at the window's start and its length; ValueError if it is damaged."""
    z, out, fed, size = zlib.decompressobj(31), [], 0, 0
    try:
        while not z.eof:
            if not w.need(fed + 1):
                raise ValueError("cut short")
            out.append(z.decompress(bytes(w.data[fed:]), RECORD_MAX - size + 1))
            size += len(out[-1])
            if size > RECORD_MAX or z.unconsumed_tail:
                raise ValueError("longer than RECORD_MAX")
            fed = len(w.data)
    except zlib.error as e:
        raise ValueError(f"gzip: {e}") from None
    return b"".join(out), fed - len(z.unused_data)


def _plain(w: Window) -> tuple[bytes, int]:
    """The uncompressed record at the window's start and its length."""
    w.need(len(VERSION))
    if not _VERSION_LINE.match(w.data):
        raise ValueError("no version line")
    seen = 0
    while (end := w.data.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
        seen = len(w.data)
        if seen > RECORD_MAX or not w.more():
            raise ValueError("header without end")
    m = re.search(rb"\r\nContent-Length: (\d+)", bytes(w.data[:end]))
    if not m:
        raise ValueError("no content length")
    n = end + 4 + int(m[1]) + 4
    if n > RECORD_MAX:
        raise ValueError("longer than RECORD_MAX")
    if not w.need(n):
        raise ValueError("cut short")
    return bytes(w.data[:n]), n


def salvage(stream) -> Iterator[tuple[int, int, str | None, dict | None]]:
    """(start, stop, None, fields) of each good record, (start, stop, reason, None) of each quarantined gap, in order.

    Where a check fails (compression, structure, lengths, digests) the
    reader goes on byte by byte to the next gzip member or version line
    that passes all checks; what lies between is one gap. One record of at most RECORD_MAX bytes, or
    the stretch that is searched in a chunk, is held in memory. An empty stream: nothing.
    """
    w = Window(stream)
    bad: tuple[int, str] | None = None
    while w.need(1):
        w.need(len(VERSION))  # a record may begin with the last bytes of a chunk
        try:
            raw, n = _member(w) if w.data[: len(GZIP)] == GZIP else _plain(w)
            fields = parse(raw)
        except ValueError as e:
            bad = bad or (w.at, str(e))
            # To the next place where a record may begin.
            after = 1  # only the failed place itself is passed over
            while True:
                found = [i for i in (w.data.find(GZIP, after), w.data.find(b"WARC/1.", after)) if i >= 0]
                if found:
                    w.skip(min(found))
                    break
                w.skip(max(after, len(w.data) - 6))
                after = 0
                if not w.more():
                    w.skip(len(w.data))
                    break
            continue
        if bad:
            yield bad[0], w.at, bad[1], None
            bad = None
        yield w.at, w.at + n, None, fields
        w.skip(n)
    if bad:
        yield bad[0], w.at, bad[1], None


def write_archives(pages: DataFrame, path: str, *, compress: bool = True, min_revisit: int = 100, max_file_bytes: int = 256 << 20) -> DataFrame:
    """Write a record per row of pages(page_id, url, html) under path; the manifest: file, records, bytes.

    Of rows with equal payloads of min_revisit bytes or more, that of the
    smallest page_id is a response and the others revisit it. The pairs
    (digest, smallest page_id) of repeated payloads are found by partial
    aggregation over digests and written; the join with them is broadcast
    only while that table is small, else a sort-merge join that AQE can split at a hot payload.

    A task writes files of its own names, and only a task that succeeds
    has them in the manifest, so that a lost executor or second attempt
    leaves no record twice. Null html: empty payload. Null url: urn:page:ID. Null page_id: always a response.
    Rows that repeat the smallest page_id: responses both. Empty table: no files.
    """
    spark = pages.sparkSession
    shared_dir(spark)
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    long_enough = F.length("payload") >= min_revisit
    firsts = materialise(
        rows.where(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts"
    )
    rows = rows.join(firsts, "digest", "left").withColumn("refers_to", F.when(long_enough & (F.col("first") != F.col("page_id")), F.col("first"))).drop("first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = pafs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        done, out, name, n, size = [], None, "", 0, 0
        whole = (lambda x: x) if not compress else lambda x: (c := zlib.compressobj(4, zlib.DEFLATED, 31)).compress(x) + c.flush()
        for b in batches:
            for page_id, url, body, digest, ref in zip(b["page_id"], b["url"], b["payload"], b["digest"], b["refers_to"]):
                if out is None:
                    name, n, size = f"{base}/{uuid.uuid4().hex}.warc{'.gz' if compress else ''}", 0, 0
                    out = store.open_output_stream(name)
                as_int = lambda x: None if pd.isna(x) else int(x)
                raw = whole(record(as_int(page_id), url, bytes(body), digest, as_int(ref)))
                out.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= max_file_bytes:
                    out.close()
                    done.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n, size))
        yield pd.DataFrame(done, columns=["file", "records", "bytes"]).astype({"file": object, "records": "int64", "bytes": "int64"})

    # As text, since pandas would round large nullable integers.
    text_ids = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return materialise(text_ids.mapInPandas(run, "file string, records bigint, bytes bigint"), "manifest")


def read_archives(spark: SparkSession, files: DataFrame, uri: str, *, with_payload: bool = True) -> DataFrame:
    """RECORD_SCHEMA rows of files(file) in the store of uri: a row per good record, and one with a reason per quarantined gap.

    Null file: skipped. A file that is listed twice is read twice. Repeated, empty and very long records: a row each, up to RECORD_MAX. Empty table: no rows.
    """
    shared_dir(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(uri)
        kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in RECORD_SCHEMA.split(", "))])
        rows, held = [], 0
        for b in batches:
            for name in filter(None, b.column("file").to_pylist()):
                with store.open_input_stream(name) as stream:
                    for start, stop, reason, fields in salvage(stream):
                        fields = dict(fields or {})
                        held += len(fields.get("payload") or b"") * with_payload + 500
                        if not with_payload:
                            fields.pop("payload", None)
                        rows.append({"file": name, "start": start, "stop": stop, "reason": reason, **fields})
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    # A file is one unit of work; the default parallelism deals them out.
    spread = files.select("file").repartition(spark.sparkContext.defaultParallelism, F.xxhash64("file"))
    return spread.mapInArrow(run, RECORD_SCHEMA)


def round_trip(pages: DataFrame, *, min_revisit: int = 100) -> DataFrame:
    """Write pages as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to of each record.

    ValueError where a file yields another number of records than its writer counted, with the gaps that
    were quarantined. Nulls, ties, repeated rows and empty tables: as in write_archives(). Empty and very long texts: a record each. Other columns of pages are not carried.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    manifest = write_archives(pages, path, min_revisit=min_revisit)
    read = materialise(read_archives(spark, manifest, path, with_payload=False), "records")
    good = read.where("reason is null").groupBy("file").agg(F.count("*").alias("read"))
    short = manifest.join(good, "file", "left").where("records <> coalesce(read, 0)").select("file", "records", "read").limit(3).collect()
    gaps = read.where("reason is not null").select("file", "start", "stop", "reason").limit(3).collect()
    if short or gaps:
        raise ValueError(f"archives under {path} were not read back whole: {short} {gaps}")
    return read.where("reason is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
