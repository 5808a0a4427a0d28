"""WARC archives: deduplicated writing, and reading with segment reassembly.

Writing: the payload's SHA-256 decides between a response and a revisit of the smallest page_id with that payload.
A response is an HTTP message with chunked transfer framing; one longer than a segment becomes a first record and
continuation records (origin id, segment number, total length in the last). Records go through Spark's text writer,
whose commit protocol survives lost tasks; the separator of its lines is the last line end of a record.

Reading: archives are split at the version line, which the writer keeps out of payloads by ending a chunk inside it.
Continuation records are grouped by origin id, ordered by segment number, and their lengths verified against the total;
then the chunked framing is decoded.

Defined results: a null payload is empty; payloads under `min_dedup` bytes are never revisits; rows that repeat the
smallest page_id of a payload are all responses; a null page_id is never referred to, and revisits a page_id with its
payload if there is one; a null url is about:blank in the archive and null again when read; other columns of pages,
whatever they are called, aren't read; a record whose lengths don't add
up has complete = false and a null payload; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_bytes, shared_dir, text_batches

VERSION = b"WARC/1.1\r\n"
SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 16 << 10
MIN_DEDUP = 100
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"
_SEGMENTED = "\r\nWARC-Segment-Number: "
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def chunked(payload: bytes, chunk_bytes: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing; no chunk holds the version line whole."""
    out, at = [], 0
    while at < len(payload):
        end = min(at + chunk_bytes, len(payload))
        mark = payload.find(VERSION, at, end)
        if mark >= 0:
            end = mark + 5
        out.append(b"%x\r\n%b\r\n" % (end - at, payload[at:end]))
        at = end
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if end < 0 or (size and len(body) < end + 2 + size):
            return None
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without its last line end, which the text writer adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return VERSION + head.encode() + b"\r\n" + block + b"\r\n"


def mark_revisits(pages: DataFrame, min_dedup: int = MIN_DEDUP) -> DataFrame:
    """page_id, url, html, digest, refers_to. The digest join is split by Spark where one payload has many rows."""
    hashed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    long = F.octet_length("html") >= min_dedup
    # rows without a page_id count: alone with one other row they revisit it
    first = hashed.filter(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("digest", "first")
    return hashed.join(first, "digest", "left").select("page_id", "url", "html", "digest", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, min_dedup: int = MIN_DEDUP) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for page, url, payload, digest, first in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), column_bytes(batch, "html"), batch.column("digest").to_pylist(), batch.column("refers_to").to_pylist()):
                row += 1
                name = lambda p: f"<urn:uuid:{uuid.uuid5(_NAMES, str(p))}>"
                common = [("WARC-Target-URI", quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~")), *[("WARC-X-No-URI", 1)] * (url is None), ("WARC-Date", _DATE), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-X-Payload-Length", len(payload)), ("WARC-X-Row", row)]
                if page is not None:
                    common.append(("WARC-X-Page-Id", page))
                if first is not None:
                    out.append(record([("WARC-Type", "revisit"), ("WARC-Record-ID", name(f"revisit {page} {row}")), ("WARC-Profile", _PROFILE), ("WARC-Refers-To", name(f"{first} {digest}")), ("WARC-X-Refers-To-Page-Id", first), *common], b""))
                    continue
                block = _HTTP + chunked(payload, chunk_bytes)
                own = name(f"{page} {digest}")  # rows that share both are one resource
                if len(block) <= segment_bytes:
                    out.append(record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common], block))
                    continue
                parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
                out.append(record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("WARC-Segment-Number", 1)], parts[0]))
                for k, part in enumerate(parts[1:], 2):
                    last = [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
                    out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", name(f"{page} {row} {k}")), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), *last, ("WARC-Date", _DATE), ("WARC-X-Row", row)], part))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    text_batches(pages.sparkSession)
    mark_revisits(pages, min_dedup).mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n").text(path, compression="gzip")


_RECORD = "page_id long, url string, record_type string, refers_to long, digest string, payload_length long, origin string, row long, segment int, total long, complete boolean, block binary"


def parse(data: bytes) -> dict:
    """A record as split from an archive, without its version line."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n") if ": " in x)
    number = lambda k: int(fields[k]) if k in fields else None
    size = number("Content-Length") or 0
    return {
        "page_id": number("WARC-X-Page-Id"), "url": None if "WARC-X-No-URI" in fields else fields.get("WARC-Target-URI"), "record_type": fields.get("WARC-Type"), "refers_to": number("WARC-X-Refers-To-Page-Id"),
        "digest": fields.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None, "payload_length": number("WARC-X-Payload-Length"),
        "origin": fields.get("WARC-Segment-Origin-ID", fields.get("WARC-Record-ID")), "row": number("WARC-X-Row"), "segment": number("WARC-Segment-Number"),
        "total": number("WARC-Segment-Total-Length"), "complete": len(rest) >= size, "block": rest[:size],
    }


_PAGE = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, complete boolean"


def _page(first: dict, block: bytes, complete: bool, with_payload: bool) -> dict:
    out = {k: first[k] for k in ("page_id", "url", "record_type", "refers_to")}
    if first["record_type"] == "revisit":
        out |= {"payload_bytes": first["payload_length"], "payload_digest": first["digest"], "complete": complete, "payload": None}
    else:
        head, _, body = block.partition(b"\r\n\r\n")
        payload = (dechunked(body) if re.search(rb"(?i)\r\ntransfer-encoding: *chunked", head) else body) if complete else None
        good = payload is not None
        out |= {"payload_bytes": len(payload) if good else None, "payload_digest": hashlib.sha256(payload).hexdigest() if good else None, "complete": good, "payload": payload}
    if not with_payload:
        del out["payload"]
    return out


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per page: page_id, url, record_type, refers_to, payload_bytes, payload_digest, complete, and the payload if asked for."""
    lines = spark.read.option("lineSep", VERSION.decode()).text(path).filter(F.length("value") > 0)
    split = F.col("value").contains(_SEGMENTED)
    schema = _PAGE + ", payload binary" * with_payload
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("complete", pa.bool_())] + [("payload", pa.binary())] * with_payload)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse(x) for x in batch.column("value").to_pylist()]
            yield pa.RecordBatch.from_pylist([_page(r, r["block"], r["complete"], with_payload) for r in rows], schema=arrow)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _RECORD.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
        records = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _RECORD.split(", ")])
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in map(parse, batch.column("value").to_pylist())], schema=records)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for group in batch.column("parts").to_pylist():
                group.sort(key=lambda r: r["segment"] or 1)
                block = b"".join(r["block"] for r in group)
                total = group[-1]["total"] if len(group) > 1 else len(block)
                good = [r["segment"] or 1 for r in group] == list(range(1, len(group) + 1)) and all(r["complete"] for r in group) and total == len(block)
                out.append(_page(group[0], block, good, with_payload))
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    binary = F.col("value").cast("binary").alias("value")
    fields = F.struct(*[x.split()[0] for x in _RECORD.split(", ")])
    # a group holds one record's parts, as long together as the value that was written
    groups = lines.filter(split).select(binary).mapInArrow(parts, _RECORD).groupBy("origin", "row").agg(F.collect_list(fields).alias("parts")).select("parts")
    return lines.filter(~split).select(binary).mapInArrow(whole, schema).unionByName(groups.mapInArrow(joined, schema))


def warc_round_trip(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    spark = pages.sparkSession
    path = shared_dir(spark)
    write_warc(pages, path, segment_bytes)
    return read_warc(spark, path)
