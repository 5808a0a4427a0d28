"""Binary token files with Elias-Fano encoded document boundaries.

A shard file holds the ids of consecutive documents in ascending doc_id order, concatenated, as little-endian unsigned
16-bit integers (32-bit for larger vocabularies), then two Elias-Fano sequences: the documents' end positions and their
doc_ids. An Elias-Fano sequence of n values below u keeps the low log2(u/n) bits of each value and the high bits in
unary, about 2 + log2(u/n) bits a value, and its select structure (the place of every 256th set bit) gives any value
without decoding the others. The layout is

    magic "EFTK0001" | ids | ends | doc_ids | 6 unsigned 64-bit integers: width of an id (and 256 where documents have
    no doc_id), number of documents, ids in all, byte offset of ends, byte offset of doc_ids, smallest doc_id (signed)

Shards are written by range of doc_id, each by one task, under a name that no other attempt has. A manifest (a row per
shard), which Spark commits, gives the files that count and their order; a file that it doesn't name is of a lost
attempt. Defined results: null and empty texts have the end id alone; repeated doc_ids stand next to each other, ordered
by text; documents without a doc_id come first, in shards of their own; other columns are ignored; an empty table gives
no shard.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, text_batches
from .tokens import default_path, encoder

MAGIC = b"EFTK0001"
END_ID = 0
SAMPLE = 256
#: Ids and documents of a shard after which a task begins the next one.
SHARD_IDS, SHARD_DOCS = 64_000_000, 1_000_000
#: Values that are packed and documents that are read at once.
BLOCK = 1 << 13
NO_ID = 256
_TAIL = "<5Qq"


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        places = np.arange(low_bits, dtype=np.uint64)
        # blocks of a multiple of 8 values end with a byte
        low = [np.packbits(((v[k : k + BLOCK, None] >> places) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for k in range(0, n, BLOCK)]
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, low_bits, np.concatenate([np.zeros(0, np.uint8), *low]), np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return struct.pack("<4Q", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, a, b = struct.unpack_from("<4Q", data)
        at = 32
        low, high = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        return cls(n, low_bits, low, high, np.frombuffer(data, "<u4", -(-n // SAMPLE), at + a + b))

    def _low(self, first: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, np.int64)
        begin, end = first * self.low_bits, (first + count) * self.low_bits
        bits = np.unpackbits(self.low[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 :][: end - begin]
        return bits.reshape(count, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def select(self, i: int) -> int:
        """Value i, by the sampled place of a set bit at or before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = place // 8
        chunk = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
        chunk[: place % 8] = 0
        base = byte * 8
        while chunk.sum() <= left:
            left -= int(chunk.sum())
            byte += len(chunk) // 8
            base = byte * 8
            chunk = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
        one = base + int(np.flatnonzero(chunk)[left])
        return ((one - i) << self.low_bits) | int(self._low(i, 1)[0])

    def values(self, first: int, last: int) -> np.ndarray:
        """Values first to last - 1: the bits between two sampled places are read, and no others."""
        if first >= last:
            return np.zeros(0, np.int64)
        k, end = first // SAMPLE, -(-last // SAMPLE)
        begin = int(self.samples[k])
        stop = int(self.samples[end]) if end < len(self.samples) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin // 8 : -(-stop // 8)], bitorder="little")) + begin // 8 * 8
        at = np.searchsorted(ones, begin) + np.arange(first - k * SAMPLE, last - k * SAMPLE)
        return ((ones[at] - np.arange(first, last)) << self.low_bits) | self._low(first, last - first)

    def decode(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(self.values(k, min(k + BLOCK, self.n)) for k in range(0, self.n, BLOCK))])


class Shard:
    """Random access to a shard file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        self.width, self.n, self.ids, at, at_ids, self.first_id = struct.unpack(_TAIL, file.read_at(48, size - 48))
        self.has_ids, self.width = self.width < NO_ID, self.width % NO_ID
        if file.read_at(8, 0) != MAGIC:
            raise ValueError("not a token file")
        self.ends = EliasFano.from_bytes(file.read_at(at_ids - at, at))
        self.doc_ids = EliasFano.from_bytes(file.read_at(size - 48 - at_ids, at_ids))

    def tokens(self, i: int) -> np.ndarray:
        begin = self.ends.select(i - 1) if i else 0
        return self.span(begin, self.ends.select(i))

    def span(self, begin: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - begin) * self.width, 8 + begin * self.width), f"<u{self.width}").astype("<u4")


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Writes shard files below path; the manifest: shard, file, first_doc_id, n_docs, n_ids, start (ids before it)."""
    spark = docs.sparkSession
    text_batches(spark)
    tokenizer_path = tokenizer_path or default_path()
    kinds = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("first_doc_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        width = 2 if encode.tokenizer.get_vocab_size() <= 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        files, folder = _filesystem(path)
        out, name, ends, ids, total, serial = None, "", [], [], 0, TaskContext.get().partitionId() * 100_000

        def close() -> pa.RecordBatch:
            first = ids[0]
            numbers = np.array(ids) - first if first is not None else np.zeros(len(ids), np.int64)
            a, b = EliasFano.encode(np.array(ends)).to_bytes(), EliasFano.encode(numbers).to_bytes()
            at = 8 + total * width
            out.write(a + b + struct.pack(_TAIL, width + (NO_ID if first is None else 0), len(ids), total, at, at + len(a), first or 0))
            out.close()
            return pa.RecordBatch.from_pylist([{"shard": serial, "file": name, "first_doc_id": first, "n_docs": len(ids), "n_ids": total}], schema=kinds)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if out is not None and (total >= shard_ids or len(ids) >= shard_docs or (doc is None) != (ids[0] is None)):
                    yield close()
                    out, ends, ids, total, serial = None, [], [], 0, serial + 1
                if out is None:
                    files.create_dir(folder, recursive=True)
                    name = f"part-{serial:012d}-{uuid.uuid4().hex}.eftk"
                    out = files.open_output_stream(f"{folder}/{name}")
                    out.write(MAGIC)
                got = np.frombuffer(encode.ids(text or "") + end, "<u4")
                out.write(got.astype(f"<u{width}").tobytes())
                total += len(got)
                ends.append(total)
                ids.append(doc)
        if out is not None:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, "shard long, file string, first_doc_id long, n_docs long, n_ids long").write.parquet(f"{path}/manifest")
    manifest = spark.read.parquet(f"{path}/manifest")
    # a row per shard, so that the running total may stand in one task
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, path: str) -> DataFrame:
    """From the files of a manifest, a row per document: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _filesystem(path)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with files.open_input_file(f"{folder}/{name}") as file:
                    shard = Shard(file)
                    for first in range(0, shard.n, BLOCK):  # blocks of documents, so that memory doesn't follow the shard
                        last = min(first + BLOCK, shard.n)
                        ends, ids = shard.ends.values(first, last), shard.doc_ids.values(first, last) + shard.first_id
                        begins = np.concatenate([[shard.ends.select(first - 1) if first else 0], ends[:-1]])
                        crc = []
                        for k in range(0, last - first, 500):
                            b, e = begins[k : k + 500].tolist(), ends[k : k + 500].tolist()
                            block = memoryview(shard.span(b[0], e[-1]).tobytes())
                            crc += [zlib.crc32(block[4 * (x - b[0]) : 4 * (y - b[0])]) for x, y in zip(b, e)]
                        names = pa.array(ids) if shard.has_ids else pa.nulls(len(ids), pa.int64())
                        yield pa.RecordBatch.from_arrays([names, pa.array(begins + start), pa.array(ends - begins), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a task per shard; the rows are too small for Spark to keep them apart by itself
    spread = manifest.select("shard", "file", "start").repartitionByRange(max(1, manifest.count()), "shard")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    path = shared_dir(docs.sparkSession)
    return read_tokens(write_tokens(docs, path, tokenizer_path, end_id, shard_ids), path)
