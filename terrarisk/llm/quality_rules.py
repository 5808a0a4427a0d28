"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Word unigrams and bigrams of every text are hashed into buckets, whose number follows the n-grams of the corpus. Two
multinomials are counted over all documents: the raw corpus, and the trusted target (documents that a label calls
good). A document's score is the mean over its n-grams of log p_target - log p_raw, so that it doesn't grow with length;
a document below the threshold is rejected. Base rules (too few words, too much repetition) come first.

Tasks count their texts, and chunks of their counts are summed. Sums are kept in 16 bits: exact below 2^15, in steps of
1/1024 of a doubling above. While they take at most `TABLE_BYTES`, they are broadcast and documents are scored where
they lie. Beyond that neither a task's counts nor the sums come together: the n-grams of blocks of texts are dealt out
by chunk, those of each document as well, the task of a chunk returns what it adds to each document's score as integers,
whose sum has no order, and a document is known by a 64-bit hash of its id and text. Both ways give the same scores.

A document's own n-grams are left out of the raw corpus, and out of the target if it is trusted.

Defined results: null and empty texts have no words and fail the base rules; a document without n-grams has score 0;
repeated rows are judged one by one and alike; empty tables give empty results; without trusted labels the two
multinomials are equal, every score is 0 and only the base rules decide.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, Cache, WHITE, column_bytes, met_in_buckets, mixed, stored, text_batches

#: The least number of buckets, and the n-grams for which there is one.
BUCKETS = 1 << 14
GRAMS_A_BUCKET = 32
#: The most bytes of counts that are broadcast.
TABLE_BYTES = 64_000_000
#: Buckets of a chunk (as a power of two, 24 at most), and distinct n-grams of a block of texts.
CHUNK_BITS = 19
BLOCK = 1_000_000
#: Parts of a score are whole numbers of this fraction.
UNIT = 1 << 32
THRESHOLD = -0.11
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Counts below this are exact; above it, a doubling has STEPS codes.
EXACT, STEPS = 1 << 15, 1 << 10
SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))


def ngram_buckets(words: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the unigrams, then of the bigrams."""
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    grams = np.concatenate([h + np.uint64(1), (h[:-1] << np.uint64(32)) ^ (h[1:] + np.uint64(2))])
    return (mixed(grams) % np.uint64(buckets)).astype(np.int64)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of `width` words found at least twice in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key = ids[:n]
    for k in range(1, width):  # renumbered after each word, so that keys stay exact at any length
        key = key * len(number) + ids[k : k + n]
        if k < width - 1 and len(number) > 1 << 20:
            key = np.unique(key, return_inverse=True)[1]
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = count[at] > 1
    if not hit.any():
        return 0
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : k + n] |= hit
    return int(covered.sum())


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(text.translate(None, WHITE + _CONTINUATION)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def coded(counts: np.ndarray) -> np.ndarray:
    """Counts in 16 bits."""
    over = EXACT + np.rint(STEPS * np.log2(np.maximum(counts, EXACT) / EXACT))
    return np.where(counts < EXACT, counts, np.minimum(over, 65535)).astype(np.uint16)


def decoded(codes: np.ndarray) -> np.ndarray:
    codes = codes.astype(float)
    return np.where(codes < EXACT, codes, EXACT * 2.0 ** (np.maximum(codes - EXACT, 0) / STEPS))


class Totals:
    """Buckets, and all n-grams of the corpus and of the target."""

    def __init__(self, buckets: int, raw: int, target: int):
        self.buckets, self.raw, self.target = buckets, raw, target

    def parts(self, raw: np.ndarray, target: np.ndarray, k: np.ndarray, length: np.ndarray, trusted: np.ndarray) -> np.ndarray:
        """What buckets add to a document's summed log ratio, as whole numbers of UNIT: their coded counts, the
        document's own count k, and its length and trust."""
        p = (np.maximum(decoded(raw) - k, 0) + 0.5) / (np.maximum(self.raw - length, 0) + 0.5 * self.buckets)
        own = np.where(trusted, 1, 0)
        q = (np.maximum(decoded(target) - own * k, 0) + self.buckets * p) / (np.maximum(self.target - own * length, 0) + self.buckets)
        return np.rint(k * np.log(q / p) * UNIT).astype(np.int64)

    def score(self, h: np.ndarray, raw: np.ndarray, target: np.ndarray, trusted: bool) -> float:
        """Mean log ratio of a document's n-grams h, by the coded counts of all buckets."""
        if not len(h):
            return 0.0
        u, k = np.unique(h, return_counts=True)
        return float(self.parts(raw[u], target[u], k, np.int64(len(h)), np.bool_(trusted)).sum() / UNIT / len(h))


def n_grams(docs: DataFrame) -> int:
    """Unigrams and bigrams of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(max(0, 2 * len(text.split()) - 1) for batch in batches for text in column_bytes(batch, "text"))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return docs.select("text").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0


def bucket_count(grams: int) -> int:
    """As many as give each bucket GRAMS_A_BUCKET n-grams."""
    return max(BUCKETS, -(-grams // GRAMS_A_BUCKET))


#: Kinds of rows: counts of the corpus, of the target, and n-grams of the corpus with the documents that have them.
RAW, TARGET, SCORED = 0, 1, 2
GRAM_ROWS = "chunk int, kind int, keys binary, lengths binary, sizes binary, trusted binary, low binary, high binary, times binary"


def _packed(x: np.ndarray, kind: type) -> bytes:
    return zlib.compress(x.astype(kind).tobytes(), 1)


def _unpacked(x: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind).astype(np.int64)


def gram_rows(docs: DataFrame, buckets: int, chunk_bits: int, kind: int) -> DataFrame:
    """GRAM_ROWS of docs (key, trusted, text): a row per block of texts and chunk; SCORED ones with the texts' keys,
    lengths, trust and number of n-grams in the chunk."""
    names = [c.split()[0] for c in GRAM_ROWS.split(", ")]

    def rows(held: list[tuple[int, bool, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        grams, times = np.concatenate([r[2] for r in held]), np.concatenate([r[3] for r in held])
        keys, trusted, lengths = np.array([r[0] or 0 for r in held], np.int64), np.array([r[1] for r in held]), np.array([r[3].sum() for r in held])
        doc = np.repeat(np.arange(len(held)), [len(r[2]) for r in held])
        if kind != SCORED:
            grams, at = np.unique(grams, return_inverse=True)
            times, doc = np.bincount(at, times).astype(np.int64), np.zeros(len(grams), np.int64)
        chunk = grams >> chunk_bits
        order = np.argsort(chunk, kind="stable")
        grams, times, doc, chunk = grams[order] & ((1 << chunk_bits) - 1), times[order], doc[order], chunk[order]
        ends = [0, *(np.flatnonzero(np.diff(chunk)) + 1), len(chunk)]
        out = []
        for a, b in zip(ends, ends[1:]):
            d, n = np.unique(doc[a:b], return_counts=True)
            own = (keys[d].tobytes(), _packed(lengths[d], np.uint32), _packed(n, np.uint32), _packed(trusted[d], np.uint8)) if kind == SCORED else (None,) * 4
            out.append((int(chunk[a]), kind, *own, (grams[a:b] & 0xFFFF).astype(np.uint16).tobytes(), _packed(grams[a:b] >> 16, np.uint8), _packed(times[a:b], np.uint32)))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k < 2 else pa.binary()) for k, c in enumerate(zip(*out))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            Cache.only(__name__)
            for key, good, text in zip(batch.column("key").to_pylist(), batch.column("trusted").to_pylist(), column_bytes(batch, "text")):
                if words := text.split():
                    held.append((key, good, *np.unique(ngram_buckets(words, buckets), return_counts=True)))
                    size += len(held[-1][2])
                    if size >= BLOCK:
                        yield rows(held)
                        held, size = [], 0
        if held:
            yield rows(held)

    return docs.select("key", "trusted", "text").mapInArrow(run, GRAM_ROWS)


def dense_rows(docs: DataFrame, buckets: int, chunk_bits: int, kind: int) -> DataFrame:
    """Rows (chunk, kind, counts) of docs (text): each task's counts of all buckets, as the four planes of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.uint32)
        for batch in batches:
            Cache.only(__name__)
            for text in column_bytes(batch, "text"):
                if words := text.split():
                    u, k = np.unique(ngram_buckets(words, buckets), return_counts=True)
                    counts[u] += k.astype(np.uint32)
        for chunk in range(-(-buckets >> chunk_bits) if counts.any() else 0):
            own = counts[chunk << chunk_bits : (chunk + 1) << chunk_bits]
            data = zlib.compress(np.ascontiguousarray(own.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], names=["chunk", "kind", "counts"])

    # every task sends a table of all buckets, so their number follows the cores, not the input
    return docs.select("text").coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "chunk int, kind int, counts binary")


def with_trust(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with _trusted (whether a label calls the document good), and the trusted ones alone.

    Only documents in a bucket of a trusted id are shuffled to be joined with the labels.
    """
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    some = met_in_buckets(docs, F.col("doc_id").cast("long"), good, F.col("_id").cast("long"))
    others = met_in_buckets(docs, F.col("doc_id").cast("long"), good, F.col("_id").cast("long"), how="leftanti")
    # by a shuffle at every size: the labels grow with the corpus
    joined = some.hint("merge").join(good.withColumn("_trusted", F.lit(True)), F.col("doc_id") == F.col("_id"), "left").select(*docs.columns, F.coalesce("_trusted", F.lit(False)).alias("_trusted"))
    joined, _ = stored(joined, "joined")  # it is read three times; labels may cover a third of the documents
    return joined.unionByName(others.withColumn("_trusted", F.lit(False))), joined.filter("_trusted")


def _read(row: dict) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(row["low"], np.uint16).astype(np.int64) | _unpacked(row["high"], np.uint8) << 16
    return at, _unpacked(row["times"], np.uint32)


def _counted(part: pa.Table, chunk_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Coded counts of a chunk's buckets: raw, target."""
    raw, good = np.zeros(1 << chunk_bits, np.int64), np.zeros(1 << chunk_bits, np.int64)
    for i in range(part.num_rows):
        row = {c: part.column(c)[i].as_py() for c in ("kind", "low", "high", "times")}
        np.add.at(good if row["kind"] == TARGET else raw, *_read(row))
    return coded(raw), coded(good)


def _summed(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Coded counts of a chunk's buckets from dense rows: raw, target."""
    total: dict[int, np.ndarray] = {}
    for kind, data in zip(part.column("kind").to_pylist(), part.column("counts")):
        planes = np.frombuffer(zlib.decompress(data.as_py()), np.uint8).reshape(4, -1)
        own = np.ascontiguousarray(planes.T).view(np.uint32).ravel()
        total[kind] = total[kind] + own if kind in total else own.astype(np.int64)
    size = len(next(iter(total.values())))
    return coded(total.get(RAW, np.zeros(size, np.int64))), coded(total.get(TARGET, np.zeros(size, np.int64)))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int | None = None, chunk_bits: int = CHUNK_BITS, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed and kept.

    Columns of docs that are called so are replaced; all others, whatever they are called, stand aside and come back.
    """
    aside, back = apart(docs, [*_NEW])
    out = _judged(aside, labels, threshold, buckets, chunk_bits, table_bytes)
    return out.select(*back, *_NEW)


_NEW = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept")


def _judged(docs: DataFrame, labels: DataFrame, threshold: float, buckets: int | None, chunk_bits: int, table_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    text_batches(spark)
    grams = n_grams(docs)
    buckets = buckets or bucket_count(grams)
    key = F.xxhash64("doc_id", "text")
    marked, trusted = with_trust(docs, labels)
    keyed = lambda df: df.select(key.alias("key"), F.col("_trusted").alias("trusted"), "text")
    small = 4 * buckets <= table_bytes
    totals = Totals(buckets, grams, n_grams(trusted))
    new = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double, base_failed boolean, kept boolean"
    names = {x.split()[0] for x in new.split(", ")}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in names), new])

    def judge(batch: pa.RecordBatch, score: Callable) -> pa.RecordBatch:
        n, base, llr = [], [], []
        for i, text in enumerate(column_bytes(batch, "text")):
            words = text.split()
            n.append(len(words))
            base.append(base_counts(text, words))
            llr.append(score(i, words))
        n_words, rest, scores = np.array(n, np.int64), np.array(base, np.int64).reshape(-1, 4), np.array(llr, float)
        failed = (n_words < MIN_WORDS) | (100 * rest[:, 3] > MAX_REPEAT_PERCENT * n_words)
        columns = {"n_words": n_words} | {c: rest[:, i] for i, c in enumerate(("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))} | {"llr": scores, "base_failed": failed, "kept": ~failed & (scores >= threshold)}
        batch = batch.select([c for c in batch.schema.names if c not in ("_trusted", "_llr", *columns)])
        return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, columns.values())], names=[*batch.schema.names, *columns])

    if not totals.target or small:
        codes = np.zeros((2, buckets if totals.target else 0), np.uint16)
        if totals.target:
            def add(part: pa.Table) -> pa.Table:
                raw, good = _summed(part)
                return pa.table({"chunk": part.column("chunk")[:1], "raw": [zlib.compress(raw.tobytes(), 1)], "good": [zlib.compress(good.tobytes(), 1)]}, schema=pa.schema([("chunk", pa.int32()), ("raw", pa.binary()), ("good", pa.binary())]))

            rows = dense_rows(docs, buckets, chunk_bits, RAW).unionByName(dense_rows(trusted, buckets, chunk_bits, TARGET))
            for chunk, *both in rows.groupBy("chunk").applyInArrow(add, "chunk int, raw binary, good binary").toLocalIterator():  # at most table_bytes
                at = slice(chunk << chunk_bits, min(buckets, chunk + 1 << chunk_bits))
                for k in (0, 1):
                    codes[k, at] = np.frombuffer(zlib.decompress(both[k]), np.uint16)
        spread = spark.sparkContext.broadcast(codes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            raw, good = spread.value
            for batch in batches:
                if batch.num_rows:
                    Cache.only(__name__)
                    own = batch.column("_trusted").to_pylist()
                    yield judge(batch, lambda i, words: totals.score(ngram_buckets(words, buckets), raw, good, own[i]) if totals.target else 0.0)

        return marked.mapInArrow(run, schema)

    def scored(part: pa.Table) -> pa.Table:
        raw, good = _counted(part, chunk_bits)
        keys, sums, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(part.num_rows):
            row = {c: part.column(c)[i].as_py() for c in part.column_names}
            if row["kind"] == SCORED:
                at, k = _read(row)
                n = _unpacked(row["sizes"], np.uint32)
                each = totals.parts(raw[at], good[at], k, np.repeat(_unpacked(row["lengths"], np.uint32), n), np.repeat(_unpacked(row["trusted"], np.uint8), n) > 0)
                first = np.cumsum(n) - n
                keys.append(np.frombuffer(row["keys"], np.int64))
                sums.append(np.add.reduceat(each, first))
                counts.append(np.add.reduceat(k, first))
        return pa.table({"key": np.concatenate(keys), "part": np.concatenate(sums), "n": np.concatenate(counts)})

    rows = gram_rows(keyed(marked), buckets, chunk_bits, SCORED).unionByName(gram_rows(keyed(trusted), buckets, chunk_bits, TARGET))
    parts = rows.groupBy("chunk").applyInArrow(scored, "key long, part long, n long")
    # rows with one key bring their parts and n-grams alike, so their mean is that of one
    found = parts.groupBy("key").agg((F.sum("part") / F.lit(float(UNIT)) / F.sum("n")).alias("_llr")).withColumnRenamed("key", "_key")
    ready = docs.withColumn("_key", key).hint("merge").join(found, "_key", "left").select(*docs.columns, F.coalesce("_llr", F.lit(0.0)).alias("_llr"))

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                llr = batch.column("_llr").to_pylist()
                yield judge(batch, lambda i, words: llr[i])

    return ready.mapInArrow(given, schema)
