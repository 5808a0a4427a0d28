"""Benchmark decontamination with a distributed positional inverted index.

`build_index` stores, for segments of the training documents, a postings list (sorted word positions) for each of their
terms, and the documents' places in each segment. Every document lies in one segment, so a segment answers phrase
queries alone. The index knows nothing of the test items: `find_indexed` asks one index for any benchmark, any width and
any slop. `search` joins the wanted terms to the postings and takes the windows to the segments that hold their rarest
term: its list, shifted by the term's offset, is intersected with the shifted lists of the next rarest terms until none
is left or all are met (exact phrase), or each position must have every term within `slop` of its place (proximity).

Test items go through the driver in rounds of at most `ROUND_BYTES`, so that a benchmark of any size is searched whole;
all rounds read the one index, and what they find of a document is merged.

Words: A-Z lowered, runs of other bytes than ASCII non-alphanumerics. Defined results: null and empty texts have no
words and are never hit; items without words have no windows; rows of one item_id are one item; items with equal texts
are all reported; items without an item_id count as one item, which the hash leaves out; repeated rows are judged one
by one; null doc_ids are rows like others; other columns are ignored; empty tables give empty results (no items: no
hits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, marked, remove, shared_dir, text_batches

WINDOW = 10
#: Bytes (about) of the terms and windows that one round broadcasts.
ROUND_BYTES = 32_000_000
#: Words of a segment of the index; a longer document is a segment by itself.
SEGMENT_WORDS = 1_500_000
#: Rows of a batch of postings.
LISTS = 20_000
#: Stands for a term in the row that holds a segment's documents; no term is empty.
HEAD = b""
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def item_windows(text: bytes, width: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Distinct windows of `width` consecutive words; a shorter item is one window."""
    w = words_of(text)
    return list(dict.fromkeys(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))) if w else []


class _Numbers(dict):
    """Numbers words in the order in which they are first met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


INDEX = "segment string, term binary, n long, postings binary"


def _postings(segment: str, numbers: _Numbers, found: list[np.ndarray], starts: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows of a segment's terms in the terms' order; found: the numbers of each document's words, in their order."""
    sizes = np.array([len(x) for x in found])
    term = np.concatenate(found)
    pos = (np.arange(len(term)) + np.repeat(np.array(starts) - np.cumsum(sizes) + sizes, sizes)).astype("<u4")
    pos = pos[np.argsort(term, kind="stable")]
    size = np.bincount(term, minlength=len(numbers))
    ends = np.concatenate([[0], np.cumsum(size)])
    words = list(numbers)
    order = sorted(range(len(words)), key=words.__getitem__)  # so that files have ranges of terms
    for k in range(0, len(order), LISTS):
        part = order[k : k + LISTS]
        lists = pa.array([pos[ends[i] : ends[i + 1]].tobytes() for i in part], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([segment] * len(part)), pa.array([words[i] for i in part], pa.binary()), pa.array(size[part], pa.int64()), lists], names=["segment", "term", "n", "postings"])


def build_index(docs: DataFrame, path: str, segment_words: int = SEGMENT_WORDS) -> None:
    """Writes the index of docs (doc_id, ident, twin, text) to path: a row per segment and term (n, postings), and one per
    segment with term HEAD (ids, null marks, idents, twins, first positions and word counts of its documents)."""

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, sizes, found, at, numbers = [], [], [], [], 0, _Numbers()
        serial = 0

        def close() -> Iterator[pa.RecordBatch]:
            name = f"{TaskContext.get().partitionId()}-{serial}"
            head = np.array([[r[0] or 0 for r in ids], [r[0] is None for r in ids], [r[1] for r in ids], [r[2] for r in ids], starts, sizes], np.int64).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([HEAD], pa.binary()), pa.array([len(ids)], pa.int64()), pa.array([head], pa.binary())], names=["segment", "term", "n", "postings"])
            yield from _postings(name, numbers, found, starts)

        for batch in batches:
            for *row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ident", "twin")), column_bytes(batch, "text")):
                words = words_of(text)
                if ids and at + len(words) > segment_words:
                    yield from close()
                    serial += 1
                    ids, starts, sizes, found, at, numbers = [], [], [], [], 0, _Numbers()
                found.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                ids.append(row)
                starts.append(at)
                sizes.append(len(words))
                at += len(words) + 1  # the place between two documents holds no word, so no phrase spans them
        if ids:
            yield from close()

    docs.select("doc_id", "ident", "twin", "text").mapInArrow(segment, INDEX).write.parquet(path)


def phrase_starts(lists: list[tuple[int, np.ndarray]], slop: int = 0) -> np.ndarray:
    """Starts at which every term lies at its offset (within slop); lists: (offset, sorted positions), rarest first."""
    offset, positions = lists[0]
    shifts = range(-slop, slop + 1)
    start = np.unique(np.concatenate([positions - offset + d for d in shifts])) if slop else positions - offset
    for offset, positions in lists[1:]:
        if not len(start):
            break
        i = np.searchsorted(positions, start + offset - slop)
        start = start[(i < len(positions)) & (positions[np.minimum(i, len(positions) - 1)] <= start + offset + slop)]
    return start


FOUND = "doc_id long, ident long, twin long, n_words long, spans array<long>, items array<string>"


def search(index: DataFrame, terms: dict[bytes, int], windows: list[tuple[tuple[int, ...], list[int]]], item_ids: list[str | None], slop: int, path: str) -> None:
    """Writes a row per document of the index, as FOUND, to path: spans are begin and end of each run of hit words, one
    after the other.

    terms: number of each term. windows: term numbers of a window, and the numbers of the items that have it. Both are
    of one round, whose bytes bound what is broadcast here.
    """
    spark = index.sparkSession
    wanted = spark.createDataFrame(pa.table({"term": pa.array([HEAD, *terms], pa.binary()), "number": pa.array([-1, *terms.values()], pa.int32())}))
    lists = index.join(F.broadcast(wanted), "term")
    # at most a row for each term of the round
    frequency = {r[0]: r[1] for r in lists.filter("number >= 0").groupBy("number").agg(F.sum("n")).collect()}
    plans: dict[int, list] = {}
    for terms_of, items in windows:
        order = sorted(range(len(terms_of)), key=lambda k: (frequency.get(terms_of[k], 0), k))
        if all(frequency.get(t, 0) for t in terms_of):
            plans.setdefault(terms_of[order[0]], []).append(([(terms_of[k], k) for k in order], len(terms_of), items))
    spread = spark.sparkContext.broadcast((plans, item_ids))

    def look(part: pa.Table) -> pa.Table:
        plans, item_ids = spread.value
        lists: dict[int, np.ndarray] = {}
        for term, data in zip(part.column("number").to_pylist(), part.column("postings").to_pylist()):
            lists[term] = np.frombuffer(data, "<u4").astype(np.int64) if term >= 0 else np.frombuffer(data, "<i8").reshape(6, -1)
        ids, absent, ident, twin, starts, sizes = lists[-1]
        marks = np.zeros(int(starts[-1] + sizes[-1]) + 2, np.int32)
        found: dict[int, set[int]] = {}
        for rarest in plans.keys() & lists.keys():
            for steps, size, items in plans[rarest]:
                if any(t not in lists for t, _ in steps):
                    continue
                at = phrase_starts([(k, lists[t]) for t, k in steps], slop)
                at = at[at >= 0]
                if len(at):
                    np.add.at(marks, at, 1)
                    np.add.at(marks, np.minimum(at + size, len(marks) - 1), -1)
                    for d in np.unique(np.searchsorted(starts, at, "right") - 1).tolist():
                        found.setdefault(d, set()).update(items)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(marks) > 0, [False]])))
        spans: dict[int, list[int]] = {}
        for a, b in edge.reshape(-1, 2).tolist():
            d = int(np.searchsorted(starts, a, "right") - 1)
            last = int(starts[d] + sizes[d])
            if a < last:  # with slop, a run may reach beyond its document
                spans.setdefault(d, []).extend((a - int(starts[d]), min(b, last) - int(starts[d])))
        names = [[item_ids[i] for i in found.get(d, ())] for d in range(len(ids))]
        return pa.table([pa.array(ids, mask=absent > 0), pa.array(ident), pa.array(twin), pa.array(sizes), pa.array([spans.get(d, []) for d in range(len(ids))], pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))], names=[c.split()[0] for c in FOUND.split(", ")])

    lists.select("segment", "number", "postings").groupBy("segment").applyInArrow(look, FOUND).write.parquet(path)
    spread.destroy()


def _rounds(benchmark: DataFrame, width: int, most: int) -> Iterator[tuple[dict, dict, list]]:
    """Terms, windows and item_ids of the items, in parts of about `most` bytes; at least one part."""
    terms, windows, numbers, size = {}, {}, {}, 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").orderBy("item_id").toLocalIterator():
        if size > most:
            yield terms, windows, list(numbers)
            terms, windows, numbers, size = {}, {}, {}, 0
        number = numbers.setdefault(item, len(numbers))
        for w in item_windows((text or "").encode(), width):
            size += 100 + 40 * len(w) + sum(len(x) + 60 for x in w if x not in terms)
            windows.setdefault(tuple(terms.setdefault(x, len(terms)) for x in w), set()).add(number)
    yield terms, windows, list(numbers)


def covered(spans: list[int]) -> list[int]:
    """Spans of several rounds as disjoint ones, in order."""
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def find(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = 0, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """A row per row of docs: doc_id, ident, twin (see common.marks), n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/index"
    text_batches(spark)
    build_index(marked(docs), path)
    found = find_indexed(spark.read.schema(INDEX).parquet(path), benchmark, width, slop, round_bytes)
    remove(spark, path)
    return found


def find_indexed(index: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = 0, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """As find, of the documents of an index; what it returns doesn't read the index any more."""
    spark = index.sparkSession
    path, found = shared_dir(spark), None
    for number, (terms, windows, item_ids) in enumerate(_rounds(benchmark, width, round_bytes)):
        search(index, terms, list(windows.items()), item_ids, slop, f"{path}/hits{number}")
        hits = spark.read.parquet(f"{path}/hits{number}")
        if found is None:
            found = hits
        else:  # equal rows have equal hits, so one of them stands for all
            more = hits.filter("size(items) > 0").dropDuplicates(["ident", "twin"]).select("ident", "twin", F.col("spans").alias("s"), F.col("items").alias("i"))
            none = F.array()
            found = found.hint("merge").join(more, ["ident", "twin"], "left").select("doc_id", "ident", "twin", "n_words", F.concat("spans", F.coalesce("s", none.cast("array<bigint>"))).alias("spans"), F.concat("items", F.coalesce("i", none.cast("array<string>"))).alias("items"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [sum(s[1::2]) - sum(s[::2]) for s in map(covered, batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "ident", "twin", "n_words")), pa.array(n, pa.int64()), batch.column("items")], names=["doc_id", "ident", "twin", "n_words", "n_hit", "items"])

    counted = found.mapInArrow(count, "doc_id long, ident long, twin long, n_words long, n_hit long, items array<string>")
    items = F.array_sort(F.array_distinct("items"))
    return counted.select("doc_id", "ident", "twin", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = 0, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    return find(docs, benchmark, width, slop, round_bytes).drop("ident", "twin")
