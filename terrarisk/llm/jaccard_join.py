"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its distinct 4-word shingles (64-bit hashes). Equal sets are one class. The sets are sorted
by one global order, rare shingles first; the rarity comes from a counting sketch of fixed size over all documents.
Two sets that overlap in alpha shingles share at least l of the first n - alpha + l shingles of each, for every l.
Each set picks its l by the estimated cost of its candidates (longer lists scanned against fewer sets verified), and a
pair must share l = min(l_a, l_b) shingles of these prefixes at positions that still allow the overlap.

Pairs inside one component need no link, so candidates come in rounds, and components are joined between them. A star
round takes every set with one set, the pivot, of each of its prefix shingles (another pivot for each shingle and
round, `PIVOTS` of them after the first round), which is linear in the prefixes. Shingles that no other prefix has lower what a pair can share, so that edited
copies too far from all others meet none of them. Star rounds go on while they join components and the shingles that still span
several would make more than `FANOUT` pairs a set: a set that links with many of a large component meets one of them by a
pivot, and not all of them later. What is left then is taken whole: for each such shingle the sets
outside the largest component with the sets of other components, kept if they share as many shingles as their level
asks. Every row of a shingle carries 256 bits of its set's signature, so that sets which differ in too many shingles make no
pair in either kind of round. A bound from whole parity signatures drops most pairs that can't reach the threshold; of the others each set's nearest
is compared first, on the whole sets, and then those that still lie in two components. Sets meet in cells of one set
and at most `CELL` others.

Defined results: null texts and texts without words have no shingles, are alone and keep their own doc_id; fewer than
four words are one shingle; repeated rows are members of one class; rows with one doc_id and different texts are judged
one by one; null doc_ids are rows like others, but never name a component unless no other member has an id; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Cache, LOWER, column_bytes, marked, marks, met_in_buckets, mixed, remove, shared_dir, stored, text_batches
from .components import components

WIDTH = 4
PERCENT = 85
#: Counters of the rarity sketch: 4 bytes each on the way, one byte each when broadcast.
SKETCH = 1 << 21
CHUNK = 1 << 16
MAX_LEVEL = 6
#: Bits of a signature: half the set's size as a power of two, within these.
SIGNATURES = 256, 16384
#: The shortest signature as four numbers.
SHORT = ["s0", "s1", "s2", "s3"]
CELL = 256
#: Pairs a set at which open shingles are taken whole, and the most star rounds before that.
FANOUT = 2
ROUNDS = 8
#: Pivots of a shingle after the first star round, and the share of all sets joined so far that a round joins at most
#: where another one isn't worth it.
PIVOTS, SETTLED = 8, 0.005
BLOCK_WORDS = 200_000
#: Classes that a task remembers (in two generations) so as to read copies once; what it forgets is merged after the shuffle.
SEEN = 100_000
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


_log = logging.getLogger(__name__)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; texts are hashed together up to BLOCK_WORDS words."""
    at = 0
    while at < len(texts):
        block, n = [], 0
        while at < len(texts) and (not block or n < BLOCK_WORDS):
            block.append(texts[at].translate(LOWER).split())
            n += len(block[-1])
            at += 1
        Cache.only(__name__)
        h = mixed(np.fromiter((x for words in block for x in map(xxhash.xxh64_intdigest, words)), np.uint64, n))
        long = np.full(n, width, np.uint64)
        for k in range(width):
            m = max(0, n - k)
            long[:m] = mixed(long[:m] * _M[k % 4] + h[k : k + m])
        start = 0
        for words in block:
            size = len(words)
            if size >= width:
                s = np.sort(long[start : start + size - width + 1])
                new = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=new[1:])
                yield s[new]
            elif size:
                one = np.full(1, size, np.uint64)
                for k in range(size):
                    one = mixed(one * _M[k % 4] + h[start + k : start + k + 1])
                yield one
            else:
                yield np.zeros(0, np.uint64)
            start += size


def key_of(s: np.ndarray, collided: frozenset[int] = frozenset()) -> int:
    """The class of a set: a 64-bit hash of the sorted set; another one where different sets have the same."""
    key = xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)
    return check_of(s) if key in collided else key


def check_of(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), 1) - (1 << 63)


def signature(s: np.ndarray) -> bytes:
    """Parities of the shingles by their highest bits; a longer one folds to a shorter one by exclusive or of its halves."""
    bits = min(max(SIGNATURES[0], 1 << (len(s) // 2 - 1).bit_length()), SIGNATURES[1])
    place = (s & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sig: bytes) -> list[int]:
    """A signature at its shortest, as signed numbers."""
    return np.bitwise_xor.reduce(np.frombuffer(sig, np.int64).reshape(-1, len(SHORT)), 0).tolist()


def distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Places at which signatures differ, each pair at the length of its shorter one."""
    out = np.zeros(len(a), np.int64)
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b)]).reshape(-1, 2)
    for size in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes == size).all(1))
        sides = [np.frombuffer(b"".join(side[i] for i in at), np.uint64).reshape(len(at), -1) for side in (a, b)]
        least = min(x.shape[1] for x in sides)
        x, y = (np.bitwise_xor.reduce(x.reshape(len(at), -1, least), 1) for x in sides)
        out[at] = np.bitwise_count(x ^ y).sum(1)
    return out


class Seen:
    """Whether a key came before, as far as two generations of keys remember."""

    def __init__(self) -> None:
        self.now: set[int] = set()
        self.older: set[int] = set()

    def __call__(self, key: int) -> bool:
        known = key in self.now or key in self.older
        if len(self.now) >= SEEN:
            self.now, self.older = set(), self.now
        self.now.add(key)
        return known


def read_sets(docs: DataFrame, width: int, path: str) -> np.ndarray:
    """Writes (doc_id, ident, twin, n, key, other, sig, s0 to s3) of every row to path/sets, and returns the sketch (of fixed size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = np.zeros(SKETCH, np.uint32), Seen()
        kinds = {"doc_id": pa.int64(), "ident": pa.int64(), "twin": pa.int64(), "n": pa.int64(), "key": pa.int64(), "other": pa.int64(), "sig": pa.binary(), **dict.fromkeys(SHORT, pa.int64()), "chunk": pa.int32(), "counts": pa.binary()}

        def row(columns: dict, size: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in kinds.items()], names=list(kinds))

        for batch in batches:
            n, keys, others, sigs, new = [], [], [], [], []
            for s in shingle_sets(column_bytes(batch, "text"), width):
                n.append(len(s))
                keys.append(key_of(s) if len(s) else None)
                others.append(check_of(s) if len(s) else None)
                sigs.append(signature(s) if len(s) else None)
                if len(s) and not seen(keys[-1]):
                    new.append(s)
            short = [folded(s) if s else [None] * len(SHORT) for s in sigs]
            if new:
                sketch += np.bincount((np.concatenate(new) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
            yield row({"doc_id": batch.column("doc_id"), "ident": batch.column("ident"), "twin": batch.column("twin"), "n": n, "key": keys, "other": others, "sig": sigs} | {c: [x[k] for x in short] for k, c in enumerate(SHORT)}, len(n))
        parts = [(k, zlib.compress(sketch[k * CHUNK : (k + 1) * CHUNK].tobytes(), 1)) for k in range(SKETCH // CHUNK)] if seen.now else []
        yield row({"chunk": [k for k, _ in parts], "counts": [c for _, c in parts]}, len(parts))

    def total(part: pa.Table) -> pa.Table:
        out = np.zeros(CHUNK, np.uint64)
        for c in part.column("counts").to_pylist():
            out += np.frombuffer(zlib.decompress(c), np.uint32)
        return pa.table({"chunk": [part.column("chunk")[0].as_py()], "counts": [zlib.compress(out.astype(np.float32).tobytes(), 1)]}, schema=pa.schema([("chunk", pa.int32()), ("counts", pa.binary())]))

    docs.mapInArrow(run, "doc_id long, ident long, twin long, n long, key long, other long, sig binary, s0 long, s1 long, s2 long, s3 long, chunk int, counts binary").write.parquet(f"{path}/sets")
    rows = docs.sparkSession.read.parquet(f"{path}/sets").filter("chunk is not null").groupBy("chunk").applyInArrow(total, "chunk int, counts binary").collect()  # of fixed size
    sketch = np.zeros(SKETCH, np.float32)
    for chunk, counts in rows:
        sketch[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(zlib.decompress(counts), np.float32)
    return sketch


def rarity(sketch: np.ndarray) -> np.ndarray:
    """Classes 0 (rare) to 63 by the logarithm of a count above what chance puts into a counter."""
    mean = float(sketch.mean())
    return np.floor(np.log2(1 + np.maximum(0, sketch - mean - 3 * np.sqrt(mean)))).astype(np.uint8)


def prefix(s: np.ndarray, classes: np.ndarray, percent: int, max_level: int) -> tuple[np.ndarray, int]:
    """The set's prefix in the global order, and its level l."""
    c = classes[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
    n = len(s)
    first = n - -(-percent * n // 100) + 1
    order = np.argsort(c, kind="stable")[: min(n, first + max_level - 1)]  # s is sorted: ties go by the hash
    found = np.cumsum(2.0 ** c[order] - 1)
    levels = np.arange(1, len(order) - first + 2)
    cost = found[first - 1 :] * (1 + (4 + n / 8) / levels) + 2 * levels
    level = int(np.argmin(cost)) + 1
    return s[order[: first + level - 1]], level


def shared_prefixes(docs: DataFrame, classes: np.ndarray, collided: frozenset[int], width: int, percent: int, max_level: int) -> DataFrame:
    """Prefix shingles of at least two classes: token, key, n, pos, rank, level.

    pos is the shingle's place in the prefix, rank its place among those that another prefix has as well. A shingle that
    no other prefix has, before one that two sets share, isn't in both: both prefixes would hold it. So rank counts what
    two sets can share up to there.
    """
    spread = docs.sparkSession.sparkContext.broadcast(classes)  # SKETCH bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            rows = []
            for s in shingle_sets(column_bytes(batch, "text"), width):
                if not len(s) or seen(key := key_of(s, collided)):
                    continue
                got, level = prefix(s, spread.value, percent, max_level)
                rows.append((got, key, len(s), level))
            if rows:
                size = [len(r[0]) for r in rows]
                column = lambda k: np.repeat([r[k] for r in rows], size)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[0] for r in rows]).view(np.int64)), pa.array(column(1), pa.int64()), pa.array(column(2), pa.int32()), pa.array(np.concatenate([np.arange(1, k + 1) for k in size]), pa.int32()), pa.array(column(3), pa.int32())], names=["token", "key", "n", "pos", "level"])

    tokens = docs.select("text").mapInArrow(run, "token long, key long, n int, pos int, level int")
    own = ["token", "key", "n", "pos", "level"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by token; a token with one class goes, and repeated rows too."""
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        held: list[np.ndarray] | None = None  # the first row of a token that has one class so far
        open_token: tuple[int, int] | None = None  # a token that was found to have two, and its last key
        for batch in batches:
            arrays = [batch.column(c).to_numpy() for c in own]
            if held is not None:
                arrays = [np.concatenate([h, x]) for h, x in zip(held, arrays)]
            token, key = arrays[:2]
            new, start = np.ones(len(token), bool), np.ones(len(token), bool)
            start[1:] = token[1:] != token[:-1]
            new[1:] = start[1:] | (key[1:] != key[:-1])
            lead = np.maximum.accumulate(np.where(start, np.arange(len(token)), 0))
            many = np.zeros(len(token), bool)
            many[lead[new & ~start]] = True
            if open_token is not None and token[0] == open_token[0]:
                many[0], new[0] = True, key[0] != open_token[1]
            keep = many[lead] & new
            at = np.flatnonzero(keep)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(x[at], k) for x, k in zip(arrays, kinds)], names=own)
            last = lead[-1]
            if many[last]:
                held, open_token = None, (int(token[-1]), int(key[-1]))
            else:
                held, open_token = [x[last : last + 1] for x in arrays], None

    ordered = tokens.repartition("token").sortWithinPartitions("token", "key")
    met = ordered.mapInArrow(runs, "token long, key long, n int, pos int, level int")
    # a set has no more rows here than its prefix has shingles
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("pos")))
    return ranked.filter(f"100 * (rank + n - pos) >= {percent} * n")


def may_link(a: str, b: str, percent: int) -> str:
    """SQL: rows a and b of one token can belong to a pair over the threshold, at the pair's level.

    The pair must share alpha shingles: of those up to the token no more than the smaller rank, of the rest no more
    than either has. One of the first `level` that it shares lies where each side has alpha - level to come. The sets
    differ in at least as many shingles as their signatures in bits, so in no more than n + m - 2 alpha.
    """
    n, m = f"{a}n", f"{b}n"
    alpha = f"(({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent})"
    level = f"least({a}level, {b}level)"
    most = f"least({a}rank, {b}rank) + least({n} - {a}pos, {m} - {b}pos)"
    differ = " + ".join(f"bit_count({a}{c} ^ {b}{c})" for c in SHORT)
    return f"{differ} <= {n} + {m} - 2 * {alpha} and 100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) and {a}pos <= {n} - {alpha} + {level} and {b}pos <= {m} - {alpha} + {level} and {most} >= {alpha}"


def verify(pairs: DataFrame, classes: DataFrame, part: DataFrame | None, docs: DataFrame, width: int, percent: int, collided: frozenset[int]) -> DataFrame | None:
    """Compares pairs (key, centre) and joins those over the threshold to the components (node, root); returns them.

    The signatures' bound comes first. Each set's nearest candidate is compared before the rest, most of which then lie
    in one component and need no comparison.
    """
    spark = docs.sparkSession
    sig = classes.select("key", F.struct("ident", "n", "sig").alias("s"))
    # both sides of these joins grow with the corpus, so they are shuffled at every size
    both = pairs.hint("merge").join(sig.toDF("key", "a"), "key").hint("merge").join(sig.toDF("centre", "b"), "centre")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = distances(batch.column("a_sig").to_pylist(), batch.column("b_sig").to_pylist())
            total = batch.column("a_n").to_numpy() + batch.column("b_n").to_numpy()
            overlap = (total - apart) // 2
            at = np.flatnonzero(100 * overlap >= percent * (total - overlap))
            names = ["key", "centre", "key_ident", "centre_ident"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in names), pa.array(apart[at] / total[at], pa.float64())], names=[*names, "d"])

    flat = both.select("key", "centre", F.col("a.ident").alias("key_ident"), F.col("b.ident").alias("centre_ident"), *[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "ab" for c in ("n", "sig")])
    near, near_path = stored(flat.mapInArrow(bound, "key long, centre long, key_ident long, centre_ident long, d double"), "near")
    if near.isEmpty():
        return part
    order = F.struct("d", F.xxhash64("key", "centre"))
    ends = F.struct("key", "centre", "key_ident", "centre_ident")
    nearest = near.select(F.explode(F.array("key", "centre")).alias("end"), ends.alias("p"), order.alias("o")).groupBy("end").agg(F.min_by("p", "o").alias("p"))
    part = _joined(part, compare(nearest.select("p.*").distinct(), docs, width, percent, collided))
    rest = near.drop("d")
    if part is not None:
        apart = rest.hint("merge").join(part.toDF("key", "ra"), "key", "left").hint("merge").join(part.toDF("centre", "rb"), "centre", "left")
        rest = apart.filter("coalesce(ra, key) <> coalesce(rb, centre)").drop("ra", "rb")
    rest, rest_path = stored(rest, "rest")
    if not rest.isEmpty():
        part = _joined(part, compare(rest, docs, width, percent, collided))
    for path in (near_path, rest_path):
        remove(spark, path)
    return part


def _joined(part: DataFrame | None, links: DataFrame) -> DataFrame | None:
    if links.isEmpty():
        return part
    return components(links if part is None else part.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))


def compare(near: DataFrame, docs: DataFrame, width: int, percent: int, collided: frozenset[int]) -> DataFrame:
    """The pairs (a, b) of near (key, centre, their idents) whose sets reach the threshold; sets are made anew from the
    texts of their representatives. A centre meets its keys in cells of about CELL."""
    degree = near.groupBy("centre").agg(F.count("*").alias("d"))
    cell = F.pmod(F.xxhash64("key"), F.ceil(F.col("d") / CELL)).alias("cell")
    stars, path = stored(near.hint("merge").join(degree, "centre").select("centre", cell, "key", "key_ident", "centre_ident"), "cells")
    rows = stars.select("centre", "cell", "key").unionByName(stars.select("centre", "cell", F.col("centre").alias("key")).distinct())

    ends = F.explode(F.array(*[F.struct(F.col(f"{c}_ident").alias("ident"), F.col(c).alias("key")) for c in ("key", "centre")]))
    wanted = stars.select(ends.alias("e")).groupBy("e.ident").agg(F.first("e.key").alias("key"))
    # rows of one id and text are taken once
    few = met_in_buckets(docs.select("ident", "twin", "text"), F.col("ident"), wanted, F.col("ident")).dropDuplicates(["ident", "twin"])
    texts = few.hint("merge").join(wanted, "ident").select("key", "text")

    def meet(part: pa.Table) -> pa.Table:
        centre = part.column("centre")[0].as_py()
        own = {k: s for k, s in zip(part.column("key").to_pylist(), shingle_sets(column_bytes(part, "text"), width)) if len(s) and key_of(s, collided) == k}
        c, out = own.pop(centre), []
        for k, s in own.items():
            common = len(np.intersect1d(c, s, assume_unique=True))
            if 100 * common >= percent * (len(c) + len(s) - common):
                out.append(k)
        return pa.table({"a": pa.array([centre] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})

    links, _ = stored(rows.hint("merge").join(texts, "key").groupBy("centre", "cell").applyInArrow(meet, "a long, b long"), "links")
    remove(docs.sparkSession, path)
    return links


#: What a shingle's row says of its set.
OWN = ["key", "n", "pos", "rank", "level", *SHORT]


def _rooted(shared: DataFrame, part: DataFrame | None) -> DataFrame:
    own = shared.select("token", *OWN)
    if part is None:
        return own.withColumn("root", F.col("key"))
    return own.hint("merge").join(part.toDF("key", "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))


def grouped(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, max_level: int = MAX_LEVEL) -> DataFrame:
    """A row per row of docs: doc_id, ident, twin, n_shingles, root (of its component; null without words), component_id."""
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession)
    text_batches(spark)
    docs = marked(docs)
    sketch = read_sets(docs, width, path)
    members = spark.read.parquet(f"{path}/sets").filter("chunk is null").select("doc_id", "ident", "twin", "n", "key", "other", "sig", *SHORT)
    rows = members.filter("key is not null")

    def classed(rows: DataFrame) -> tuple[DataFrame, str]:
        return stored(rows.groupBy("key").agg(F.min("ident").alias("ident"), F.min("doc_id").alias("first_id"), F.min("other").alias("lo"), F.max("other").alias("hi"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in ("sig", *SHORT)]), "classes")

    classes, classes_path = classed(rows)
    # different sets with one 64-bit hash: a handful in ten thousand million sets
    collided = frozenset(r.key for r in classes.filter("lo <> hi").select("key").collect())
    if collided:
        again = F.when(F.col("key").isin(list(collided)), F.col("other")).otherwise(F.col("key"))
        members, rows = members.withColumn("key", again), rows.withColumn("key", again)
        classes, classes_path = classed(rows)
    prefixes = shared_prefixes(docs, rarity(sketch), collided, width, percent, max_level)  # dealt by key
    shared, shared_path = stored(prefixes.hint("merge").join(classes.select("key", *SHORT), "key"), "shared")

    part, before, rows, rows_path = None, None, shared, shared_path
    joined, fresh = 0, 0  # sets that have met their component's root: in all, and by the last round
    for number in range(1, ROUNDS + 1):
        # the rows of shingles that span several components, with the pivot of the round; dealt by shingle once for all of it
        own = _rooted(rows, part).repartition("token")
        seeds = range(1 if number == 1 else PIVOTS)
        first = lambda p, key, k: F.min_by(p, F.xxhash64("token", key, F.lit(number), F.lit(k))).alias(f"p{k}")
        sized = own.groupBy("token", "root").agg(F.count("*").alias("m"), *[first(F.struct(*OWN, "root"), "key", k) for k in seeds])
        tokens = sized.groupBy("token").agg(F.sum("m").alias("all"), F.max_by("root", F.struct("m", "root")).alias("largest"), F.max("m").alias("most"), F.count("*").alias("roots"), *[first(F.col(f"p{k}"), f"p{k}.key", k) for k in seeds]).filter("roots > 1")
        tokens = tokens.withColumn("p", F.array_distinct(F.array(*[f"p{k}" for k in seeds]))).drop(*[f"p{k}" for k in seeds])
        open_rows, open_path = stored(own.hint("merge").join(tokens, "token"), "open")
        remove(spark, rows_path)  # shingles of one component stay so: the next round goes on from the open ones
        rows, rows_path = open_rows, open_path
        left = open_rows.agg(F.sum(F.col("all") - F.col("most")).alias("pairs"), F.count("*").alias("sets")).first()
        _log.info("round %d: %s sets of open shingles, %s pairs if taken whole", number, left.sets, left.pairs)
        if not left.sets:
            break
        # few pairs, or a round that has joined next to nothing: the rest is taken whole
        settled = before is not None and left.pairs > 0.8 * before and fresh <= SETTLED * joined
        whole = (number > 1 and left.pairs <= FANOUT * left.sets) or number == ROUNDS or settled
        if whole:
            a = open_rows.filter("root <> largest").select("token", *[F.col(c).alias(f"a_{c}") for c in (*OWN, "root")])
            b = open_rows.select("token", *[F.col(c).alias(f"b_{c}") for c in (*OWN, "root", "largest")])
            met = a.hint("merge").join(b, "token").filter(f"a_root <> b_root and (b_root = b_largest or a_key < b_key) and {may_link('a_', 'b_', percent)}")
            ends = [F.least("a_key", "b_key").alias("lo"), F.greatest("a_key", "b_key").alias("hi")]
            counted = met.groupBy(*ends).agg(F.count("*").alias("c"), F.first(F.least("a_level", "b_level")).alias("level"), F.min("a_key").alias("centre")).filter("c >= level")
            pairs = counted.select(F.when(F.col("centre") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("key"), "centre")
        else:
            near = F.expr(f"filter(p, x -> x.root <> root and {may_link('', 'x.', percent)})")
            pairs = open_rows.select("key", F.explode(near).alias("x")).select("key", F.col("x.key").alias("centre")).distinct()
        part = verify(pairs, classes, part, docs, width, percent, collided)
        now = 0 if part is None else part.filter("node <> root").count()
        before, joined, fresh = left.pairs, now, now - joined
        if whole:
            break
    remove(spark, rows_path)

    named = classes.select("key", "first_id")
    named = named.withColumn("root", F.col("key")) if part is None else named.hint("merge").join(part.toDF("key", "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    names = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_key = named.hint("merge").join(names, "root").select("key", "root", "component_id")
    # copies are many rows of one key, so the classes are the side that a split of that key repeats
    return members.hint("merge").join(by_key, "key", "left").select("doc_id", "ident", "twin", F.col("n").alias("n_shingles"), "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, max_level: int = MAX_LEVEL) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id."""
    return grouped(docs, width, percent, max_level).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Of each component one row of docs, whole; rows without words are no one's copies and all stay.

    The row with the smallest doc_id stays (null ones come last), among rows with one doc_id and linked texts any one.
    """
    found = grouped(docs, width, percent).filter("root is not null")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "ident", "twin")).alias("r")).select(F.col("r.ident").alias("_ident"), F.col("r.twin").alias("_twin"))
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.filter(has_words).withColumns({f"_{k}": v for k, v in marks().items()})
    # equal rows are merged in each task before the shuffle, which is needed at every size
    kept = keyed.dropDuplicates(["_ident", "_twin"]).hint("merge").join(first, ["_ident", "_twin"])
    return kept.select(docs.columns).unionByName(docs.filter(~has_words))
