"""Best-fit packing of documents into token sequences by a grouping genetic algorithm on islands.

Documents are tokenised where they lie; those longer than a sequence are cut into full pieces and one first piece that
may be shorter. Full pieces are sequences by themselves. The others are dealt to blocks by hash; each block is evolved
on several islands. A chromosome is a list of bins. Crossover injects whole well-filled bins of one parent into the
other, removes the bins that now hold duplicates, and best-fits the displaced documents; mutation empties some of the
least filled bins. After each epoch the islands of a block pass their elites on in a ring. The bins that stay under
`pool_fill` are then pooled across blocks, dealt anew bin by bin and evolved once more with their present packing as
an individual, so that pooling never adds a sequence. A block whose best-fit-decreasing packing (or the one it comes with)
meets a lower bound is done and goes to no island; on the islands a block ends early when it meets the bound.

Defined results: null and empty texts are the end id alone; repeated rows are packed as often as they occur; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, text_batches
from .tokens import default_path, encoder

CAPACITY = 2048
END_ID = 0
BLOCK_ITEMS = 2048
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 8
POPULATION = 5
POOL_FILL = 0.98
_PIECES = "item long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents, with a number (item) that is unique among them."""
    tokenizer_path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        item = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = memoryview(encode.ids(text or "") + end)
                n = len(ids) // 4
                begin, size = 0, n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    rows.append((item, doc, piece, begin, size, zlib.crc32(ids[4 * begin : 4 * (begin + size)])))
                    item, begin, size = item + 1, begin + size, capacity
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(zip(*rows))], names=[x.split()[0] for x in _PIECES.split(", ")])

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(b for b in batches if b.num_rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(full, _PIECES)


class Bins:
    """An individual: the items of each bin, and the bins by their free space."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.size: list[int] = sizes.tolist()
        self.items: dict[int, list[int]] = {}
        self.free: dict[int, int] = {}
        self.by_free: dict[int, list[int]] = {}
        self.mask, self.next = 0, 0

    def _put(self, b: int, free: int) -> None:
        self.free[b] = free
        self.by_free.setdefault(free, []).append(b)
        self.mask |= 1 << free

    def _take(self, b: int) -> int:
        free = self.free.pop(b)
        at = self.by_free[free]
        at.remove(b)
        if not at:
            del self.by_free[free]
            self.mask &= ~(1 << free)
        return free

    def add_bin(self, items: list[int], free: int | None = None) -> None:
        """A bin of these items; its free space, where it is known, isn't summed again."""
        b, self.next = self.next, self.next + 1
        self.items[b] = items
        self._put(b, self.capacity - sum(map(self.size.__getitem__, items)) if free is None else free)

    def drop_bin(self, b: int) -> list[int]:
        self._take(b)
        return self.items.pop(b)

    def best_fit(self, items: list[int]) -> None:
        """Places items, in their order, each in the bin that it leaves least room in."""
        for i in items:
            size = self.size[i]
            rest = self.mask >> size
            if rest:
                free = size + (rest & -rest).bit_length() - 1
                b = self.by_free[free][-1]
                self._take(b)
                self.items[b].append(i)
                self._put(b, free - size)
            else:
                self.add_bin([i])

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then bins of uneven fill."""
        return -len(self.items), sum((1 - f / self.capacity) ** 2 for f in self.free.values())

    def assignment(self) -> np.ndarray:
        out = np.empty(len(self.sizes), np.int64)
        for k, items in enumerate(self.items.values()):
            out[items] = k
        return out

    @classmethod
    def of(cls, sizes: np.ndarray, capacity: int, assignment: np.ndarray) -> Bins:
        out = cls(sizes, capacity)
        order = np.argsort(assignment, kind="stable")
        for items in np.split(order, np.flatnonzero(np.diff(assignment[order])) + 1):
            out.add_bin(items.tolist())
        return out


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: by the total, and by items that can't share a bin."""
    best = -(-int(sizes.sum()) // capacity)
    total = np.bincount(sizes, minlength=capacity + 1)
    count, weight = np.cumsum(total), np.cumsum(total * np.arange(capacity + 1))
    for k in range(1, capacity // 2 + 1):
        large = count[capacity] - count[capacity - k]
        half = count[capacity - k] - count[capacity // 2]
        room = half * capacity - (weight[capacity - k] - weight[capacity // 2])
        middle = weight[capacity // 2] - weight[k - 1]
        best = max(best, int(large + half + max(0, -(-(middle - room) // capacity))))
    return best


def crossover(a: Bins, b: Bins, rng: np.random.Generator) -> Bins:
    """Whole well-filled bins of b go into a; bins of a with duplicates go; displaced items are placed by best fit."""
    fills = sorted(b.free, key=b.free.__getitem__)
    gene = [k for k in fills[: max(1, len(fills) // 4)] if rng.random() < 0.5] or [fills[0]]
    injected = {i for k in gene for i in b.items[k]}
    child, displaced = Bins(a.sizes, a.capacity), []
    for k, items in a.items.items():
        if injected.isdisjoint(items):
            child.add_bin(list(items), a.free[k])
        else:
            displaced += [i for i in items if i not in injected]
    for k in gene:
        child.add_bin(list(b.items[k]), b.free[k])
    child.best_fit(sorted(displaced, key=lambda i: -a.size[i]))
    return child


def mutate(a: Bins, rng: np.random.Generator) -> None:
    worst = sorted(a.free, key=lambda k: -a.free[k])
    chosen = worst[: max(2, len(worst) // 50)] + [worst[k] for k in rng.integers(0, len(worst), 3)]
    loose = [i for b in dict.fromkeys(chosen) for i in a.drop_bin(b)]
    a.best_fit(sorted(loose, key=lambda i: -a.size[i] * (1 + 0.2 * rng.random())))


def evolve(sizes: np.ndarray, seeds: list[np.ndarray], capacity: int, seed: int, generations: int = GENERATIONS, population: int = POPULATION) -> np.ndarray:
    """The best assignment found, from given ones and best-fit-decreasing with noise."""
    rng = np.random.default_rng(seed)
    bound = lower_bound(sizes, capacity)
    people = [Bins.of(sizes, capacity, s) for s in seeds]
    for one in people:
        if len(one.items) <= bound:
            return one.assignment()
    while len(people) < population:
        one = Bins(sizes, capacity)
        noise = 1 + (0.0 if not people else 0.15) * rng.random(len(sizes))
        one.best_fit(np.argsort(-sizes * noise, kind="stable").tolist())
        people.append(one)
        if len(one.items) <= bound:
            return one.assignment()
    for _ in range(generations):
        people.sort(key=Bins.fitness, reverse=True)
        if len(people[0].items) <= bound:
            break
        people = people[:population]
        children = []
        for _ in range(population):
            i, j = rng.choice(population, 2, replace=False)
            child = crossover(people[i], people[j], rng)
            if rng.random() < 0.6:
                mutate(child, rng)
            children.append(child)
        people += children
    return max(people, key=Bins.fitness).assignment()


def first_fit(sizes: np.ndarray, seeds: list[np.ndarray], capacity: int) -> tuple[np.ndarray, bool]:
    """The better of the given assignments and best-fit decreasing, and whether it meets the lower bound."""
    one = Bins(sizes, capacity)
    one.best_fit(np.argsort(-sizes, kind="stable").tolist())
    best = min([*(Bins.of(sizes, capacity, s) for s in seeds), one], key=lambda b: len(b.items))
    return best.assignment(), len(best.items) <= lower_bound(sizes, capacity)


def _on_islands(state: DataFrame, capacity: int, islands: int, epochs: int) -> DataFrame:
    """state: block, items, sizes, elites (assignments to start from). Returns block, items, sizes, elite."""

    def epoch(number: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for r in frame.itertuples(index=False):
                    sizes = np.asarray(r.sizes, np.int64)
                    seed = zlib.crc32(f"{r.block} {r.island} {number}".encode())
                    out.append(evolve(sizes, [np.unique(np.asarray(e), return_inverse=True)[1] for e in r.elites], capacity, seed))
                yield frame[["block", "island", "items", "sizes"]].assign(elite=out, bins=[int(e.max()) + 1 for e in out])

        return run

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [first_fit(np.asarray(r.sizes, np.int64), [np.unique(np.asarray(e), return_inverse=True)[1] for e in r.elites], capacity) for r in frame.itertuples(index=False)]
            yield frame[["block", "items", "sizes"]].assign(elite=[e for e, _ in got], done=[d for _, d in got])

    spark = state.sparkSession
    path = shared_dir(spark)
    state.repartition("block").mapInPandas(begin, "block long, items array<long>, sizes array<int>, elite array<long>, done boolean").write.parquet(path)
    begun = spark.read.parquet(path)
    schema = "block long, island int, items array<long>, sizes array<int>, elite array<long>, bins int"
    state = begun.filter("not done").select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "items", "sizes", F.array("elite").alias("elites")).repartition("block", "island")
    for number in range(epochs):
        path = shared_dir(spark)
        state.mapInPandas(epoch(number), schema).write.parquet(path)
        state = spark.read.parquet(path)
        if number < epochs - 1:
            guests = state.select("block", ((F.col("island") + 1) % islands).cast("int").alias("island"), F.col("elite").alias("guest"))
            state = state.join(guests, ["block", "island"]).select("block", "island", "items", "sizes", F.array("elite", "guest").alias("elites"))
    best = state.groupBy("block").agg(F.min_by(F.struct("items", "sizes", "elite"), F.struct("bins", "island")).alias("b")).select("block", "b.*")
    return begun.filter("done").select("block", "items", "sizes", "elite").unionByName(best)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, end_id: int = END_ID, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, pool_fill: float = POOL_FILL) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession)
    text_batches(spark)
    cut(docs, capacity, tokenizer_path, end_id).write.parquet(f"{path}/pieces")
    pieces = spark.read.parquet(f"{path}/pieces")
    loose = pieces.filter(F.col("length") < capacity).select("item", F.col("length").cast("int").alias("size"))
    blocks = max(1, -(-loose.count() // block_items))

    def gathered(rows: DataFrame) -> DataFrame:
        """rows: block, bin, item, size. A block's rows are bounded, for items are dealt by hash to enough blocks."""
        got = rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("item", "size", "bin"))).alias("r"))
        return got.select("block", F.col("r.item").alias("items"), F.col("r.size").alias("sizes"), F.col("r.bin").alias("bins"))

    first = gathered(loose.select(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), F.lit(0).cast("long").alias("bin"), "item", "size"))
    none = F.array().cast("array<array<long>>")
    packed = _on_islands(first.select("block", "items", "sizes", none.alias("elites")), capacity, islands, epochs)

    def bins(state: DataFrame) -> DataFrame:
        """block, bin, item, size, offset and the bin's fill."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for r in frame.itertuples(index=False):
                    sizes, at = np.asarray(r.sizes, np.int64), np.asarray(r.elite, np.int64)
                    order = np.argsort(at, kind="stable")
                    total = np.cumsum(sizes[order]) - sizes[order]
                    first = np.flatnonzero(np.diff(at[order], prepend=-1))
                    offset = total - np.repeat(total[first], np.diff(np.append(first, len(order))))
                    fill = np.bincount(at, sizes)
                    yield pd.DataFrame({"block": r.block, "bin": at[order], "item": np.asarray(r.items, np.int64)[order], "size": sizes[order], "offset": offset, "fill": fill[at[order]] / capacity})

        return state.mapInPandas(run, "block long, bin long, item long, size int, offset long, fill double")

    bins(packed).write.parquet(f"{path}/bins")
    done = spark.read.parquet(f"{path}/bins")
    low = done.filter(F.col("fill") < pool_fill).withColumn("bin", F.col("block") * F.lit(1 << 24) + F.col("bin"))
    groups = max(1, -(-low.count() // block_items))
    second = gathered(low.select(F.pmod(F.xxhash64("bin"), F.lit(groups)).alias("block"), "bin", "item", "size"))
    again = bins(_on_islands(second.select("block", "items", "sizes", F.array("bins").alias("elites")), capacity, islands, epochs))
    placed = done.filter(F.col("fill") >= pool_fill).select("item", (F.col("block") * F.lit(1 << 25) + F.col("bin") * 2).alias("sequence_id"), "offset").unionByName(again.select("item", (F.col("block") * F.lit(1 << 25) + F.col("bin") * 2 + 1).alias("sequence_id"), "offset"))
    full = pieces.filter(F.col("length") >= capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity).join(placed, "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    return rest.unionByName(full)
