"""Hard-negative mining by a vertical scan of the vectors (BOND: branch and bound on decomposed data).

A task holds a block of rows by dimension. For each anchor it reads dimensions in falling magnitude of the anchor's
components and adds their products to partial scores; what the dimensions not yet read can still add lies between sums
of their least and largest contributions over the block. Rows whose bounds fall short of what is wanted leave the
candidates, until few are left, whose scores are then complete and exact.

Anchors are taken in blocks of at most `block` rows, each of which meets all rows in two scans: the first finds the
nearest rows of the anchor's label (positives), the second, within the window that each positive sets, the nearest rows
of other labels. Tasks return a few rows for each anchor, of which Spark ranks the best; the driver holds one block of
anchors and its positives.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part, nor do rows whose
vector has another length than most. A null vec_id is no anchor; as a positive or negative it stands after all others of
its score. Rows of the anchor's own vec_id aren't other rows. Repeated rows are ranked one by one, repeated anchors taken
once. An anchor without positives, and a positive without rows in its window, give no rows; a negative positive_score
has an empty window. Scaled components beyond 2^26 count as 2^26. Extra columns, whatever they are called, aren't read.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import matrix, scaled

FACTOR = 256
#: Anchors of a round, rows of a task's block, and dimensions read between two rounds of bounds.
ANCHORS, BLOCK, STEP = 4096, 8192, 8
_NO_ID = (1 << 63) - 1
_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_MET = "anchor int, vec_id long, score long"


class Block:
    """Rows by dimension, sorted by label and vec_id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels = ids[order], labels[order]
        self.exact = x.shape[1] * float(np.abs(x).max(initial=0)) ** 2 < 2.0**53
        self.columns = np.ascontiguousarray(x[order].T.astype(float if self.exact else np.int64))
        self.low, self.high = self.columns.min(1), self.columns.max(1)

    def of_label(self, label: int) -> slice:
        return slice(int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right")))

    def suits(self, anchor: np.ndarray) -> bool:
        return self.exact and len(anchor) * float(np.abs(anchor).max(initial=0)) * float(max(abs(self.low).max(), abs(self.high).max())) < 2.0**53

    def scan(self, anchor: np.ndarray, alive: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """Rows (of alive) that keep(lower, upper) never dropped, with their exact scores."""
        kind = float if self.suits(anchor) else np.int64
        a, order = anchor.astype(kind), np.argsort(-np.abs(anchor), kind="stable")
        columns = self.columns if kind is float or not self.exact else self.columns.astype(np.int64)
        ends = np.stack([a * self.low.astype(kind), a * self.high.astype(kind)])[:, order]
        least, most = (np.concatenate([np.cumsum(e[::-1])[::-1], [0]]) for e in (ends.min(0), ends.max(0)))
        score = np.zeros(len(alive), kind)
        for at in range(0, len(order), STEP):
            if not len(alive):
                break
            read = order[at : at + STEP]
            part = columns[read][:, alive] if len(alive) < columns.shape[1] else columns[read]
            score = score + a[read] @ part
            rest = min(at + STEP, len(order))
            stay = keep(score + least[rest], score + most[rest])
            if stay is not None and not stay.all():
                alive, score = alive[stay], score[stay]
        return alive, score.astype(np.int64)


def kth(values: np.ndarray, k: int) -> float:
    """The k-th largest, or less than anything where there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by id."""
    if len(ids) > k:
        least = kth(scores, k)
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))


def positives_in(block: Block, anchor_id: int, label: int, anchor: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """ids and scores of the block's k best other rows of the label; rows under floor may be left out."""
    own = block.of_label(label)
    alive = np.arange(own.start, own.stop)
    alive = alive[block.ids[alive] != anchor_id]
    alive, score = block.scan(anchor, alive, lambda lower, upper: upper >= max(floor, kth(lower, k)))
    top = best(block.ids[alive], score, k)
    return block.ids[alive][top], score[top]


def negatives_in(block: Block, anchor_id: int, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and scores of the rows of other labels that are among the k best of the block in a window (least, most)."""
    own = block.of_label(label)
    alive = np.concatenate([np.arange(own.start), np.arange(own.stop, len(block.ids))])
    alive = alive[block.ids[alive] != anchor_id]

    def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        wanted = np.zeros(len(lower), bool)
        for least, most in windows:
            inside = (lower <= most) & (upper >= least)
            sure = lower[inside & (lower >= least) & (upper <= most)]
            wanted |= inside & (upper >= kth(sure, k))
        return wanted

    alive, score = block.scan(anchor, alive, keep)
    ids, taken = block.ids[alive], np.zeros(len(alive), bool)
    for least, most in windows:
        some = np.flatnonzero((score >= least) & (score <= most))
        taken[some[best(ids[some], score[some], k)]] = True
    return ids[taken], score[taken]


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[Block]:
    """Arrow batches joined to blocks of about BLOCK rows."""
    held, n = [], 0

    def made() -> Block:
        ids, labels = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("vec_id", "label"))
        return Block(ids, labels, np.concatenate([matrix(b, "x", d) for b in held]))

    for batch in batches:
        if batch.num_rows:
            held, n = [*held, batch], n + batch.num_rows
        if n >= BLOCK:
            yield made()
            held, n = [], 0
    if held:
        yield made()


def _met(anchor: list[int], ids: list[np.ndarray], scores: list[np.ndarray]) -> pa.RecordBatch:
    times = np.repeat(np.array(anchor, np.int32), [len(i) for i in ids])
    return pa.RecordBatch.from_arrays([pa.array(times), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))], names=["anchor", "vec_id", "score"])


def nearest_positives(rows: DataFrame, d: int, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, k: int) -> DataFrame:
    """anchor (its place), vec_id, score, place: the k best rows of the anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        for block in _blocks(batches, d):
            for i in range(len(ids)):
                own, score = found[i]
                new, new_score = positives_in(block, ids[i], labels[i], x[i], k, kth(score, k))
                own, score = np.concatenate([own, new]), np.concatenate([score, new_score])
                top = best(own, score, k)
                found[i] = own[top], score[top]
        some = [i for i in range(len(ids)) if len(found[i][0])]
        if some:
            yield _met(some, [found[i][0] for i in some], [found[i][1] for i in some])

    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    return rows.mapInArrow(run, _MET).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def windowed_negatives(rows: DataFrame, d: int, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, windows: list[list[tuple[int, int]]], k: int) -> DataFrame:
    """anchor, vec_id, score: all that can be among the k best of other labels in one of the anchor's windows."""
    wanted = [i for i in range(len(ids)) if windows[i]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, d):
            got = [negatives_in(block, ids[i], labels[i], x[i], windows[i], k) for i in wanted]
            if got:
                yield _met(wanted, [g[0] for g in got], [g[1] for g in got])

    return rows.mapInArrow(run, _MET)


def hard_negatives(embeddings: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, every: int = 100, block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (vec_id divisible by
    `every`) and each of its `positives` nearest rows of the same label, the `negatives` nearest rows of other labels
    with a score between `low` hundredths of the positive's score and that score."""
    spark = embeddings.sparkSession
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    given = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").filter("label is not null")
    rows, d = scaled(given, "embedding", FACTOR)
    rows = rows.select(F.coalesce("vec_id", F.lit(_NO_ID)).alias("vec_id"), moved.alias("label"), "x")
    anchors, _ = stored(rows.filter(F.col("vec_id") % every == 0).filter(F.col("vec_id") != _NO_ID).distinct().withColumn("share", F.pmod(F.xxhash64("vec_id", "x"), F.lit(1 << 20))), "anchors")
    rounds = -(-anchors.count() // max(1, block // 2)) if d else 0  # shares by hash are uneven: blocks are half full on average
    width = -(-(1 << 20) // max(1, rounds))
    found = []
    for r in range(rounds):
        mine = anchors.filter((F.col("share") >= r * width) & (F.col("share") < (r + 1) * width)).select("vec_id", "label", "x").toArrow().combine_chunks()
        if not mine.num_rows:
            continue
        ids, labels = (mine.column(c).to_numpy() for c in ("vec_id", "label"))
        x = matrix(mine.to_batches()[0], "x", d)
        near = nearest_positives(rows, d, ids, labels, x, positives).collect()  # at most `positives` rows an anchor
        windows: list[list[tuple[int, int]]] = [[] for _ in ids]
        for p in near:
            least = -(-low * p.score // 100)
            if least <= p.score:
                windows[p.anchor].append((least, p.score))
        met = windowed_negatives(rows, d, ids, labels, x, [sorted(set(w)) for w in windows], negatives)
        about = spark.createDataFrame([(p.anchor, int(ids[p.anchor]), p.place, p.vec_id, p.score) for p in near], "anchor int, anchor_id long, place int, positive_id long, positive_score long")
        inside = (F.col("score") <= F.col("positive_score")) & (100 * F.col("score") >= low * F.col("positive_score"))
        order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id")
        best_rows = met.join(about, "anchor").filter(inside).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
        back = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
        found.append(stored(best_rows.select("anchor_id", back("positive_id").alias("positive_id"), "rank", back("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), f"round{r}")[0])
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], _OUT)
