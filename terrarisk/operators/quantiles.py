"""Exact percentiles without a buffer of all values: mergeable summaries narrow a bracket, exact counts close it.

Each round asks Spark's mergeable percentile summary for a grid of cut values within the bracket, then counts exactly how
many values lie in each of its cells; the cell that holds the wanted rank is the next bracket, so that no guarantee of
the summary is needed for the result, only for speed. A bracket narrows by about GRID a round. When no bracket holds more
than `limit` values, those few, counted by value, give the percentile by linear interpolation.

Defined results: NULL and NaN values don't count; a group without others has n = 0 and a NULL percentile, no row if
groups are given; NULL is a group; ties are counted apart, so that a value that many rows share closes its bracket; an
empty table gives n = 0.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrarisk.sources.scratch import scratch_dir

GRID, ACCURACY, LIMIT = 256, 10_000, 50_000
_STATE = ("q", "n", "lo", "hi", "below", "inside")


def _stored(df: DataFrame) -> DataFrame:
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _within(values: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """The values in each bracket. Without groups there are as many brackets as percentiles: they become literals."""
    inside = (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))
    if not keys:
        if brackets.isEmpty():
            return values.sparkSession.createDataFrame([], StructType([*values.schema.fields, *brackets.schema.fields]))
        rows = [F.struct(*[F.lit(r[c]).cast(brackets.schema[c].dataType).alias(c) if not isinstance(r[c], list) else F.array(*map(F.lit, r[c])).alias(c) for c in brackets.columns]) for r in brackets.collect()]
        return values.withColumn("_b", F.explode(F.array(*rows))).select("_v", "_b.*").filter(inside)
    met = [F.col(f"_k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    on = met[0]
    for m in met[1:]:
        on = on & m
    return values.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)}).join(brackets, on).filter(inside).drop(*[f"_k{i}" for i in range(len(keys))])


def _ranks() -> tuple[Column, Column]:
    """The places, from 0, of the values below and above the percentile."""
    at = F.col("q") * (F.col("n") - 1)
    return F.floor(at), F.ceil(at)


def exact_percentiles(df: DataFrame, value: str, qs: list[float], by: list[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """The columns of `by`, q, n and percentile: the q-th percentile (0 to 1) of `value`, linear between values."""
    keys = list(by or [])
    values = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null and not isnan(_v)")
    start = values.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    state = _stored(start.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).select(*keys, "q", "n", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")))
    wide = (F.col("inside") > limit) & (F.col("lo") < F.col("hi"))
    while not state.filter(wide).isEmpty():
        state = _stored(state.filter(~F.coalesce(wide, F.lit(False))).unionByName(_narrowed(values, state.filter(wide), keys)))
    low, high = _ranks()
    tied = state.filter("lo = hi or n = 0").select(*keys, "q", "n", F.col("lo").alias("percentile"))
    few = _within(values, state.filter("lo < hi"), keys).groupBy(*keys, *_STATE, "_v").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*keys, "q").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("below")
    placed = few.withColumn("first", before)
    holds = lambda rank: F.max(F.when((F.col("first") <= rank) & (rank < F.col("first") + F.col("c")), F.col("_v")))
    ends = placed.groupBy(*keys, "q", "n").agg(holds(low).alias("a"), holds(high).alias("b"))
    part = F.col("q") * (F.col("n") - 1) - F.floor(F.col("q") * (F.col("n") - 1))
    return tied.unionByName(ends.select(*keys, "q", "n", (F.col("a") + (F.col("b") - F.col("a")) * part).alias("percentile")))


def _narrowed(values: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
    """Brackets of one cell of a grid, or of two where the percentile lies between them."""
    steps = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    grid = _within(values, wide, keys).groupBy(*keys, *_STATE).agg(F.percentile_approx("_v", steps, ACCURACY).alias("grid"))
    grid = _stored(grid.withColumn("grid", F.array_sort(F.array_distinct(F.concat(F.array("lo"), "grid")))))
    cut = F.array_max(F.filter("grid", lambda g: g <= F.col("_v")))
    cells = _within(values, grid, keys).withColumn("cut", cut).groupBy(*keys, *_STATE, "cut", (F.col("_v") > F.col("cut")).alias("over")).agg(F.count("*").alias("c"), F.min("_v").alias("bottom"), F.max("_v").alias("top"))
    earlier = Window.partitionBy(*keys, "q").orderBy("cut", "over").rowsBetween(Window.unboundedPreceding, -1)  # 2 GRID rows
    placed = cells.withColumn("first", F.col("below") + F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    low, high = _ranks()
    wanted = placed.filter((F.col("first") <= high) & (low < F.col("first") + F.col("c")))
    return wanted.groupBy(*keys, "q", "n").agg(F.min("bottom").alias("lo"), F.max("top").alias("hi"), F.min("first").alias("below"), F.sum("c").alias("inside")).select(*keys, *_STATE)
