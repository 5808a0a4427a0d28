"""Jobs on line and ring geometry: thinning, clipping and sampling along lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrarisk.functions import geometry as G

from .spatial import segments


def _thin(points: np.ndarray, tolerance: float) -> np.ndarray:
    """The points that Douglas and Peucker's rule keeps, with a stack instead of recursion."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d = points[b] - points[a]
        size = float(np.hypot(*d))
        rest = points[a + 1 : b] - points[a]
        far = np.abs(d[0] * rest[:, 1] - d[1] * rest[:, 0]) / size if size else np.hypot(rest[:, 0], rest[:, 1])
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def simplify(layer: DataFrame, key: str, tolerance: Column) -> DataFrame:
    """key, parts with thinned rings; a closed ring of under four points, and a line of under two, goes. Not topology-preserving."""

    shape = pa.list_(pa.struct([("rings", pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            keys, out = [], []
            for k, parts, tol in zip(f.column(key).to_pylist(), f.column("parts").to_pylist(), f.column("tolerance").to_pylist()):
                kept = []
                for part in parts:
                    rings = []
                    for ring in part["rings"]:
                        p = np.array([(q["x"], q["y"]) for q in ring], float)
                        closed = len(p) > 2 and (p[0] == p[-1]).all()
                        t = _thin(p, tol) if len(p) > 2 else p
                        if len(t) >= (4 if closed else 2):
                            rings.append([{"x": float(x), "y": float(y)} for x, y in t])
                        elif not rings:
                            break  # without its shell a part is gone
                    if rings:
                        kept.append({"rings": rings})
                if kept:
                    keys.append(k)
                    out.append(kept)
            yield pa.RecordBatch.from_arrays([pa.array(keys, f.schema.field(key).type), pa.array(out, shape)], names=[key, "parts"])

    kind = layer.schema[key].dataType.simpleString()
    return layer.select(key, "parts", tolerance.alias("tolerance")).mapInArrow(run, f"{key} {kind}, parts {G.GEOMETRY}")


def clip_segments(layer: DataFrame, key: str, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """key, ax, ay, bx, by: the edges' parts inside a box, by the range of their parameter that lies in it."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    low, high, inside = F.lit(0.0), F.lit(1.0), F.lit(True)
    for p, q in ((-dx, F.col("ax") - xmin), (dx, xmax - F.col("ax")), (-dy, F.col("ay") - ymin), (dy, ymax - F.col("ay"))):
        t = F.try_divide(q, p)
        low = F.when(p < 0, F.greatest(low, t)).otherwise(low)
        high = F.when(p > 0, F.least(high, t)).otherwise(high)
        inside = inside & ((p != 0) | (q >= 0))
    s = segments(layer, key).withColumns({"t0": low, "t1": high, "ok": inside}).filter("ok AND t0 < t1")
    at = lambda a, b, t: F.col(a) + F.col(t) * (F.col(b) - F.col(a))
    return s.select(key, at("ax", "bx", "t0").alias("ax"), at("ay", "by", "t0").alias("ay"), at("ax", "bx", "t1").alias("bx"), at("ay", "by", "t1").alias("by"))


def sample_along(layer: DataFrame, key: str, step_km: float) -> DataFrame:
    """key, k, x, y: points at every step of a line's length, from its start."""
    e = layer.select(key, F.posexplode(G.all_edges(F.col("parts"))).alias("i", "e")).select(key, "i", *[F.col(f"e.{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"])
    e = e.withColumn("len", G.haversine_km(F.col("ay"), F.col("ax"), F.col("by"), F.col("bx")))
    upto = F.sum("len").over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    e = e.withColumn("end", upto).withColumn("start", F.col("end") - F.col("len")).filter("len > 0")
    first = F.ceil(F.col("start") / step_km)
    last = F.ceil(F.col("end") / step_km) - 1
    e = e.withColumn("k", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    t = (F.col("k") * step_km - F.col("start")) / F.col("len")
    return e.select(key, "k", (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y"))


def geometry_quality(layer: DataFrame, key: str) -> DataFrame:
    """One row of counts: empty (no part or no point), rings, unclosed, short (under four points), flat (no area) and
    touching (a point twice besides the ends)."""
    r = layer.select(key, F.explode_outer("parts").alias("p")).select(key, F.posexplode_outer("p.rings").alias("ring", "r"))
    n, same = F.size("r"), F.element_at("r", 1) == F.element_at("r", -1)
    inner = F.slice("r", 1, F.greatest(n - 1, F.lit(0)))
    some = F.col("r").isNotNull() & (n > 0)
    return r.agg(
        F.count_if(~some | F.col("r").isNull()).alias("empty"), F.count_if(some).alias("rings"), F.count_if(some & ~same).alias("unclosed"), F.count_if(some & (n < 4)).alias("short"),
        F.count_if(some & (n >= 4) & same & (F.abs(G.ring_area(F.col("r"))) < 1e-12)).alias("flat"), F.count_if(some & (F.size(F.array_distinct(inner)) < F.size(inner))).alias("touching"),
        F.count_distinct(F.when(F.col("ring") > 0, F.col(key))).alias("with_holes"),
    )


def usable(layer: DataFrame) -> DataFrame:
    """layer with open rings closed, rings without four points or area left out, and features without a first ring gone."""
    close = lambda r: F.when((F.size(r) > 0) & (F.element_at(r, 1) != F.element_at(r, -1)), F.concat(r, F.slice(r, 1, 1))).otherwise(r)
    good = lambda r: (F.size(r) >= 4) & (F.abs(G.ring_area(r)) >= 1e-12)
    closed = F.transform("parts", lambda p: F.transform(p["rings"], close))
    parts = F.transform(F.filter(closed, lambda rings: (F.size(rings) > 0) & good(rings[0])), lambda rings: F.struct(F.filter(rings, good).alias("rings")))
    return layer.withColumn("parts", parts).filter(F.size("parts") > 0)
