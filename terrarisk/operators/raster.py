"""Raster operators in pixel form (tile_id, row, col, value), row 0 in the south, and array form for dense windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrarisk.operators import spatial as S

TILE_DEGREES = 0.1


def to_array(pixels: DataFrame, rows: int, cols: int, missing: float | None = None) -> DataFrame:
    """tile_id, data: a dense row-major array per tile, NULL (or missing) where no pixel is. A tile is one task's work."""

    def scatter(part: pa.Table) -> pa.Table:
        at = part.column("row").to_numpy().astype(np.int64) * cols + part.column("col").to_numpy().astype(np.int64)
        value = part.column("value").cast(pa.float64())
        there = value.is_valid().to_numpy()
        data, empty = np.full(rows * cols, 0.0 if missing is None else missing), np.ones(rows * cols, bool)
        data[at[there]], empty[at[there]] = value.drop_null().to_numpy(), False
        flat = pa.array(data, mask=empty) if missing is None else pa.array(data)
        return pa.table({"tile_id": part.column("tile_id")[:1], "data": pa.ListArray.from_arrays(pa.array([0, rows * cols], pa.int32()), flat)})

    kind = pixels.schema["tile_id"].dataType.simpleString()
    return pixels.select("tile_id", "row", "col", "value").groupBy("tile_id").applyInArrow(scatter, f"tile_id {kind}, data array<double>")


def dense(pixels: DataFrame, rows: int, cols: int, missing: float = 0.0) -> DataFrame:
    """Pixels of whole tiles, with `missing` where none was."""
    return explode_pixels(to_array(pixels, rows, cols, missing), cols)


def explode_pixels(tiles: DataFrame, cols: int) -> DataFrame:
    p = tiles.select("tile_id", F.posexplode("data").alias("k", "value"))
    return p.select("tile_id", F.expr(f"k div {cols}").alias("row"), (F.col("k") % cols).alias("col"), "value")


def positions(lat: Column, lon: Column, south: Column, west: Column, rows: int, cols: int) -> tuple[Column, Column]:
    """Fractional row and column of a site in its tile."""
    return (lat - south) / F.lit(TILE_DEGREES) * (rows - 1), (lon - west) / F.lit(TILE_DEGREES) * (cols - 1)


def sample_bilinear(sites: DataFrame, pixels: DataFrame, rows: int, cols: int) -> DataFrame:
    """site_id, value: the four neighbours by weight, missing ones left out; NULL if all are missing.

    sites have tile_id, south and west. Neighbours come by one equi-join on tile, row and column.
    """
    rf, cf = positions(F.col("lat"), F.col("lon"), F.col("south"), F.col("west"), rows, cols)
    s = sites.select("site_id", "tile_id", rf.alias("rf"), cf.alias("cf")).withColumns({"r0": F.floor("rf"), "c0": F.floor("cf")})
    dr, dc = F.col("rf") - F.col("r0"), F.col("cf") - F.col("c0")
    near = F.array(*[F.struct(F.least(F.col("r0") + i, F.lit(rows - 1)).alias("row"), F.least(F.col("c0") + j, F.lit(cols - 1)).alias("col"), ((dr if i else 1 - dr) * (dc if j else 1 - dc)).alias("w")) for i in (0, 1) for j in (0, 1)])
    n = s.select("site_id", "tile_id", F.explode(near).alias("n")).select("site_id", "tile_id", "n.*")
    met = n.join(pixels, ["tile_id", "row", "col"], "left").filter("value is not null")
    got = met.groupBy("site_id").agg(F.try_divide(F.sum(F.col("value") * F.col("w")), F.sum("w")).alias("value"))
    return sites.select("site_id").join(got, "site_id", "left")


def nearest_pixel(sites: DataFrame, rows: int, cols: int) -> DataFrame:
    """sites with the row and col of the nearest pixel, halves up."""
    rf, cf = positions(F.col("lat"), F.col("lon"), F.col("south"), F.col("west"), rows, cols)
    clamp = lambda v, n: F.least(F.greatest(F.floor(v + 0.5), F.lit(0)), F.lit(n - 1))
    return sites.withColumns({"row": clamp(rf, rows), "col": clamp(cf, cols)})


def sample_nearest(sites: DataFrame, pixels: DataFrame, rows: int, cols: int, default: float = 0.0) -> DataFrame:
    return nearest_pixel(sites, rows, cols).join(pixels, ["tile_id", "row", "col"], "left").select("site_id", F.coalesce("value", F.lit(default)).alias("value"))


def slope_deg(sites: DataFrame, pixels: DataFrame, rows: int, cols: int) -> DataFrame:
    """site_id, elevation, slope in degrees from the four neighbours; a missing one counts as the centre."""
    at = nearest_pixel(sites, rows, cols).select("site_id", "tile_id", "lat", "row", "col")
    around = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for k, (i, j) in enumerate([(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)])])
    met = at.select("site_id", "tile_id", "lat", F.explode(around).alias("n")).select("site_id", "tile_id", "lat", "n.*").join(pixels, ["tile_id", "row", "col"], "left")
    v = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    g = met.groupBy("site_id").agg(F.first("lat").alias("lat"), *[v(k).alias(f"v{k}") for k in range(5)]).filter("v0 is not null")
    o = lambda k: F.coalesce(f"v{k}", "v0")
    y, x = TILE_DEGREES / rows * 111000, F.lit(TILE_DEGREES / cols * 111000) * F.cos(F.radians("lat"))
    dzdx, dzdy = (o(3) - o(4)) / (2 * x), (o(1) - o(2)) / (2 * y)
    return g.select("site_id", F.col("v0").alias("elevation"), F.degrees(F.atan(F.sqrt(dzdx * dzdx + dzdy * dzdy))).alias("slope"))


def window_max(sites: DataFrame, pixels: DataFrame, rows: int, cols: int, radius: int) -> DataFrame:
    """site_id and the largest value within radius pixels of the nearest pixel; the offsets are a small literal array. A
    window is looked at once for all sites whose nearest pixel is the same."""
    d = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)])
    at = nearest_pixel(sites, rows, cols).select("site_id", F.col("tile_id").alias("_tile"), F.col("row").alias("_row"), F.col("col").alias("_col"))
    own = ["_tile", "_row", "_col"]
    n = at.select(*own).distinct().select(*own, F.explode(d).alias("d")).select(*own, F.col("_tile").alias("tile_id"), (F.col("_row") + F.col("d.i")).alias("row"), (F.col("_col") + F.col("d.j")).alias("col"))
    found = n.join(pixels, ["tile_id", "row", "col"]).groupBy(*own).agg(F.max("value").alias("value"))
    return at.join(found, own).groupBy("site_id").agg(F.max("value").alias("value"))


def max_slope_nearby(sites: DataFrame, pixels: DataFrame, rows: int, cols: int, radius: int | None = None) -> DataFrame:
    """site_id, elevation, slope and the largest slope within radius pixels (4, or a 50th of the rows if that is less);
    pixels at a tile's border are skipped.

    The site's elevation stands for missing neighbours, and its latitude gives the width of a pixel. A site meets its
    tile's array once, instead of a row for each of the (2 radius + 3) squared pixels.
    """
    radius = min(4, rows // 50) if radius is None else radius
    at = nearest_pixel(sites, rows, cols).select("site_id", "tile_id", "lat", "row", "col")
    met = at.join(to_array(pixels, rows, cols), "tile_id")
    y, x = TILE_DEGREES / rows * 111000, F.lit(TILE_DEGREES / cols * 111000) * F.cos(F.radians("lat"))
    inside = lambda r, k: (r >= 0) & (r < rows) & (k >= 0) & (k < cols)
    height = lambda r, k: F.when(inside(r, k), F.coalesce(F.get("data", (r * cols + k).cast("int")), F.col("elevation"))).otherwise(F.col("elevation"))

    def slope(r: Column, k: Column) -> Column:
        dx, dy = (height(r, k + 1) - height(r, k - 1)) / (2 * x), (height(r + 1, k) - height(r - 1, k)) / (2 * y)
        return F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))

    met = met.withColumn("elevation", F.get("data", (F.col("row") * cols + F.col("col")).cast("int"))).filter("elevation is not null")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i or j] or [F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))])
    inner = F.filter(steps, lambda d: (F.col("row") + d["i"] >= 1) & (F.col("row") + d["i"] < rows - 1) & (F.col("col") + d["j"] >= 1) & (F.col("col") + d["j"] < cols - 1))
    own = slope(F.col("row"), F.col("col"))
    around = F.array_max(F.transform(inner, lambda d: slope(F.col("row") + d["i"], F.col("col") + d["j"])))
    return met.select("site_id", "elevation", own.alias("slope"), F.greatest(own, around).alias("max_slope"))


def sample_distance_weighted(sites: DataFrame, pixels: DataFrame, rows: int, cols: int, radius: int, mu: float = 6.63, sigma: float = 0.51, metres: float = 30.0) -> DataFrame:
    """The pixel's value, or where it is zero a mean of non-zero pixels by a lognormal weight of their distance."""
    at = nearest_pixel(sites, rows, cols).select("site_id", "tile_id", "row", "col")
    own = at.join(pixels, ["tile_id", "row", "col"], "left").select("site_id", F.coalesce("value", F.lit(0.0)).alias("own"))
    kernel = []
    for i in range(-radius, radius + 1):
        for j in range(-radius, radius + 1):
            d = float(np.hypot(i, j)) * metres
            if 0 < d <= radius * metres:
                kernel.append((i, j, float(np.exp(-0.5 * ((np.log(d) - mu) / sigma) ** 2) / d)))
    k = at.sparkSession.createDataFrame(kernel, "i int, j int, w double")  # (2 radius + 1) squared rows
    met = at.join(own.filter("own = 0"), "site_id").join(F.broadcast(k)).select("site_id", "tile_id", (F.col("row") + F.col("i")).alias("row"), (F.col("col") + F.col("j")).alias("col"), "w")
    mean = met.join(pixels.filter("value > 0"), ["tile_id", "row", "col"]).groupBy("site_id").agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("mean"))
    return own.join(mean, "site_id", "left").select("site_id", F.when(F.col("own") > 0, F.col("own")).otherwise(F.coalesce("mean", F.lit(0.0))).alias("value"))


def _per_tile(tiles: DataFrame, rows: int, cols: int, step) -> DataFrame:
    """Applies a numpy function to each tile's grid; tiles come in Arrow batches, so memory holds a few at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [step(np.array(d, float).reshape(rows, cols)).ravel() for d in f["data"]]
            yield pd.DataFrame({"tile_id": f["tile_id"], "data": out})

    return tiles.select("tile_id", "data").mapInPandas(run, "tile_id long, data array<double>")


def focal_max_fill(tiles: DataFrame, rows: int, cols: int, radius: int) -> DataFrame:
    """Zero pixels take the largest value of the window."""

    def step(g: np.ndarray) -> np.ndarray:
        p = np.pad(np.nan_to_num(g), radius)
        w = np.lib.stride_tricks.sliding_window_view(p, (2 * radius + 1, 2 * radius + 1))
        return np.where(g == 0, w.max((2, 3)), g)

    return _per_tile(tiles, rows, cols, step)


def focal_mean_fill(tiles: DataFrame, rows: int, cols: int, radius: int) -> DataFrame:
    """Zero pixels take the mean of the disc around them, zeros beyond the tile; tiles without both kinds stay."""

    def step(g: np.ndarray) -> np.ndarray:
        if not (g == 0).any() or not (g > 0).any():
            return g
        y, x = np.ogrid[-radius : radius + 1, -radius : radius + 1]
        disc = (x * x + y * y <= radius * radius).astype(float)
        shape = [rows + 2 * radius, cols + 2 * radius]
        full = np.fft.irfft2(np.fft.rfft2(g, shape) * np.fft.rfft2(disc, shape), shape)
        return np.where(g == 0, full[radius : radius + rows, radius : radius + cols] / disc.sum(), g)

    return _per_tile(tiles, rows, cols, step)


def slope_grid(tiles: DataFrame, rows: int, cols: int, metres: float) -> DataFrame:
    """Slope in degrees: central differences inside, one-sided at the edges."""

    def step(g: np.ndarray) -> np.ndarray:
        dy, dx = np.gradient(g, metres)
        return np.degrees(np.arctan(np.hypot(dx, dy)))

    return _per_tile(tiles, rows, cols, step)


def box_smooth(grid: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """Mean of 3 by 3 with the border repeated; grid (i, j, value) is complete."""
    d = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    clamp = lambda v, n: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1))
    need = grid.select("i", "j", F.explode(d).alias("d")).select("i", "j", clamp(F.col("i") + F.col("d.a"), n_rows).alias("si"), clamp(F.col("j") + F.col("d.b"), n_cols).alias("sj"))
    return need.join(grid.select(F.col("i").alias("si"), F.col("j").alias("sj"), "value"), ["si", "sj"]).groupBy("i", "j").agg(F.avg("value").alias("value"))


def resample_nearest(pixels: DataFrame, rows: int, cols: int, new_rows: int, new_cols: int) -> DataFrame:
    """Each new pixel takes the old one under its centre."""
    spark = pixels.sparkSession
    r = spark.range(new_rows).select(F.col("id").alias("new_row"), F.floor((F.col("id") + 0.5) * rows / new_rows).alias("row"))
    k = spark.range(new_cols).select(F.col("id").alias("new_col"), F.floor((F.col("id") + 0.5) * cols / new_cols).alias("col"))
    return pixels.join(F.broadcast(r), "row").join(F.broadcast(k), "col").select("tile_id", F.col("new_row").alias("row"), F.col("new_col").alias("col"), "value")


def rasterize(polygons: DataFrame, pixels: DataFrame, value: str, combine: str = "max", seq: str = "seq") -> DataFrame:
    """tile_id, row, col, value of the polygons over each pixel's centre (pixels: tile_id, row, col, lat, lon): the largest
    ("max"), or that of the polygon painted last, by seq ("last"); pixels under no polygon aren't returned."""
    hit = S.zonal_pairs(polygons, pixels).groupBy("tile_id", "row", "col")
    kept = F.max(value) if combine == "max" else F.max_by(value, F.struct(seq, value))
    return hit.agg(kept.alias("value"))


def split_chunks(chunks: DataFrame, rows: int, cols: int) -> DataFrame:
    """Chunks of 2 by 2 tiles (south, west, data: rows by cols from the north) to tiles (south, west, data from the south).

    Each quarter is a slice of whole rows, cut and put together inside the JVM; quarters without a value go.
    """
    half_r, half_c = rows // 2, cols // 2
    quarters = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    # row k from the south of the northern half (i = 1) is row half_r - 1 - k from the north
    line = lambda k: F.slice("data", ((F.lit(half_r) * (2 - F.col("q.i")) - 1 - k) * cols + F.col("q.j") * half_c + 1).cast("int"), half_c)
    cut = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(half_r - 1)), line))
    at = lambda c, k: F.round(F.col(c) + F.col(f"q.{k}") * F.lit(TILE_DEGREES), 6).alias(c)
    whole = chunks.filter(F.size("data") == rows * cols).withColumn("q", F.explode(quarters))
    return whole.select(at("south", "i"), at("west", "j"), cut.alias("data")).filter(F.exists("data", lambda v: v.isNotNull() & ~F.isnan(v)))


def sample_nearby_max(sites: DataFrame, pixels: DataFrame, rows: int, cols: int, radius: int | None = None) -> DataFrame:
    """site_id, value: the site's pixel, or where it is zero the largest pixel within radius (7, or a tenth of the rows if
    that is less) in its tile; 0 where there is no tile. Only sites on a zero pixel look at the window."""
    radius = min(7, rows // 10) if radius is None else radius
    own = sites.select("site_id", "tile_id", "lat", "lon", "south", "west").join(sample_nearest(sites, pixels, rows, cols), "site_id")
    near = window_max(own.filter("value = 0").drop("value"), pixels.filter("value > 0"), rows, cols, radius).withColumnRenamed("value", "near")
    return own.select("site_id", "value").join(near, "site_id", "left").select("site_id", F.when(F.col("value") != 0, F.col("value")).otherwise(F.coalesce("near", F.lit(0.0))).alias("value"))


def encode(value: Column, scale: float, offset: float = 0.0) -> Column:
    """To 16 bits, cut towards zero; 65535 stays free for missing."""
    return F.when(value.isNull(), 65535).otherwise(F.least(F.greatest((value - offset) * scale, F.lit(0.0)), F.lit(65534.0)).cast("int"))


def decode(raw: Column, scale: float, offset: float = 0.0, nodata: int = 65535) -> Column:
    return F.when(raw != nodata, raw / F.lit(float(scale)) + offset)


def unpack_flags(raw: Column, feet: tuple[int, ...] = (1, 2, 3, 4, 6, 10)) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(str(f)) for f in feet]), F.array(*[F.getbit(raw, F.lit(k)) == 1 for k in range(len(feet))]))


def promote_low(pixels: DataFrame, classes: DataFrame, least: int = 2) -> DataFrame:
    """Pixels under the lower quartile of the tile's positive values, and in a class of `least` or more (tile_id, row,
    col, class), take their median."""
    q = pixels.filter("value > 0").groupBy("tile_id").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5))).alias("q"))
    met = pixels.join(q, "tile_id", "left").join(classes.select("tile_id", "row", "col", "class"), ["tile_id", "row", "col"], "left")
    low = (F.col("value") < F.col("q")[0]) & (F.col("class") >= least)
    return met.select("tile_id", "row", "col", F.when(low, F.col("q")[1]).otherwise(F.col("value")).alias("value"))


def fire_arrival_30yr(pixels: DataFrame, factors: DataFrame, classes: DataFrame, rows: int, cols: int, radius: int = 167, least: float = 0.001) -> DataFrame:
    """tile_id, row, col, p30: the chance that fire arrives in 30 years.

    Annual burn probabilities (pixels, in units of 1e-5, missing ones zero) times the tile's calibration factor
    (tile_id, value); low pixels of high hazard classes are promoted, zeros filled with a focal mean; tiles whose
    largest p30 is under `least` go. The quartiles are taken before the factor, which changes no order.
    """
    promoted = promote_low(dense(pixels, rows, cols), classes)
    annual = promoted.join(factors.select("tile_id", F.col("value").alias("factor")), "tile_id").withColumn("value", F.col("value") / 1e5 * F.col("factor"))
    full = explode_pixels(focal_mean_fill(to_array(annual, rows, cols, 0.0), rows, cols, min(radius, rows // 2)), cols)
    p = 1 - F.pow(1 - F.least(F.greatest("value", F.lit(0.0)), F.lit(1.0)), F.lit(30.0))
    arrival = full.select("tile_id", "row", "col", p.alias("p30"))
    kept = arrival.groupBy("tile_id").agg(F.max("p30").alias("m")).filter(F.col("m") >= least).select("tile_id")
    return arrival.join(kept, "tile_id", "leftsemi")


def fire_exposure(arrival: DataFrame, flame: DataFrame, distance: DataFrame, share: DataFrame, rows: int, cols: int, distance_shape: tuple[int, int], radius: int = 7) -> DataFrame:
    """arrival with the damage model's inputs: flame_ft (zeros take the largest near them), distance_m (resampled from
    its own grid; zero where there is none) and the tile's fair_share (tile_id, value)."""
    near = explode_pixels(focal_max_fill(to_array(flame, rows, cols, 0.0), rows, cols, min(radius, rows // 10)), cols).withColumnRenamed("value", "flame_ft")
    far = resample_nearest(distance, *distance_shape, rows, cols).withColumnRenamed("value", "distance_m")
    at = ["tile_id", "row", "col"]
    met = arrival.join(near, at, "left").join(far, at, "left").join(share.select("tile_id", F.col("value").alias("fair_share")), "tile_id", "left")
    return met.select(*at, "p30", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("flame_ft", "distance_m", "fair_share")])


def fire_risk_tiles(exposure: DataFrame, p_destroyed: Column, scale: float = 10000.0) -> DataFrame:
    """tile_id, row, col, raw: p30 times the chance of destruction, in 16 bits; tiles that are all zero go.

    The product is rounded to 9 places before it is cut, so that the last bits of either factor decide no step.
    """
    raw = exposure.withColumn("raw", encode(F.round(F.col("p30") * p_destroyed, 9), scale)).select("tile_id", "row", "col", "raw")
    return raw.join(raw.filter("raw > 0").select("tile_id").distinct(), "tile_id", "leftsemi")


def mean_modeled(pixels: DataFrame, cell: float, scale: float = 1e5) -> DataFrame:
    """ci, cj, modeled: the mean of all pixels (lat, lon, value), zeros too, in each coarse cell."""
    at = [F.floor(F.col(c) / F.lit(cell)).alias(n) for c, n in (("lat", "ci"), ("lon", "cj"))]
    return pixels.groupBy(*at).agg((F.avg("value") / scale).alias("modeled"))


def calibration_factors(observed: DataFrame, modeled: DataFrame, low: float = 0.5, high: float = 20.0) -> DataFrame:
    """ci, cj, factor: observed over modeled frequency where the model has any, clipped; nothing observed counts as 0."""
    met = modeled.filter("modeled > 0").join(observed.select("ci", "cj", "obs"), ["ci", "cj"], "left")
    return met.select("ci", "cj", F.least(F.greatest(F.coalesce("obs", F.lit(0.0)) / F.col("modeled"), F.lit(low)), F.lit(high)).alias("factor"))


def fill_with_median(factors: DataFrame, cells: DataFrame) -> DataFrame:
    """All cells (ci, cj) with value: their factor, else the median of the factors."""
    median = factors.agg(F.median("factor").alias("med"))  # one row
    return cells.join(factors, ["ci", "cj"], "left").join(F.broadcast(median)).select(*cells.columns, F.coalesce("factor", "med").alias("value"))
