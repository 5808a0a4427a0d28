"""Queries over rasters: sampling, focal and zonal operators, calibration and fire risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrarisk.functions import hazard as H
from terrarisk.operators import mosaic as Q
from terrarisk.operators import raster as R
from terrarisk.operators import spatial as S
from terrarisk.operators import stats as A

from .fixtures import ctes, fixture
from .registry import query

c = F.col
N = 40


def r6(x):
    return F.round(x, 6)


def pixels(spark, sf_dir):
    return fixture(spark, sf_dir, "raster_pixels").select("tile_id", c("prow").alias("row"), c("pcol").alias("col"), "value")


def sites(spark, sf_dir):
    return fixture(spark, sf_dir, "raster_sites").withColumns({"south": 34 + c("tile_id") * F.lit(0.1), "west": F.lit(-118.5)})


AT = ctes("raster_sites", "raster_pixels") + ", pos AS (SELECT site_id, tile_id, lat, (lat - (34 + tile_id * 0.1::DOUBLE)) / 0.1::DOUBLE * 39 AS rf, (lon + 118.5::DOUBLE) / 0.1::DOUBLE * 39 AS cf FROM raster_sites), spot AS (SELECT *, least(greatest(floor(rf + 0.5), 0), 39) AS r, least(greatest(floor(cf + 0.5), 0), 39) AS k FROM pos)"


@query("r1_sample_bilinear", AT + ", n AS (SELECT site_id, tile_id, least(floor(rf) + i, 39) AS r, least(floor(cf) + j, 39) AS k, (CASE i WHEN 1 THEN rf - floor(rf) ELSE 1 - (rf - floor(rf)) END) * (CASE j WHEN 1 THEN cf - floor(cf) ELSE 1 - (cf - floor(cf)) END) AS w FROM pos, range(2) a(i), range(2) b(j)), v AS (SELECT site_id, CASE WHEN sum(w) > 0 THEN sum(value * w) / sum(w) END AS value FROM n JOIN raster_pixels p ON p.tile_id = n.tile_id AND prow = r AND pcol = k GROUP BY site_id) SELECT s.site_id, round(value, 4) AS value FROM raster_sites s LEFT JOIN v USING (site_id)")
def r1(spark, sf_dir):
    return R.sample_bilinear(sites(spark, sf_dir), pixels(spark, sf_dir), N, N).select("site_id", F.round("value", 4).alias("value"))


@query("r2_sample_nearest", AT + "SELECT site_id, coalesce(value, 0) AS value FROM spot LEFT JOIN raster_pixels p ON p.tile_id = spot.tile_id AND prow = r AND pcol = k")
def r2(spark, sf_dir):
    return R.sample_nearest(sites(spark, sf_dir), pixels(spark, sf_dir), N, N)


@query("r3_sample_elevation", AT + ", v AS (SELECT site_id, lat, (SELECT max(value) FROM raster_pixels p WHERE p.tile_id = spot.tile_id AND prow = r AND pcol = k) AS v0, (SELECT max(value) FROM raster_pixels p WHERE p.tile_id = spot.tile_id AND prow = r + 1 AND pcol = k) AS n, (SELECT max(value) FROM raster_pixels p WHERE p.tile_id = spot.tile_id AND prow = r - 1 AND pcol = k) AS s, (SELECT max(value) FROM raster_pixels p WHERE p.tile_id = spot.tile_id AND prow = r AND pcol = k + 1) AS e, (SELECT max(value) FROM raster_pixels p WHERE p.tile_id = spot.tile_id AND prow = r AND pcol = k - 1) AS w FROM spot) SELECT site_id, v0 AS elevation, round(degrees(atan(sqrt(pow((coalesce(e, v0) - coalesce(w, v0)) / (2 * 277.5::DOUBLE * cos(radians(lat))), 2) + pow((coalesce(n, v0) - coalesce(s, v0)) / 555::DOUBLE, 2)))), 6) AS slope FROM v WHERE v0 IS NOT NULL")
def r3(spark, sf_dir):
    return R.slope_deg(sites(spark, sf_dir), pixels(spark, sf_dir), N, N).select("site_id", "elevation", r6("slope").alias("slope"))


SLOPES = AT + """, o AS (SELECT site_id, spot.tile_id, lat, CAST(r AS BIGINT) AS r, CAST(k AS BIGINT) AS k, p.value AS v0 FROM spot JOIN raster_pixels p ON p.tile_id = spot.tile_id AND prow = CAST(r AS BIGINT) AND pcol = CAST(k AS BIGINT)),
n AS (SELECT site_id, tile_id, lat, v0, i = 0 AND j = 0 AS own, r + i AS r, k + j AS k FROM o, range(-4, 5) x(i), range(-4, 5) y(j) WHERE (i = 0 AND j = 0) OR (r + i BETWEEN 1 AND 38 AND k + j BETWEEN 1 AND 38)),
g AS (SELECT n.site_id, v0, own, degrees(atan(sqrt(pow((coalesce(e.value, v0) - coalesce(w.value, v0)) / (2 * 277.5::DOUBLE * cos(radians(lat))), 2) + pow((coalesce(u.value, v0) - coalesce(d.value, v0)) / 555::DOUBLE, 2)))) AS s
FROM n LEFT JOIN raster_pixels e ON e.tile_id = n.tile_id AND e.prow = n.r AND e.pcol = n.k + 1 LEFT JOIN raster_pixels w ON w.tile_id = n.tile_id AND w.prow = n.r AND w.pcol = n.k - 1 LEFT JOIN raster_pixels u ON u.tile_id = n.tile_id AND u.prow = n.r + 1 AND u.pcol = n.k LEFT JOIN raster_pixels d ON d.tile_id = n.tile_id AND d.prow = n.r - 1 AND d.pcol = n.k)
SELECT site_id, any_value(v0) AS elevation, round(max(s) FILTER (own), 6) AS slope, round(max(s), 6) AS max_slope FROM g GROUP BY site_id"""


@query("r4_max_slope_nearby", SLOPES)
def r4b(spark, sf_dir):
    return R.max_slope_nearby(sites(spark, sf_dir), pixels(spark, sf_dir), N, N, 4).select("site_id", "elevation", r6("slope").alias("slope"), r6("max_slope").alias("max_slope"))


@query("j8_raster_join", AT + "SELECT site_id, CAST(r AS BIGINT) AS row, CAST(k AS BIGINT) AS col, value FROM spot JOIN raster_pixels p ON p.tile_id = spot.tile_id AND prow = r AND pcol = k")
def j8(spark, sf_dir):
    """A site and its nearest pixel."""
    return R.nearest_pixel(sites(spark, sf_dir), N, N).join(pixels(spark, sf_dir), ["tile_id", "row", "col"]).select("site_id", "row", "col", "value")


@query("r4_max_nearby", AT + "SELECT site_id, max(value) AS value FROM spot JOIN raster_pixels p ON p.tile_id = spot.tile_id AND abs(prow - r) <= 4 AND abs(pcol - k) <= 4 GROUP BY site_id")
def r4(spark, sf_dir):
    return R.window_max(sites(spark, sf_dir), pixels(spark, sf_dir), N, N, 4)


@query("r5_sample_burn_probability", AT + ", own AS (SELECT site_id, spot.tile_id, r, k, coalesce(value, 0) AS own FROM spot LEFT JOIN raster_pixels p ON p.tile_id = spot.tile_id AND prow = r AND pcol = k), near AS (SELECT site_id, sqrt(pow(prow - r, 2) + pow(pcol - k, 2)) * 30 AS d, value FROM own JOIN raster_pixels p ON p.tile_id = own.tile_id AND abs(prow - r) <= 6 AND abs(pcol - k) <= 6 WHERE own = 0 AND value > 0), m AS (SELECT site_id, sum(value * exp(-0.5 * pow((ln(d) - 6.63) / 0.51, 2)) / d) / sum(exp(-0.5 * pow((ln(d) - 6.63) / 0.51, 2)) / d) AS mean FROM near WHERE d > 0 AND d <= 180 GROUP BY site_id) SELECT site_id, round(CASE WHEN own > 0 THEN own ELSE coalesce(mean, 0) END, 4) AS value FROM own LEFT JOIN m USING (site_id)")
def r5(spark, sf_dir):
    return R.sample_distance_weighted(sites(spark, sf_dir), pixels(spark, sf_dir), N, N, 6).select("site_id", F.round("value", 4).alias("value"))


GRID = ctes("raster_pixels") + ", grid AS (SELECT t AS tile_id, r, k, coalesce(value, 0) AS v FROM range(4) a(t), range(40) b(r), range(40) c(k) LEFT JOIN raster_pixels p ON p.tile_id = t AND prow = r AND pcol = k)"


@query("r6_focal_max_fill", GRID + " SELECT g.tile_id, g.r AS row, g.k AS col, CASE WHEN any_value(g.v) = 0 THEN max(n.v) ELSE any_value(g.v) END AS value FROM grid g JOIN grid n ON n.tile_id = g.tile_id AND abs(n.r - g.r) <= 2 AND abs(n.k - g.k) <= 2 GROUP BY 1, 2, 3")
def r6_(spark, sf_dir):
    return R.explode_pixels(R.focal_max_fill(R.to_array(pixels(spark, sf_dir), N, N, 0.0), N, N, 2), N).select("tile_id", c("row").cast("long").alias("row"), c("col").cast("long").alias("col"), "value")


@query("r7_focal_mean_fill", GRID + " SELECT g.tile_id, g.r AS row, g.k AS col, round(CASE WHEN any_value(g.v) = 0 THEN sum(CASE WHEN pow(n.r - g.r, 2) + pow(n.k - g.k, 2) <= 9 THEN n.v ELSE 0 END) / 29 ELSE any_value(g.v) END, 4) AS value FROM grid g JOIN grid n ON n.tile_id = g.tile_id AND abs(n.r - g.r) <= 3 AND abs(n.k - g.k) <= 3 GROUP BY 1, 2, 3")
def r7(spark, sf_dir):
    return R.explode_pixels(R.focal_mean_fill(R.to_array(pixels(spark, sf_dir), N, N, 0.0), N, N, 3), N).select("tile_id", c("row").cast("long").alias("row"), c("col").cast("long").alias("col"), F.round("value", 4).alias("value"))


@query("r8_slope_grid", GRID + ", s AS (SELECT tile_id, r, k, v, (CASE WHEN k = 0 THEN lead(v) OVER x - v WHEN k = 39 THEN v - lag(v) OVER x ELSE (lead(v) OVER x - lag(v) OVER x) / 2 END) / 250.0 AS dx, (CASE WHEN r = 0 THEN lead(v) OVER y - v WHEN r = 39 THEN v - lag(v) OVER y ELSE (lead(v) OVER y - lag(v) OVER y) / 2 END) / 250.0 AS dy FROM grid WINDOW x AS (PARTITION BY tile_id, r ORDER BY k), y AS (PARTITION BY tile_id, k ORDER BY r)) SELECT tile_id, r AS row, k AS col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 4) AS value FROM s")
def r8(spark, sf_dir):
    return R.explode_pixels(R.slope_grid(R.to_array(pixels(spark, sf_dir), N, N, 0.0), N, N, 250.0), N).select("tile_id", c("row").cast("long").alias("row"), c("col").cast("long").alias("col"), F.round("value", 4).alias("value"))


@query("s6_explode_pixels", GRID + " SELECT tile_id, r AS row, k AS col, v AS value FROM grid WHERE tile_id IN (SELECT tile_id FROM raster_pixels)")
def s6(spark, sf_dir):
    """Pixel form to array form and back."""
    return R.explode_pixels(R.to_array(pixels(spark, sf_dir), N, N, 0.0), N).select("tile_id", c("row").cast("long").alias("row"), c("col").cast("long").alias("col"), "value")


CENTRES = ctes("raster_pixels", "raster_polys") + ", px AS (SELECT tile_id, prow, pcol, value, 34 + tile_id * 0.1::DOUBLE + (prow + 0.5) * 0.0025::DOUBLE AS lat, -118.5::DOUBLE + (pcol + 0.5) * 0.0025::DOUBLE AS lon FROM raster_pixels), hit AS (SELECT p.poly_id, p.class_code, px.* FROM raster_polys p JOIN px ON px.lon > p.xmin AND px.lon < p.xmin + p.size_deg AND px.lat > p.ymin AND px.lat < p.ymin + p.size_deg)"


def centres(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return p.withColumns({"lat": 34 + c("tile_id") * F.lit(0.1) + (c("row") + 0.5) * 0.0025, "lon": F.lit(-118.5) + (c("col") + 0.5) * 0.0025})


def boxes(df, size="size_deg"):
    """Boxes as polygons."""
    pt = lambda a, b: F.struct((c("xmin") + (c(size) if a else F.lit(0.0))).alias("x"), (c("ymin") + (c(size) if b else F.lit(0.0))).alias("y"))
    return df.withColumn("parts", F.array(F.struct(F.array(F.array(pt(0, 0), pt(1, 0), pt(1, 1), pt(0, 1), pt(0, 0))).alias("rings"))))


@query("a11_zonal_stats", CENTRES + " SELECT poly_id, count(*) AS n, round(max(abs(value)), 6) AS mx, round(avg(abs(value)), 6) AS mean FROM hit GROUP BY poly_id")
def a11(spark, sf_dir):
    hit = S.zonal_pairs(boxes(fixture(spark, sf_dir, "raster_polys").drop("tile_id")), centres(spark, sf_dir))
    return hit.groupBy("poly_id").agg(F.count("*").alias("n"), r6(F.max(F.abs("value"))).alias("mx"), r6(F.avg(F.abs("value"))).alias("mean"))


@query("j17_zonal_join", CENTRES + " SELECT poly_id, tile_id, prow AS row, pcol AS col FROM hit")
def j17(spark, sf_dir):
    return S.zonal_pairs(boxes(fixture(spark, sf_dir, "raster_polys").drop("tile_id")), centres(spark, sf_dir)).select("poly_id", "tile_id", "row", "col")


def painted(spark, sf_dir, combine):
    px, polys = centres(spark, sf_dir), boxes(fixture(spark, sf_dir, "raster_polys").drop("tile_id")).withColumn("seq", c("poly_id"))
    hit = R.rasterize(polys, px, "class_code", combine)
    return px.select("tile_id", "row", "col").join(hit, ["tile_id", "row", "col"], "left").select("tile_id", "row", "col", F.coalesce("value", F.lit(0)).cast("long").alias("class"))


PAINTED = CENTRES + " SELECT px.tile_id, px.prow AS row, px.pcol AS col, CAST(coalesce({}, 0) AS BIGINT) AS class FROM px LEFT JOIN hit ON hit.tile_id = px.tile_id AND hit.prow = px.prow AND hit.pcol = px.pcol GROUP BY 1, 2, 3"


@query("r9_rasterize", PAINTED.format("max(hit.class_code)"))
def r9(spark, sf_dir):
    """The highest class of the polygons over each pixel."""
    return painted(spark, sf_dir, "max")


@query("r9_rasterize_last", PAINTED.format("arg_max(hit.class_code, hit.poly_id)"))
def r9_last(spark, sf_dir):
    """The class of the polygon painted last."""
    return painted(spark, sf_dir, "last")


def mosaic(spark, sf_dir):
    """The four tiles side by side, two by two."""
    return R.to_array(pixels(spark, sf_dir), N, N, 0.0).withColumns({"ti": F.floor(c("tile_id") / 2), "tj": c("tile_id") % 2})


MOSAIC = GRID + ", m AS (SELECT tile_id, r, k, v, tile_id // 2 * 40 + r AS y, tile_id % 2 * 40 + k AS x FROM grid)"


def mosaic_pixels(tiles):
    return R.explode_pixels(tiles, N).select("tile_id", c("row").cast("long").alias("row"), c("col").cast("long").alias("col"), F.round("value", 4).alias("value"))


@query("r6_focal_max_mosaic", MOSAIC + " SELECT g.tile_id, g.r AS row, g.k AS col, round(CASE WHEN any_value(g.v) = 0 THEN max(n.v) ELSE any_value(g.v) END, 4) AS value FROM m g JOIN m n ON abs(n.y - g.y) <= 2 AND abs(n.x - g.x) <= 2 GROUP BY 1, 2, 3")
def r6_mosaic(spark, sf_dir):
    """Windows reach over the borders of tiles."""
    return mosaic_pixels(Q.focal_max_fill(mosaic(spark, sf_dir), N, N, 2))


@query("r7_focal_mean_mosaic", MOSAIC + " SELECT g.tile_id, g.r AS row, g.k AS col, round(CASE WHEN any_value(g.v) = 0 THEN sum(CASE WHEN pow(n.y - g.y, 2) + pow(n.x - g.x, 2) <= 9 THEN n.v ELSE 0 END) / 29 ELSE any_value(g.v) END, 4) AS value FROM m g JOIN m n ON abs(n.y - g.y) <= 3 AND abs(n.x - g.x) <= 3 GROUP BY 1, 2, 3")
def r7_mosaic(spark, sf_dir):
    return mosaic_pixels(Q.focal_mean_fill(mosaic(spark, sf_dir), N, N, 3))


@query("r8_slope_mosaic", MOSAIC + ", s AS (SELECT tile_id, r, k, (CASE WHEN x = 0 THEN lead(v) OVER wx - v WHEN x = 79 THEN v - lag(v) OVER wx ELSE (lead(v) OVER wx - lag(v) OVER wx) / 2 END) / 250.0 AS dx, (CASE WHEN y = 0 THEN lead(v) OVER wy - v WHEN y = 79 THEN v - lag(v) OVER wy ELSE (lead(v) OVER wy - lag(v) OVER wy) / 2 END) / 250.0 AS dy FROM m WINDOW wx AS (PARTITION BY y ORDER BY x), wy AS (PARTITION BY x ORDER BY y)) SELECT tile_id, r AS row, k AS col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 4) AS value FROM s")
def r8_mosaic(spark, sf_dir):
    return mosaic_pixels(Q.slope_grid(mosaic(spark, sf_dir), N, N, 250.0))


@query("r6_sample_nearby_max", AT + ", own AS (SELECT site_id, s.tile_id, s.r, s.k, coalesce(p.value, 0) AS v FROM spot s LEFT JOIN raster_pixels p ON p.tile_id = s.tile_id AND p.prow = s.r AND p.pcol = s.k) SELECT o.site_id, CASE WHEN o.v <> 0 THEN o.v ELSE coalesce(max(p.value), 0) END AS value FROM own o LEFT JOIN raster_pixels p ON p.tile_id = o.tile_id AND abs(p.prow - o.r) <= 4 AND abs(p.pcol - o.k) <= 4 GROUP BY o.site_id, o.v")
def r6_site(spark, sf_dir):
    return R.sample_nearby_max(sites(spark, sf_dir), pixels(spark, sf_dir), N, N)


@query("r10_split_chunks", GRID + " SELECT tile_id * 4 + (1 - r // 20) * 2 + k // 20 AS tile, 19 - r % 20 AS row, k % 20 AS col, v AS value FROM grid WHERE tile_id IN (SELECT tile_id FROM raster_pixels)")
def r10_chunks(spark, sf_dir):
    """Each tile taken as a chunk of 2 by 2 tiles, stored from the north."""
    chunks = R.to_array(pixels(spark, sf_dir), N, N, 0.0).select(c("tile_id").cast("double").alias("south"), F.lit(0.0).alias("west"), "data")
    cut = R.split_chunks(chunks, N, N).withColumn("whole", F.floor("south"))
    quarter = F.round((c("south") - c("whole")) / F.lit(R.TILE_DEGREES)) * 2 + F.round(c("west") / F.lit(R.TILE_DEGREES))
    tiles = cut.select((c("whole") * 4 + quarter).cast("long").alias("tile_id"), "data")
    return R.explode_pixels(tiles, N // 2).select(c("tile_id").alias("tile"), c("row").cast("long").alias("row"), c("col").cast("long").alias("col"), "value")


@query("r10_resample_nearest", ctes("raster_pixels") + " SELECT tile_id, r AS row, k AS col, value FROM raster_pixels, range(100) a(r), range(100) b(k) WHERE prow = floor((r + 0.5) * 0.4) AND pcol = floor((k + 0.5) * 0.4)")
def r10(spark, sf_dir):
    return R.resample_nearest(pixels(spark, sf_dir), N, N, 100, 100)


@query("r11_encode_decode", ctes("raster_pixels") + " SELECT tile_id, prow AS row, pcol AS col, CAST(trunc(least(greatest((value + 100) * 10, 0), 65534)) AS BIGINT) AS raw, round(trunc(least(greatest((value + 100) * 10, 0), 65534)) / 10.0 - 100, 6) AS back, (CAST(value AS BIGINT) & 4) > 0 AS ft3 FROM raster_pixels")
def r11(spark, sf_dir):
    raw = R.encode(c("value"), 10, -100)
    return pixels(spark, sf_dir).select("tile_id", "row", "col", raw.cast("long").alias("raw"), r6(R.decode(raw, 10, -100)).alias("back"), F.element_at(R.unpack_flags(c("value").cast("long")), "3").alias("ft3"))


@query("a9_tile_percentiles", ctes("raster_pixels") + " SELECT tile_id, round(quantile_cont(value, 0.25), 6) AS p25, round(median(value), 6) AS p50 FROM raster_pixels WHERE value > 0 GROUP BY tile_id")
def a9(spark, sf_dir):
    p = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5)))
    return pixels(spark, sf_dir).filter("value > 0").groupBy("tile_id").agg(r6(p[0]).alias("p25"), r6(p[1]).alias("p50"))


@query("r12_promote_low", CENTRES + ", q AS (SELECT tile_id, quantile_cont(value, 0.25) AS p25, median(value) AS p50 FROM raster_pixels WHERE value > 0 GROUP BY tile_id), k AS (SELECT tile_id, prow, pcol, max(class_code) AS cls FROM hit GROUP BY 1, 2, 3) SELECT px.tile_id, px.prow AS row, px.pcol AS col, round(CASE WHEN value < p25 AND cls >= 2 THEN p50 ELSE value END, 6) AS value FROM px JOIN q USING (tile_id) LEFT JOIN k ON k.tile_id = px.tile_id AND k.prow = px.prow AND k.pcol = px.pcol")
def r12(spark, sf_dir):
    """Pixels under the tile's lower quartile in a high class take the tile's median."""
    return R.promote_low(pixels(spark, sf_dir), r9(spark, sf_dir)).select("tile_id", "row", "col", r6("value").alias("value"))


@query("a6_mean_modeled", ctes("raster_pixels") + " SELECT tile_id, CAST(prow // 8 AS BIGINT) AS i, CAST(pcol // 8 AS BIGINT) AS j, round(sum(value) / 64, 6) AS mean FROM raster_pixels GROUP BY 1, 2, 3")
def a6(spark, sf_dir):
    """Means of 8 by 8 pixels, missing ones as zero."""
    return pixels(spark, sf_dir).groupBy("tile_id", F.floor(c("row") / 8).alias("i"), F.floor(c("col") / 8).alias("j")).agg(r6(F.sum("value") / 64).alias("mean"))


FREQ = ctes("perimeters") + ", px AS (SELECT DISTINCT fire_year, i, j FROM (SELECT fire_year, unnest(range(CAST(ceil(ymin * 100 - 0.5) AS BIGINT), CAST(ceil((ymin + size_deg) * 100 - 0.5) AS BIGINT))) AS i, xmin, size_deg FROM perimeters), LATERAL (SELECT unnest(range(CAST(ceil(xmin * 100 - 0.5) AS BIGINT), CAST(ceil((xmin + size_deg) * 100 - 0.5) AS BIGINT))) AS j)), freq AS (SELECT CAST(floor(i / 50.0) AS BIGINT) AS ci, CAST(floor(j / 50.0) AS BIGINT) AS cj, count(*) / (2500.0 * (SELECT count(DISTINCT fire_year) FROM perimeters)) AS obs FROM px GROUP BY 1, 2)"


def observed(spark, sf_dir):
    """Share of the 0.01 degree pixels of a half-degree cell that burn in a year, once a year each."""
    p = fixture(spark, sf_dir, "perimeters")
    span = lambda lo: F.sequence(F.ceil(lo * 100 - 0.5), F.ceil((lo + c("size_deg")) * 100 - 0.5) - 1)
    px = p.withColumn("i", F.explode(span(c("ymin")))).withColumn("j", F.explode(span(c("xmin")))).select("fire_year", "i", "j").distinct()
    years = p.agg(F.count_distinct("fire_year").alias("years"))
    k = px.groupBy(F.floor(c("i") / 50).alias("ci"), F.floor(c("j") / 50).alias("cj")).agg(F.count("*").alias("n"))
    return k.join(F.broadcast(years)).select("ci", "cj", (c("n") / (c("years") * 2500.0)).alias("obs"))


@query("a5_observed_frequency", FREQ + " SELECT ci, cj, round(obs, 9) AS obs FROM freq")
def a5(spark, sf_dir):
    return observed(spark, sf_dir).select("ci", "cj", F.round("obs", 9).alias("obs"))


FACTORS = FREQ.replace("WITH perimeters", ctes("modeled_pixels") + ", perimeters") + ", model AS (SELECT CAST(floor(lat / 0.5::DOUBLE) AS BIGINT) AS ci, CAST(floor(lon / 0.5::DOUBLE) AS BIGINT) AS cj, avg(value) / 1e5 AS m FROM modeled_pixels GROUP BY 1, 2), factors AS (SELECT ci, cj, least(greatest(coalesce(obs, 0) / m, 0.5::DOUBLE), 20::DOUBLE) AS factor FROM model LEFT JOIN freq USING (ci, cj) WHERE m > 0), box AS (SELECT min(ci) AS i0, max(ci) AS i1, min(cj) AS j0, max(cj) AS j1 FROM freq), full_grid AS (SELECT ci, cj, ci - i0 AS i, cj - j0 AS j, coalesce(factor, (SELECT median(factor) FROM factors)) AS f, i1 - i0 + 1 AS ni, j1 - j0 + 1 AS nj FROM (SELECT * FROM box, LATERAL (SELECT unnest(range(i0, i1 + 1)) AS ci), LATERAL (SELECT unnest(range(j0, j1 + 1)) AS cj)) cells LEFT JOIN factors USING (ci, cj))"


def factors(spark, sf_dir):
    """Observed frequency over the modeled one, by half-degree cell."""
    return R.calibration_factors(observed(spark, sf_dir), R.mean_modeled(fixture(spark, sf_dir, "modeled_pixels"), 0.5))


@query("a7_calibration_factors", FACTORS.split(", box AS")[0] + " SELECT ci, cj, round(factor, 6) AS factor FROM factors")
def a7(spark, sf_dir):
    return factors(spark, sf_dir).select("ci", "cj", r6("factor").alias("factor"))


@query("a6_mean_of_cells", FACTORS.split(", factors AS")[0] + " SELECT ci, cj, round(m, 9) AS modeled FROM model")
def a6b(spark, sf_dir):
    return R.mean_modeled(fixture(spark, sf_dir, "modeled_pixels"), 0.5).select("ci", "cj", F.round("modeled", 9).alias("modeled"))


def filled(spark, sf_dir):
    """The whole grid from its south-west corner; cells without a factor take the median."""
    o = observed(spark, sf_dir).agg(F.min("ci").alias("i0"), F.max("ci").alias("i1"), F.min("cj").alias("j0"), F.max("cj").alias("j1"))
    cells = o.withColumn("ci", F.explode(F.sequence("i0", "i1"))).withColumn("cj", F.explode(F.sequence("j0", "j1")))
    full = R.fill_with_median(factors(spark, sf_dir), cells)
    return full.select("ci", "cj", (c("ci") - c("i0")).alias("i"), (c("cj") - c("j0")).alias("j"), "value", (c("i1") - c("i0") + 1).alias("ni"), (c("j1") - c("j0") + 1).alias("nj"))


@query("a8_fill_with_median", FACTORS + " SELECT i, j, round(f, 6) AS factor FROM full_grid")
def a8(spark, sf_dir):
    return filled(spark, sf_dir).select("i", "j", r6("value").alias("factor"))


@query("w6_box_smooth", FACTORS + ", d AS (SELECT i, j, least(greatest(i + a, 0), ni - 1) AS si, least(greatest(j + b, 0), nj - 1) AS sj FROM full_grid, range(-1, 2) x(a), range(-1, 2) y(b)) SELECT d.i, d.j, round(avg(f), 6) AS factor FROM d JOIN full_grid g ON g.i = si AND g.j = sj GROUP BY 1, 2")
def w6(spark, sf_dir):
    g = filled(spark, sf_dir)
    size = g.select("ni", "nj").first()
    return R.box_smooth(g.select("i", "j", "value"), size.ni, size.nj).select("i", "j", r6("value").alias("factor"))


@query("j18_grid_lookup", FACTORS + " SELECT tile, round(f, 6) AS factor FROM (SELECT t AS tile, least(greatest(t * 3 - 5, 0), (SELECT max(ni) FROM full_grid) - 1) AS i, least(greatest(t * 2 - 3, 0), (SELECT max(nj) FROM full_grid) - 1) AS j FROM range(20) r(t)) JOIN full_grid USING (i, j)")
def j18(spark, sf_dir):
    """Cells by clamped index: places beyond the grid take its border."""
    g = filled(spark, sf_dir)
    size = g.agg(F.max("ni").alias("mi"), F.max("nj").alias("mj"))
    t = spark.range(20).join(F.broadcast(size)).select(c("id").alias("tile"), F.least(F.greatest(c("id") * 3 - 5, F.lit(0)), c("mi") - 1).alias("i"), F.least(F.greatest(c("id") * 2 - 3, F.lit(0)), c("mj") - 1).alias("j"))
    return t.join(g.select("i", "j", "value"), ["i", "j"]).select("tile", r6("value").alias("factor"))


HAZARD = CENTRES.replace("px AS (SELECT", "centre AS (SELECT").replace("JOIN px ON", "JOIN centre px ON").replace("WITH raster_pixels", FACTORS + ", raster_pixels")
FIRE = HAZARD + """,
grid AS (SELECT t AS tile_id, r, k, coalesce(value, 0) AS v FROM (SELECT DISTINCT tile_id AS t FROM raster_pixels), range(40) b(r), range(40) c(k) LEFT JOIN raster_pixels p ON p.tile_id = t AND prow = r AND pcol = k),
q AS (SELECT tile_id, quantile_cont(value, 0.25) AS p25, median(value) AS p50 FROM raster_pixels WHERE value > 0 GROUP BY tile_id),
cls AS (SELECT tile_id, prow AS r, pcol AS k, max(class_code) AS cls FROM hit GROUP BY 1, 2, 3),
ext AS (SELECT min(ci) AS i0, max(ci) AS i1, min(cj) AS j0, max(cj) AS j1 FROM full_grid),
cal AS (SELECT tile_id, f FROM (SELECT DISTINCT tile_id, least(greatest(CAST(floor((34.05::DOUBLE + tile_id * 0.1::DOUBLE) / 0.5::DOUBLE) AS BIGINT), i0), i1) AS ci, least(greatest(CAST(floor(-118.45::DOUBLE / 0.5::DOUBLE) AS BIGINT), j0), j1) AS cj FROM raster_pixels, ext) JOIN full_grid USING (ci, cj)),
m AS (SELECT g.tile_id, g.r, g.k, CASE WHEN g.v < p25 AND cls >= 2 THEN p50 ELSE g.v END / 1e5 * f AS p FROM grid g JOIN cal USING (tile_id) LEFT JOIN q USING (tile_id) LEFT JOIN cls ON cls.tile_id = g.tile_id AND cls.r = g.r AND cls.k = g.k),
disc AS (SELECT count(*) AS n FROM range(-20, 21) a(x), range(-20, 21) b(y) WHERE x * x + y * y <= 400),
filled AS (SELECT g.tile_id, g.r, g.k, CASE WHEN any_value(g.p) = 0 THEN sum(CASE WHEN pow(n.r - g.r, 2) + pow(n.k - g.k, 2) <= 400 THEN n.p ELSE 0 END) / (SELECT n FROM disc) ELSE any_value(g.p) END AS p FROM m g JOIN m n ON n.tile_id = g.tile_id AND abs(n.r - g.r) <= 20 AND abs(n.k - g.k) <= 20 GROUP BY 1, 2, 3),
arrival AS (SELECT tile_id, r, k, 1 - pow(1 - least(greatest(p, 0::DOUBLE), 1::DOUBLE), 30) AS p30 FROM filled QUALIFY max(1 - pow(1 - least(greatest(p, 0::DOUBLE), 1::DOUBLE), 30)) OVER (PARTITION BY tile_id) >= 0.001)"""


def arrival(spark, sf_dir):
    tiles = sites(spark, sf_dir).select("tile_id").distinct().select("tile_id", (34.05 + c("tile_id") * F.lit(0.1)).alias("lat"), F.lit(-118.45).alias("lon"))
    return R.fire_arrival_30yr(pixels(spark, sf_dir), S.grid_lookup(tiles, filled(spark, sf_dir).select("ci", "cj", "value"), 0.5), r9(spark, sf_dir), N, N)


@query("r13_fire_arrival_30yr", FIRE + " SELECT tile_id, r AS row, k AS col, round(p30, 6) AS p30 FROM arrival")
def r13(spark, sf_dir):
    """Calibrated, promoted and filled burn probabilities over 30 years."""
    return arrival(spark, sf_dir).select("tile_id", c("row").cast("long").alias("row"), c("col").cast("long").alias("col"), r6("p30").alias("p30"))


EXPOSED = FIRE.replace("WITH modeled_pixels", ctes("zip_units") + ", modeled_pixels") + """,
flame AS (SELECT tile_id, r, k, CAST(CAST(v AS BIGINT) % 5 AS DOUBLE) AS v FROM grid),
cfl AS (SELECT g.tile_id, g.r, g.k, CASE WHEN any_value(g.v) = 0 THEN max(n.v) ELSE any_value(g.v) END AS flame_ft FROM flame g JOIN flame n ON n.tile_id = g.tile_id AND abs(n.r - g.r) <= 4 AND abs(n.k - g.k) <= 4 GROUP BY 1, 2, 3),
ssd AS (SELECT tile_id, r, k, value AS distance_m FROM raster_pixels, range(40) a(r), range(40) b(k) WHERE prow % 2 = 0 AND pcol % 2 = 0 AND prow // 2 = CAST(floor((r + 0.5) * 20 / 40) AS BIGINT) AND pcol // 2 = CAST(floor((k + 0.5) * 20 / 40) AS BIGINT)),
share AS (SELECT tile_id, CASE WHEN housing_units > 0 THEN least(greatest(coalesce(pif_2025, 0)::DOUBLE / housing_units, 0), 1) ELSE 0 END AS fair_share FROM (SELECT t.tile_id, z.*, row_number() OVER (PARTITION BY t.tile_id ORDER BY pow(34.05::DOUBLE + t.tile_id * 0.1::DOUBLE - z.lat, 2) + pow(-118.45::DOUBLE - z.lon, 2), z.zip) AS rn FROM (SELECT DISTINCT tile_id FROM raster_pixels) t, zip_units z) WHERE rn = 1),
exposure AS (SELECT a.tile_id, a.r, a.k, p30, coalesce(flame_ft, 0) AS flame_ft, coalesce(distance_m, 0) AS distance_m, coalesce(fair_share, 0) AS fair_share FROM arrival a LEFT JOIN cfl ON cfl.tile_id = a.tile_id AND cfl.r = a.r AND cfl.k = a.k LEFT JOIN ssd ON ssd.tile_id = a.tile_id AND ssd.r = a.r AND ssd.k = a.k LEFT JOIN share ON share.tile_id = a.tile_id)"""


def exposure(spark, sf_dir):
    """Arrival with flame length, distance between structures and the share of the nearest zip's insured of last resort."""
    p = pixels(spark, sf_dir)
    flame = p.withColumn("value", (c("value").cast("long") % 5).cast("double"))
    distance = p.filter("row % 2 = 0 and col % 2 = 0").withColumns({"row": F.expr("row div 2"), "col": F.expr("col div 2")})
    tiles = p.select("tile_id").distinct().select("tile_id", (34.05 + c("tile_id") * F.lit(0.1)).alias("lat"), F.lit(-118.45).alias("lon"))
    units = fixture(spark, sf_dir, "zip_units")
    share = S.nearest_centroid(tiles, units, "tile_id", "zip").join(units, "zip").select("tile_id", A.fair_share(c("pif_2025"), c("housing_units")).alias("value"))
    return R.fire_exposure(arrival(spark, sf_dir), flame, distance, share, N, N, (20, 20))


@query("r14_fire_exposure", EXPOSED + " SELECT tile_id, r AS row, k AS col, round(p30, 6) AS p30, flame_ft, distance_m, round(fair_share, 6) AS fair_share FROM exposure")
def r14b(spark, sf_dir):
    e = exposure(spark, sf_dir)
    return e.select("tile_id", c("row").cast("long").alias("row"), c("col").cast("long").alias("col"), r6("p30").alias("p30"), "flame_ft", "distance_m", r6("fair_share").alias("fair_share"))


@query("r14_fire_risk_tiles", EXPOSED + ", z AS (SELECT tile_id, CAST(trunc(least(greatest(round(p30 / (1 + exp(-(0.3::DOUBLE * flame_ft - 0.01::DOUBLE * distance_m + fair_share))), 9) * 10000, 0), 65534)) AS BIGINT) AS raw FROM exposure) SELECT tile_id, CAST(sum(raw) AS BIGINT) AS total, max(raw) AS mx FROM z GROUP BY tile_id HAVING max(raw) > 0")
def r14(spark, sf_dir):
    """Arrival by a logistic chance of destruction, encoded; SQL can state this one."""
    destroyed = 1 / (1 + F.exp(-(0.3 * c("flame_ft") - 0.01 * c("distance_m") + c("fair_share"))))
    raw = R.fire_risk_tiles(exposure(spark, sf_dir), destroyed)
    return raw.groupBy("tile_id").agg(F.sum("raw").cast("long").alias("total"), F.max("raw").cast("long").alias("mx"))


@query("r14_fire_risk_by_model")
def r14c(spark, sf_dir):
    """The same with the damage model, whose label is destruction."""
    from terrarisk.operators import model as M

    from .model_queries import trained

    e = M.scored(trained(spark, sf_dir, destroyed_only=True), exposure(spark, sf_dir))
    return R.fire_risk_tiles(e, c("p")).select("tile_id", c("row").cast("long").alias("row"), c("col").cast("long").alias("col"), c("raw").cast("long").alias("raw"))
