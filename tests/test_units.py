"""Hand-computed values and edge cases."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from terrarisk.functions import geometry as G
from terrarisk.functions import hazard as H
from terrarisk.functions import text as T
from terrarisk.operators import lines as L
from terrarisk.operators import model as M
from terrarisk.operators import raster as R
from terrarisk.operators import spatial as S
from terrarisk.operators import stats as A
from terrarisk.plans.sql_functions import register
from terrarisk.sources import files as X


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_rates(spark):
    lit = lambda v: F.lit(float(v))
    r = one(spark, H.p_horizon(H.flood_annual(F.lit("AE"))), H.p_horizon(F.lit(H.DAM_RATE)), H.fragility(lit(6.5)), H.pga_to_mmi(lit(0)), H.landslide_annual(F.lit(3), F.lit(95), lit(0)), H.erosion_annual(lit(0.01), lit(-30)), H.erosion_annual(lit(3), lit(-1)), H.tsunami_annual(F.lit(True), F.lit(None).cast("double"), lit(0.6)), H.combined_p30(F.array(lit(1.5), lit(0))))
    assert [round(x, 7) for x in r] == [round(1 - 0.996**30, 7), 0.0026965, 0.1, 1.0, 0.0027663, 1.2, 0.0, 0.00025, 1.0]


def test_text(spark):
    lit = F.lit
    r = one(spark, T.classify_status(lit("Inactive - x")), T.classify_status(lit("Inactive - x"), strict=True), T.classify_status(lit(None).cast("string")), T.title_case(lit("o'neil 2nd-st éa")), T.normalize_street(lit(" MAIN st")), T.extract_zip(lit("12345 Elm, 90210-1")), T.extract_zip(lit("12345 Elm, 90210"), first=True), T.parse_increment(lit("slr_1_0ft")), T.parse_increment(lit("slr_5ft")), T.number(lit(" nan ")), T.number(lit("")))
    assert list(r) == ["active", "monitoring", "unknown", "O'Neil 2Nd-St Éa", "Main Street", "90210", "12345", 1.0, None, None, None]


def square(x, y, size, hole=None):
    ring = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    return [([ring(x, y, size)] + ([ring(*hole)] if hole else []),)]


def test_containment(spark):
    parts = square(0.0, 0.0, 4.0, (1.0, 1.0, 1.0)) + square(10.0, 10.0, 1.0)
    layer = spark.createDataFrame([(1, 1, parts), (2, 2, square(-3.0, -3.0, 0.5))], f"poly_id long, seq long, parts {G.GEOMETRY}")
    sites = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 10.5, 10.5), (4, 5.0, 5.0), (5, -2.8, -2.6)], "site_id long, lat double, lon double")
    assert sorted(tuple(r) for r in S.zone_pairs(sites, layer).select("site_id", "poly_id").collect()) == [(1, 1), (3, 1), (5, 2)]
    wide = spark.createDataFrame([(9, 9, square(-50.0, -20.0, 40.0))], layer.schema)
    assert S.zone_exists(sites.withColumn("lat", F.lit(0.0)).withColumn("lon", F.lit(-30.0)), wide).filter("in_zone").count() == 5


def test_distances(spark):
    lit = lambda v: F.lit(float(v))
    r = one(spark, G.haversine_km(lit(0), lit(0), lit(0), lit(1)), G.point_segment_km(lit(0), lit(0), lit(1), lit(0), lit(1), lit(0)), G.point_segment_km(lit(1), lit(0.5), lit(0), lit(0), lit(1), lit(0)))
    assert [round(x, 3) for x in r] == [111.195, 111.195, 111.195]


def test_nearest_is_complete(spark):
    import random

    rnd = random.Random(1)
    pts = [(i, rnd.uniform(32, 42), rnd.uniform(-124, -114)) for i in range(300)]
    sites = spark.createDataFrame(pts[:60], "site_id long, lat double, lon double")
    points = spark.createDataFrame(pts[60:], "feature_id long, lat double, lon double")
    near = S.point_distances(sites, points, "feature_id", 80.0)
    brute = sites.crossJoin(points.withColumnsRenamed({"lat": "b", "lon": "c"})).select("site_id", "feature_id", G.haversine_km(F.col("lat"), F.col("lon"), F.col("b"), F.col("c")).alias("d")).filter("d <= 80")
    assert near.count() == brute.count() > 0
    got = {r.site_id: r.zip for r in S.nearest_centroid(sites.withColumnRenamed("site_id", "k"), points.withColumnRenamed("feature_id", "zip"), "k", "zip").withColumnRenamed("k", "site_id").collect()}
    for i, lat, lon in pts[:60]:
        assert got[i] == min(pts[60:], key=lambda p: ((p[1] - lat) ** 2 + (p[2] - lon) ** 2, p[0]))[0]


def test_planted_slope(spark):
    rows = [(1, 1, k / 2.0, 0.01 * k + 5) for k in range(6)] + [(1, 2, 0.0, 1.0), (1, 2, 2.0, None)] + [(1, 3, k / 10.0, 1.0 * k) for k in range(5)]
    got = A.displacement_trend(spark.createDataFrame(rows, "frame_id long, pixel_id long, t double, v double"), ["frame_id", "pixel_id"], "t", "v").collect()
    assert [(r.pixel_id, round(r.velocity_mm_yr, 6), round(r.residual_mm, 6)) for r in got] == [(2 - 1, 20.0, 0.0)]


def test_thinning(spark):
    line = [([[(0.0, 0.0), (1.0, 0.001), (2.0, 0.0), (3.0, 1.0)]],)]
    ring = [([[(0.0, 0.0), (1e-6, 0.0), (1e-6, 1e-6), (0.0, 0.0)]],)]
    df = spark.createDataFrame([(1, line), (2, ring)], f"k long, parts {G.GEOMETRY}")
    got = {r.k: len(r.parts[0].rings[0]) for r in L.simplify(df, "k", F.lit(0.01)).collect()}
    assert got == {1: 3}


def test_files(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"a":"1"},"geometry":{"type":"Point","coordinates":[1.5,2.5,9]}},\n{"type":"Feature","properties":{},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}]}')
    rows = X.read_features(spark, f"file://{tmp_path}/f.json", "l").orderBy("seq").collect()
    assert rows[0].parts[0].rings[0][0].x == 1.5 and rows[0].props == {"a": "1"} and len(rows[1].parts[0].rings[0]) == 4
    tiles = tmp_path / "tiles"
    tiles.mkdir()
    (tiles / "34.0_-118.5.bin").write_bytes(struct.pack("<4H", 1000, 65535, 1100, 1200))
    (tiles / "bad.bin").write_bytes(b"12")
    got = X.read_raster_tiles(spark, f"file://{tiles}", 2, 2, scale=10.0, offset=-100.0, nodata=65535).collect()
    assert [(r.tile_key, r.data) for r in got] == [("34.0_-118.5", [0.0, None, 10.0, 20.0])]
    found = {r.file: r.layer for r in X.discover_inputs(spark, f"file://{tmp_path}", {"sra": (["sra", "f.json"], ["lra"]), "tile": (["bin"], [])}).collect()}
    assert found["f.json"] == "sra" and found["bad.bin"] == "tile"


def test_focal_and_sql(spark):
    tiles = spark.createDataFrame([(1, [0.0, 2.0, 0.0, 4.0])], "tile_id long, data array<double>")
    assert R.focal_max_fill(tiles, 2, 2, 1).first().data == [4.0, 2.0, 4.0, 4.0]
    register(spark)
    r = spark.sql("SELECT p_horizon(0.004D, 30D) AS a, flood_annual('VE') AS b, pga_to_mmi(0D) AS c, haversine_km(0D, 0D, 0D, 1D) AS d").first()
    assert [round(x, 4) for x in r] == [0.1133, 0.006, 1.0, 111.1949]


def test_large_tile_is_scattered_in_time(spark):
    """A tile of 400 by 400, the size of real ones."""
    import time

    n = 400
    pixels = spark.range(n * n).filter("id % 3 <> 0").select(F.lit(7).alias("tile_id"), F.expr(f"id div {n}").alias("row"), (F.col("id") % n).alias("col"), F.when(F.col("id") % 5 != 0, F.col("id").cast("double")).alias("value"))
    began = time.time()
    data = R.to_array(pixels, n, n).first().data
    zeros = R.to_array(pixels, n, n, 0.0).first().data
    assert time.time() - began < 20
    assert data == [float(i) if i % 3 and i % 5 else None for i in range(n * n)] and zeros == [x or 0.0 for x in data]


def test_geocode_cache_restarts(spark, tmp_path):
    """Five rows, then nothing new, then one new row: the cache keeps all; a replayed batch changes nothing."""
    from terrarisk.streaming import jobs

    schema = "event_id long, address string, created_at long"
    path = f"file://{tmp_path}"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    run = lambda: {r.key: r.event_id for r in jobs.geocode_cache(spark.readStream.schema(schema).parquet(f"{path}/in"), path).collect()}
    put([(i, f"{i} Main St", i) for i in range(5)])
    first = run()
    assert len(first) == 5 and run() == first
    put([(9, "0 main  st", 9)])
    assert run() == first | {"0 main st": 9}
    assert run() == first | {"0 main st": 9}


def test_tables_by_hand(spark):
    """A few fixed values written out, so that a wrong constant doesn't pass on both sides."""
    lit = F.lit
    n10 = lambda n: H.landslide_annual(lit(3), lit(n), lit(0.0))
    r = one(spark, n10(0), n10(29), n10(80), n10(81), H.lookup(lit("VHIGH").alias("x"), {"VHIGH": "Very High"}), T.classify_status(lit("Completed - Case Closed")), G.albers(lit(-120.0), lit(34.0))["x"], G.albers(lit(-120.0), lit(37.0))["y"])
    assert list(r)[:4] == [0.00000049, 0.00002588, 0.00072447, 0.00276627] and r[4] == "Very High"
    assert abs(r[6]) < 1e-6 and abs(r[7] - -112982) < 500
    assert H.FLOOD_RATES["AE"] == 0.004 and T.HAZARD_CLASSES["vhigh"] == "Very High"


def test_geometry_kinds(spark):
    """Points, lines and polygons: a polygon is never near."""
    rows = [(1, [([[(0.0, 0.0)]],)]), (2, [([[(0.0, 0.0), (1.0, 0.0)]],)]), (3, square(0.0, 0.0, 1.0))]
    got = {r.k: r.d for r in spark.createDataFrame(rows, f"k long, parts {G.GEOMETRY}").select("k", G.geometry_km(F.col("parts"), F.lit(1.0), F.lit(0.0)).alias("d")).collect()}
    assert round(got[1], 3) == round(got[2], 3) == 111.195 and got[3] == float("inf")


def test_geometry_repair(spark):
    """Open, short, flat, touching and empty rings are counted; what can be used is closed and kept."""
    ring = lambda *p: ([[(float(x), float(y)) for x, y in p]],)
    rows = [
        (1, square(0.0, 0.0, 1.0)), (2, [ring((0, 0), (1, 0), (1, 1), (0, 1))]), (3, [ring((0, 0), (1, 1), (0, 0))]), (4, [ring((0, 0), (1, 1), (2, 2), (0, 0))]),
        (5, [ring((0, 0), (2, 0), (1, 1), (2, 2), (1, 1), (0, 2), (0, 0))]), (6, []), (7, None), (8, square(0.0, 0.0, 9.0, (1.0, 1.0, 1.0))),
    ]
    df = spark.createDataFrame(rows, f"k long, parts {G.GEOMETRY}")
    r = L.geometry_quality(df, "k").first().asDict()
    assert r == {"empty": 2, "rings": 7, "unclosed": 1, "short": 1, "flat": 1, "touching": 1, "with_holes": 1}
    kept = {x.k: len(x.parts[0].rings[0]) for x in L.usable(df).collect()}
    assert kept == {1: 5, 2: 5, 5: 7, 8: 5}


def test_counts_and_filters(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 5, "x"), ("a", 9, None)], "s string, n long, t string")
    assert sorted(map(tuple, A.value_counts(df, {"s": "s", "t": "t"}, 1).collect())) == [("s", "a", 2), ("t", "x", 2)]
    rules = {"s": ("matches", "^a"), "n": ("least", 2), "t": ("none_of", ["x"])}
    assert [r.n for r in df.filter(A.row_filter(rules)).collect()] == [9]
    assert {r.rule: r.n_bad for r in A.validate_table(df, {"t": F.col("t").isNull()}, (5, 9)).collect()} == {"t": 1, "row_count": 1}
    fixed = A.apply_corrections(df, "s", spark.createDataFrame([("a", "z")], "raw string, corrected string"))
    assert sorted(r.s for r in fixed.collect()) == ["b", "z", "z"] and fixed.columns == df.columns


def test_scores_are_those_of_the_trees(spark):
    """Batch inference against the sum of the trees, and folds against their counts."""
    rows = [(i, float(i % 2 or i % 7 == 0), float(i % 10), float(i % 4), 0.1 * (i % 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "structure_id long, label double, distance_m double, flame_ft double, fair_share double")
    model = M.train_damage_model(df, trees=4)
    trees = model.stages[-1]
    from pyspark.ml.linalg import Vectors

    for r in M.scored(model, df).limit(25).collect():
        v = Vectors.dense([r.distance_m, r.flame_ft, r.fair_share])
        margin = sum(w * t.predict(v) for w, t in zip(trees.treeWeights, trees.trees))
        assert abs(r.p - 1 / (1 + math.exp(-2 * margin))) < 1e-9
    folds = {(r.label, r.fold): r["count"] for r in M.with_folds(df).groupBy("label", "fold").count().collect()}
    for label in (0.0, 1.0):
        sizes = [folds[label, k] for k in range(5)]
        assert max(sizes) - min(sizes) <= 1
    assert sorted(map(tuple, M.with_folds(df.repartition(3)).select("structure_id", "fold").collect())) == sorted(map(tuple, M.with_folds(df).select("structure_id", "fold").collect()))
    rows = M.kfold_auc(df, k=2, trees=2)
    parts = M.with_folds(df, 2)
    s = M.scored(M.train_damage_model(parts.filter("fold <> 0"), trees=2), parts.filter("fold = 0")).select("p", "label").collect()
    pairs = [(a.p > b.p) + 0.5 * (a.p == b.p) for a in s if a.label for b in s if not b.label]
    assert abs(rows[0]["auc"] - sum(pairs) / len(pairs)) < 1e-6


def test_response_surface_interpolates(spark):
    grids = {"x": [0, 1, 2], "y": [0, 10]}
    rows = [(i, j, 2.0 * x + y) for i, x in enumerate(grids["x"]) for j, y in enumerate(grids["y"])]
    surface = spark.createDataFrame(rows, "i_x int, i_y int, p double")
    sites = spark.createDataFrame([(1, 0.5, 5.0), (2, 9.0, 10.0), (3, -1.0, 0.0)], "site_id long, x double, y double")
    assert {r.site_id: round(r.p, 6) for r in M.interp_trilinear(sites, surface, grids).collect()} == {1: 6.0, 2: 14.0, 3: 0.0}


def test_even_subsample(spark):
    days = spark.range(1, 31).select(F.lit("short").alias("f"), F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).alias("d"))
    years = spark.range(30).select(F.lit("long").alias("f"), F.date_add(F.lit("2020-01-01"), (F.col("id") * 40).cast("int")).alias("d"))
    few = spark.range(8).select(F.lit("few").alias("f"), F.date_add(F.lit("2020-01-01"), (F.col("id") * 90).cast("int")).alias("d"))
    both = days.unionByName(years).unionByName(few)
    count = lambda **how: {r.f: r["count"] for r in A.even_subsample(both, "f", "d", **how).groupBy("f").count().collect()}
    assert count() == {"short": 30, "long": 8, "few": 8}
    assert count(min_years=0.0) == {"short": 8, "long": 8, "few": 8}


def test_self_nearest(spark):
    """Points alone in their block, and one whose nearest lies beyond the cell of a farther one."""
    points = [(1, 34.0, -118.0), (2, 34.0, -118.01), (3, 41.0, -124.0), (4, -33.0, 151.0), (5, 36.99, -120.01), (6, 35.01, -121.99), (7, 36.99, -117.99), (8, 34.0, -118.0)]
    want = {a: min(((y - v) ** 2 + (x - u) ** 2) ** 0.5 for b, v, u in points if b != a) * 111000 * math.cos(math.radians(y)) for a, y, x in points}
    df = spark.createDataFrame(points, "k long, lat double, lon double")
    for cell in (0.005, 2.0):
        got = {r.k: r.distance_m for r in S.self_nearest(df, "k", cell).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in got)
    assert S.self_nearest(df.limit(1), "k", 2.0).count() == 0


def test_window_of_a_pixel_is_looked_at_once(spark):
    """Sites at one pixel share its window: what meets the offsets doesn't grow with the sites."""
    sites = spark.range(2000).select(F.col("id").alias("site_id"), F.lit(1).cast("long").alias("tile_id"), (34 + F.col("id") % 3 / 100).alias("lat"), F.lit(-118.45).alias("lon"), F.lit(34.0).alias("south"), F.lit(-118.5).alias("west"))
    pixels = spark.range(1600).select(F.lit(1).cast("long").alias("tile_id"), F.expr("id div 40").alias("row"), (F.col("id") % 40).alias("col"), (F.col("id") * 7919 % 1601).cast("double").alias("value"))
    got = R.window_max(sites, pixels, 40, 40, 4)
    grid = {(p.row, p.col): p.value for p in pixels.collect()}
    at = {s.site_id: (s.row, s.col) for s in R.nearest_pixel(sites, 40, 40).collect()}
    assert {r.site_id: r.value for r in got.collect()} == {i: max(grid[a, b] for a in range(max(r - 4, 0), min(r + 5, 40)) for b in range(max(k - 4, 0), min(k + 5, 40))) for i, (r, k) in at.items()}
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    offsets = next(i for i, line in enumerate(plan) if "Generate explode" in line)
    assert "Aggregate" in plan[offsets + 1]
