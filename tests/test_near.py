"""The block searches in numpy against brute force and against the Column expressions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from terrarisk.functions import geometry as G
from terrarisk.operators import near as N
from terrarisk.operators import spatial as S


def scene(seed, places=60, edges=400, lat=36.0):
    r = np.random.default_rng(seed)
    ay, ax = lat + r.uniform(-0.6, 0.6, edges), -120 + r.uniform(-0.8, 0.8, edges)
    long = r.random(edges) < 0.7
    by, bx = ay + long * r.normal(0, 0.1, edges), ax + long * r.normal(0, 0.1, edges)
    ay[:2], by[:2] = np.nan, np.nan
    return lat + r.uniform(-0.3, 0.3, places), -120 + r.uniform(-0.3, 0.3, places), ax, ay, bx, by, r.permutation(edges) // 2, r.integers(0, 12, edges)


@pytest.mark.parametrize("lat", [36.0, 71.0, 88.5])
@pytest.mark.parametrize("k, hundredths", [(None, True), (1, False), (5, False)])
def test_nearest(lat, k, hundredths, monkeypatch):
    monkeypatch.setattr(N, "PAIRS", 4000)
    la, lo, ax, ay, bx, by, seq, code = scene(1, lat=lat)
    p, e, km = N.nearest(la, lo, ax, ay, bx, by, seq, code, 40.0, k, hundredths)
    d = N.exact_km(la[:, None], lo[:, None], ax, ay, bx, by)
    for i in range(len(la)):
        best = {}
        for j in np.flatnonzero(d[i] <= 40.0):
            order = (np.floor(d[i, j] * 100 + 0.5) if hundredths else d[i, j], seq[j], d[i, j])
            best[code[j]] = min(best.get(code[j], (order, j)), (order, j))
        want = sorted(best.values())[:k]
        assert sorted(e[p == i]) == sorted(j for _, j in want)
    assert len(p) and np.allclose(km, d[p, e])
    assert all(len(v) == 0 for v in N.nearest(la, lo, *[v[:0] for v in (ax, ay, bx, by, seq, code)], 40.0))


def test_within():
    la, lo, x, y, _, _, seq, _ = scene(2, edges=3000)
    p, e, km = N.within(la, lo, y, x, seq, 3.0)
    d = N.exact_km(la[:, None], lo[:, None], x, y, x, y)
    want = {}
    for i, j in zip(*np.nonzero(d <= 3.0)):
        want[i, seq[j]] = min(want.get((i, seq[j]), (9.0, 0)), (d[i, j], j))
    assert {(i, seq[j]): (a, j) for i, j, a in zip(p, e, km)} == want and len(want) > 20


def test_by_name_moves_only_what_is_found(spark):
    """Of the pairs of places and edges none are sorted or moved: they are met in the task that holds their block."""
    r = np.random.default_rng(4)
    lines = [(i, i, f"n{i % 3}" if i % 7 else None, [([[(x, y), (x + 0.02, y + 0.01), (x + 0.03, y)]],)]) for i, (x, y) in enumerate(zip((-120 + r.uniform(-1, 1, 800)).tolist(), (36 + r.uniform(-1, 1, 800)).tolist()))]
    layer = spark.createDataFrame(lines, f"line_id long, seq long, name string, parts {G.GEOMETRY}")
    sites = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip((36 + r.uniform(-1, 1, 50)).tolist(), (-120 + r.uniform(-1, 1, 50)).tolist()))] + [(99, None, None)], "site_id long, lat double, lon double")
    got = S.nearest_line_per_name(sites, layer, "line_id", "name", "seq", 50.0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 1 and "CoGroup" in plan
    d = G.point_line_km(F.col("parts"), F.col("lat"), F.col("lon"))
    brute = sites.crossJoin(layer).select("site_id", "name", "line_id", "seq", d.alias("d")).filter("d <= 50").groupBy("site_id", "name").agg(F.min(F.struct(F.floor(F.col("d") * 100 + 0.5), "seq", "line_id")).alias("b"))
    assert {(x.site_id, x.name, x.line_id) for x in got.collect()} == {(x.site_id, x.name, x.b.line_id) for x in brute.collect()}


def test_first_zones(spark):
    r = np.random.default_rng(5)
    ring = lambda x, y, s: [(x - s, y - s), (x + s, y - s), (x + s, y), (x, y), (x, y + s), (x - s, y + s), (x - s, y - s)]
    zones = []
    for i in range(40):
        x, y, s = r.uniform(-1, 1), r.uniform(-1, 1), r.uniform(0.1, 0.6)
        zones.append((i, [([ring(x, y, s), ring(x - s / 2, y - s / 2, s / 4)] if i % 2 else [ring(x, y, s)],), ([ring(y, x, s / 3)],)]))
    zones += [(40, None), (41, []), (43, [([[(0.0, 0.0)]],)])]
    layer = spark.createDataFrame(zones, f"seq long, parts {G.GEOMETRY}")
    lat, lon = r.uniform(-1, 1, 300), r.uniform(-1, 1, 300)
    sites = spark.createDataFrame(list(enumerate(zip(lat.tolist(), lon.tolist()))), "i long, at struct<lat double, lon double>")
    held = sites.crossJoin(layer).filter(G.contains_point(F.col("parts"), F.col("at.lon"), F.col("at.lat"))).groupBy("i", (F.col("seq") % 3).alias("c")).agg(F.min("seq").alias("s")).collect()
    table = layer.toArrow()
    seq = N.whole(table.column("seq"))
    p, z = N.first_zones(lat, lon, table.column("parts").combine_chunks(), seq, seq % 3)
    assert {(x.i, x.c, x.s) for x in held} == {(i, seq[j] % 3, seq[j]) for i, j in zip(p, z)} and len(held) > 100
    assert N.codes(pa.chunked_array([["a", None, "a"]])).tolist() == [0, 1, 0]


def test_lines_of_many_edges(spark):
    """Distances to lines of one to seven edges, by place with a column of the site's own, against the expression over a whole line."""
    r = np.random.default_rng(6)
    lines = [(i, [([list(zip((-120 + r.uniform(-1, 1) + np.cumsum(r.normal(0, 0.15, 2 + i % 7))).tolist(), (36 + r.uniform(-1, 1) + np.cumsum(r.normal(0, 0.15, 2 + i % 7))).tolist()))],)]) for i in range(120)]
    layer = spark.createDataFrame(lines, f"line_id long, parts {G.GEOMETRY}")
    spots = [(36 + a, -120 + b) for a, b in r.uniform(-1, 1, (15, 2)).tolist()]
    sites = spark.createDataFrame([(i, *spots[i % 15], i % 2) for i in range(90)], "site_id long, lat double, lon double, kind long")
    far = S.place_distances(sites, layer, "line_id", 30.0, ("kind",))
    assert far.count() == far.select("lat", "lon", "kind", "line_id").distinct().count()
    got = {(x.site_id, x.line_id, x.kind): x.distance_km for x in S.unfold(far.select("ids", "line_id", "kind", "distance_km")).collect()}
    d = G.point_line_km(F.col("parts"), F.col("lat"), F.col("lon"))
    want = {(x.site_id, x.line_id, x.kind): x.d for x in sites.crossJoin(layer).select("site_id", "line_id", "kind", d.alias("d")).filter("d <= 30").collect()}
    assert got == pytest.approx(want, abs=1e-9) and len(got) > 500


@pytest.mark.parametrize("name", ["j7_fault_join", "h5_score_faults"])
def test_pairs_unfold_last(spark, sf_dir, name):
    """What is computed of a pair is computed once a place: sites are unfolded above it."""
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(ids") < plan.index("round(")


def test_points_meet_as_places(spark):
    """Sites and points at one place each meet once and are unfolded last; none is lost, nor a key that is NULL."""
    sites = spark.createDataFrame([(i, 36.0 + i % 4 / 100, -120.0) for i in range(4800)] + [(None, 36.0, -120.0), (9, None, -120.0)], "site_id long, lat double, lon double")
    points = spark.createDataFrame([(i, 36.0, -120.0 + i % 3 / 50) for i in range(90)] + [(7, 36.0, -120.0), (None, 36.0, -120.0)], "feature_id long, lat double, lon double")
    pairs = S.place_point_distances(sites, points, "feature_id", 2.5)
    d = G.haversine_km(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))
    brute = sites.crossJoin(points.withColumnsRenamed({"lat": "p_lat", "lon": "p_lon"})).select("site_id", "feature_id", d.alias("distance_km")).filter("distance_km <= 2.5")
    assert pairs.count() < 30 and pairs.agg(F.sum(F.size("ids") * F.size("keys"))).first()[0] == brute.count() > 100_000
    total = lambda df: df.groupBy(F.floor(F.col("distance_km") * 1000).alias("m")).agg(F.count("*"), F.sum("site_id"), F.sum("feature_id"), F.count("site_id"), F.count("feature_id")).sort("m").collect()
    assert total(S.point_distances(sites, points, "feature_id", 2.5)) == total(brute)
