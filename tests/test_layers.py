"""The report from layers: few and odd layers; the plan moves sites once for all layers."""

from pyspark.sql import functions as F

from terrarisk.functions import geometry as G
from terrarisk.operators import layers as Y

SITE = "site_id long, lat double, lon double, tract_rate double, xs array<double>, ys array<double>, seq string, layer int"
PROPS = "seq long, props map<string,string>"


def square(x, y, size):
    return [([[(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]],)]


def test_report(spark):
    sites = spark.createDataFrame([(1, 34.05, -118.45, 0.5, None, None, "s", 1), (2, 40.0, -120.0, None, [0.005, 0.1, 2.0], [0.02, 0.01, 0.0], "s", 1), (3, None, None, None, None, None, "s", 1)], SITE)
    zones = lambda rows: spark.createDataFrame(rows, f"{PROPS}, parts {G.GEOMETRY}")
    here = square(-118.5, 34.0, 0.2)
    layers = {
        "flood_zones": zones([(2, {"FLD_ZONE": "AE"}, here), (1, {"FLD_ZONE": "VE"}, here), (0, {"FLD_ZONE": "X"}, square(-110.0, 30.0, 1.0)), (3, None, None)]),
        "dam_inundation": zones([(1, {"name": "B"}, here), (2, {"name": "A"}, here), (3, {"name": "B"}, here), (4, {"name": ""}, here)]),
        "landslide_supplemental": zones([(1, {"is_active": "true"}, here)]),
        "slr": zones([(1, {"increment_ft": "10"}, here), (2, {"increment_ft": "2"}, here)]),
        "faults": zones([(1, {"fault_name": "F", "ucerf3_prob": "20"}, [([[(-118.45, 34.1), (-118.4, 34.1)]],)]), (2, {"fault_name": "F"}, [([[(-118.45, 34.2), (-118.4, 34.2)]],)]), (3, None, [([[(-118.0, 34.05), (-118.0, 34.06)]],)])]),
        "airports": spark.createDataFrame([(1, {"ident": "near"}, 34.05, -118.449), (2, {"ident": "lead", "annual_piston_ops": "5"}, 34.05, -118.44)], f"{PROPS}, lat double, lon double"),
        "contamination": spark.createDataFrame([(1, {"name": "c"}, 34.051, -118.45), (2, {}, 34.056, -118.45), (3, {}, 34.09, -118.45)], f"{PROPS}, lat double, lon double"),
        "elevation": spark.createDataFrame([(34.0, -118.5, 3, 3, [1.0, 2.0, 3.0, 4.0, 5.0, None, 7.0, 8.0, 9.0])], "south double, west double, rows int, cols int, data array<double>"),
    }
    got = {r.site_id: r for r in Y.report(sites, layers).collect()}
    assert set(got) == {1, 2, 3}
    r = got[1]
    assert r.zones.fema_flood == "V/VE" and r.zones.dam_inundation.dam_names == ["B", "A", "Unknown"] and r.zones.expansive_soil == "Unknown"
    assert r.sea_level_rise.lowest_threshold_ft == 2 and r.sea_level_rise.inundated_at == [2, 10]
    assert [(f.name, f.seq) for f in r.faults] == [("F", 1), ("Unknown", 3)] and abs(r.faults[0].distance_km - 5.56) < 0.01 and r.faults[0].ucerf3_prob == 0.2
    assert r.structural.landslide_tier == 1 and r.structural.landslide_velocity == 999 and r.structural.earthquake.annual_p == 0
    assert r.aviation_lead.nearest_airport.code == "lead" and r.aviation_lead.risk_level == "Moderate"
    assert [s.name for s in r.contamination.sites_within_500m] == ["c"] and [s.name for s in r.contamination.sites_within_half_mile] == ["c", "Unknown"]
    assert r.elevation_m == 5.0 and r.vs30 == 760 and r.traffic_pollution.nearest_major_road is None and r.enviroscreen is None
    empty = got[2]
    assert empty.zones.fema_flood == "None" and empty.faults == [] and empty.structural.earthquake.annual_p > 0 and not empty.zones.dam_inundation.in_zone
    assert empty.structural.combined_30yr > empty.structural.combined_30yr_retrofitted
    assert Y.report(sites.limit(0), layers).count() == 0
    plan = Y.report(sites.withColumn("lat", F.col("lat") + 0), layers)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("Join") <= 2


def test_places_are_searched_once(spark):
    """Many sites at few places: what is met is of places, and only what the report takes of a layer and name leaves a block."""
    spots = [(34.05, -118.45), (35.5, -119.5), (34.0500001, -118.45)]
    sites = spark.createDataFrame([(i, *spots[i % 3], float(i), None, None, "s", 1) for i in range(600)], SITE)
    line = lambda x, y: [([[(x, y), (x + 0.01, y), (x + 0.02, y + 0.01)]],)]
    faults = spark.createDataFrame([(i, {"fault_name": f"F{i % 3}"}, line(-118.6 + i / 500, 34.0 + i % 7 / 50)) for i in range(200)], f"{PROPS}, parts {G.GEOMETRY}")
    airports = spark.createDataFrame([(i, {"ident": str(i)}, 34.0 + i / 500, -118.5) for i in range(100)], f"{PROPS}, lat double, lon double")
    layers = {"faults": faults, "traffic": faults, "airports": airports, "flood_zones": spark.createDataFrame([(i, {}, square(-118.6, 33.9, 0.3 + i / 100)) for i in range(50)], f"{PROPS}, parts {G.GEOMETRY}")}
    met = Y.meet(sites, layers).groupBy("lat", "lon", "layer").count().collect()
    assert {(r.lat, r.layer): r["count"] for r in met} == {(lat, layer): n for lat, _ in (spots[0], spots[2]) for layer, n in ((None, 1), ("faults", 3), ("traffic", 1), ("airports", 10), ("flood_zones", 1))} | {(35.5, None): 1}
    got = Y.report(sites, layers).select("site_id", F.size("faults").alias("n"), "structural.landslide.annual_p", F.to_json("traffic_pollution").alias("t")).collect()
    assert sorted(r.site_id for r in got) == list(range(600)) and all(r.n == (0 if r.site_id % 3 == 1 else 3) for r in got)
    assert len({r.annual_p for r in got}) == 600 and len({r.t for r in got if r.site_id % 3 == 0}) == 1


def test_shared_tables_are_derived_once(spark, sf_dir):
    """The zones, lines and tiles from which several layers are cut aren't derived again for each layer."""
    from terrarisk.plans import layer_queries as Q

    plan = Q.whole(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "supplier.parquet" in plan and "lineitem.parquet" not in plan and "part.parquet" not in plan
    assert sum(line.strip(" +-:*").startswith("Exchange") for line in plan.split("\n")) < 30
