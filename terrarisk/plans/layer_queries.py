"""Queries of the whole site report from layers, part by part, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrarisk.functions import hazard as H
from terrarisk.operators import layers as Y
from terrarisk.operators import raster as R
from terrarisk.operators import spatial as S
from terrarisk.sources.scratch import scratch_dir

from .fixtures import ctes, fixture
from .registry import query
from .site_queries import CLIPPED, FRAG, INSIDE, MMI, N10, NEAR_LINES, PGA, TSUNAMI, curves, faults, hav, zones

c = F.col
N = 40


def r6(x):
    return F.round(x, 6)


def props(**columns) -> F.Column:
    return F.create_map(*[x for k, v in columns.items() for x in (F.lit(k), v.cast("string"))])


def sites(spark, sf_dir) -> DataFrame:
    """Sites all over, near lines and points, and within the raster tiles."""
    pick = lambda name, add: fixture(spark, sf_dir, name).select((c("site_id") + add).alias("site_id"), "lat", "lon")
    all_sites = pick("sites", 0).unionByName(pick("raster_sites", 1_000_000)).unionByName(pick("near_point_sites", 2_000_000))
    return all_sites.join(curves(spark, sf_dir).withColumnRenamed("user_id", "site_id"), "site_id", "left").withColumn("tract_rate", (c("site_id") % 7).cast("double") / 10000)


def kept(df: DataFrame) -> DataFrame:
    """df written and read again: several layers are cut from it, which otherwise derive it each for itself."""
    path = f"{scratch_dir(df.sparkSession)}/layer"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def site_layers(spark, sf_dir) -> dict[str, DataFrame]:
    z, l, points = kept(zones(spark, sf_dir)), kept(faults(spark, sf_dir)), fixture(spark, sf_dir, "airport_points")
    i = c("poly_id")
    zone = lambda keep, **p: z.filter(keep).select("seq", props(**p).alias("props"), "parts")
    deposit = {"Confidence": c("confidence"), "velocity_max_mm_yr": c("velocity_max_mm_yr"), "is_active": c("is_active")}
    at = lambda df, seq, **p: df.select(c(seq).alias("seq"), props(**p).alias("props"), "lat", "lon")
    tiles = kept(R.to_array(fixture(spark, sf_dir, "raster_pixels").select("tile_id", c("prow").alias("row"), c("pcol").alias("col"), "value"), N, N))
    raster = lambda f: tiles.select((34 + c("tile_id") * F.lit(0.1)).alias("south"), F.lit(-118.5).alias("west"), F.lit(N).alias("rows"), F.lit(N).alias("cols"), F.transform("data", f).alias("data"))
    line = c("line_id")
    return {
        "flood_zones": zone("true", FLD_ZONE=c("fld_zone")),
        "fire_zones": zone("poly_id % 2 = 0", hazard_class=c("raw_hazard")),
        "tsunami": zone("poly_id % 3 = 0"  , FLD_ZONE=c("fld_zone")),
        "liquefaction": zone("poly_id % 2 = 1", none=i),
        "landslide": zone("poly_id % 5 < 3", none=i),
        "dam_inundation": zone("poly_id % 7 < 3", DAMNAME=F.concat(F.lit("dam "), (i % 9).cast("string"))),
        "soils": zone("poly_id % 4 > 0", lep_class=F.when(i % 3 > 0, F.concat(F.lit("class "), (i % 3).cast("string")))),
        "slr": zone("true", increment_ft=c("increment_ft")),
        "enviroscreen": zone("poly_id % 3 > 0", overall_percentile=c("overall_percentile"), tract=i),
        "landslide_inventory": zone("poly_id % 4 <> 1", **deposit),
        "landslide_supplemental": zone("poly_id % 4 = 1", **deposit),
        "faults": l.select("seq", props(fault_name=c("fault_name"), fault_type=c("raw_type"), ucerf3_prob=F.when(line % 6 == 0, line % 40), length_km=F.when(line % 4 == 1, line % 90 + 1), slip_rate=F.when(line % 3 == 0, line % 10)).alias("props"), "parts"),
        "traffic": l.filter("line_id % 2 = 0").select("seq", props(AHEAD_AADT=c("ahead_aadt")).alias("props"), "parts"),
        "airports": at(points, "feature_id", airport_id=c("airport_id"), annual_piston_ops=c("annual_piston_ops")),
        "erosion": at(points, "feature_id", erosion_rate_m_yr=c("erosion_rate_m_yr")),
        "contamination": at(fixture(spark, sf_dir, "contamination_points"), "feature_id", site_name=c("raw_type"), status=c("raw_status"), source=c("source")),
        "elevation": raster(lambda v: v / 10 - 100),
        "vs30": raster(lambda v: 200 + v),
        "fire_risk": raster(lambda v: v),
        "landslide_susc": raster(lambda v: F.floor(v) % 90),
        "insar_velocity": raster(lambda v: v / 100 - 3),
    }


def whole(spark, sf_dir) -> DataFrame:
    return Y.report(sites(spark, sf_dir), site_layers(spark, sf_dir))


# The same from the derived tables, a statement a layer.
SITES = ctes("raster_sites", "near_point_sites", "near_line_sites").removeprefix("WITH ") + ", plain AS (" + ctes("sites").removeprefix("WITH sites AS (") + ", sites AS (SELECT site_id, lat, lon FROM plain UNION ALL SELECT site_id + 1000000, lat, lon FROM raster_sites UNION ALL SELECT site_id + 2000000, lat, lon FROM near_point_sites)"
BASE = INSIDE.replace(ctes("sites"), "WITH " + SITES).replace("WITH " + SITES, "WITH " + ctes("line_vertices", "line_attrs", "airport_points", "contamination_points", "raster_pixels", "hazard_curves").removeprefix("WITH ") + ", " + SITES, 1)
FIRST = lambda keep: f"(SELECT i.site_id, arg_min(z.poly_id, z.seq) AS poly_id FROM inside i JOIN zone_attrs z USING (poly_id) WHERE {keep} GROUP BY i.site_id)"
LINES = BASE + NEAR_LINES[NEAR_LINES.index(",\nseg AS"):].replace("near_line_sites", "sites")
SHORE = lambda km, keep="true": f"(SELECT * FROM (SELECT s.site_id, p.feature_id, {hav('s.lat', 's.lon', 'p.lat', 'p.lon')} AS km, row_number() OVER (PARTITION BY s.site_id ORDER BY {hav('s.lat', 's.lon', 'p.lat', 'p.lon')}, p.feature_id) AS rn FROM sites s JOIN airport_points p ON abs(s.lat - p.lat) < 0.6 AND abs(s.lon - p.lon) < 0.8) WHERE km <= {km} AND {keep})"
PIXEL = """,
pos AS (SELECT site_id, lat, CAST(floor(lat / 0.1::DOUBLE) AS BIGINT) - 340 AS tile_id, lat - 34 AS up, (lon + 118.5::DOUBLE) / 0.1::DOUBLE * 39 AS cf FROM sites WHERE lat >= 34 AND lat < 34.4 AND lon >= -118.5 AND lon < -118.4),
spot AS (SELECT *, (up - tile_id * 0.1::DOUBLE) / 0.1::DOUBLE * 39 AS rf FROM pos),
near AS (SELECT *, least(greatest(floor(rf + 0.5), 0), 39) AS r, least(greatest(floor(cf + 0.5), 0), 39) AS k FROM spot),
val AS (SELECT n.site_id, n.lat, p.value AS v, e.value AS e, w.value AS w, u.value AS u, d.value AS d FROM near n LEFT JOIN raster_pixels p ON p.tile_id = n.tile_id AND p.prow = n.r AND p.pcol = n.k LEFT JOIN raster_pixels e ON e.tile_id = n.tile_id AND e.prow = n.r AND e.pcol = n.k + 1
 LEFT JOIN raster_pixels w ON w.tile_id = n.tile_id AND w.prow = n.r AND w.pcol = n.k - 1 LEFT JOIN raster_pixels u ON u.tile_id = n.tile_id AND u.prow = n.r + 1 AND u.pcol = n.k LEFT JOIN raster_pixels d ON d.tile_id = n.tile_id AND d.prow = n.r - 1 AND d.pcol = n.k),
grad AS (SELECT site_id, v, (coalesce(e, v) - coalesce(w, v)) / 10 / (2 * 0.1::DOUBLE / 40 * 111000 * cos(radians(lat))) AS dx, (coalesce(u, v) - coalesce(d, v)) / 10 / (2 * 0.1::DOUBLE / 40 * 111000) AS dy FROM val),
bil AS (SELECT s.site_id, round(sum(p.value * w) / nullif(sum(w), 0), 6) AS b FROM (SELECT site_id, tile_id, least(floor(rf) + i, 39) AS r, least(floor(cf) + j, 39) AS k, (CASE i WHEN 1 THEN rf - floor(rf) ELSE 1 - rf + floor(rf) END) * (CASE j WHEN 1 THEN cf - floor(cf) ELSE 1 - cf + floor(cf) END) AS w FROM spot, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)) s JOIN raster_pixels p ON p.tile_id = s.tile_id AND p.prow = s.r AND p.pcol = s.k GROUP BY s.site_id)
"""


@query(
    "h21_layers_zones",
    BASE
    + f"""SELECT s.site_id, CASE WHEN z.fld_zone IN ('V', 'VE') THEN 'V/VE' WHEN z.fld_zone IN ('AH', 'AO', 'A') THEN 'A' WHEN z.fld_zone IN ('AE', 'D', 'X') THEN z.fld_zone ELSE 'None' END AS flood, coalesce(fz.raw_hazard, 'None') AS fire, t.poly_id IS NOT NULL AS tsunami, q.poly_id IS NOT NULL AS liquefaction, l.poly_id IS NOT NULL AS landslide,
coalesce(dams, '') AS dams, CASE WHEN so.poly_id % 3 > 0 THEN concat('class ', CAST(so.poly_id % 3 AS VARCHAR)) ELSE 'Unknown' END AS soil, coalesce(slr, '') AS inundated, ez.overall_percentile AS percentile, CAST(ez.poly_id AS VARCHAR) AS tract
FROM sites s LEFT JOIN first_hit f USING (site_id) LEFT JOIN zone_attrs z USING (poly_id) LEFT JOIN {FIRST('z.poly_id % 2 = 0')} fi ON fi.site_id = s.site_id LEFT JOIN zone_attrs fz ON fz.poly_id = fi.poly_id LEFT JOIN {FIRST('z.poly_id % 3 = 0')} t ON t.site_id = s.site_id LEFT JOIN {FIRST('z.poly_id % 2 = 1')} q ON q.site_id = s.site_id
LEFT JOIN {FIRST('z.poly_id % 5 < 3')} l ON l.site_id = s.site_id LEFT JOIN {FIRST('z.poly_id % 4 > 0')} so ON so.site_id = s.site_id LEFT JOIN {FIRST('z.poly_id % 3 > 0')} en ON en.site_id = s.site_id LEFT JOIN zone_attrs ez ON ez.poly_id = en.poly_id
LEFT JOIN (SELECT site_id, string_agg(name, ',' ORDER BY seq) AS dams FROM (SELECT site_id, concat('dam ', CAST(poly_id % 9 AS VARCHAR)) AS name, min(poly_id) AS seq FROM inside WHERE poly_id % 7 < 3 GROUP BY 1, 2) GROUP BY site_id) dn ON dn.site_id = s.site_id
LEFT JOIN (SELECT site_id, string_agg(CAST(ft AS VARCHAR), ',' ORDER BY ft) AS slr FROM (SELECT DISTINCT site_id, increment_ft AS ft FROM inside JOIN zone_attrs USING (poly_id)) GROUP BY site_id) sl ON sl.site_id = s.site_id""",
)
def layers_zones(spark, sf_dir):
    z, e = c("zones"), c("enviroscreen")
    # -999 stands for missing in the derived layer
    return whole(spark, sf_dir).select(
        "site_id", z["fema_flood"].alias("flood"), z["fire_hazard"].alias("fire"), z["tsunami_inundation"].alias("tsunami"), z["liquefaction_zone"].alias("liquefaction"), z["landslide"].alias("landslide"), F.array_join(z["dam_inundation"]["dam_names"], ",").alias("dams"), z["expansive_soil"].alias("soil"),
        F.array_join(F.transform(c("sea_level_rise")["inundated_at"], lambda x: x.cast("int").cast("string")), ",").alias("inundated"), e["overall_percentile"].alias("percentile"), e["tract"].alias("tract"),
    )


NAMED = "CASE WHEN a.fault_name = '' THEN 'Unknown' ELSE a.fault_name END"


@query(
    "h21_layers_faults",
    LINES
    + PIXEL
    + f""", args AS (SELECT d.site_id, a.seq, {NAMED} AS name, a.raw_type AS type, distance_km AS d, CASE WHEN a.line_id % 6 = 0 THEN CAST(a.line_id % 40 AS DOUBLE) END AS ucerf, CASE WHEN a.line_id % 4 = 1 THEN CAST(a.line_id % 90 AS DOUBLE) + 1 END AS len_km, coalesce(200 + b, 760) AS vs30, row_number() OVER (PARTITION BY d.site_id, {NAMED} ORDER BY floor(distance_km * 100 + 0.5), a.seq) AS rn FROM dist d JOIN line_attrs a USING (line_id) LEFT JOIN bil ON bil.site_id = d.site_id WHERE distance_km <= 50),
mags AS (SELECT *, CASE WHEN ucerf IS NOT NULL THEN 6.7 WHEN len_km > 0 THEN least(greatest(5.16 + 1.12 * log10(len_km), 5.0), 8.5) ELSE 6.0 END AS mag FROM args WHERE rn = 1), pgas AS (SELECT *, {PGA} AS pga FROM mags)
SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY floor(d * 100 + 0.5), seq) AS place, name, type, floor(d * 100 + 0.5) / 100 AS distance_km, ucerf / 100 AS ucerf3_prob, floor(({MMI.format(p='pga')}) * 10 + 0.5) / 10 AS mmi, round({FRAG.format(m='(' + MMI.format(p='pga') + ')')}, 5) AS damage FROM pgas""",
)
def layers_faults(spark, sf_dir):
    f = whole(spark, sf_dir).select("site_id", F.posexplode("faults").alias("k", "f"))
    return f.select("site_id", (c("k") + 1).cast("long").alias("place"), "f.name", "f.type", "f.distance_km", "f.ucerf3_prob", c("f.expected_mmi").alias("mmi"), F.round("f.damage_prob", 5).alias("damage"))


@query(
    "h21_layers_near",
    LINES
    + f""", air AS (SELECT site_id, arg_min(airport_id, rn) AS code, floor(arg_min(km, rn) * 100 + 0.5) / 100 AS km FROM {SHORE(50)} n JOIN airport_points USING (feature_id) WHERE rn <= 10 AND annual_piston_ops > 0 GROUP BY site_id),
road AS (SELECT site_id, floor(distance_km * 1000 + 0.5) AS m, distance_km * 1000 AS raw, coalesce(try_cast(ahead_aadt AS BIGINT), 0) AS aadt FROM (SELECT d.*, row_number() OVER (PARTITION BY site_id ORDER BY distance_km, line_id) AS rn FROM dist d WHERE distance_km <= 20 AND line_id % 2 = 0) JOIN line_attrs USING (line_id) WHERE rn = 1),
con AS (SELECT s.site_id, count(*) FILTER (km <= 0.5) AS near, count(*) AS half, arg_min(coalesce(raw_type, 'Unknown'), (km, feature_id)) AS first FROM (SELECT s.site_id, p.feature_id, p.raw_type, {hav('s.lat', 's.lon', 'p.lat', 'p.lon')} AS km FROM sites s JOIN contamination_points p ON abs(s.lat - p.lat) < 0.02 AND abs(s.lon - p.lon) < 0.02) s WHERE km <= 0.8047 GROUP BY s.site_id)
SELECT s.site_id, air.code, air.km, CASE WHEN air.km < 0.5 THEN 'High' WHEN air.km < 1 THEN 'Moderate' WHEN air.km < 2 THEN 'Elevated' ELSE 'Low' END AS lead, road.m AS road_m, road.aadt, CASE WHEN raw < 100 AND aadt > 100000 THEN 'Severe' WHEN raw < 200 AND aadt > 20000 THEN 'Elevated' ELSE 'Low' END AS traffic, coalesce(con.near, 0) AS within_500m, coalesce(con.half, 0) AS within_half_mile, con.first AS nearest_name
FROM sites s LEFT JOIN air USING (site_id) LEFT JOIN road USING (site_id) LEFT JOIN con USING (site_id)""",
)
def layers_near(spark, sf_dir):
    a, t, k = c("aviation_lead"), c("traffic_pollution"), c("contamination")
    return whole(spark, sf_dir).select(
        "site_id", a["nearest_airport"]["code"].alias("code"), a["nearest_airport"]["distance_km"].alias("km"), a["risk_level"].alias("lead"), t["nearest_major_road"]["distance_m"].alias("road_m"), t["nearest_major_road"]["aadt"].alias("aadt"), t["risk_level"].alias("traffic"),
        F.size(k["sites_within_500m"]).cast("long").alias("within_500m"), F.size(k["sites_within_half_mile"]).cast("long").alias("within_half_mile"), F.get(k["sites_within_half_mile"], F.lit(0))["name"].alias("nearest_name"),
    )


@query("h21_layers_rasters", BASE + PIXEL + "SELECT s.site_id, floor(coalesce(v / 10 - 100, 0) * 10 + 0.5) / 10 AS elevation_m, floor(coalesce(degrees(atan(sqrt(dx * dx + dy * dy))), 0) * 10 + 0.5) / 10 AS slope_deg, floor(coalesce(200 + b, 760) + 0.5) AS vs30 FROM sites s LEFT JOIN grad USING (site_id) LEFT JOIN bil USING (site_id)")
def layers_rasters(spark, sf_dir):
    return whole(spark, sf_dir).select("site_id", "elevation_m", "slope_deg", "vs30")


@query(
    "h21_layers_structural",
    BASE
    + PIXEL
    + f""", bins AS (SELECT user_id, i, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM hazard_curves WINDOW w AS (PARTITION BY user_id ORDER BY i)),
mids AS (SELECT *, CASE WHEN x1 IS NULL THEN {MMI.format(p='x')} ELSE {MMI.format(p='((x + x1) / 2)')} END AS mmi FROM bins),
shaking AS (SELECT user_id, sum(greatest(CASE WHEN x1 IS NULL THEN y ELSE y - y1 END, 0) * ({FRAG.format(m='mmi')})) AS shake FROM mids GROUP BY user_id),
ex AS (SELECT user_id, arg_min(y + (0.1::DOUBLE - x) / (x1 - x) * (y1 - y), i) AS p01 FROM bins WHERE x <= 0.1 AND x1 >= 0.1 GROUP BY user_id),
a AS (SELECT s.site_id, t.poly_id, dz.poly_id IS NOT NULL AS dep, dz.confidence AS conf, CASE WHEN dz.poly_id % 4 = 1 AND dz.is_active THEN coalesce(dz.velocity_max_mm_yr, 999) ELSE coalesce(dz.velocity_max_mm_yr, abs(b / 100 - 3)) END AS v, l.poly_id IS NOT NULL AS zone, CAST(coalesce(floor(px.v) % 90, 0) AS INT) AS n10, CAST(s.site_id % 7 AS DOUBLE) / 10000 AS tract, coalesce(px.v / 10000, 0) AS fire,
 px.v / 10 - 100 AS e, coalesce(h.km, 10) AS coast, h.km, hp.erosion_rate_m_yr AS rate, coalesce(lower(trim(fz.raw_hazard)) IN ('very high', 'vhigh', '2'), false) AS high, z.fld_zone, shake, CASE WHEN q.poly_id IS NOT NULL THEN coalesce(p01, 0) * 0.12::DOUBLE ELSE 0 END AS liq, dam.poly_id IS NOT NULL AS in_dam
 FROM sites s LEFT JOIN first_hit f USING (site_id) LEFT JOIN zone_attrs z USING (poly_id) LEFT JOIN {FIRST('z.poly_id % 3 = 0')} t ON t.site_id = s.site_id LEFT JOIN {FIRST('z.poly_id % 2 = 1')} q ON q.site_id = s.site_id LEFT JOIN {FIRST('z.poly_id % 5 < 3')} l ON l.site_id = s.site_id LEFT JOIN {FIRST('z.poly_id % 7 < 3')} dam ON dam.site_id = s.site_id
 LEFT JOIN {FIRST('z.poly_id % 2 = 0')} fi ON fi.site_id = s.site_id LEFT JOIN zone_attrs fz ON fz.poly_id = fi.poly_id LEFT JOIN {FIRST('z.poly_id % 4 = 1')} sup ON sup.site_id = s.site_id LEFT JOIN {FIRST('z.poly_id % 4 <> 1')} inv ON inv.site_id = s.site_id LEFT JOIN zone_attrs dz ON dz.poly_id = coalesce(sup.poly_id, inv.poly_id)
 LEFT JOIN {SHORE(10, 'rn = 1')} h ON h.site_id = s.site_id LEFT JOIN airport_points hp ON hp.feature_id = h.feature_id LEFT JOIN shaking k ON k.user_id = s.site_id LEFT JOIN ex ON ex.user_id = s.site_id LEFT JOIN val px ON px.site_id = s.site_id LEFT JOIN bil ON bil.site_id = s.site_id),
tt AS (SELECT *, CASE WHEN v > 3.5 THEN 1 WHEN dep AND coalesce(conf, 0) >= 3 THEN 2 WHEN zone AND n10 > 0 THEN 3 ELSE 4 END AS tier, km * 1000 AS m FROM a),
r AS (SELECT site_id, tier, coalesce(1 - (1 - shake) * (1 - liq), 0) AS earthquake, coalesce(1 - (1 - 0.3::DOUBLE * shake) * (1 - liq), 0) AS fitted, CASE WHEN fire > 0 THEN 1 - pow(1 - fire, 1.0::DOUBLE / 30) ELSE 0 END AS wildfire, high AND fire < 0.05 AS low, CASE WHEN fld_zone IN ('V', 'VE') THEN 0.006::DOUBLE WHEN fld_zone IN ('AE', 'A', 'AH', 'AO') THEN 0.004 WHEN fld_zone = 'D' THEN 0.0015 WHEN fld_zone = 'X' THEN 0.00002 ELSE 0.000005 END AS flood,
 {TSUNAMI.replace('f.poly_id', 'poly_id')} AS tsunami, CASE tier WHEN 1 THEN 0.023 WHEN 2 THEN 0.00277 WHEN 3 THEN ({N10})[least(n10, 81) + 1] ELSE tract END::DOUBLE AS landslide, CASE WHEN in_dam THEN 0.00009 ELSE 0 END::DOUBLE AS dam,
 CASE WHEN km <= 2 AND rate < 0 THEN CASE WHEN m < 50 THEN 0.02::DOUBLE * (-rate / 0.5) WHEN m < 200 THEN 0.005::DOUBLE * (-rate / 0.5) * (200 - m) / 150 ELSE 1 / (1 + exp(0.05::DOUBLE * (m / -rate - 100))) END ELSE 0 END AS erosion FROM tt)
SELECT site_id, CAST(tier AS BIGINT) AS tier, low, round(earthquake, 9) AS earthquake, round(wildfire, 9) AS wildfire, round(flood, 9) AS flood, round(tsunami, 9) AS tsunami, round(landslide, 9) AS landslide, round(dam, 9) AS dam, round(erosion, 9) AS erosion, round(1 - pow((1 - earthquake) * {CLIPPED}, 30), 6) AS combined, round(1 - pow((1 - fitted) * {CLIPPED}, 30), 6) AS combined_retrofitted FROM r""",
)
def layers_structural(spark, sf_dir):
    s = c("structural")
    names = ["earthquake", "wildfire", "flood", "tsunami", "landslide", "dam", "erosion"]
    return whole(spark, sf_dir).select("site_id", s["landslide_tier"].cast("long").alias("tier"), s["wildfire_low"].alias("low"), *[F.round(s[n]["annual_p"], 9).alias(n) for n in names], r6(s["combined_30yr"]).alias("combined"), r6(s["combined_30yr_retrofitted"]).alias("combined_retrofitted"))
