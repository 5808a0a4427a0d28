"""The whole site report from layers: one table of all layers by block, met by the places of the sites once.

Sites at one place meet the same, so places are searched and reported, and sites join what their place found. Zones,
edges and points become rows of one table, each copied to the half degree blocks where they can matter to a place: a zone
to the blocks of its box, an edge or a point to those within the layer's reach. A block's places meet its features in
one task, in numpy, and only what the report takes of each layer and name leaves it (the first zone, the nearest edge of a
fault). Raster tiles are joined by their own 0.1 degree cell. One aggregate lays a place's items side by side; the number
of shuffles doesn't depend on the number of layers.

Layers, all optional: zones (seq, props map<string,string>, parts), lines (the same), points (seq, props, lat, lon) and
rasters (south, west, rows, cols, data: dense from the south, NULL where missing). Ties go to the smaller seq.
Sites: site_id, lat, lon, tract_rate (NULL: 0), xs and ys (hazard curve; NULL: no earthquake term). A site in no layer is
reported with defaults; a layer that isn't given counts as empty; rows of sites that differ in a column are reported one
by one, equal rows once; an empty table of sites gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrarisk.functions import geometry as G
from terrarisk.functions import hazard as H
from terrarisk.functions import text as T
from terrarisk.operators import near as N
from terrarisk.operators import report as Y
from terrarisk.operators import spatial as S

#: Degrees of a raster tile, and of a block in which places meet the other layers.
CELL, BLOCK = 0.1, 0.5
ZONES = ("flood_zones", "fire_zones", "tsunami", "liquefaction", "landslide", "dam_inundation", "soils", "slr", "enviroscreen", "landslide_inventory", "landslide_supplemental")
#: Kilometres within which a feature counts.
LINES = {"faults": 50.0, "traffic": 20.0}
POINTS = {"airports": 50.0, "erosion": 10.0, "contamination": 0.8047}
RASTERS = ("elevation", "vs30", "fire_risk", "landslide_susc", "insar_velocity")
NEAREST_AIRPORTS = 10

_ROW = f"layer string, name string, seq long, props map<string,string>, parts {G.GEOMETRY}, ax double, ay double, bx double, by double, ci long, cj long"
_FOUND = "lat double, lon double, layer string, name string, seq long, d double, props map<string,string>"


def _name(layer: str) -> Column:
    """Of a layer's features with equal names the report takes one."""
    p = lambda *keys: T.first_text(*[F.col("props")[k] for k in keys], default="Unknown")
    if layer == "faults":
        return p("fault_name", "name")
    if layer == "dam_inundation":
        return p("dam_name", "DAMNAME", "name")
    if layer == "slr":
        return F.col("props")["increment_ft"]
    return F.col("seq").cast("string") if layer in ("airports", "contamination") else F.lit("")


def _rows(layer: DataFrame, name: str) -> DataFrame:
    """A layer in the common form; columns that it hasn't are NULL."""
    have = layer.withColumns({"layer": F.lit(name), "name": _name(name)})
    pairs = [part.split(" ", 1) for part in _ROW.split(", ")]
    return have.selectExpr(*[f"CAST({c if c in have.columns else 'NULL'} AS {type_}) AS {c}" for c, type_ in pairs])


def _edge_rows(name: str, edges: DataFrame, reach: float) -> DataFrame:
    return _rows(S.grown(edges, F.least("ay", "by"), F.greatest("ay", "by"), F.least("ax", "bx"), F.greatest("ax", "bx"), reach, cell=BLOCK)[0], name)


def layer_cells(layers: dict[str, DataFrame]) -> DataFrame | None:
    """All layers but rasters as rows of one table, by block; None if there are none."""
    unknown = set(layers) - {*ZONES, *LINES, *POINTS, *RASTERS}
    if unknown:
        raise ValueError(f"not a layer: {sorted(unknown)}")
    out = []
    for name, layer in layers.items():
        if name in ZONES:
            out.append(_rows(S.cover_cells(layer.select("seq", "props", "parts"), BLOCK, 1e-9), name))
        elif name in LINES:
            out.append(_edge_rows(name, layer.select("seq", "props", F.explode(G.all_edges(F.col("parts"))).alias("e")).selectExpr("seq", "props", "e.a.x AS ax", "e.a.y AS ay", "e.b.x AS bx", "e.b.y AS by"), LINES[name]))
        elif name in POINTS:
            out.append(_edge_rows(name, layer.selectExpr("seq", "props", "lon AS ax", "lat AS ay", "lon AS bx", "lat AS by"), POINTS[name]))
    return reduce(DataFrame.unionByName, out) if out else None


def _find(places: pa.Table, table: pa.Table) -> pa.Table:
    """The features of a block that its places take, a row each, and a row without a layer for each place."""
    lat, lon = N.numbers(places.column("lat")), N.numbers(places.column("lon"))
    seq, code, of = N.whole(table.column("seq")), N.codes(table.column("name")), table.column("layer").to_numpy()
    ax, ay, bx, by = (N.numbers(table.column(c)) for c in ("ax", "ay", "bx", "by"))
    at, rows, km = [np.arange(len(lat))], [np.full(len(lat), -1)], [np.full(len(lat), np.nan)]
    for layer in dict.fromkeys(of):
        mine = np.flatnonzero(of == layer)
        edges = [v[mine] for v in (ax, ay, bx, by, seq, code)]
        if layer in ZONES:
            p, e = N.first_zones(lat, lon, table.column("parts").take(pa.array(mine)).combine_chunks(), seq[mine], code[mine])
            d = np.full(len(p), np.nan)
        elif layer == "contamination":
            p, e, d = N.within(lat, lon, ay[mine], ax[mine], seq[mine], POINTS[layer])
        else:
            # faults go by the distance that is reported, so that equally far segments of a name are taken by seq
            p, e, d = N.nearest(lat, lon, *edges, (LINES | POINTS)[layer], NEAREST_AIRPORTS if layer == "airports" else None, layer == "faults")
        at.append(p)
        rows.append(mine[e])
        km.append(d)
    at, rows, km = (np.concatenate(v) for v in (at, rows, km))
    taken = pa.array(rows, mask=rows < 0)
    return pa.table({**{c: places.column(c).take(pa.array(at)) for c in ("lat", "lon")}, **{c: table.column(c).take(taken) for c in ("layer", "name", "seq")}, "d": pa.array(km, mask=np.isnan(km)), "props": table.column("props").take(taken)})


def _pixel(r: Column, k: Column) -> Column:
    """A pixel of the tile, NULL beyond its border or where missing."""
    there = (r >= 0) & (r < F.col("rows")) & (k >= 0) & (k < F.col("cols"))
    return F.when(there, F.get("data", (r * F.col("cols") + k).cast("int")))


def _samples() -> Column:
    """[nearest pixel, bilinear value, slope in degrees] of a site in a tile."""
    rf = (F.col("lat") - F.col("south")) / F.lit(CELL) * (F.col("rows") - 1)
    kf = (F.col("lon") - F.col("west")) / F.lit(CELL) * (F.col("cols") - 1)
    r, k = (F.least(F.greatest(F.floor(v + 0.5), F.lit(0)), F.col(n) - 1) for v, n in ((rf, "rows"), (kf, "cols")))
    r0, k0 = F.floor(rf), F.floor(kf)
    corner = lambda i, j: (_pixel(F.least(r0 + i, F.col("rows") - 1), F.least(k0 + j, F.col("cols") - 1)), (rf - r0 if i else 1 - (rf - r0)) * (kf - k0 if j else 1 - (kf - k0)))
    four = [corner(i, j) for i in (0, 1) for j in (0, 1)]
    weighted = reduce(Column.__add__, [F.coalesce(v * w, F.lit(0.0)) for v, w in four])
    weight = reduce(Column.__add__, [F.when(v.isNotNull(), w).otherwise(0.0) for v, w in four])
    own = _pixel(r, k)
    near = lambda i, j: F.coalesce(_pixel(r + i, k + j), own)
    y, x = F.lit(CELL) / F.col("rows") * 111000, F.lit(CELL) / F.col("cols") * 111000 * F.cos(F.radians("lat"))
    dx, dy = (near(0, 1) - near(0, -1)) / (2 * x), (near(1, 0) - near(-1, 0)) / (2 * y)
    return F.array(own, F.try_divide(weighted, weight), F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))))


def meet(sites: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """lat, lon, layer and `item` (seq, name, d in km, props, v: samples): of each layer and name the first zone or nearest
    feature of each place of the sites, all points near it, and the tiles that hold it. Each place has also a row without
    a layer."""
    places = sites.select("lat", "lon").distinct()
    table = layer_cells(layers)
    found = [places.withColumns({c: F.lit(None).cast(t) for c, t in (f.split(" ", 1) for f in _FOUND.split(", ")) if c not in ("lat", "lon")}) if table is None else S.blocks(S.in_cells(places, BLOCK), table, _find, _FOUND)]
    index = lambda c: F.floor((F.col(c) + CELL / 2) / F.lit(CELL)).cast("long")
    tiles = [layer.filter("size(data) = rows * cols").select(F.lit(name).alias("layer"), "south", "west", "rows", "cols", "data", index("south").alias("ci"), index("west").alias("cj")) for name, layer in layers.items() if name in RASTERS]
    if tiles:
        held = F.expr(f"lat >= south AND lat <= south + {2 * CELL}D AND lon >= west AND lon <= west + {2 * CELL}D")
        met = S.in_cells(places, CELL).join(reduce(DataFrame.unionByName, tiles), ["ci", "cj"]).filter(held)
        found.append(met.select("lat", "lon", "layer", F.lit("").alias("name"), F.lit(0).cast("long").alias("seq"), _samples().alias("v")))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    v = F.col("v") if tiles else F.lit(None).cast("array<double>")
    return every.select("lat", "lon", "layer", F.when(F.col("layer").isNotNull(), F.struct("seq", "name", "d", "props", v.alias("v"))).alias("item"))


def _number(item: str, *keys: str) -> Column:
    return T.first_number(*[F.col(item)["props"][k] for k in keys])


def _text(item: str, *keys: str, default: str) -> Column:
    return T.first_text(*[F.col(item)["props"][k] for k in keys], default=default)


def _faults() -> Column:
    """Each step is a transform of its own, so that the motion is computed once a fault."""

    def motion(f: Column) -> Column:
        p = f["props"]
        ucerf = T.first_number(p["ucerf3_30yr_m67_prob_pct"], p["ucerf3_prob"])
        pga = H.ground_motion(H.magnitude(ucerf, T.number(p["length_km"])), f["d"], F.col("vs30_used"))
        about = F.struct(H.half_up(f["d"], 2).alias("distance_km"), f["seq"].alias("seq"), f["name"].alias("name"), T.first_text(p["fault_type"], p["type"], default="Unknown").alias("type"), T.first_number(p["slip_rate_mm_yr"], p["slip_rate"]).alias("slip"))
        return F.struct(about.alias("about"), ucerf.alias("ucerf"), pga.alias("pga"))

    shaken = F.transform(F.transform("faults", motion), lambda f: F.struct(f["about"].alias("about"), f["ucerf"].alias("ucerf"), H.pga_to_mmi(f["pga"]).alias("mmi")))
    done = lambda f: F.struct(
        *[f["about"][n].alias(n) for n in ("distance_km", "seq", "name", "type")], f["about"]["slip"].alias("slip_rate_mm_yr"), (f["ucerf"] / 100).alias("ucerf3_prob"), H.half_up(f["mmi"], 1).alias("expected_mmi"),
        H.fault_rate(f["ucerf"], f["about"]["slip"]).alias("annual_rate"), H.fragility(f["mmi"]).alias("damage_prob"),
    )
    return F.array_sort(F.transform(shaken, done))


def _by_distance(items: str) -> Column:
    """Items sorted by distance, then seq."""
    keyed = F.transform(items, lambda f: F.struct(f["d"].alias("d"), f["seq"].alias("seq"), F.to_json(f["props"]).alias("p")))  # maps can't be compared
    return F.transform(F.array_sort(keyed), lambda f: F.struct(f["d"].alias("d"), f["seq"].alias("seq"), F.from_json(f["p"], "map<string,string>").alias("props")))


def _contaminated(km: float) -> Column:
    def one(f: Column) -> Column:
        p = f["props"]
        return F.struct(H.half_up(f["d"] * 1000).alias("distance_m"), T.first_text(p["site_name"], p["BUSINESS_NAME"], p["name"], default="Unknown").alias("name"), T.first_text(p["site_type"], p["type"], default="Unknown").alias("type"), T.first_text(p["status"], p["cleanup_status"], default="Unknown").alias("status"), T.first_text(p["source"], default="unknown").alias("source"))

    return F.transform(F.filter("contamination_near", lambda f: f["d"] <= km), one)


#: What the structural hazards of a site take from its place.
_OF_PLACE = ("liquefaction_zone", "fire_p30", "fire_zone", "fld_zone", "in_tsunami", "elevation", "coast_km", "deposit", "confidence", "velocity", "slide_zone", "n10", "in_dam", "shore_km", "shore_rate")


def report(sites: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """site_id, lat, lon and the report's parts as nested columns: elevation_m, slope_deg, vs30, faults, zones,
    sea_level_rise, structural, enviroscreen, aviation_lead, traffic_pollution, contamination."""
    exceeded = H.exceedance_at(F.col("xs"), F.col("ys"))
    scored = sites.select(
        "site_id", "lat", "lon", F.coalesce(F.col("tract_rate").cast("double"), F.lit(0.0)).alias("tract_rate"), *[F.when(F.col("xs").isNotNull(), H.integrate_curve(F.col("xs"), F.col("ys"), fitted)).alias(n) for fitted, n in ((False, "shaking"), (True, "shaking_fitted"))],
        F.when(F.col("xs").isNotNull(), exceeded).alias("exceeded"),
    )
    scored = scored.distinct()
    one = lambda layer: F.first(F.when(F.col("layer") == layer, F.col("item")), ignorenulls=True).alias(layer)
    many = lambda layer: F.collect_list(F.when(F.col("layer") == layer, F.col("item"))).alias(layer)
    listed = ("faults", "dam_inundation", "slr", "airports", "contamination")
    wide = meet(scored, layers).groupBy("lat", "lon").agg(*[many(n) if n in listed else one(n) for n in (*ZONES, *LINES, *POINTS, *RASTERS)])
    has = lambda n: F.col(n).isNotNull()
    feature = F.coalesce("landslide_supplemental", "landslide_inventory")
    wide = wide.withColumns({"deposit_item": feature, "elevation": F.col("elevation")["v"][0], "slope": F.col("elevation")["v"][2], "vs30_used": F.coalesce(F.round(F.col("vs30")["v"][1], 6), F.lit(760.0)), "airports_near": F.slice(_by_distance("airports"), 1, NEAREST_AIRPORTS), "contamination_near": _by_distance("contamination")})
    mapped = _number("deposit_item", "velocity_max_mm_yr")
    active = has("landslide_supplemental") & (F.col("landslide_supplemental")["props"]["is_active"] == "true")
    ops = lambda f: F.coalesce(T.number(f["props"]["annual_piston_ops"]), F.lit(0.0)) > 0
    wide = wide.withColumns(
        {
            "liquefaction_zone": has("liquefaction"), "fire_p30": F.coalesce(F.col("fire_risk")["v"][0] / 10000, F.lit(0.0)), "fire_zone": H.lookup(F.lower(F.trim(_text("fire_zones", "hazard_class", "FHSZ_Description", default=""))), T.HAZARD_CLASSES), "fld_zone": F.col("flood_zones")["props"]["FLD_ZONE"],
            "in_tsunami": has("tsunami"), "coast_km": F.coalesce(F.col("erosion")["d"], F.lit(10.0)), "deposit": has("deposit_item"), "confidence": _number("deposit_item", "Confidence"), "velocity": F.when(F.coalesce(active, F.lit(False)), F.coalesce(mapped, F.lit(999.0))).otherwise(F.coalesce(mapped, F.abs(F.col("insar_velocity")["v"][1]))),
            "slide_zone": has("landslide"), "n10": F.coalesce(F.col("landslide_susc")["v"][0], F.lit(0.0)), "in_dam": F.size("dam_inundation") > 0, "shore_km": F.col("erosion")["d"], "shore_rate": _number("erosion", "erosion_rate_m_yr"), "lead": F.get(F.filter("airports_near", ops), F.lit(0)),
        }
    )
    feet = F.array_sort(F.transform("slr", lambda s: T.number(s["name"])))
    road_m, aadt = F.col("traffic")["d"] * 1000, F.coalesce(*[F.regexp_extract(F.col("traffic")["props"][k], r"^\s*(\d+)", 1).try_cast("long") for k in ("AHEAD_AADT", "BACK_AADT", "aadt")], F.lit(0))
    lead_km = H.half_up(F.col("lead.d"), 2)
    screen = {"overall_percentile": ("overall_percentile", "CIscoreP"), "pm25_pctl": ("pm25_pctl", "PM2_5_P"), "diesel_pm_pctl": ("diesel_pm_pctl", "Diesel_PM_P"), "traffic_pctl": ("traffic_pctl", "Traffic_P"), "poverty_pctl": ("poverty_pctl", "Poverty_P")}
    placed = wide.select(
        F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), H.half_up(F.coalesce("elevation", F.lit(0.0)), 1).alias("elevation_m"), H.half_up(F.coalesce("slope", F.lit(0.0)), 1).alias("slope_deg"), H.half_up(F.col("vs30_used")).alias("vs30"), _faults().alias("faults"),
        F.struct(
            "liquefaction_zone", F.col("slide_zone").alias("landslide"), F.coalesce(H.lookup(F.col("fld_zone"), H.FLOOD_GROUPS), F.lit("None")).alias("fema_flood"), F.when(has("fire_zones"), _text("fire_zones", "hazard_class", "FHSZ_Description", default="")).otherwise("None").alias("fire_hazard"), F.col("in_tsunami").alias("tsunami_inundation"),
            F.struct(F.col("in_dam").alias("in_zone"), F.transform(F.array_sort(F.transform("dam_inundation", lambda f: F.struct(f["seq"].alias("seq"), f["name"].alias("name")))), lambda f: f["name"]).alias("dam_names")).alias("dam_inundation"), _text("soils", "shrink_swell_class", "lep_class", default="Unknown").alias("expansive_soil"),
        ).alias("zones"),
        F.struct(F.get(feet, F.lit(0)).alias("lowest_threshold_ft"), feet.alias("inundated_at")).alias("sea_level_rise"),
        F.when(has("enviroscreen"), F.struct(*[_number("enviroscreen", *k).alias(n) for n, k in screen.items()], F.nullif(_text("enviroscreen", "tract", "Census_Tract", default=""), F.lit("")).alias("tract"))).alias("enviroscreen"),
        F.struct(F.when(has("lead"), F.struct(_text("lead", "airport_id", "ident", "code", default="").alias("code"), _text("lead", "airport_name", "name", default="").alias("name"), lead_km.alias("distance_km"), _number("lead", "annual_piston_ops").alias("piston_ops"))).alias("nearest_airport"), H.aviation_risk(lead_km).alias("risk_level")).alias("aviation_lead"),
        F.struct(F.when(has("traffic"), F.struct(H.half_up(road_m).alias("distance_m"), aadt.alias("aadt"))).alias("nearest_major_road"), H.traffic_risk(road_m, aadt).alias("risk_level")).alias("traffic_pollution"),
        F.struct(_contaminated(0.5).alias("sites_within_500m"), _contaminated(POINTS["contamination"]).alias("sites_within_half_mile")).alias("contamination"),
        *_OF_PLACE,
    )
    own = scored.join(placed, F.col("lat").eqNullSafe(F.col("_lat")) & F.col("lon").eqNullSafe(F.col("_lon")), "left")
    liquefied = H.liquefaction_annual(F.col("exceeded"), F.col("liquefaction_zone"))
    quake = lambda n: F.coalesce(1 - (1 - F.col(n)) * (1 - liquefied), F.lit(0.0))
    own = Y.other_hazards(own).withColumns({"earthquake": quake("shaking"), "earthquake_retrofitted": quake("shaking_fitted")})
    annual = lambda h: F.struct(F.col(h).alias("annual_p"), H.p_horizon(F.col(h)).alias("p30"))
    total = lambda q: H.combined_p30(F.array(q, *[h for h in Y.HAZARDS if h != "earthquake"]))
    structural = F.struct(*[annual(h).alias(h) for h in Y.HAZARDS], annual("earthquake_retrofitted").alias("earthquake_retrofitted"), "landslide_tier", F.col("velocity").alias("landslide_velocity"), "wildfire_low", total("earthquake").alias("combined_30yr"), total("earthquake_retrofitted").alias("combined_30yr_retrofitted")).alias("structural")
    return own.select("site_id", "lat", "lon", "elevation_m", "slope_deg", "vs30", "faults", "zones", "sea_level_rise", structural, "enviroscreen", "aviation_lead", "traffic_pollution", "contamination")
