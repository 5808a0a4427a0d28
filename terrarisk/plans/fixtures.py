"""Input tables derived from the test tables, as SQL that Spark and DuckDB both run; {name} stands for a test table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events", "nation")

SQL = {
    "sites": """
SELECT c_custkey AS site_id,
       CAST(32500 + (c_custkey * 7919) % 9500 AS DOUBLE) / 1000 AS lat,
       CAST(-124500 + (c_custkey * 104729) % 10500 AS DOUBLE) / 1000 AS lon,
       CAST(90000 + c_nationkey * 7 AS VARCHAR(5)) AS zip
FROM {customer}
""",
    "zone_vertices": """
SELECT s_suppkey AS poly_id, t.ring, t.n,
       CAST(-124200 + (s_suppkey * 7001) % 9900 AS DOUBLE) / 1000 + t.dx * CAST(200 + 50 * (s_suppkey % 7) AS DOUBLE) / 10000 AS x,
       CAST(32800 + (s_suppkey * 6007) % 9000 AS DOUBLE) / 1000 + t.dy * CAST(200 + 50 * (s_suppkey % 7) AS DOUBLE) / 10000 AS y
FROM {supplier} CROSS JOIN (VALUES (0,1,-10,-10),(0,2,10,-10),(0,3,10,0),(0,4,0,0),(0,5,0,10),(0,6,-10,10),(0,7,-10,-10),
       (1,1,-7,-7),(1,2,-3,-7),(1,3,-3,-3),(1,4,-7,-3),(1,5,-7,-7)) AS t(ring, n, dx, dy)
WHERE t.ring = 0 OR s_suppkey % 4 = 0
""",
    "zone_attrs": """
SELECT s_suppkey AS poly_id, s_suppkey AS seq,
       CASE s_suppkey % 8 WHEN 0 THEN 'V' WHEN 1 THEN 'VE' WHEN 2 THEN 'AE' WHEN 3 THEN 'AH' WHEN 4 THEN 'AO' WHEN 5 THEN 'D' WHEN 6 THEN 'X' ELSE 'OPEN WATER' END AS fld_zone,
       CASE s_suppkey % 6 WHEN 0 THEN 'very high' WHEN 1 THEN 'VHIGH' WHEN 2 THEN '2' WHEN 3 THEN 'mod' WHEN 4 THEN 'Moderate' ELSE 'n/a' END AS raw_hazard,
       CAST(s_suppkey % 13 AS DOUBLE) - 1 AS lep_pct,
       CASE s_suppkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 6 ELSE 10 END AS increment_ft,
       CAST(s_suppkey % 9 AS INT) AS confidence,
       CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey % 11 AS DOUBLE) END AS velocity_max_mm_yr,
       s_suppkey % 10 = 0 AS is_active,
       CASE WHEN s_suppkey % 5 = 0 THEN CAST(-999 AS DOUBLE) ELSE CAST((s_suppkey * 37) % 101 AS DOUBLE) END AS overall_percentile
FROM {supplier}
""",
    "line_vertices": """
SELECT p_partkey AS line_id, t.n,
       CAST(-124300 + (p_partkey * 9973) % 10200 + t.dx * (20 + p_size) AS DOUBLE) / 1000 AS x,
       CAST(32600 + (p_partkey * 8887) % 9300 + t.dy * (10 + p_size % 20) AS DOUBLE) / 1000 AS y
FROM {part} CROSS JOIN (VALUES (1,0,0),(2,3,2),(3,5,-1)) AS t(n, dx, dy)
""",
    "line_attrs": """
SELECT p_partkey AS line_id, p_partkey AS seq,
       CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 40 = 1 THEN 'Hayward fault zone' WHEN p_partkey % 40 = 2 THEN 'San Andreas fault zone'
            ELSE concat('Fault ', CAST(p_partkey % 40 AS VARCHAR(5))) END AS fault_name,
       CASE p_size % 4 WHEN 0 THEN 'Less than 0.2 mm/yr' WHEN 1 THEN 'Between 1 and 5 mm/yr' WHEN 2 THEN 'Greater than 5 mm/yr' ELSE '' END AS slip_rate_text,
       CASE p_size % 5 WHEN 0 THEN 'Right lateral' WHEN 1 THEN 'thrust' WHEN 2 THEN 'NORMAL' WHEN 3 THEN 'oblique' ELSE 'unspecified' END AS raw_type,
       CASE WHEN p_partkey % 9 = 0 THEN 'n/a' ELSE CAST((p_partkey * 7919) % 150000 AS VARCHAR(10)) END AS ahead_aadt
FROM {part}
""",
    "contamination_points": """
SELECT o_orderkey AS feature_id,
       CAST(32500 + (o_orderkey * 3571) % 9500 AS DOUBLE) / 1000 AS lat, CAST(-124500 + (o_orderkey * 2753) % 10500 AS DOUBLE) / 1000 AS lon,
       CASE o_orderkey % 7 WHEN 0 THEN 'Open - Remediation' WHEN 1 THEN 'Inactive - Needs Evaluation' WHEN 2 THEN 'Completed - Case Closed'
            WHEN 3 THEN 'Certified / Land Use Restrictions' WHEN 4 THEN 'No Further Action' WHEN 5 THEN 'Refer: Other Agency' END AS raw_status,
       CASE o_orderkey % 2 WHEN 0 THEN 'envirostor' ELSE 'geotracker' END AS source,
       CASE o_orderkey % 4 WHEN 0 THEN 'Federal Superfund' WHEN 1 THEN 'LUST Cleanup Site' WHEN 2 THEN 'Military' END AS raw_type
FROM {orders}
""",
    "airport_points": """
SELECT s_suppkey AS feature_id, CAST(32500 + (s_suppkey * 6007) % 9500 AS DOUBLE) / 1000 AS lat, CAST(-124500 + (s_suppkey * 7001) % 10500 AS DOUBLE) / 1000 AS lon,
       concat(CASE WHEN s_suppkey % 2 = 0 THEN 'K' ELSE '' END, 'A', CAST(s_suppkey % 30 AS VARCHAR(5))) AS airport_id,
       CASE WHEN s_suppkey % 4 = 0 THEN CAST(20000 + s_suppkey * 10 AS DOUBLE) END AS annual_piston_ops,
       CAST((s_suppkey * 10) % 360 AS DOUBLE) AS wind_from,
       CAST((s_suppkey * 13) % 300 AS DOUBLE) / 100 - 2 AS erosion_rate_m_yr
FROM {supplier}
""",
    "raster_pixels": """
SELECT l_suppkey % 4 AS tile_id, l_partkey % 40 AS prow, l_orderkey % 40 AS pcol, CAST(sum(l_quantity) AS DOUBLE) AS value
FROM {lineitem} WHERE ((l_partkey % 40) * 7 + (l_orderkey % 40) * 13) % 5 <> 0
GROUP BY l_suppkey % 4, l_partkey % 40, l_orderkey % 40
""",
    "raster_sites": """
SELECT c_custkey AS site_id, c_custkey % 4 AS tile_id,
       CAST(34000 + 100 * (c_custkey % 4) + (c_custkey * 37) % 100 AS DOUBLE) / 1000 AS lat, CAST(-118500 + (c_custkey * 53) % 100 AS DOUBLE) / 1000 AS lon
FROM {customer}
""",
    "displacement": """
SELECT user_id % 3 AS frame_id, user_id AS pixel_id, CAST(ts AS DATE) AS acq_date,
       CASE WHEN event_id % 10 = 3 THEN NULL ELSE value / 1000 END AS displacement_m
FROM {events}
""",
    "perimeters": """
SELECT o_orderkey AS fire_id, year(o_orderdate) AS fire_year,
       CAST(-124000 + (o_orderkey * 611) % 9000 AS DOUBLE) / 1000 AS xmin, CAST(33000 + (o_orderkey * 433) % 8000 AS DOUBLE) / 1000 AS ymin,
       CAST(20 + o_orderkey % 60 AS DOUBLE) / 1000 AS size_deg
FROM {orders}
""",
    "modeled_pixels": """
SELECT p_partkey AS pixel_id, CAST(33000 + (p_partkey * 433) % 8000 AS DOUBLE) / 1000 AS lat, CAST(-124000 + (p_partkey * 611) % 9000 AS DOUBLE) / 1000 AS lon,
       CAST((p_partkey * 31) % 97 * 10 AS DOUBLE) AS value
FROM {part}
""",
    "structures": """
SELECT l_orderkey * 10 + l_linenumber AS structure_id,
       CASE WHEN l_returnflag = 'R' AND l_quantity > 20 THEN 'Destroyed (>50%)' WHEN l_returnflag = 'A' AND l_quantity > 40 THEN 'Major (26-50%)'
            WHEN l_linenumber = 7 THEN 'Inaccessible' WHEN l_linenumber = 6 THEN NULL ELSE 'No Damage' END AS damage,
       l_quantity AS distance_m, l_discount * 100 AS flame_ft, l_tax * 10 AS fair_share,
       CASE WHEN l_suppkey % 8 <> 0 THEN CAST(1930 + l_partkey % 90 AS DOUBLE) END AS year_built, CAST(l_orderkey * 31 % 101 AS DOUBLE) / 100 AS ember,
       CAST(32500 + (l_orderkey * 7919) % 9500 AS DOUBLE) / 1000 AS lat, CAST(-124500 + (l_partkey * 104729) % 10500 AS DOUBLE) / 1000 AS lon
FROM {lineitem}
""",
    "addresses": """
SELECT o_orderkey AS line_no, concat('part-', CAST(o_custkey % 3 AS VARCHAR(3))) AS file_name,
       CAST(100 + o_custkey % 400 AS VARCHAR(6)) AS number,
       CASE o_orderkey % 6 WHEN 0 THEN 'elm st' WHEN 1 THEN 'OAK AVE' WHEN 2 THEN 'Mission Blvd' WHEN 3 THEN 'el camino real' WHEN 4 THEN ' bay  dr' ELSE '' END AS street,
       CASE WHEN o_orderkey % 11 = 0 THEN '5' END AS unit, concat('city ', CAST(o_custkey % 25 AS VARCHAR(3))) AS city,
       CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(90000 + o_custkey % 25 AS VARCHAR(5)) END AS postcode,
       CAST(32000 + (o_orderkey * 3571) % 10500 AS DOUBLE) / 1000 AS lat, CAST(-124500 + (o_orderkey * 2753) % 10500 AS DOUBLE) / 1000 AS lon
FROM {orders}
""",
    "soil_components": """
SELECT DISTINCT l_partkey % 200 AS mukey, l_orderkey AS cokey, CAST(5 + (l_orderkey * 31) % 90 AS DOUBLE) AS comppct_r
FROM {lineitem}
""",
    "soil_horizons": """
SELECT l_orderkey AS cokey, l_linenumber AS hz, CAST(l_linenumber * 10 AS DOUBLE) AS hzdept_r, CAST(l_linenumber * 10 AS DOUBLE) + l_quantity AS hzdepb_r,
       CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_discount * 100 END AS lep_r
FROM {lineitem}
""",
    "hazard_curves": """
SELECT e.user_id, t.i, CAST(t.x AS DOUBLE) / 1000 AS x, CAST(count(CASE WHEN e.value > t.x / 10 THEN 1 END) AS DOUBLE) / count(*) / 50 AS y
FROM {events} e CROSS JOIN (VALUES (0,5),(1,50),(2,150),(3,400),(4,900),(5,2000)) AS t(i, x)
GROUP BY e.user_id, t.i, t.x
""",
    "zip_units": """
SELECT CAST(90000 + n_nationkey * 7 AS VARCHAR(5)) AS zip, CASE WHEN n_nationkey = 3 THEN CAST(0 AS DOUBLE) ELSE CAST(100 + n_nationkey * 40 AS DOUBLE) END AS housing_units,
       CASE WHEN n_nationkey % 6 = 5 THEN NULL WHEN n_nationkey = 4 THEN 999 ELSE n_nationkey * 9 END AS pif_2025,
       CAST(33000 + n_nationkey * 350 AS DOUBLE) / 1000 AS lat, CAST(-123900 + n_nationkey * 380 AS DOUBLE) / 1000 AS lon
FROM {nation}
""",
    "tract_rates": """
SELECT concat('06001', CAST(400000 + n_nationkey AS VARCHAR(6))) AS tractfips, CASE WHEN n_nationkey = 7 THEN 'NV' ELSE 'CA' END AS stateabbrv,
       CASE WHEN n_nationkey = 9 THEN NULL ELSE CAST(n_nationkey AS DOUBLE) / 100 END AS lnds_afreq, CAST(1 + n_nationkey % 4 AS DOUBLE) / 1000 AS lnds_hlrb,
       CAST(-124500 + 2100 * (n_nationkey % 5) AS DOUBLE) / 1000 AS xmin, CAST(32500 + 1900 * floor(n_nationkey / 5) AS DOUBLE) / 1000 AS ymin
FROM {nation}
""",
    "geocode_events": """
SELECT event_id, concat('  ', CAST(user_id AS VARCHAR(6)), ' Main   ST ') AS address, CAST(32500 + (event_id * 7919) % 9500 AS DOUBLE) / 1000 AS lat,
       CAST(-124500 + (event_id * 104729) % 10500 AS DOUBLE) / 1000 AS lon, ts AS created_at
FROM {events}
""",
    "landslide_points": """
SELECT o_orderkey AS ls_id, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST((o_orderkey * 13) % 90 AS DOUBLE) END AS n10_90m,
       CAST(31500 + (o_orderkey * 3571) % 11000 AS DOUBLE) / 1000 AS lat_n, CAST(-125000 + (o_orderkey * 2753) % 11500 AS DOUBLE) / 1000 AS lon_e
FROM {orders}
""",
    "raster_polys": """
SELECT s_suppkey AS poly_id, s_suppkey % 4 AS tile_id,
       CAST(-1185000 + (s_suppkey * 97) % 800 AS DOUBLE) / 10000 AS xmin, CAST(340000 + 1000 * (s_suppkey % 4) + (s_suppkey * 59) % 800 AS DOUBLE) / 10000 AS ymin,
       CAST(37 + 20 * (s_suppkey % 7) AS DOUBLE) / 10000 AS size_deg, CAST(1 + s_suppkey % 3 AS INT) AS class_code
FROM {supplier}
""",
    "near_point_sites": """
SELECT c_custkey AS site_id,
       CAST(3250000 + 100 * (((c_custkey % 10) * 6007) % 9500) + ((c_custkey * 37) % 61 - 30) * (CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 100 END) AS DOUBLE) / 100000 AS lat,
       CAST(-12450000 + 100 * (((c_custkey % 10) * 7001) % 10500) + ((c_custkey * 53) % 61 - 30) * (CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 100 END) AS DOUBLE) / 100000 AS lon
FROM {customer}
""",
    "near_line_sites": """
SELECT c_custkey AS site_id,
       CAST(3260000 + 100 * (((c_custkey % 200) * 8887) % 9300) + ((c_custkey * 37) % 61 - 30) * (CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 100 END) AS DOUBLE) / 100000 AS lat,
       CAST(-12430000 + 100 * (((c_custkey % 200) * 9973) % 10200) + ((c_custkey * 53) % 61 - 30) * (CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 100 END) AS DOUBLE) / 100000 AS lon
FROM {customer}
""",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in SQL[name]}
    return spark.sql(SQL[name], **used)


def ctes(*names: str) -> str:
    """The derived tables as the WITH clause of a DuckDB query."""
    return "WITH " + ",\n".join(f"{n} AS ({re.sub(r'[{}]', '', SQL[n])})" for n in names)
