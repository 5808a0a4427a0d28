"""Queries over attribute tables: normalisation, aggregates, windows, search and validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrarisk.functions import hazard as H
from terrarisk.functions import text as T
from terrarisk.operators import stats as A
from terrarisk.operators.quantiles import exact_percentiles

from .fixtures import ctes, fixture
from .registry import query

c = F.col


def r6(x):
    return F.round(x, 6)


@query("n1_resolve_columns", "SELECT s_suppkey AS id, s_name AS name, NULL::VARCHAR AS missing FROM supplier")
def n1(spark, sf_dir):
    return A.resolve_columns(spark.read.parquet(f"{sf_dir}/supplier.parquet"), {"id": ["S_SUPPKEY"], "name": ["s.name"], "missing": ["nothing"]})


@query("n1b_select_by_keyword", "SELECT s_suppkey FROM supplier")
def n1b(spark, sf_dir):
    return A.select_by_keyword(spark.read.parquet(f"{sf_dir}/supplier.parquet"), ["suppkey"])


@query("n1c_detect_class_column", ctes("zone_attrs") + "SELECT 'raw_hazard' AS col, count(*) AS n FROM zone_attrs")
def n1c(spark, sf_dir):
    z = fixture(spark, sf_dir, "zone_attrs").select("poly_id", "fld_zone", "raw_hazard")
    return z.agg(F.lit(A.detect_class_column(z, {k: v for k, v in T.HAZARD_CLASSES.items() if len(k) > 1})).alias("col"), F.count("*").alias("n"))


@query("n2_num_prop", ctes("line_attrs") + "SELECT line_id, coalesce(try_cast(nullif(trim(ahead_aadt), '') AS DOUBLE), CAST(line_id AS DOUBLE)) AS aadt FROM line_attrs")
def n2(spark, sf_dir):
    return fixture(spark, sf_dir, "line_attrs").select("line_id", T.first_number(c("ahead_aadt"), c("line_id").cast("string")).alias("aadt"))


@query("n3_str_prop", ctes("line_attrs") + "SELECT line_id, coalesce(nullif(fault_name, ''), nullif(slip_rate_text, ''), 'Unknown') AS name FROM line_attrs")
def n3(spark, sf_dir):
    return fixture(spark, sf_dir, "line_attrs").select("line_id", T.first_text(c("fault_name"), c("slip_rate_text"), default="Unknown").alias("name"))


@query("n4_null_sentinels", ctes("zone_attrs") + "SELECT poly_id, CASE WHEN overall_percentile > -999 THEN overall_percentile END AS overall_percentile FROM zone_attrs")
def n4(spark, sf_dir):
    return A.null_sentinels(fixture(spark, sf_dir, "zone_attrs").select("poly_id", "overall_percentile"))


@query("n5_map_categories", ctes("zone_attrs") + "SELECT poly_id, CASE raw_hazard WHEN 'very high' THEN 'Very High' WHEN 'VHIGH' THEN 'Very High' WHEN '2' THEN 'High' ELSE 'Moderate' END AS hazard_class FROM zone_attrs WHERE raw_hazard <> 'n/a'")
def n5(spark, sf_dir):
    return fixture(spark, sf_dir, "zone_attrs").select("poly_id", H.lookup(F.lower(F.trim("raw_hazard")), T.HAZARD_CLASSES).alias("hazard_class")).filter("hazard_class is not null")


@query("n5_fault_types", ctes("line_attrs") + "SELECT line_id, CASE lower(trim(raw_type)) WHEN 'right lateral' THEN 'strike-slip' WHEN 'thrust' THEN 'thrust' WHEN 'normal' THEN 'normal' WHEN 'oblique' THEN 'oblique' ELSE 'other' END AS fault_type FROM line_attrs")
def n5b(spark, sf_dir):
    return fixture(spark, sf_dir, "line_attrs").select("line_id", F.coalesce(H.lookup(F.lower(F.trim("raw_type")), T.FAULT_TYPES), F.lit("other")).alias("fault_type"))


STATUS = "CASE WHEN s IS NULL THEN 'unknown' " + " ".join(f"WHEN contains(lower(trim(s)), '{p}') THEN '{v}'" for p, v in T.STATUS_PATTERNS) + " ELSE 'unknown' END"


@query("n6_classify_status", ctes("contamination_points") + f"SELECT feature_id, {STATUS} AS status FROM (SELECT feature_id, raw_status AS s FROM contamination_points)")
def n6(spark, sf_dir):
    return fixture(spark, sf_dir, "contamination_points").select("feature_id", T.classify_status(c("raw_status")).alias("status"))


@query("n7_parse_slip_rate", ctes("line_attrs") + "SELECT line_id, CASE slip_rate_text WHEN 'Less than 0.2 mm/yr' THEN 0.1::DOUBLE WHEN 'Between 1 and 5 mm/yr' THEN 3::DOUBLE WHEN 'Greater than 5 mm/yr' THEN 7.5::DOUBLE END AS slip FROM line_attrs")
def n7(spark, sf_dir):
    return fixture(spark, sf_dir, "line_attrs").select("line_id", T.parse_slip_rate(c("slip_rate_text")).alias("slip"))


@query("n8_assign_by_pattern", ctes("line_attrs") + "SELECT line_id, CASE WHEN regexp_matches(fault_name, 'San Andreas\\b') THEN 22::DOUBLE WHEN regexp_matches(fault_name, 'Hayward\\b') THEN 33::DOUBLE END AS pct FROM line_attrs")
def n8(spark, sf_dir):
    return fixture(spark, sf_dir, "line_attrs").select("line_id", T.assign_by_pattern(c("fault_name")).alias("pct"))


@query("n9_bucketize", ctes("zone_attrs") + "SELECT poly_id, CASE WHEN lep_pct < 0 THEN 'Unknown' WHEN lep_pct < 3 THEN 'Low' WHEN lep_pct < 6 THEN 'Moderate' WHEN lep_pct < 9 THEN 'High' ELSE 'Very High' END AS class FROM zone_attrs")
def n9(spark, sf_dir):
    return fixture(spark, sf_dir, "zone_attrs").select("poly_id", T.shrink_swell(c("lep_pct")).alias("class"))


@query("n10_row_filters", ctes("addresses") + "SELECT line_no FROM addresses WHERE lat BETWEEN 32.5 AND 42.0 AND lon BETWEEN -124.5 AND -114.0")
def n10(spark, sf_dir):
    return fixture(spark, sf_dir, "addresses").filter(A.in_bounds(c("lat"), c("lon"))).select("line_no")


@query("n10_filter_rules", ctes("line_attrs") + "SELECT line_id FROM line_attrs WHERE regexp_matches(raw_type, '(?i)^(right|normal)') AND try_cast(ahead_aadt AS INT) >= 5000 AND seq BETWEEN 10 AND 5000 AND slip_rate_text <> 'Greater than 5 mm/yr'")
def n10b(spark, sf_dir):
    rules = {"raw_type": ("matches", "(?i)^(right|normal)"), "aadt": ("least", 5000), "seq": ("between", 10, 5000), "slip_rate_text": ("none_of", ["Greater than 5 mm/yr"])}
    return fixture(spark, sf_dir, "line_attrs").withColumn("aadt", c("ahead_aadt").try_cast("int")).filter(A.row_filter(rules)).select("line_id")


@query("n11_union_sources", ctes("contamination_points", "airport_points") + "SELECT origin, count(*) AS n, count(raw_status) AS with_status FROM (SELECT 'sites' AS origin, raw_status FROM contamination_points UNION ALL SELECT 'airports', NULL FROM airport_points) GROUP BY origin")
def n11(spark, sf_dir):
    both = A.union_sources({"sites": fixture(spark, sf_dir, "contamination_points"), "airports": fixture(spark, sf_dir, "airport_points")})
    return both.groupBy("origin").agg(F.count("*").alias("n"), F.count("raw_status").alias("with_status"))


@query("n12_parse_increment", ctes("zone_attrs") + "SELECT poly_id, CAST(increment_ft AS DOUBLE) AS ft FROM zone_attrs")
def n12(spark, sf_dir):
    z = fixture(spark, sf_dir, "zone_attrs")
    name = F.when(c("poly_id") % 2 == 0, F.format_string("slr_%d_0ft", "increment_ft")).otherwise(F.format_string("slr_%dft", "increment_ft"))
    return z.select("poly_id", T.parse_increment(name).alias("ft"))


STREET = "CASE o WHEN 'elm st' THEN 'Elm Street' WHEN 'OAK AVE' THEN 'Oak Avenue' WHEN 'Mission Blvd' THEN 'Mission Boulevard' WHEN 'el camino real' THEN 'El Camino Real' WHEN ' bay  dr' THEN 'Bay  Drive' END"
ADDRESSES = ctes("addresses") + f", clean AS (SELECT line_no, file_name, number || ' ' || ({STREET}) || CASE WHEN unit IS NOT NULL THEN ' #' || unit ELSE '' END AS address, 'City ' || split_part(city, ' ', 2) AS city, postcode, lat, lon FROM (SELECT *, street AS o FROM addresses) WHERE street <> '' AND lat BETWEEN 32.5 AND 42.0 AND lon BETWEEN -124.5 AND -114.0)"


@query("n13_normalize_address", ADDRESSES + " SELECT line_no, address, address || ', ' || city || ', CA' || CASE WHEN postcode <> '' THEN ', ' || postcode ELSE '' END AS display FROM clean")
def n13(spark, sf_dir):
    return A.normalize_address(fixture(spark, sf_dir, "addresses")).select("line_no", "address", "display")


@query("n14_apply_corrections", ctes("addresses") + "SELECT line_no, CASE street WHEN 'elm st' THEN 'elmwood st' ELSE street END AS street FROM addresses")
def n14(spark, sf_dir):
    fixes = spark.range(1).select(F.lit("elm st").alias("raw"), F.lit("elmwood st").alias("corrected"))
    return A.apply_corrections(fixture(spark, sf_dir, "addresses"), "street", fixes).select("line_no", "street")


@query("n15_normalize_key", ctes("geocode_events") + "SELECT event_id, trim(regexp_replace(lower(address), '\\s+', ' ', 'g')) AS key FROM geocode_events")
def n15(spark, sf_dir):
    return fixture(spark, sf_dir, "geocode_events").select("event_id", T.normalize_key(c("address")).alias("key"))


@query("n16_extract_zip", ctes("addresses") + "SELECT line_no, nullif(postcode, '') AS zip FROM addresses")
def n16(spark, sf_dir):
    return fixture(spark, sf_dir, "addresses").select("line_no", T.extract_zip(F.concat_ws(", ", F.concat(F.lit("12 "), "street"), "city", "postcode")).alias("zip"))


@query("n17_measurement_period", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' WHEN o_orderkey % 3 = 1 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' to ' || CAST(CAST(o_orderdate AS DATE) + 365 AS VARCHAR) END AS period FROM orders")
def n17(spark, sf_dir):
    d, k = c("o_orderdate").cast("date"), c("o_orderkey") % 3
    period = F.concat_ws(" to ", F.when(k > 0, d.cast("string")), F.when(k == 2, F.date_add(d, 365).cast("string")))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", T.first_text(period, default="unknown").alias("period"))


@query("n18_validate_table", ctes("tract_rates") + "SELECT rule, n_bad FROM (SELECT count(*) FILTER (length(tractfips) <> 11) AS geoid_length, count(*) FILTER (lnds_afreq IS NULL) AS null_rate, CASE WHEN count(*) BETWEEN 8000 AND 10000 THEN 0 ELSE 1 END AS row_count FROM tract_rates) UNPIVOT (n_bad FOR rule IN (geoid_length, null_rate, row_count))")
def n18(spark, sf_dir):
    return A.validate_table(fixture(spark, sf_dir, "tract_rates"), {"geoid_length": F.length("tractfips") != 11, "null_rate": c("lnds_afreq").isNull()}, (8000, 10000))


@query("a2_weighted_lep", ctes("soil_horizons") + "SELECT cokey, round(sum(lep_r * (hzdepb_r - hzdept_r)) / nullif(sum(hzdepb_r - hzdept_r), 0), 6) AS lep FROM soil_horizons GROUP BY cokey")
def a2(spark, sf_dir):
    return A.weighted_lep(fixture(spark, sf_dir, "soil_horizons")).select("cokey", r6("lep").alias("lep"))


@query("a3_dominant_row", ctes("soil_components") + "SELECT mukey, cokey, comppct_r FROM (SELECT *, row_number() OVER (PARTITION BY mukey ORDER BY comppct_r DESC, cokey) AS rn FROM soil_components) WHERE rn = 1")
def a3(spark, sf_dir):
    return A.dominant_row(fixture(spark, sf_dir, "soil_components"), "mukey", "comppct_r", "cokey", ["cokey", "comppct_r"])


@query("j13_soil_chain", ctes("soil_components", "soil_horizons") + "SELECT d.mukey, d.cokey, round(h.lep, 6) AS lep, CASE WHEN h.lep >= 0 AND h.lep < 3 THEN 'Low' WHEN h.lep < 6 THEN 'Moderate' WHEN h.lep < 9 THEN 'High' WHEN h.lep >= 9 THEN 'Very High' ELSE 'Unknown' END AS class FROM (SELECT *, row_number() OVER (PARTITION BY mukey ORDER BY comppct_r DESC, cokey) AS rn FROM soil_components) d LEFT JOIN (SELECT cokey, sum(lep_r * (hzdepb_r - hzdept_r)) / nullif(sum(hzdepb_r - hzdept_r), 0) AS lep FROM soil_horizons GROUP BY cokey) h USING (cokey) WHERE rn = 1")
def j13(spark, sf_dir):
    top = A.dominant_row(fixture(spark, sf_dir, "soil_components"), "mukey", "comppct_r", "cokey", ["cokey"])
    return top.join(A.weighted_lep(fixture(spark, sf_dir, "soil_horizons")), "cokey", "left").select("mukey", "cokey", r6("lep").alias("lep"), T.shrink_swell(c("lep")).alias("class"))


@query("a4_median_per_cell", ctes("structures") + "SELECT CAST(floor(lat * 10) AS BIGINT) AS i, CAST(floor(lon * 10) AS BIGINT) AS j, least(CAST(trunc(median(distance_m)) AS BIGINT), 65535) AS v FROM structures GROUP BY 1, 2")
def a4(spark, sf_dir):
    return A.median_per_cell(fixture(spark, sf_dir, "structures"), "distance_m")


@query("a10_displacement_trend", ctes("displacement") + ", t AS (SELECT frame_id, pixel_id, date_diff('day', DATE '2000-01-01', acq_date) / 365.25::DOUBLE AS yr, displacement_m AS v FROM displacement) SELECT frame_id, pixel_id, count(v) AS n, round(regr_slope(v, yr) * 1000, 3) AS velocity_mm_yr FROM t WHERE v IS NOT NULL GROUP BY 1, 2 HAVING count(v) >= 4 AND max(yr) - min(yr) >= 0.05")
def a10(spark, sf_dir):
    """The test stream spans weeks, so the span's limit is lower here than the operator's year."""
    d = fixture(spark, sf_dir, "displacement").withColumn("yr", F.date_diff("acq_date", F.lit("2000-01-01").cast("date")) / F.lit(365.25))
    return A.displacement_trend(d, ["frame_id", "pixel_id"], "yr", "displacement_m", min_span=0.05).select("frame_id", "pixel_id", "n", F.round("velocity_mm_yr", 3).alias("velocity_mm_yr"))


@query("a10_trend_by_day", ctes("displacement") + ", t AS (SELECT frame_id, pixel_id, CAST(date_diff('day', DATE '2000-01-01', acq_date) AS DOUBLE) AS d, displacement_m AS v FROM displacement WHERE displacement_m IS NOT NULL) SELECT frame_id, pixel_id, count(*) AS n, round(regr_slope(v, d) * 1000, 3) AS velocity, round(1000 * sqrt(greatest((regr_syy(v, d) - regr_slope(v, d) * regr_sxy(v, d)) / count(*), 0)), 3) AS residual FROM t GROUP BY 1, 2 HAVING count(*) >= 4 AND max(d) - min(d) >= 1")
def a10b(spark, sf_dir):
    """The operator with days as its unit of time."""
    d = fixture(spark, sf_dir, "displacement").withColumn("d", F.date_diff("acq_date", F.lit("2000-01-01").cast("date")).cast("double"))
    return A.displacement_trend(d, ["frame_id", "pixel_id"], "d", "displacement_m").select("frame_id", "pixel_id", "n", F.round("velocity_mm_yr", 3).alias("velocity"), F.round("residual_mm", 3).alias("residual"))


@query("a12_merge_max", ctes("displacement") + ", f AS (SELECT frame_id, pixel_id % 20 AS poly, max(abs(displacement_m)) AS mx, avg(abs(displacement_m)) AS mean FROM displacement GROUP BY 1, 2) SELECT poly, frame_id, round(mx, 6) AS mx, round(mean, 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY poly ORDER BY mx DESC, frame_id) AS rn FROM f WHERE mx IS NOT NULL) WHERE rn = 1")
def a12(spark, sf_dir):
    f = fixture(spark, sf_dir, "displacement").groupBy("frame_id", (c("pixel_id") % 20).alias("poly")).agg(F.max(F.abs("displacement_m")).alias("mx"), F.avg(F.abs("displacement_m")).alias("mean"))
    return A.merge_max(f, "poly", "frame_id", "mx", ["frame_id", "mx", "mean"]).select("poly", "frame_id", r6("mx").alias("mx"), r6("mean").alias("mean"))


SHARE = "CASE WHEN housing_units > 0 THEN least(greatest(coalesce(pif_2025, 0) / housing_units, 0), 1) ELSE 0 END"


@query("a13_fair_share", ctes("zip_units") + f"SELECT zip, round({SHARE}, 4) AS share FROM zip_units WHERE {SHARE} > 0")
def a13(spark, sf_dir):
    return fixture(spark, sf_dir, "zip_units").select("zip", F.round(A.fair_share(c("pif_2025"), c("housing_units")), 4).alias("share"), A.fair_share(c("pif_2025"), c("housing_units")).alias("s")).filter("s > 0").drop("s")


@query("j21_census_policy_join", ctes("zip_units") + "SELECT u.zip, u.housing_units, CAST(coalesce(p.pif, 0) AS BIGINT) AS pif FROM zip_units u LEFT JOIN (SELECT zip, pif_2025 AS pif FROM zip_units WHERE zip > '90050') p USING (zip)")
def j21(spark, sf_dir):
    u = fixture(spark, sf_dir, "zip_units")
    return A.census_policy_join(u, u.filter("zip > '90050'").select("zip", c("pif_2025").alias("pif")))


@query("a14_tract_rate", ctes("tract_rates") + "SELECT tractfips, round(lnds_afreq * lnds_hlrb, 9) AS rate FROM tract_rates WHERE stateabbrv = 'CA' AND lnds_afreq IS NOT NULL")
def a14(spark, sf_dir):
    return A.tract_rate(fixture(spark, sf_dir, "tract_rates")).select("tractfips", F.round("rate", 9).alias("rate"))


@query("a15_landslide_rate_by_n10", ctes("landslide_points") + ", k AS (SELECT CAST(least(greatest(trunc(n10_90m), 0), 81) AS BIGINT) AS n10, count(*) AS n FROM landslide_points WHERE n10_90m IS NOT NULL AND lat_n BETWEEN 32.5 AND 42.0 AND lon_e BETWEEN -124.5 AND -114.0 GROUP BY 1) SELECT r.n10, coalesce(n, 0) AS n, round(coalesce(n, 0)::DOUBLE / (SELECT sum(n) FROM k), 6) AS share FROM range(82) r(n10) LEFT JOIN k USING (n10)")
def a15(spark, sf_dir):
    p = fixture(spark, sf_dir, "landslide_points").select(c("n10_90m").alias("n10"), c("lat_n").alias("lat"), c("lon_e").alias("lon"))
    return A.landslide_rate_by_n10(p).select("n10", "n", r6("share").alias("share"))


@query("a16_n10_histogram", ctes("landslide_points") + "SELECT CAST(ceil((n10_90m + 1) / 5) AS BIGINT) AS bin, count(*) AS n FROM landslide_points WHERE n10_90m IS NOT NULL GROUP BY 1")
def a16(spark, sf_dir):
    return A.n10_histogram(fixture(spark, sf_dir, "landslide_points").select(c("n10_90m").alias("n10")))


@query("a17_histogram", ctes("line_attrs") + "SELECT CAST((v >= 5000)::INT + (v >= 20000)::INT + (v >= 50000)::INT + (v >= 100000)::INT AS BIGINT) AS bin, count(*) AS n FROM (SELECT try_cast(ahead_aadt AS DOUBLE) AS v FROM line_attrs) WHERE v IS NOT NULL GROUP BY 1")
def a17(spark, sf_dir):
    return A.histogram(fixture(spark, sf_dir, "line_attrs"), T.number(c("ahead_aadt")), [5000, 20000, 50000, 100000])


@query("a18_profile", ctes("airport_points") + "SELECT count(*) AS n, count(*) - count(annual_piston_ops) AS nulls, count(DISTINCT airport_id) AS ids, round(min(erosion_rate_m_yr), 6) AS lo, round(max(erosion_rate_m_yr), 6) AS hi, round(avg(erosion_rate_m_yr), 6) AS mean, round(median(erosion_rate_m_yr), 6) AS med, round(stddev_samp(erosion_rate_m_yr), 6) AS std, count(*) FILTER (erosion_rate_m_yr < 0) AS eroding, round(quantile_cont(erosion_rate_m_yr, 0.9), 6) AS p90 FROM airport_points")
def a18(spark, sf_dir):
    a = fixture(spark, sf_dir, "airport_points")
    numbers = A.profile(a, "erosion_rate_m_yr").select("n", *[r6(x).alias(x) for x in ("lo", "hi", "mean", "med", "std", "p90")])
    more = a.agg(F.count_if(c("annual_piston_ops").isNull()).alias("nulls"), F.count_distinct("airport_id").alias("ids"), F.count_if(c("erosion_rate_m_yr") < 0).alias("eroding"))
    return numbers.join(F.broadcast(more))  # a row each


@query("a18_whole_profile", ctes("landslide_points") + "SELECT count(*) AS n, count(*) - count(n10_90m) AS nulls, count(DISTINCT n10_90m) AS n_distinct, count(*) FILTER (n10_90m < 0) AS negative, count(*) FILTER (n10_90m = 0) AS zero, count(*) FILTER (n10_90m > 0) AS positive, round(min(n10_90m), 6) AS lo, round(max(n10_90m), 6) AS hi, round(avg(n10_90m), 6) AS mean, round(stddev_samp(n10_90m), 6) AS std, round(quantile_cont(n10_90m, 0.1), 6) AS p10, round(median(n10_90m), 6) AS med, round(quantile_cont(n10_90m, 0.9), 6) AS p90 FROM landslide_points")
def a18_whole(spark, sf_dir):
    p = A.whole_profile(fixture(spark, sf_dir, "landslide_points"), "n10_90m")
    return p.select("n", "nulls", "n_distinct", "negative", "zero", "positive", *[r6(x).alias(x) for x in ("lo", "hi", "mean", "std", "p10", "med", "p90")])


@query("a18_exact_percentiles", "SELECT l_returnflag, q, count(*) AS n, round(CASE q WHEN 0.1 THEN quantile_cont(l_extendedprice, 0.1) WHEN 0.5 THEN median(l_extendedprice) ELSE quantile_cont(l_extendedprice, 0.99) END, 6) AS percentile FROM lineitem, (VALUES (0.1::DOUBLE), (0.5), (0.99)) t(q) GROUP BY l_returnflag, q")
def a18_percentiles(spark, sf_dir):
    """By group; a small limit, so that brackets narrow in several rounds."""
    got = exact_percentiles(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_extendedprice", [0.1, 0.5, 0.99], ["l_returnflag"], limit=500)
    return got.select("l_returnflag", "q", "n", r6("percentile").alias("percentile"))


@query("a19_value_counts", ctes("contamination_points") + "SELECT CASE WHEN grouping(source) = 0 THEN 'source' ELSE 'type' END AS dim, coalesce(source, raw_type, 'none') AS value, count(*) AS n FROM contamination_points GROUP BY GROUPING SETS ((source), (raw_type))")
def a19(spark, sf_dir):
    return A.value_counts(fixture(spark, sf_dir, "contamination_points"), {"source": "source", "type": "raw_type"})


@query("w4_dedupe_addresses", ADDRESSES + " SELECT line_no FROM (SELECT line_no, row_number() OVER (PARTITION BY lower(address), lower(city) ORDER BY file_name, line_no) AS rn FROM clean) WHERE rn = 1")
def w4(spark, sf_dir):
    return A.dedupe_addresses(A.normalize_address(fixture(spark, sf_dir, "addresses"))).select("line_no")


@query("w5_even_subsample", ctes("displacement") + ", d AS (SELECT DISTINCT frame_id, acq_date FROM displacement), k AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY acq_date) - 1 AS i, count(*) OVER (PARTITION BY frame_id) AS m, min(acq_date) OVER (PARTITION BY frame_id) AS lo, max(acq_date) OVER (PARTITION BY frame_id) AS hi FROM d) SELECT frame_id, CAST(acq_date AS VARCHAR) AS acq_date FROM k WHERE m <= 8 OR date_diff('day', lo, hi) / 365.25 < 1 OR i IN (SELECT floor(j * (m - 1) / 7.0) FROM range(8) r(j))")
def w5(spark, sf_dir):
    return A.even_subsample(fixture(spark, sf_dir, "displacement").select("frame_id", "acq_date").distinct(), "frame_id", "acq_date").select("frame_id", c("acq_date").cast("string").alias("acq_date"))


@query("w7_top_n_zips", ctes("zip_units") + "SELECT zip, CAST(pif_2025 AS BIGINT) AS pif FROM zip_units WHERE pif_2025 IS NOT NULL ORDER BY pif_2025 DESC, zip LIMIT 10")
def w7(spark, sf_dir):
    return A.top_n_zips(fixture(spark, sf_dir, "zip_units").select("zip", c("pif_2025").alias("pif")))


@query("w8_policy_trend", ctes("zip_units") + ", y AS (SELECT zip, 2025 - k AS year, CAST(coalesce(pif_2025, 0) * (10 - k) AS BIGINT) AS pif FROM zip_units, range(5) r(k)) SELECT zip, CAST(year AS BIGINT) AS year, pif, pif - lag(pif) OVER (PARTITION BY zip ORDER BY year) AS change FROM y")
def w8(spark, sf_dir):
    u = fixture(spark, sf_dir, "zip_units")
    wide = u.select("zip", *[(F.coalesce("pif_2025", F.lit(0)) * (10 - k)).alias(f"pif_{2025 - k}") for k in range(5)])
    return A.policy_trend(wide, [2025 - k for k in range(5)])


@query("w9_frame_order", ctes("displacement", "airport_points") + "SELECT d.frame_id, round(min(lon), 6) AS west FROM displacement d JOIN airport_points p ON p.feature_id = d.frame_id + 1 GROUP BY d.frame_id ORDER BY west LIMIT 2")
def w9(spark, sf_dir):
    p = fixture(spark, sf_dir, "airport_points").select((c("feature_id") - 1).alias("frame_id"), "lon")
    return A.frame_order(fixture(spark, sf_dir, "displacement").select("frame_id").distinct().join(p, "frame_id")).select("frame_id", r6("west").alias("west"))


@query("t1_prefix_search", ADDRESSES + ", q AS (SELECT unnest(['10', '15', '2', '399 e', '100 OAK']) AS q) SELECT q, rank, line_no AS address_id FROM (SELECT q, line_no, row_number() OVER (PARTITION BY q ORDER BY lower(address), line_no) AS rank FROM clean JOIN q ON length(q) >= 2 AND starts_with(lower(address), lower(q))) WHERE rank <= 6")
def t1(spark, sf_dir):
    a = A.normalize_address(fixture(spark, sf_dir, "addresses")).select(c("line_no").alias("address_id"), "address")
    q = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("10", "15", "2", "399 e", "100 OAK")])).alias("q"))
    return A.prefix_search(a, q).select("q", c("rank").cast("long").alias("rank"), "address_id")


@query("t2_fuzzy_prefix_match", ADDRESSES + " SELECT line_no, regexp_matches(lower(address), '^[0-9]+ (oak|mission) (ave|boul)') AS hit FROM clean")
def t2(spark, sf_dir):
    a = A.normalize_address(fixture(spark, sf_dir, "addresses"))
    n = F.regexp_extract("address", r"^(\d+)", 1)
    return a.select("line_no", (A.fuzzy_prefix_match(F.concat(n, F.lit(" oa ave")), c("address")) | A.fuzzy_prefix_match(F.concat(n, F.lit(" miss blvd")), c("address"))).alias("hit"))


@query("t3_geocode_resolve", ctes("geocode_events", "addresses") + ", e AS (SELECT *, trim(regexp_replace(lower(address), '\\s+', ' ', 'g')) AS key FROM geocode_events), cache AS (SELECT key, arg_max(lat, event_id) AS lat, arg_max(lon, event_id) AS lon FROM e WHERE event_id % 7 = 0 GROUP BY key), idx AS (SELECT concat(number, ' main st') AS key, arg_max(lat, line_no) AS lat, arg_max(lon, line_no) AS lon FROM addresses GROUP BY 1), r AS (SELECT e.event_id, CASE WHEN e.event_id % 5 = 0 THEN 'given' WHEN c.key IS NOT NULL THEN 'cache' WHEN i.key IS NOT NULL THEN 'index' ELSE 'unresolved' END AS source, CASE WHEN e.event_id % 5 = 0 THEN e.lat WHEN c.key IS NOT NULL THEN c.lat ELSE i.lat END AS lat, CASE WHEN e.event_id % 5 = 0 THEN e.lon WHEN c.key IS NOT NULL THEN c.lon ELSE i.lon END AS lon FROM e LEFT JOIN cache c USING (key) LEFT JOIN idx i USING (key)) SELECT event_id AS request_id, source, round(lat, 6) AS lat, round(lon, 6) AS lon, NOT (lat BETWEEN 32.5 AND 42.0 AND lon BETWEEN -124.5 AND -114.0) AS outside FROM r")
def t3(spark, sf_dir):
    e = fixture(spark, sf_dir, "geocode_events").withColumn("key", T.normalize_key(c("address")))
    given = c("event_id") % 5 == 0
    requests = e.select(c("event_id").alias("request_id"), "key", F.when(given, c("lat")).alias("lat"), F.when(given, c("lon")).alias("lon"))
    cache = e.filter("event_id % 7 = 0").groupBy("key").agg(F.max_by("lat", "event_id").alias("lat"), F.max_by("lon", "event_id").alias("lon"))
    index = fixture(spark, sf_dir, "addresses").groupBy(F.concat("number", F.lit(" main st")).alias("key")).agg(F.max_by("lat", "line_no").alias("lat"), F.max_by("lon", "line_no").alias("lon"))
    return A.geocode_resolve(requests, cache, index).select("request_id", "source", r6("lat").alias("lat"), r6("lon").alias("lon"), "outside")


@query("s12_upsert_geocodes", ctes("geocode_events") + "SELECT key, event_id FROM (SELECT *, trim(regexp_replace(lower(address), '\\s+', ' ', 'g')) AS key, row_number() OVER (PARTITION BY trim(regexp_replace(lower(address), '\\s+', ' ', 'g')) ORDER BY created_at DESC, event_id DESC) AS rn FROM geocode_events) WHERE rn = 1")
def s12(spark, sf_dir):
    e = fixture(spark, sf_dir, "geocode_events").withColumn("key", T.normalize_key(c("address")))
    return A.upsert_latest(e.filter("event_id % 3 = 0"), e.filter("event_id % 3 <> 0"), "key", ["created_at", "event_id"]).select("key", "event_id")


@query("h1_p30", ctes("sites") + "SELECT site_id, round(1 - pow(1 - site_id / 100000.0::DOUBLE, 30), 6) AS p30, round(1 - pow(1 - (site_id % 100) / 100.0::DOUBLE, 1.0 / 30), 6) AS annual FROM sites")
def h1(spark, sf_dir):
    i = c("site_id").cast("double")
    return fixture(spark, sf_dir, "sites").select("site_id", r6(H.p_horizon(i / 100000)).alias("p30"), r6(H.annual_from((c("site_id") % 100).cast("double") / 100)).alias("annual"))


@query("j12_backfill_postcode", ADDRESSES + ", near AS (SELECT line_no, zip FROM (SELECT a.line_no, z.zip, row_number() OVER (PARTITION BY a.line_no ORDER BY pow(a.lat - z.lat, 2) + pow(a.lon - z.lon, 2), z.zip) AS rn FROM clean a CROSS JOIN zu z WHERE a.postcode = '') WHERE rn = 1) SELECT line_no, coalesce(zip, postcode) AS postcode FROM clean LEFT JOIN near USING (line_no)".replace("CROSS JOIN zu z", "CROSS JOIN (" + ctes("zip_units").removeprefix("WITH zip_units AS (")[:-1] + ") z"))
def j12(spark, sf_dir):
    from terrarisk.operators import spatial as S

    a = A.normalize_address(fixture(spark, sf_dir, "addresses"))
    near = S.nearest_centroid(a.filter("postcode = ''"), fixture(spark, sf_dir, "zip_units"), "line_no", "zip")
    return a.join(near, "line_no", "left").select("line_no", F.coalesce("zip", "postcode").alias("postcode"))
