"""Queries that write and read files, and streams over derived tables."""

from __future__ import annotations

import functools
import json
import struct

import pyarrow as pa
from pyspark.sql import functions as F

from terrarisk.functions import text as T
from terrarisk.operators import raster as R
from terrarisk.operators import spatial as S
from terrarisk.operators import stats as A
from terrarisk.sources import files as X
from terrarisk.sources.scratch import scratch_dir
from terrarisk.sources.sorted_text import prefix_lookup, write_sorted
from terrarisk.streaming import jobs
from terrarisk.streaming.stateful import earliest_addresses

from .fixtures import ctes, fixture
from .registry import query
from .site_queries import INSIDE, zones
from .table_queries import ADDRESSES

c = F.col


def r6(x):
    return F.round(x, 6)


@query("s2_read_address_lines", ctes("addresses") + "SELECT count(*) AS n, count(*) FILTER (line_no % 7 = 0) AS skipped, round(sum(CASE WHEN line_no % 7 = 0 THEN 0 ELSE lat END), 4) AS lat FROM addresses")
def s2(spark, sf_dir):
    """Some rows lose a coordinate, and every tenth line is followed by a blank one."""
    path = scratch_dir(spark)
    a = fixture(spark, sf_dir, "addresses")
    xy = F.when(c("line_no") % 7 == 0, F.array("lon")).otherwise(F.array("lon", "lat"))
    line = F.to_json(F.struct(F.struct("number", "street").alias("properties"), F.struct(F.lit("Point").alias("type"), xy.alias("coordinates")).alias("geometry")))
    a.select(F.when(c("line_no") % 10 == 0, F.concat(line, F.lit("\n"))).otherwise(line).alias("value")).write.text(path)
    got = X.read_address_lines(spark, path)
    return got.agg(F.count("*").alias("n"), F.count_if("skipped").alias("skipped"), F.round(F.sum(F.when(~c("skipped"), c("lat")).otherwise(0.0)), 4).alias("lat"))


@query("s3_read_csv", "SELECT CAST(n_nationkey + 1000 AS BIGINT) AS key_number, count(*) AS n FROM nation GROUP BY 1")
def s3(spark, sf_dir):
    """Keys with leading zeros stay text."""
    path = scratch_dir(spark)
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    n.select(F.format_string("0%d", c("n_nationkey") + 1000).alias("key"), "n_name").write.option("header", True).csv(path)
    got = X.read_csv(spark, path, "key string, n_name string", ["key"])
    return got.filter(F.length("key") == 5).groupBy(c("key").cast("long").alias("key_number")).agg(F.count("*").alias("n"))


@query("s4_read_delimited", ctes("soil_components") + "SELECT mukey, count(*) AS n FROM soil_components GROUP BY mukey")
def s4(spark, sf_dir):
    path = scratch_dir(spark)
    fixture(spark, sf_dir, "soil_components").write.option("sep", "|").csv(path)
    return X.read_delimited(spark, path, ["mukey", "cokey", "comppct_r"]).groupBy(c("mukey").cast("long").alias("mukey")).agg(F.count("*").alias("n"))


@query("s9_write_tiled", ctes("zone_vertices") + ", box AS (SELECT poly_id, floor(min(y) / 0.5) AS i0, floor(max(y) / 0.5) AS i1, floor(min(x) / 0.5) AS j0, floor(max(x) / 0.5) AS j1 FROM zone_vertices GROUP BY poly_id) SELECT DISTINCT CAST(ci AS BIGINT) || '_' || CAST(cj AS BIGINT) AS tile, true AS has_bytes FROM (SELECT unnest(range(i0::BIGINT, i1::BIGINT + 1)) AS ci, j0, j1 FROM box), LATERAL (SELECT unnest(range(j0::BIGINT, j1::BIGINT + 1)) AS cj)")
def s9(spark, sf_dir):
    return X.write_tiled(zones(spark, sf_dir), scratch_dir(spark), 0.5).select("tile", (c("bytes") > 0).alias("has_bytes"))


@query("s10_write_raster_tiles", ctes("raster_pixels") + "SELECT tile_id, CAST(1600 AS BIGINT) AS n, count(*) AS valid FROM raster_pixels GROUP BY tile_id HAVING count(*) >= 160")
def s10(spark, sf_dir):
    path = scratch_dir(spark)
    p = fixture(spark, sf_dir, "raster_pixels").select("tile_id", c("prow").alias("row"), c("pcol").alias("col"), "value")
    X.write_raster_tiles(R.to_array(p, 40, 40), path, 0.1)
    return spark.read.parquet(path).select("tile_id", F.size("data").cast("long").alias("n"), F.size(F.filter("data", lambda x: x.isNotNull())).cast("long").alias("valid"))


@query("s11_export_chunks", ADDRESSES + " SELECT count(*) AS n, CAST(sum(line_no) AS BIGINT) AS total FROM clean")
def s11(spark, sf_dir):
    path = scratch_dir(spark)
    X.export_chunks(A.normalize_address(fixture(spark, sf_dir, "addresses")).select("line_no", "address", "city"), path, "line_no", 1000)
    got = spark.read.text(path).select(F.regexp_extract("value", r"VALUES \('(\d+)'", 1).cast("long").alias("k"))
    return got.agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("s11_export_order", ADDRESSES + ", k AS (SELECT line_no, row_number() OVER (ORDER BY line_no) - 1 AS p FROM clean) SELECT p // 700 AS chunk, count(*) AS n, min(line_no) AS first, max(line_no) AS last FROM k GROUP BY 1")
def s11_order(spark, sf_dir):
    """Chunk by chunk: exact sizes, whole ranges of the order."""
    path = scratch_dir(spark)
    X.export_chunks(A.normalize_address(fixture(spark, sf_dir, "addresses")).select("line_no", "address", "city"), path, "line_no", 700)
    got = spark.read.text(path).select(c("chunk").cast("long").alias("chunk"), F.regexp_extract("value", r"VALUES \('(\d+)'", 1).cast("long").alias("k"))
    return got.groupBy("chunk").agg(F.count("*").alias("n"), F.min("k").alias("first"), F.max("k").alias("last"))


@query("s13_parse_policy_table", ctes("zip_units") + "SELECT zip, CAST(1000 + pif_2025 AS BIGINT) AS pif_2025, CAST(pif_2025 AS BIGINT) AS pif_2024 FROM zip_units WHERE pif_2025 IS NOT NULL")
def s13(spark, sf_dir):
    z = fixture(spark, sf_dir, "zip_units")
    line = F.when(c("pif_2025").isNull(), F.concat("zip", F.lit(" - -"))).otherwise(F.concat("zip", F.lit("  "), F.format_number(1000 + c("pif_2025").cast("int"), 0), F.lit(" 3.1% "), c("pif_2025").cast("string"), F.lit(" -2%")))
    return X.parse_policy_table(z.select(line.alias("value"))).select("zip", "pif_2025", "pif_2024")


LATEST = ctes("geocode_events") + "SELECT key, event_id FROM (SELECT *, trim(regexp_replace(lower(address), '\\s+', ' ', 'g')) AS key, row_number() OVER (PARTITION BY trim(regexp_replace(lower(address), '\\s+', ' ', 'g')) ORDER BY created_at DESC, event_id DESC) AS rn FROM geocode_events) WHERE rn = 1"


def streamed(df, path, files=3):
    """df written as files and read as a stream, one file a batch."""
    df.repartition(files).write.parquet(f"{path}/in")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


@query("st1_stream_geocode_cache", LATEST)
def st1(spark, sf_dir):
    path = scratch_dir(spark)
    return jobs.geocode_cache(streamed(fixture(spark, sf_dir, "geocode_events"), path), path).select("key", "event_id")


@query("st2_stream_displacement", ctes("displacement") + "SELECT frame_id, pixel_id, count(*) AS n, round(regr_slope(displacement_m, CAST(date_diff('day', DATE '2000-01-01', acq_date) AS DOUBLE)) * 1000, 3) AS slope FROM displacement WHERE displacement_m IS NOT NULL GROUP BY 1, 2")
def st2(spark, sf_dir):
    """Each batch writes the pixels that it changes; the last row of each equals the batch result."""
    path = scratch_dir(spark)
    d = fixture(spark, sf_dir, "displacement").withColumn("d", F.date_diff("acq_date", F.lit("2000-01-01").cast("date")).cast("double"))
    got = jobs.changes(jobs.displacement_state(streamed(d, path)), path, ["frame_id", "pixel_id"])
    return got.select("frame_id", "pixel_id", "n", F.round(c("slope") * 1000, 3).alias("slope"))


@query("st3_stream_velocity_windows", "WITH e AS (SELECT user_id % 3 AS frame_id, ts, CASE WHEN event_id % 10 <> 3 THEN value / 1000 END AS v FROM events), w AS (SELECT date_trunc('day', ts) AS day, frame_id, count(v) AS n FROM e GROUP BY 1, 2) SELECT strftime(day, '%Y-%m-%d') AS day, frame_id, n FROM w WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM e) - INTERVAL 1 HOUR")
def st3(spark, sf_dir):
    """Days that the watermark has passed; the last ones stay open."""
    path = scratch_dir(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((c("user_id") % 3).alias("frame_id"), c("ts").cast("timestamp").alias("ts"), F.when(c("event_id") % 10 != 3, c("value") / 1000).alias("displacement_m"))
    w = jobs.velocity_windows(streamed(e, path, 1), "1 day", "1 hour")
    q = w.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema("window struct<start:timestamp,end:timestamp>, frame_id long, n long, slope double").parquet(f"{path}/out")
    return got.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "frame_id", "n")


@query("st4_stream_reports", INSIDE + "SELECT s.site_id, z.fld_zone FROM sites s LEFT JOIN first_hit f USING (site_id) LEFT JOIN zone_attrs z USING (poly_id)")
def st4(spark, sf_dir):
    path = scratch_dir(spark)
    sites = fixture(spark, sf_dir, "sites").select("site_id", "lat", "lon")
    return jobs.site_reports(streamed(sites, path), zones(spark, sf_dir), path).select("site_id", "fld_zone")


@query("st5_stream_addresses", ADDRESSES + " SELECT count(DISTINCT (lower(address), lower(city))) AS n, true AS unique_keys FROM clean")
def st5(spark, sf_dir):
    path = scratch_dir(spark)
    a = fixture(spark, sf_dir, "addresses").withColumn("seen_at", F.timestamp_seconds(c("line_no")))
    first = jobs.first_addresses(streamed(a, path), "3650 days")
    q = first.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{path}/out")
    return got.agg(F.count("*").alias("n"), (F.count("*") == F.count_distinct("key")).alias("unique_keys"))


@query("st5_stream_first_in_order", ADDRESSES + " SELECT line_no FROM (SELECT line_no, row_number() OVER (PARTITION BY lower(address), lower(city) ORDER BY file_name, line_no) AS rn FROM clean) WHERE rn = 1")
def st5_order(spark, sf_dir):
    """The same rows as the batch form, though files arrive in any order."""
    path = scratch_dir(spark)
    a = fixture(spark, sf_dir, "addresses").withColumn("seen_at", F.timestamp_seconds(c("line_no")))
    first = earliest_addresses(streamed(a, path), ["file_name", "line_no"], "3650 days")
    return jobs.changes(first, path, ["key"]).select("line_no")


@query("s1_read_features", ctes("zone_vertices", "zone_attrs") + "SELECT fld_zone, count(DISTINCT poly_id) AS n, round(sum(x), 4) AS sx FROM zone_vertices JOIN zone_attrs USING (poly_id) GROUP BY fld_zone")
def s1(spark, sf_dir):
    """Collections of a bounded number of features, a file each, written and read back, each by several tasks, with rings."""
    path = scratch_dir(spark)
    z = zones(spark, sf_dir)
    one = X.features_json(z, ["fld_zone", "poly_id"]).withColumn("g", F.get_json_object("value", "$.properties.poly_id").cast("long") % F.lit(max(8, z.count() // 500)))
    files = one.groupBy("g").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("value"), ","), F.lit("]}")).alias("value"))
    files.select("value", "g").write.partitionBy("g").option("lineSep", "\n").text(path)
    points = F.flatten(F.flatten(F.transform("parts", lambda p: p["rings"])))
    got = X.read_features(spark, f"{path}/*/*.txt", "zones", 32 << 10).select(c("props")["fld_zone"].alias("fld_zone"), F.aggregate(points, F.lit(0.0), lambda a, q: a + q["x"]).alias("sx"))
    return got.groupBy("fld_zone").agg(F.count("*").alias("n"), F.round(F.sum("sx"), 4).alias("sx"))


TILE_BYTES = "WITH t AS (SELECT s_suppkey AS k, s_suppkey % 3 AS kind FROM supplier)"


@query("s5_read_raster_tiles", TILE_BYTES + " SELECT concat('t', CAST(k AS VARCHAR)) AS tile_key, 2 AS rows, 2 AS cols, round(32.0::DOUBLE + k * 0.1::DOUBLE, 6) AS south, CAST(3 * (k % 200) + 6 AS DOUBLE) AS total, CAST(1 AS BIGINT) AS missing FROM t WHERE kind <> 2")
def s5(spark, sf_dir):
    """Tiles in pairs with a sidecar (kind 0), with a header (kind 1), and short ones that give no tile (kind 2)."""
    path = scratch_dir(spark)
    t = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(c("s_suppkey").alias("k")).repartition(4, "k")

    def write(batches):
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(path)
        for name in ("pairs", "headed"):
            files.create_dir(f"{folder}/{name}", recursive=True)
        for batch in batches:
            for k in batch.column("k").to_pylist():
                v, south = [k % 200, k % 200 + 1, 65535, k % 200 + 5], 32.0 + k * 0.1
                if k % 3 == 1:
                    made = {f"headed/t{k}.bin": struct.pack("<2I2d4f", 2, 2, south, -118.0, *v[:2], -9999.0, v[3])}
                else:
                    made = {f"pairs/t{k}.bin": struct.pack("<4H", *v)[: 8 if k % 3 == 0 else 6], f"pairs/t{k}.json": json.dumps({"rows": 2, "cols": 2, "bounds": {"south": south, "west": -118.0}, "nodata": 65535}).encode()}
                for name, data in made.items():
                    with files.open_output_stream(f"{folder}/{name}") as out:
                        out.write(data)
            yield pa.RecordBatch.from_arrays([batch.column("k")], names=["k"])

    t.mapInArrow(write, "k long").write.format("noop").mode("overwrite").save()
    got = X.read_tile_pairs(spark, f"{path}/pairs").unionByName(X.read_headed_tiles(spark, f"{path}/headed"))
    total = F.aggregate("data", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return got.select("tile_key", "rows", "cols", r6("south").alias("south"), total.alias("total"), F.size(F.filter("data", lambda x: x.isNull())).cast("long").alias("missing"))


@query("s8_discover_inputs", "SELECT concat('f', CAST(n_nationkey AS VARCHAR), CASE n_nationkey % 3 WHEN 0 THEN '_sra.json' WHEN 1 THEN '_lra_sra.json' ELSE '_other.json' END) AS file, CASE WHEN n_nationkey % 3 = 0 THEN 'sra' WHEN n_nationkey % 3 = 1 THEN 'lra' END AS layer FROM nation")
def s8(spark, sf_dir):
    path = scratch_dir(spark)
    k = c("n_nationkey")
    name = F.concat(F.lit("f"), k.cast("string"), F.when(k % 3 == 0, "_sra.json").when(k % 3 == 1, "_lra_sra.json").otherwise("_other.json"))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(name.alias("name"))

    def write(batches):
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(path)
        files.create_dir(folder, recursive=True)
        for batch in batches:
            for x in batch.column("name").to_pylist():
                with files.open_output_stream(f"{folder}/{x}") as out:
                    out.write(b"{}")
            yield batch

    n.mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()
    return X.discover_inputs(spark, path, {"sra": (["sra"], ["lra"]), "lra": (["lra"], [])})


@query("s7_read_kv_json", ctes("zip_units") + "SELECT zip AS key, housing_units AS value FROM zip_units")
def s7(spark, sf_dir):
    """Objects of a bounded number of pairs, a file each, read back by several tasks."""
    path = scratch_dir(spark)
    z = fixture(spark, sf_dir, "zip_units")
    some = z.withColumn("g", F.pmod(F.xxhash64("zip"), F.lit(max(2, z.count() // 5000))))
    some.groupBy("g").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("zip", "housing_units")))).alias("value")).write.partitionBy("g").text(path)
    return X.read_kv_json(spark, f"{path}/*/*.txt", 32 << 10)


PREFIXES = ("10", "2", "399 e", "100 OAK")


@query("t1_sorted_lookup", ADDRESSES + ", q AS (SELECT unnest(['10', '2', '399 e', '100 OAK']) AS q) SELECT q, line_no AS address_id FROM (SELECT q, line_no, row_number() OVER (PARTITION BY q ORDER BY lower(address), line_no) AS rank FROM clean JOIN q ON length(q) >= 2 AND starts_with(lower(address), lower(q))) WHERE rank <= 6")
def t1_sorted(spark, sf_dir):
    """Addresses written in order once, then a lookup a prefix that opens only the files that hold it."""
    path = scratch_dir(spark)
    a = A.normalize_address(fixture(spark, sf_dir, "addresses")).select(c("line_no").alias("address_id"), "address")
    write_sorted(a, path, "address", "address_id")
    found = [prefix_lookup(spark, path, q, "address_id").select(F.lit(q).alias("q"), "address_id") for q in PREFIXES]
    return functools.reduce(lambda x, y: x.unionByName(y), found)
