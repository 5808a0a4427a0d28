"""Sources and sinks: GeoJSON, line JSON, delimited text, binary raster tiles, key-value JSON, tiled and chunked exports."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrarisk.functions.geometry import GEOMETRY
from terrarisk.operators import spatial as S
from terrarisk.sources.scratch import scratch_dir
from terrarisk.sources.splits import SPLIT_BYTES, json_elements

_PAIR = "array<double>"
_COORDINATES = {"Point": _PAIR, "LineString": f"array<{_PAIR}>", "MultiLineString": f"array<array<{_PAIR}>>", "Polygon": f"array<array<{_PAIR}>>", "MultiPolygon": f"array<array<array<{_PAIR}>>>"}


def parts_of(kind, text):
    """GeoJSON coordinates to parts of rings of points; a third coordinate is left out."""
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    ring = lambda r: F.transform(r, point)
    part = lambda rings: F.struct(rings.alias("rings"))
    read = lambda k: F.from_json(text, _COORDINATES[k])
    return (
        F.when(kind == "Point", F.array(part(F.array(F.array(point(read("Point")))))))
        .when(kind == "LineString", F.array(part(F.array(ring(read("LineString"))))))
        .when(kind == "MultiLineString", F.transform(read("MultiLineString"), lambda r: part(F.array(ring(r)))))
        .when(kind == "Polygon", F.array(part(F.transform(read("Polygon"), ring))))
        .when(kind == "MultiPolygon", F.transform(read("MultiPolygon"), lambda p: part(F.transform(p, ring))))
        .cast(GEOMETRY)
    )


def read_features(spark: SparkSession, path: str, layer: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """FeatureCollections: layer, seq (the order in the file), geom_type, props, parts. A large file is read by many tasks."""
    schema = "properties map<string,string>, geometry struct<type:string,coordinates:string>"
    rows = json_elements(spark, path, "features", split_bytes).select("seq", F.from_json("value", schema).alias("f"))
    return rows.select(F.lit(layer).alias("layer"), "seq", F.col("f.geometry.type").alias("geom_type"), F.col("f.properties").alias("props"), parts_of(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("parts"))


def read_address_lines(spark: SparkSession, path: str) -> DataFrame:
    """Line-delimited features; blank and corrupt lines go, and so do rows without two coordinates (see skipped)."""
    schema = "properties map<string,string>, geometry struct<type:string,coordinates:array<double>>, _bad string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    good = rows.filter("_bad is null")
    return good.select("properties", (F.size("geometry.coordinates") < 2).alias("skipped"), F.get("geometry.coordinates", F.lit(0)).alias("lon"), F.get("geometry.coordinates", F.lit(1)).alias("lat"))


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame:
    """Keys stay text by an explicit schema; only the columns asked for are parsed."""
    return spark.read.schema(schema).option("header", True).csv(path).select(*columns)


def read_delimited(spark: SparkSession, path: str, names: list[str], sep: str = "|") -> DataFrame:
    return spark.read.option("sep", sep).csv(path).toDF(*names)


def read_kv_json(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """key, value of JSON objects whose values are numbers; a large object is read by many tasks."""
    pair = F.from_json(F.concat(F.lit("{"), "value", F.lit("}")), "map<string,double>")
    return json_elements(spark, path, None, split_bytes).select(F.explode(pair).alias("key", "value"))


def read_raster_tiles(spark: SparkSession, path: str, rows: int, cols: int, dtype: str = "<u2", scale: float = 1.0, offset: float = 0.0, nodata: float | None = None) -> DataFrame:
    """Binary tiles (file name = tile_key), row-major from the south; buffers of another size go, missing values are NULL."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.bin$", 1).alias("tile_key"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            keys, data = [], []
            for key, content in zip(f.column("tile_key").to_pylist(), f.column("content").to_pylist()):
                if len(content) == rows * cols * np.dtype(dtype).itemsize:
                    raw = np.frombuffer(content, dtype)
                    v = raw / scale + offset
                    gone = ~np.isfinite(v) | ((raw == nodata) if nodata is not None else False)
                    keys.append(key)
                    data.append([None if g else float(x) for x, g in zip(v, gone)])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(data, pa.list_(pa.float64()))], names=["tile_key", "data"])

    return files.mapInArrow(run, "tile_key string, data array<double>")


_TILE = "tile_key string, rows int, cols int, south double, west double, data array<double>"


def _tile_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=[c.split()[0] for c in _TILE.split(", ")])


def _values(raw: np.ndarray, nodata: float | None) -> pa.Array:
    v = raw.astype(float)
    return pa.array(v, mask=~np.isfinite(v) | (v == nodata if nodata is not None else False)).to_pylist()


def read_tile_pairs(spark: SparkSession, path: str, dtype: str = "<u2") -> DataFrame:
    """Pairs name.bin and name.json (rows, cols, bounds, nodata): tile_key, rows, cols, south, west, data.

    A file without its pair and a buffer that is too short give no tile; values are as stored, missing ones NULL.
    """
    name = F.regexp_extract("path", r"([^/]+)\.(bin|json)$", 1)
    binary = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select(name.alias("tile_key"), "content")
    about = "rows int, cols int, nodata double, bounds struct<south:double,west:double>"
    sidecar = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select(name.alias("tile_key"), F.from_json(F.col("content").cast("string"), about).alias("s")).select("tile_key", "s.rows", "s.cols", "s.nodata", "s.bounds.south", "s.bounds.west")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            rows = []
            for r in f.to_pylist():
                raw = np.frombuffer(r["content"], dtype, len(r["content"]) // np.dtype(dtype).itemsize)
                n = (r["rows"] or 0) * (r["cols"] or 0)
                if 0 < n <= len(raw):
                    rows.append((r["tile_key"], r["rows"], r["cols"], r["south"], r["west"], _values(raw[:n], r["nodata"])))
            yield _tile_rows(rows)

    return binary.join(sidecar, "tile_key").mapInArrow(run, _TILE)


def read_headed_tiles(spark: SparkSession, path: str, nodata: float = -9999.0) -> DataFrame:
    """Tiles that describe themselves: two unsigned 32-bit integers (rows, cols), two doubles (south, west), then floats
    of 32 bits; as read_tile_pairs. Files that are too short give no tile."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select(F.regexp_extract("path", r"([^/]+)\.bin$", 1).alias("tile_key"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            out = []
            for r in f.to_pylist():
                if len(r["content"]) >= 24:
                    rows, cols, south, west = struct.unpack_from("<2I2d", r["content"])
                    if rows * cols and len(r["content"]) >= 24 + 4 * rows * cols:
                        out.append((r["tile_key"], rows, cols, south, west, _values(np.frombuffer(r["content"], "<f4", rows * cols, 24), nodata)))
            yield _tile_rows(out)

    return files.mapInArrow(run, _TILE)


def discover_inputs(spark: SparkSession, path: str, layers: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """file, layer: the first layer of whose words the name has one, and none of those it excludes."""
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    out = F.lit(None).cast("string")
    for layer, (words, without) in reversed(layers.items()):
        hit = F.regexp_like(name, F.lit("|".join(words)))
        if without:
            hit = hit & ~F.regexp_like(name, F.lit("|".join(without)))
        out = F.when(hit, layer).otherwise(out)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(name.alias("file"), out.alias("layer"))


def parse_policy_table(lines: DataFrame) -> DataFrame:
    """Lines of a printed table: zip, and the counts at odd places of the rest; lines without a count go."""
    m = lines.select(F.regexp_extract("value", r"^(\d{5})\s+(.+)$", 1).alias("zip"), F.split(F.regexp_extract("value", r"^(\d{5})\s+(.+)$", 2), r"\s+").alias("t")).filter("zip <> ''")
    years = [2025, 2024, 2023, 2022, 2021]
    count = lambda k: F.regexp_replace(F.get("t", F.lit(2 * k)), ",", "").try_cast("long")
    out = m.select("zip", *[count(k).alias(f"pif_{y}") for k, y in enumerate(years)])
    return out.filter(F.coalesce(*[f"pif_{y}" for y in years]).isNotNull())


def write_tiled(layer: DataFrame, path: str, cell: float) -> DataFrame:
    """Whole geometries in every tile that they touch, partitioned by tile; the manifest: tile, files, bytes."""
    S.cover_cells(layer, cell).drop("box").withColumn("tile", F.format_string("%d_%d", "ci", "cj")).repartition("tile").write.mode("overwrite").partitionBy("tile").parquet(path)
    files = layer.sparkSession.read.parquet(path).select("tile", "_metadata.file_path", "_metadata.file_size").distinct()
    return files.groupBy("tile").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))


def write_raster_tiles(tiles: DataFrame, path: str, min_valid: float = 0.0) -> None:
    """Tiles with a value above zero and enough valid pixels."""
    some = F.exists("data", lambda x: x > 0)
    share = F.size(F.filter("data", lambda x: x.isNotNull())) / F.size("data")
    tiles.filter(some & (share >= min_valid)).write.mode("overwrite").parquet(path)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with _row, the place of each row in the order (from 0), without a sort in one task.

    Ranges of the order are sorted and written with their rows' places; the ranges' sizes, summed up, are the offsets.
    Rows with equal keys lie in one range, ordered by their other columns.
    """
    rest = [c for c in df.columns if c not in order and "map" not in df.schema[c].dataType.simpleString()]
    path = f"{scratch_dir(df.sparkSession)}/ranges"
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    df.repartitionByRange(*order).sortWithinPartitions(*order, *rest).withColumns({"_range": F.spark_partition_id(), "_at": place}).write.parquet(path)
    back = df.sparkSession.read.parquet(path)
    sizes = back.groupBy("_range").agg(F.count("*").alias("n"))  # a row a range
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_range", before.alias("_offset"))
    return back.join(F.broadcast(offsets), "_range").withColumn("_row", F.col("_offset") + F.col("_at")).drop("_range", "_at", "_offset")


def export_chunks(df: DataFrame, path: str, order: str | list[str], rows_per_file: int = 100_000) -> None:
    """INSERT statements with quotes doubled, in order, in one file a folder chunk=0, chunk=1 and so on: every file but the
    last has exactly rows_per_file rows. An empty table gives no file."""
    order = [order] if isinstance(order, str) else order
    quoted = [F.when(F.col(c).isNull(), "NULL").otherwise(F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))) for c in df.columns]
    text = F.concat(F.lit(f"INSERT INTO t ({', '.join(df.columns)}) VALUES ("), F.concat_ws(", ", *quoted), F.lit(");"))
    lines = numbered(df, order).select(F.floor(F.col("_row") / rows_per_file).alias("chunk"), "_row", text.alias("value"))
    lines.repartition("chunk").sortWithinPartitions("chunk", "_row").select("chunk", "value").write.mode("overwrite").partitionBy("chunk").text(path)


def features_json(layer: DataFrame, props: list[str]) -> DataFrame:
    """A row of GeoJSON text per polygon feature."""
    ring = lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.transform("parts", lambda p: F.transform(p["rings"], ring)).alias("coordinates"))
    return layer.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*props).alias("properties"), geometry.alias("geometry"))).alias("value"))
