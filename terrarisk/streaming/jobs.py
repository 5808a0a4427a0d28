"""Structured Streaming jobs: incremental versions of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrarisk.functions import text as T
from terrarisk.operators import spatial as S
from terrarisk.operators import stats as A


def run_available(stream: DataFrame, name_path: str, each) -> None:
    """Works off what is there in micro-batches, each handed to `each(batch, id)`; a restart goes on after the last."""
    q = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{name_path}/checkpoint").foreachBatch(each).start()
    q.awaitTermination()


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions v0, v1, ... that were written to their end."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v*/_SUCCESS")) or []
    return sorted(int(str(f.getPath().getParent().getName())[1:]) for f in done)


def geocode_cache(events: DataFrame, path: str) -> DataFrame:
    """Upserts a stream of geocodes: batch n writes version n of the cache from the last one before it.

    Versions are found in storage, so a restart goes on from what is there, a replayed batch writes its version again
    from the same one, and a run without new files returns the last version.
    """
    spark = events.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("key", T.normalize_key(F.col("address")))
        before = [v for v in _versions(spark, path) if v < number]
        old = spark.read.parquet(f"{path}/v{before[-1]}") if before else new.limit(0)
        A.upsert_latest(old, new, "key", ["created_at", "event_id"]).write.mode("overwrite").parquet(f"{path}/v{number}")

    run_available(events, path, each)
    found = _versions(spark, path)
    if not found:
        empty = spark.createDataFrame([], events.schema)
        return empty.withColumn("key", T.normalize_key(F.col("address")))
    return spark.read.parquet(f"{path}/v{found[-1]}")


def velocity_windows(stack: DataFrame, window: str, late: str) -> DataFrame:
    """Slope per frame and tumbling window, with late data dropped; for append mode."""
    x = F.unix_timestamp("ts").cast("double") / 86400 / 365.25
    return stack.withWatermark("ts", late).groupBy(F.window("ts", window), "frame_id").agg(F.count("displacement_m").alias("n"), F.regr_slope("displacement_m", x).alias("slope"))


def displacement_state(stack: DataFrame) -> DataFrame:
    """Running sums per pixel from which slopes follow; for update mode, in which a batch gives the pixels it changes."""
    v, d = F.col("displacement_m"), F.col("d")
    return stack.filter(v.isNotNull()).groupBy("frame_id", "pixel_id").agg(F.count("*").alias("n"), F.regr_slope(v, d).alias("slope"))


def granules_once(stack: DataFrame) -> DataFrame:
    """Rows of granules that are delivered twice, in one file or in several, count once: the first to arrive stays."""
    return stack.dropDuplicates(["frame_id", "pixel_id", "acq_date"])


def changes(updates: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Works off what is there in update mode and returns the last row of each key, over all runs with this path.

    A batch writes only the rows that it changed, into a folder of its own, so nothing is written again as the table
    grows, and a replayed batch replaces its folder. State is kept by RocksDB, on executors' disks and in the checkpoint.
    """
    spark, name = updates.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")

    try:
        q = updates.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(each).start()
        q.awaitTermination()
    finally:
        spark.conf.set(name, before)
    wide = spark.read.schema(updates.schema.add("batch", "long")).parquet(f"{path}/changes")
    row = F.struct(*[c for c in updates.columns if c not in keys])
    return wide.groupBy(*keys).agg(F.max_by(row, "batch").alias("row")).select(*keys, "row.*")


def first_addresses(stream: DataFrame, late: str) -> DataFrame:
    """The first address per key as files arrive, remembered for the watermark's span."""
    keyed = A.normalize_address(stream).withColumn("key", F.concat_ws("|", F.lower("address"), F.lower("city")))
    return keyed.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["key"])


def site_reports(sites: DataFrame, zones: DataFrame, path: str) -> DataFrame:
    """A stream of sites against static zones, a report per micro-batch."""

    def each(batch: DataFrame, number: int) -> None:
        S.zone_lookup(batch, zones, ["fld_zone"]).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    run_available(sites, path, each)
    return sites.sparkSession.read.parquet(f"{path}/out")
