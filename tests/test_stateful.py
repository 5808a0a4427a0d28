"""Streams in update mode: restart, replay, repeated and late rows."""

import datetime as dt

from terrarisk.streaming import jobs
from terrarisk.streaming.stateful import earliest_addresses

PIXELS = "frame_id long, pixel_id long, acq_date date, d double, displacement_m double"
LINES = "file_name string, line_no long, number string, street string, unit string, city string, postcode string, lat double, lon double, seen_at timestamp"


def day(k):
    return dt.date(2024, 1, 1) + dt.timedelta(days=k)


def granule(spark, path, rows):
    spark.createDataFrame(rows, PIXELS).coalesce(1).write.mode("append").parquet(f"{path}/in")


def trend(spark, path):
    stack = spark.readStream.schema(PIXELS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    got = jobs.changes(jobs.displacement_state(jobs.granules_once(stack)), path, ["frame_id", "pixel_id"])
    return {r.pixel_id: (r.n, None if r.slope is None else round(r.slope, 9)) for r in got.collect()}


def test_displacement_goes_on_and_writes_what_changed(spark, tmp_path):
    path = f"file://{tmp_path}"
    granule(spark, path, [(1, p, day(k), float(k), p * k * 0.5) for p in (1, 2) for k in (0, 1)] + [(1, 3, day(0), 0.0, None)])
    assert trend(spark, path) == {1: (2, 0.5), 2: (2, 1.0)}
    granule(spark, path, [(1, 1, day(3), 3.0, 4.5), (1, 1, day(1), 1.0, 99.0)])  # the second date came before
    assert trend(spark, path) == {1: (3, 1.571428571), 2: (2, 1.0)}
    last = spark.read.parquet(f"{path}/changes/batch=1")
    assert [r.pixel_id for r in last.collect()] == [1]  # only the changed pixel is written again
    assert trend(spark, path)[1][0] == 3  # nothing new: the same table


def line(name, no, number, seen, street="Main"):
    return (name, no, number, street, None, "Town", "90001", 34.0, -118.0, dt.datetime(2024, 1, 1) + dt.timedelta(days=seen))


def first(spark, path, rows, keep_days=3650):
    spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    got = jobs.changes(earliest_addresses(stream, ["file_name", "line_no"], "10 days", keep_days * 86_400_000), path, ["key"])
    return sorted((r.number, r.file_name, r.line_no) for r in got.collect())


def test_first_address_whatever_arrives_first(spark, tmp_path):
    path = f"file://{tmp_path}"
    assert first(spark, path, [line("b", 5, "1", 0), line("b", 3, "1", 0), line("b", 9, "2", 0)]) == [("1", "b", 3), ("2", "b", 9)]
    assert first(spark, path, [line("a", 7, "1", 1), line("c", 1, "2", 1)]) == [("1", "a", 7), ("2", "b", 9)]
    assert first(spark, path, [line("z", 1, "3", 100)]) == [("1", "a", 7), ("2", "b", 9), ("3", "z", 1)]
    late = first(spark, path, [line("a", 1, "1", 2), line("y", 1, "3", 99)])  # the first is beyond the watermark
    assert late == [("1", "a", 7), ("2", "b", 9), ("3", "y", 1)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_keys_are_forgotten(spark, tmp_path):
    path = f"file://{tmp_path}"
    first(spark, path, [line("b", 5, "1", 0)], 20)
    first(spark, path, [line("b", 6, "2", 100)], 20)
    first(spark, path, [line("b", 7, "2", 101)], 20)
    assert first(spark, path, [line("c", 8, "1", 102)], 20) == [("1", "c", 8), ("2", "b", 6)]  # seen anew
