"""JSON files that hold one large value, read by many tasks: elements of an array or members of an object.

A byte in the middle of such a file doesn't tell whether it lies in a string or how deep it is nested. So each byte range
is first scanned for what it does to both: whether it flips the quotes, and by how much it changes the depth if it starts
outside a string or inside one. Running sums over these (a row a range) give the true state at the start of each range; a
second scan counts the elements, which numbers them; the third reads the elements that begin in the range, past its end
where the last one needs it. All three scans run over ranges in parallel and hold a block of the file at a time.

Files are uncompressed UTF-8. Of broken files, what lies before the fault is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrarisk.sources.scratch import scratch_dir

SPLIT_BYTES = 64 << 20
BLOCK = 1 << 20
MAX_TASKS = 10_000
_STATE = "path string, start long, end long, quoted boolean, depth long"
_COUNTED = f"{_STATE}, opened boolean, carried long, own long"

#: 1 opens a container, -1 closes it, 2 divides its elements.
_KIND = np.zeros(256, np.int8)
_KIND[[ord("{"), ord("[")]] = 1
_KIND[[ord("}"), ord("]")]] = -1
_KIND[ord(",")] = 2


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    files, name = fs.FileSystem.from_uri(path)
    return files.open_input_file(name)


def _blocks(f, start: int, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Offset, bytes, and places of the quotes that open or close strings, block by block."""
    run = 0  # backslashes right before the block
    while run < start and f.read_at(1, start - run - 1) == b"\\":
        run += 1
    while start < end:
        raw = np.frombuffer(f.read_at(min(BLOCK, end - start), start), np.uint8)
        if not len(raw):
            return
        slash = raw == ord("\\")
        quotes = np.flatnonzero(raw == ord('"'))
        other = np.flatnonzero(~slash)
        if slash.any() or run:
            before = np.searchsorted(other, quotes) - 1  # the last other byte before each quote
            runs = np.where(before >= 0, quotes - 1 - other[before], quotes + run)
            quotes = quotes[runs % 2 == 0]
        yield start, raw, quotes
        run = len(raw) - 1 - int(other[-1]) if len(other) else run + len(raw)
        start += len(raw)


def _effect(f, start: int, end: int) -> tuple[bool, int, int]:
    """Whether a range flips the quotes, and its change of depth if it starts outside a string, or inside one."""
    flips, change = 0, [0, 0]
    for _, raw, quotes in _blocks(f, start, end):
        kind = _KIND[raw]
        at = np.flatnonzero(np.abs(kind) == 1)
        inside = (np.searchsorted(quotes, at) + flips) % 2
        for k in (0, 1):
            change[k] += int(kind[at[inside == k]].sum())
        flips = (flips + len(quotes)) % 2
    return bool(flips), change[0], change[1]


def _events(f, start: int, end: int, quoted: bool, depth: int, level: int) -> Iterator[tuple[int, np.ndarray, list[tuple[int, int]]]]:
    """Per block: offset, bytes, and (place, kind) of what opens, divides or closes containers of the level."""
    flips = int(quoted)
    for offset, raw, quotes in _blocks(f, start, end):
        at = np.flatnonzero(_KIND[raw])
        at = at[(np.searchsorted(quotes, at) + flips) % 2 == 0]
        kind = _KIND[raw[at]]
        after = depth + np.cumsum(np.where(kind == 2, 0, kind).astype(np.int64))
        edge = (kind > 0) & (after == level) | (kind == -1) & (after == level - 1)
        yield offset, raw, list(zip(at[edge].tolist(), kind[edge].tolist()))
        depth = int(after[-1]) if len(after) else depth
        flips = (flips + len(quotes)) % 2


def _wanted(f, at: int, member: str | None) -> bool:
    """Whether the container that opens here is the member's array; without a member every outermost one is wanted."""
    if member is None:
        return True
    back = min(at, 4096)
    head = f.read_at(back + 1, at - back).decode("utf-8", "replace")
    return re.search(r'"' + re.escape(member) + r'"\s*:\s*\[$', head) is not None


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000, chars: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, used = [], 0
    for r in rows:
        held.append(r)
        used += sum(len(v) for v in r if isinstance(v, str))
        if len(held) >= size or used >= chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), schema.types)], schema=schema)
            held, used = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), schema.types)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _each_range(work, ddl: str):
    """A mapInArrow function that gives work(file, row) for each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for r in batch.to_pylist():
                    with _open(r["path"]) as f:
                        yield from work(f, r)

        yield from _batches(rows(), _arrow(ddl))

    return run


def json_elements(spark: SparkSession, path: str, member: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, seq (from 0 in each file), value: the text of each element of the array that the outermost object has as
    `member`, or, without member, of each element (`"key": value` for objects) of the outermost array or object.

    Containers without elements give no row; null elements are elements. Files without the member give no row. If a file
    has the member twice, both arrays' elements are read, in order.
    """
    level = 1 if member is None else 2
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "length")
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long")))
    ranges = files.select("path", begin.alias("start"), "length").select("path", "start", F.least(F.col("start") + split_bytes, "length").alias("end"))
    tasks = max(1, min(MAX_TASKS, ranges.count()))
    scratch = scratch_dir(spark)

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{scratch}/{name}")
        return spark.read.parquet(f"{scratch}/{name}")

    def effect(f, r):
        yield (r["path"], r["start"], r["end"], *_effect(f, r["start"], r["end"]))

    def count(f, r):
        opened, carried, own = None, 0, 0
        for offset, _, events in _events(f, r["start"], r["end"], r["quoted"], r["depth"], level):
            for at, kind in events:
                if kind == 1:
                    opened = _wanted(f, offset + at, member)
                if kind > 0:
                    carried, own = carried + (opened is None), own + (opened is True)
        yield (r["path"], r["start"], r["end"], r["quoted"], r["depth"], opened, carried, own)

    def read(f, r):
        wanted, seq, held = r["wanted"], r["seq"], None
        for offset, raw, events in _events(f, r["start"], f.size(), r["quoted"], r["depth"], level):
            begin = 0
            for at, kind in events:
                if held is not None:
                    held += raw[begin:at].tobytes()
                    if held.strip():
                        yield (r["path"], seq, held.decode("utf-8", "replace").strip())
                        seq += 1
                    held = None
                if offset + at >= r["end"]:
                    return
                if kind == 1:
                    wanted = _wanted(f, offset + at, member)
                if kind > 0 and wanted:
                    held, begin = bytearray(), at + 1
            if held is not None:
                held += raw[begin:].tobytes()
            elif offset + len(raw) >= r["end"]:
                return

    effects = "path string, start long, end long, flips boolean, outside long, inside long"
    scanned = stored(ranges.repartition(tasks).mapInArrow(_each_range(effect, effects), effects), "effects")
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    quoted = scanned.withColumn("quoted", F.coalesce(F.sum(F.col("flips").cast("long")).over(earlier), F.lit(0)) % 2 == 1)
    change = F.when(F.col("quoted"), F.col("inside")).otherwise(F.col("outside"))
    state = quoted.withColumn("depth", F.coalesce(F.sum(change).over(earlier), F.lit(0))).select("path", "start", "end", "quoted", "depth")
    counted = stored(state.repartition(tasks).mapInArrow(_each_range(count, _COUNTED), _COUNTED), "counts")
    held = counted.withColumn("wanted", F.coalesce(F.last("opened", ignorenulls=True).over(earlier), F.lit(False)))
    n = F.col("own") + F.when(F.col("wanted"), F.col("carried")).otherwise(0)
    placed = held.withColumn("seq", F.coalesce(F.sum(n).over(earlier), F.lit(0))).filter(n > 0)
    out = "path string, seq long, value string"
    return placed.select("path", "start", "end", "quoted", "depth", "wanted", "seq").repartition(tasks).mapInArrow(_each_range(read, out), out)
