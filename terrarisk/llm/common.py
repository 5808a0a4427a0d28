"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, which bytes.split() and bytes.strip() use.
WHITE = b" \t\n\x0b\x0c\r"
#: Maps A-Z to a-z and leaves every other byte.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: The most words in a generation of a worker's cache, and the longest that it keeps.
CACHE_WORDS = 50_000
LONG_KEY = 64
#: Rows of the Arrow batches that take texts to Python.
TEXT_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that driver and executors share.

    The folder is ``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary folder; a cluster has
    none that is surely shared, and is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + os.path.abspath(base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: later steps don't compute it again."""
    return stored(df, name)[0]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As written, with the path, for remove()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def marks(doc_id: str = "doc_id") -> dict[str, Column]:
    """Two hashes that know a row by its id and text; null and repeated ids make no difference."""
    return {"ident": F.xxhash64(F.col(doc_id).cast("long"), "text"), "twin": F.xxhash64("text", F.lit(1))}


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, ident, twin, text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[v.alias(k) for k, v in marks().items()], "text")


def apart(docs: DataFrame, replaced: list[str]) -> tuple[DataFrame, list[Column]]:
    """(doc_id, text and the other columns under names that no operator uses, the columns that give docs back): so that no
    column of docs meets one of an operator's own. Columns in `replaced` go."""
    other = [c for c in docs.columns if c not in ("doc_id", "text", *replaced)]
    aside = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"_own{i}") for i, c in enumerate(other)])
    names = {c: f"_own{i}" for i, c in enumerate(other)} | {"doc_id": "doc_id", "text": "text"}
    return aside, [F.col(names[c]).alias(c) for c in docs.columns if c in names]


def met_in_buckets(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, buckets: int = 1 << 20, how: str = "leftsemi") -> DataFrame:
    """The rows of df whose key falls into a bucket of a wanted key: all that match, and few others ("leftanti": the rest).

    What is broadcast is a table of at most `buckets` numbers, whatever the tables' sizes; the join that follows this
    filter then shuffles few rows.
    """
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(buckets)).cast("int")
    there = wanted.select(place(wanted_key).alias("_bucket")).distinct()
    return df.withColumn("_bucket", place(key)).join(F.broadcast(there), "_bucket", how).drop("_bucket")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path that shared_dir() gave, once nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of df whose keys (hashes) aren't in gone. Only rows in a bucket of such a key are shuffled."""
    first = keys[0]
    maybe = met_in_buckets(df, F.col(first), gone, F.col(first))
    return met_in_buckets(df, F.col(first), gone, F.col(first), how="leftanti").unionByName(maybe.hint("merge").join(gone, keys, "left_anti"))


def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Lowers the session's rows of an Arrow batch to `rows`: a batch of 10,000 long texts takes hundreds of MB of an
    executor's memory outside its heap, for each task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null gives b""."""
    column = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with further columns at its end; a column of the same name is replaced."""
    keep = [i for i, n in enumerate(batch.schema.names) if n not in columns]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *columns.values()], names=[*(batch.schema.names[i] for i in keep), *columns])


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield each(batch)

    return df.mapInArrow(run, schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers (the finaliser of the splitmix64 generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def give_back() -> None:
    """Returns memory that a worker has freed to the system, as far as its allocators allow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Cache(dict):
    """key -> make(key), computed once by a worker while it is kept.

    A worker keeps the caches of one operator at a time: the first use of another operator's empties them. A full cache
    becomes the older of two generations; what is still used moves to the new one. Long keys aren't kept, so the bytes
    are bounded by `size`.
    """

    _of = ""
    _in_use: list[Cache] = []

    def __init__(self, make: Callable, of: str, size: int = CACHE_WORDS):
        self.make, self.of, self.size, self.older = make, of, size, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONG_KEY:
            self[key] = value
        return value

    @classmethod
    def only(cls, of: str) -> None:
        """Empties the caches of other operators than `of`; called by operators without a cache as well."""
        if not Cache._of:
            pa.set_memory_pool(pa.system_memory_pool())  # the default one keeps what batches have freed
        if Cache._of != of:
            for c in Cache._in_use:
                c.empty()
            Cache._of, Cache._in_use = of, []
            give_back()

    def empty(self) -> None:
        self.clear()
        self.older = {}

    def ready(self) -> None:
        """To be called before each text or block of texts."""
        Cache.only(self.of)
        if not any(c is self for c in Cache._in_use):
            Cache._in_use.append(self)
        if len(self) > self.size:
            self.older = dict(self)
            self.clear()
