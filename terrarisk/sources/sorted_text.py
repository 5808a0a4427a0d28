"""A table laid out in the order of a lower-case text, so that a prefix reads only the files that hold it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_sorted(df: DataFrame, path: str, text: str, key: str, files: int | None = None) -> None:
    """df in files that are ranges of lower-case `text`, ties by `key`, and beside them a table of the files' bounds.

    Null texts match no prefix and are left out. Rows with equal texts are ranged by key, so that a frequent text fills
    several files.
    """
    by = [F.col("_low"), F.col(key)]
    keyed = df.withColumn("_low", F.lower(text)).filter("_low is not null")
    ranged = keyed.repartitionByRange(files, *by) if files else keyed.repartitionByRange(*by)
    ranged.sortWithinPartitions(*by).write.mode("overwrite").parquet(f"{path}/rows")
    back = df.sparkSession.read.parquet(f"{path}/rows")
    bounds = back.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("_low").alias("low"), F.max("_low").alias("high"), F.min_by(F.struct("_low", key), F.struct("_low", key)).alias("first"), F.count("*").alias("n"))
    bounds.write.mode("overwrite").parquet(f"{path}/bounds")


def files_of_prefix(spark: SparkSession, path: str, prefix: str, limit: int | None = None) -> list[str]:
    """Files that may hold texts with the prefix, in order; with a limit no more than its first rows need."""
    low = prefix.lower()
    cut = F.substring("high", 1, len(low)) >= low  # bounds cut to the prefix's length compare as the prefix does
    hold = spark.read.parquet(f"{path}/bounds").filter(cut & (F.substring("low", 1, len(low)) <= low))
    if limit is not None:
        whole = F.when(F.col("low").startswith(low) & F.col("high").startswith(low), F.col("n")).otherwise(0)
        before = F.coalesce(F.sum(whole).over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a file
        hold = hold.withColumn("_before", before).filter(F.col("_before") < limit)
    return [r.file for r in hold.orderBy("first").select("file").collect()]


def prefix_lookup(spark: SparkSession, path: str, prefix: str, key: str, limit: int | None = 6) -> DataFrame:
    """The first rows (all without a limit), by lower-case text and key, whose text starts with the prefix, without case.

    A prefix under two characters finds nothing. Only files whose bounds allow it are opened, and in them only the row
    groups whose statistics do.
    """
    rows, low = spark.read.parquet(f"{path}/rows"), prefix.lower()
    files = files_of_prefix(spark, path, prefix, limit) if len(prefix) >= 2 else []
    if not files:
        return rows.filter("false").drop("_low")
    found = spark.read.schema(rows.schema).parquet(*files).filter((F.col("_low") >= low) & F.col("_low").startswith(low))
    return (found.orderBy("_low", key).limit(limit) if limit is not None else found).drop("_low")
