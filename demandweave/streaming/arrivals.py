"""Landed files noticed as they arrive, and the tables that follow them month by month.

A file-source stream lists the landing folders and notes every new file in a Parquet log; which files it has
seen is kept by the stream's checkpoint. It reads no content and ends when it has caught up (AvailableNow),
so a run costs the listing. What was noted and not yet applied is then applied by whole months: a month's
partition is made anew from all files of the month and replaces the one before. A run that fails halfway
leaves its files noted but not applied, and the next run does the same months again with the same result.

Defined cases: a folder without files gives no months. A month that lacks one of the needed tables waits, its files
noted. A file replaced under its old name is not noticed, as the stream tells files by path: land a correction as a
further file. A month whose rows are all gone keeps no partition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import source_month_date
from ..session import stored
from ..sources.landing import _PATH

_LISTED = "path string, modificationTime timestamp, length long, content binary"
_APPLIED = "path string, month string, file string, run int"


def note_arrivals(spark: SparkSession, root: str, store: str, files_per_batch: int = 10_000) -> None:
    """Append every file below ``root`` that no earlier call has seen to the log ``<store>/arrivals``."""
    listed = spark.readStream.format("binaryFile").schema(_LISTED).option("recursiveFileLookup", True).option(
        "maxFilesPerTrigger", files_per_batch).load(root)
    noted = listed.select(
        "path", F.regexp_extract("path", _PATH, 1).alias("month"), F.regexp_extract("path", _PATH, 2).alias("file"),
        F.col("length").alias("size_bytes"))
    noted.writeStream.format("parquet").option("path", f"{store}/arrivals").option(
        "checkpointLocation", f"{store}/arrivals_checkpoint").trigger(availableNow=True).start().awaitTermination()


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def applied(spark: SparkSession, store: str) -> DataFrame:
    """(path, month, file, run) of every file that has been applied; runs count from 1."""
    return _read(spark, f"{store}/applied", _APPLIED)


def noted(spark: SparkSession, store: str) -> DataFrame:
    """(path, month, file, size_bytes) of every file seen so far."""
    return _read(spark, f"{store}/arrivals", "path string, month string, file string, size_bytes long")


def pending(spark: SparkSession, store: str, needs: Sequence[str] = ()) -> DataFrame:
    """Noted files that have not been applied, of months that have all tables in ``needs``."""
    files = noted(spark, store)
    new = files.join(applied(spark, store).select("path"), "path", "left_anti")
    if not needs:
        return new
    table = F.regexp_replace("file", r"\.[^.]*$", "")
    whole = files.select("month", table.alias("table")).where(F.col("table").isin(list(needs))).distinct().groupBy(
        "month").count().where(F.col("count") == len(set(needs)))
    return new.join(whole.select("month"), "month", "left_semi").select(*files.columns)


def catch_up(spark: SparkSession, root: str, store: str, apply: Callable[[list[str]], None],
             needs: Sequence[str] = ()) -> list[str]:
    """Note what has arrived, call ``apply`` with the months that have new files (oldest first) and record the
    files as applied. Returns those months; no call is made when there are none."""
    note_arrivals(spark, root, store)
    new = stored(pending(spark, store, needs), "arrived")  # what is noted from now on is for the next run
    # one row per month comes to the driver
    rows = new.select("month").distinct().orderBy(source_month_date(F.col("month")).asc_nulls_last(), "month").collect()
    months = [r["month"] for r in rows]
    if not months:
        return []
    run = (applied(spark, store).agg(F.max("run")).first()[0] or 0) + 1
    apply(months)
    new.select("path", "month", "file", F.lit(run).alias("run")).write.mode("append").parquet(f"{store}/applied")
    return months


def replace_months(df: DataFrame, path: str, months: Sequence[str], column: str = "SOURCE_MONTH") -> None:
    """Write the rows of ``months`` as partitions that replace the ones before; other months are not touched.

    Rows are rebalanced by month, so a month is a few files of the advised size and a large one many tasks' work.
    """
    spark, seen = df.sparkSession, Observation()
    out = df.where(F.col(column).isin(list(months))).observe(seen, F.collect_set(column).alias("months"))
    out.hint("rebalance", F.col(column)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for month in set(months) - set(seen.get["months"]):
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"{column}={month}"), True)
