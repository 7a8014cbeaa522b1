"""Incremental work: look-back, new rows by key, late updates, windows over a stream of files.

The windowed streams are an extension; the other patterns are batch work in small steps. Each stream runs to the end of what
is there (available now) and its result is read back from the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks
from ..storage import new_path


def stream(spark: SparkSession, path: str, at: str, files_at_once: int = 1000) -> DataFrame:
    """A folder (or file) of Parquet as a stream, its event time as a timestamp in UTC."""
    schema = spark.read.parquet(path).schema
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        reader, path = reader.option("pathGlobFilter", place.getName()), place.getParent().toString()
    return reader.parquet(path).withColumn(at, F.col(at).cast("timestamp"))


def finished(df: DataFrame, name: str, mode: str, write: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs a stream over what is there. Whole results (complete) replace the ones before; others add a folder by the batch's number, which a batch that runs again overwrites."""
    spark = df.sparkSession
    out = new_path(spark, name)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows" + (f"/batch={number}" if mode != "complete" else ""))

    run = df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").foreachBatch(write or put).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows").select(*df.columns) if write is None else df


def windowed(events: DataFrame, at: str, keys: list[Column], width: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums per window and key; rows later than the watermark are dropped once their window is closed."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return events.withWatermark(at, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))


def sessions(events: DataFrame, at: str, key: str, gap: str, late: str = "1 day") -> DataFrame:
    """Runs of a key's events with no gap as long as this."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n"))


def deduplicated(events: DataFrame, at: str, keys: list[str], late: str = "14 days") -> DataFrame:
    """The first of rows with equal keys; keys are remembered as long as rows may be late."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def upserts(events: DataFrame, target: str, keys: list[str], order: list[str], name: str, part: str | None = None) -> DataFrame:
    """Keeps a target table at the latest row of each key, batch by batch. The latest has the largest values of `order`, then of the other columns by name, so batches
    may be cut anywhere. With `part`, a column that never changes for a key (such as `bucket`), a batch reads and writes only the values it touches."""
    from ..operators.windows import first_per

    def put(batch: DataFrame, _: int) -> None:
        columns = [*keys, *order, *sorted(c for c in batch.columns if c not in [*keys, *order])]
        sinks.upsert(first_per(batch.select(*columns), keys, order, descending=True).select(*batch.columns), target, keys, newer_by=order, part=part)

    finished(events, name, "append", put)
    return sinks.current(events.sparkSession, target)


def bucket(keys: list[str], n: int = 64) -> Column:
    """A number below n that never changes for a key: what a target is partitioned by."""
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def since(high_water: DataFrame, at: str, buffer_days: int, fallback: str) -> Column:
    """From when to read again, as a scalar subquery's value."""
    row = high_water.agg(F.date_sub(F.max(at), buffer_days)).first()[0]
    return F.coalesce(F.lit(row), F.lit(fallback).cast("date"))


def pruned(runs: DataFrame, at: str, now: Column, days: int = 90) -> DataFrame:
    """Rows that are no older than this."""
    return runs.where(F.col(at) >= now - F.expr(f"INTERVAL {days} DAYS"))
