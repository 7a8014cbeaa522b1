"""Keyed state in a stream: the latest row of each key, and the states of staged rows.

Both give the same result wherever micro-batches are cut. What decides is the order of the events' own times and ids: the latest row is a maximum,
and a staged row's state is a fold over its events in that order. Events that may still be preceded by others (later than the watermark) are held
with the key; those before it are folded in and forgotten, so a key's state stays small.
"""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..operators.windows import first_per
from ..sources import sinks
from ..storage import new_path
from .incremental import bucket, finished

#: The state store that keyed state needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Which state may follow which; None is a row that is not there yet. Committed and rejected rows stay so.
LEGAL = {(None, "pending"), ("pending", "committed"), ("pending", "rejected"), ("pending", "errored"), ("errored", "pending")}


def with_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def latest(events: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """The row of each key with the largest values of `order`, then of the other columns by name; a key's state is that row, which a streaming aggregate holds, and a batch gives only the keys that it has rows of."""
    with_store(events.sparkSession)
    columns = [*order, *sorted(c for c in events.columns if c not in [*keys, *order])]
    stream = first_per(events.select(*keys, *columns), keys, columns, descending=True)
    # Each row that was the latest once, of which the largest stays: reduced before it is shuffled.
    return first_per(finished(stream, name, "update"), keys, columns, descending=True).select(*events.columns)


def step(state: tuple, at: datetime.datetime, to: str, ttl: datetime.timedelta) -> tuple:
    """A staged row's state (status, since, note, refused) after an event: what `_stepped` says of columns, row by row."""
    status, since, note, refused = expired(state, at, ttl)
    return (to, at, None, refused) if (status, to) in LEGAL else (status, since, note, refused + 1)


def expired(state: tuple, now: datetime.datetime, ttl: datetime.timedelta) -> tuple:
    """A row that has been pending for longer than ttl is in error since then."""
    status, since, _, refused = state
    return ("errored", since + ttl, "expired", refused) if status == "pending" and now > since + ttl else state


#: What is held of a staged row: its state over the events that are settled, and those that others may still precede.
STATE, EVENTS = "struct<status string, since timestamp, note string, refused long>", "array<struct<at timestamp, id long, to string>>"


def _expired(state: Column, now: Column, ttl: Column) -> Column:
    """`expired` of a column."""
    end = state["since"] + ttl
    late = F.coalesce((state["status"] == "pending") & (now > end), F.lit(False))
    own = F.when(late, F.lit("errored")).otherwise(state["status"]), F.when(late, end).otherwise(state["since"]), F.when(late, F.lit("expired")).otherwise(state["note"])
    return F.struct(*own, state["refused"]).cast(STATE)


def _stepped(state: Column, event: Column, ttl: Column) -> Column:
    """`step` of a column."""
    s = _expired(state, event["at"], ttl)
    legal = reduce(Column.__or__, (s["status"].eqNullSafe(F.lit(a)) & event["to"].eqNullSafe(F.lit(b)) for a, b in sorted(LEGAL, key=str)))
    moved = F.struct(event["to"], event["at"], F.lit(None).cast("string"), s["refused"]).cast(STATE)
    return F.when(legal, moved).otherwise(F.struct(s["status"], s["since"], s["note"], s["refused"] + 1).cast(STATE))


def _folded(state: Column, events: Column, ttl: Column) -> Column:
    return F.aggregate(events, state, lambda s, e: _stepped(s, e, ttl))


def staged_states(events: DataFrame, key: str, target: str, name: str, days: int, late: str = "1 day") -> DataFrame:
    """Events (key, at, id, to) move staged rows between the states of LEGAL; others are counted as refused. A row that is pending for more than `days` days of the events' time
    expires. Keeps the table `target` (key, status, since, note, refused), in buckets.

    What is held of a key is a row of a table of this run's own, in buckets, of which a batch writes those it touches. Events are late, and dropped, if they are no later than the watermark: the latest
    time of the batches before, less `late`. Events are folded in by expressions over a key's array of a batch's events and those still open, so many keys cost little more than their rows.
    """
    spark, held = events.sparkSession, new_path(events.sparkSession, f"{name}-held")
    ttl, kind = F.expr(f"INTERVAL {days} DAYS"), events.schema[key].dataType
    columns = [F.col(key), *(F.col(c).cast(t).alias(c) for c, t in (("at", "timestamp"), ("id", "long"), ("to", "string")))]

    def watermark(old: DataFrame | None) -> Column:
        seen = old.agg(F.unix_micros(F.max("seen") - F.expr(f"INTERVAL {late}"))).first()[0] if old is not None else None
        return F.timestamp_micros(F.lit(max(0, seen or 0)))

    def put(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        old = sinks.current(spark, held)
        settled = watermark(old)
        fresh = batch.select(*columns).where(F.coalesce(F.col("at") > settled, F.lit(True)))
        fresh = fresh.groupBy(key).agg(F.collect_list(F.struct("at", "id", "to")).cast(EVENTS).alias("_events"), F.max("at").alias("_seen"))
        if old is None:
            old = spark.createDataFrame([], StructType([StructField("_key", kind)])).select("_key", *(F.lit(None).cast(t).alias(c) for c, t in (("base", STATE), ("open", EVENTS), ("seen", "timestamp"))))
        else:
            old = old.select(F.col(key).alias("_key"), "base", "open", "seen")
        both = fresh.join(old, F.col(key).eqNullSafe(F.col("_key")), "left")
        start = F.coalesce("base", F.struct(F.lit(None), F.lit(None), F.lit(None), F.lit(0)).cast(STATE))
        both = both.select(key, start.alias("base"), F.array_sort(F.concat(F.coalesce("open", F.array().cast(EVENTS)), "_events")).alias("_all"), F.greatest("seen", "_seen").alias("seen"))
        before = lambda e: F.coalesce(e["at"] <= settled, F.lit(True))
        rows = both.select(key, _folded(F.col("base"), F.filter("_all", before), ttl).alias("base"), F.filter("_all", lambda e: ~before(e)).alias("open"), "seen")
        sinks.upsert(rows.withColumn("bucket", bucket([key])), held, [key], part="bucket")

    finished(events, name, "append", put)
    out = sinks.current(spark, held)
    if out is not None:
        said = out.select(key, _expired(_folded(F.col("base"), F.col("open"), ttl), watermark(out), ttl).alias("_"), "bucket")
        sinks.upsert(said.select(key, "_.*", "bucket"), target, [key], part="bucket")
    found = sinks.current(spark, target)
    return spark.createDataFrame([], StructType([StructField(key, kind)])).select(key, F.lit(None).cast(STATE).alias("_")).select(key, "_.*") if found is None else found.select(key, "status", "since", "note", "refused")


def staged_once(events: DataFrame, key: str, days: int) -> DataFrame:
    return staged_states(events, key, new_path(events.sparkSession, "staged"), "staged-run", days)
