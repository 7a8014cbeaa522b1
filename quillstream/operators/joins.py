"""Joins: semi and anti, lookups with defaults, intervals, related rows, pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def not_in(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows whose key stands nowhere in the other table; null keys stay."""
    return left.join(right.select(F.col(right_key).alias("_k")), F.col(left_key) == F.col("_k"), "left_anti")


def having(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows whose key stands in the other table; none is repeated."""
    return left.join(right.select(F.col(right_key).alias("_k")), F.col(left_key) == F.col("_k"), "left_semi")


def with_lookup(left: DataFrame, right: DataFrame, left_key: str, right_key: str, columns: dict[str, object]) -> DataFrame:
    """Columns of the one row of the other table that has the key, or their defaults. right: unique keys."""
    there = right.select(F.col(right_key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in columns))
    out = left.join(there, F.col(left_key) == F.col("_k"), "left")
    return out.select(*left.columns, *(F.coalesce(F.col(f"_{c}"), F.lit(d)).alias(c) if d is not None else F.col(f"_{c}").alias(c) for c, d in columns.items()))


def first_of_lookups(left: DataFrame, lookups: list[tuple[DataFrame, str, str]], left_key: str, name: str) -> DataFrame:
    """The value of the first of several tables (frame, key, value) that has the key."""
    out = left
    for i, (frame, key, value) in enumerate(lookups):
        there = frame.groupBy(F.col(key).alias(f"_k{i}")).agg(F.max(value).alias(f"_v{i}"))
        out = out.join(there, F.col(left_key) == F.col(f"_k{i}"), "left")
    return out.select(*left.columns, F.coalesce(*(F.col(f"_v{i}") for i in range(len(lookups)))).alias(name))


#: A range of days is 2 ** STEP ranges of the level below; level 0 has the days.
STEP = 2


def _day(c: Column) -> Column:
    return F.unix_date(c.cast("date"))


def _code(level: int | Column, place: Column) -> Column:
    """A range of days as one number."""
    return F.shiftleft(place, 5) + level


def _extent(events: DataFrame, at: str) -> tuple[int, int, int]:
    """The first day of the events, the number of days up to the last, and how many levels those need."""
    low, high = events.agg(F.min(_day(F.col(at))), F.max(_day(F.col(at)))).first()
    days = 0 if low is None else high - low + 1
    return low or 0, days, max(1, -(-max(0, days - 1).bit_length() // STEP))


def cut(spans: DataFrame, start: str, end: str, first: int, days: int, levels: int) -> DataFrame:
    """Spans with a row for each of the disjoint ranges (`_range`) that their days from start to end (inclusive, null: no end) are made of, of `days` days from `first` on: the days from place * 2 ** (STEP * level) on, so many; at most nine a level."""
    most, by = (1 << STEP) - 1, F.col("_level") * STEP
    right = lambda c: F.call_function("shiftright", c, by)
    whole = lambda c: F.shiftleft(F.shiftright(c, STEP), STEP)
    within = spans.where(F.col(start).isNotNull()).withColumns({"_a": F.greatest(_day(F.col(start)) - first, F.lit(0)), "_b": F.least(F.coalesce(_day(F.col(end)) - first + 1, F.lit(days)), F.lit(days))}).where("_a < _b")
    each = within.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumns({"_lo": right(F.col("_a") + F.call_function("shiftleft", F.lit(1), by) - 1), "_hi": right(F.col("_b"))}).where("_lo < _hi")
    # What whole ranges of the level above cover is left to it; the last level has none above.
    up, down = whole(F.col("_lo") + most), whole(F.col("_hi"))
    above = (F.col("_level") < levels - 1) & (up < down)
    ends = each.withColumns({"_up": F.when(above, up).otherwise(F.col("_hi")), "_down": F.when(above, down).otherwise(F.col("_hi"))})
    places = [F.when(F.col("_lo") + i < F.col("_up"), F.col("_lo") + i) for i in range(2 * most)] + [F.when(F.col("_down") + i < F.col("_hi"), F.col("_down") + i) for i in range(most)]
    return ends.withColumn("_place", F.explode(F.array(*places))).where("_place IS NOT NULL").select(*spans.columns, _code(F.col("_level"), F.col("_place")).alias("_range"))


def during(events: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Each event with the spans of its key that cover it; an open end covers all that follows.

    Spans are cut into ranges of days, of which a day lies in one at most, so cover is an equality of key, level and place: a hot key's
    rows are spread over its ranges, and no pair is looked at that the days rule out. Times within a day are compared last. Levels are as many as
    the events' days need. Cut spans are many times what Spark takes their table for, so both sides are shuffled and none is broadcast.
    """
    first, days, levels = _extent(events, at)
    s = spans.withColumnsRenamed({c: f"span_{c}" for c in spans.columns})
    parts = cut(s, f"span_{start}", f"span_{end}", first, days, levels)
    day = _day(F.col(at)) - first
    placed = events.where(F.col(at).isNotNull()).withColumn("_at", F.explode(F.array(*(_code(level, F.shiftright(day, STEP * level)) for level in range(levels)))))
    exact = (F.col(f"span_{start}") <= F.col(at)) & (F.col(f"span_{end}").isNull() | (F.col(f"span_{end}") >= F.col(at)))
    on = (F.col(key) == F.col(f"span_{key}")) & (F.col("_at") == F.col("_range"))
    return placed.hint("merge").join(parts.hint("merge"), on & exact).drop("_at", "_range")


def covers(events: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, name: str = "spans") -> DataFrame:
    """J22 without pairs: events with the number of spans of their key that cover their day.

    A day has as many as have begun by then, less those that have ended before. Both are summed by key and day first, so a key's window has a row per
    day at most, whatever the number of its spans and events.
    """
    from pyspark.sql import Window

    real = spans.where(F.col(key).isNotNull() & F.col(start).isNotNull() & (F.col(end).isNull() | (_day(F.col(end)) >= _day(F.col(start)))))
    begun = real.select(F.col(key).alias("_key"), _day(F.col(start)).alias("_day"), F.lit(1).alias("_n"), F.lit(False).alias("_asked"))
    ended = real.where(F.col(end).isNotNull()).select(F.col(key).alias("_key"), (_day(F.col(end)) + 1).alias("_day"), F.lit(-1).alias("_n"), F.lit(False).alias("_asked"))
    asked = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_key"), _day(F.col(at)).alias("_day"), F.lit(0).alias("_n"), F.lit(True).alias("_asked"))
    daily = begun.unionByName(ended).unionByName(asked).groupBy("_key", "_day").agg(F.sum("_n").alias("_n"), F.max("_asked").alias("_asked"))
    so_far = F.sum("_n").over(Window.partitionBy("_key").orderBy("_day").rowsBetween(Window.unboundedPreceding, 0))
    found = daily.withColumn("_spans", so_far).where("_asked").select("_key", "_day", "_spans")
    return events.join(found, (F.col(key) == F.col("_key")) & (_day(F.col(at)) == F.col("_day")), "left").select(*events.columns, F.coalesce("_spans", F.lit(0)).alias(name))


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, values: list[str], width: int = 1) -> DataFrame:
    """The latest row of the other table at or before each row's time; null keys and times find none.

    Both tables are one sequence, without pairs, in slots of a key's time (`width` days, or units where time is a number): the last value is carried
    forward within a slot, and from the slots before by a window over one row a slot, so that a hot key's rows are many tasks' work.
    """
    from pyspark.sql import Window

    kind = right.schema[right_at].dataType
    slot = F.floor((F.col("_at") if isinstance(kind, NumericType) else F.unix_date(F.col("_at").cast("date"))) / width)
    facts = right.where(F.col(key).isNotNull() & F.col(right_at).isNotNull()).select(F.col(key).alias("_key"), F.col(right_at).alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col(right_at).alias("at"), *(F.col(v).alias(f"v_{v}") for v in values)).alias("_found"))
    marked = left.select(F.col(key).alias("_key"), F.col(left_at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(facts.schema["_found"].dataType).alias("_found"), F.struct(*left.columns).alias("_row"))
    both = marked.unionByName(facts, allowMissingColumns=True).withColumn("_slot", slot)
    within = Window.partitionBy("_key", "_slot").orderBy("_at", "_kind", "_found").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("_key").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("_key", "_slot").agg(F.max("_found").alias("_found")).select("_key", "_slot", F.last("_found", ignorenulls=True).over(earlier).alias("_before"))
    own = both.withColumn("_found", F.last("_found", ignorenulls=True).over(within)).where("_kind = 1")
    found = own.join(carried, ["_key", "_slot"], "left").select("_row", F.coalesce("_found", "_before").alias("_found"))
    return found.select("_row.*", F.col("_found.at").alias("asof_at"), *(F.col(f"_found.v_{v}").alias(f"asof_{v}") for v in values))


def related(sessions: DataFrame, title_key: Column, days: int = 365) -> DataFrame:
    """Pairs of other sessions with an equal normal title within so many days. Equality on the title and on neighbouring windows of time, so that a common title's pairs stay within its windows."""
    rows = sessions.select(F.col("id"), F.col("date"), title_key.alias("key")).withColumn("bin", F.floor(F.datediff("date", F.lit("1970-01-01")) / days))
    other = rows.select(F.col("id").alias("other_id"), F.col("date").alias("other_date"), F.col("key").alias("other_key"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("other_bin"))
    joined = rows.join(other, (F.col("key") == F.col("other_key")) & (F.col("bin") == F.col("other_bin")) & (F.col("id") != F.col("other_id")) & (F.abs(F.datediff("date", "other_date")) <= days))
    return joined.select("id", "other_id", F.datediff("other_date", "date").alias("days"))


def related_summary(sessions: DataFrame, key: Column, days: int = 365) -> DataFrame:
    """J21, W10, O09 without pairs: of each session that has related ones, their number and the nearest (the smallest id of equally near ones).

    Sessions are counted by key and date first; a key's window then has a row per date at most, whatever the number of sessions.
    """
    from pyspark.sql import Window

    rows = sessions.select("id", "date", key.alias("key")).where("date IS NOT NULL AND key IS NOT NULL")
    daily = rows.groupBy("key", "date").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    again = rows.join(daily, ["key", "date"]).groupBy("key", "date").agg(F.min("n").alias("n"), F.min("first").alias("first"), F.min(F.when(F.col("id") != F.col("first"), F.col("id"))).alias("second"))
    day = F.unix_date("date")
    order = Window.partitionBy("key").orderBy(day)
    near = order.rangeBetween(-days, days)
    beside = lambda f: F.struct(F.abs(day - F.unix_date(f("date").over(order))).alias("d"), f("first").over(order).alias("other_id"))
    spread = again.withColumn("total", F.sum("n").over(near)).withColumn("before", beside(F.lag)).withColumn("after", beside(F.lead))
    within = lambda c: F.when(F.col(f"{c}.d") <= days, F.col(c))
    own = F.when(F.col("n") > 1, F.struct(F.lit(0).alias("d"), F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("other_id")))
    return rows.join(spread, ["key", "date"]).where("total > 1").select("id", (F.col("total") - 1).alias("n"), F.coalesce(own, F.least(within("before"), within("after"))).alias("_")).select("id", "n", F.col("_.d").alias("days"), F.col("_.other_id").alias("nearest_id"))


def enriched(left: DataFrame, dimension: DataFrame, key: str, column: str) -> DataFrame:
    """A column filled from a dimension (unique keys) where it is null."""
    there = dimension.select(F.col(key).alias("_k"), F.col(column).alias("_v"))
    return left.join(there, F.col(key) == F.col("_k"), "left").select(*(F.coalesce(F.col(c), F.col("_v")).alias(c) if c == column else F.col(c) for c in left.columns))


def by_position(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str, value: str) -> DataFrame:
    """The n-th row of a key with the other table's n-th row."""
    from pyspark.sql import Window

    a = left.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(left_order)))
    b = right.select(F.col(key).alias("_k"), F.col(value).alias(f"new_{value}"), F.row_number().over(Window.partitionBy(key).orderBy(right_order)).alias("_m"))
    return a.join(b, (F.col(key) == F.col("_k")) & (F.col("_n") == F.col("_m"))).drop("_k", "_m").withColumnRenamed("_n", "position")


def first_match(names: DataFrame, variants: Column, hits: DataFrame, hit_key: str, value: str, key: str) -> DataFrame:
    """Of name variants in order, the value of the first that hits."""
    tried = names.select(key, F.posexplode(variants).alias("_pos", "_variant"))
    found = tried.join(hits.select(F.col(hit_key).alias("_h"), F.col(value).alias("_v")), F.col("_variant") == F.col("_h"))
    return found.groupBy(key).agg(F.min(F.struct("_pos", "_v")).alias("_")).select(key, F.col("_._v").alias(value))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Bag union by name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
