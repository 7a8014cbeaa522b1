"""What the windows do: first rows, neighbours, ranks within groups, collisions, pages of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import kept


def first_per(df: DataFrame, keys: list[str], order: list[str], descending: bool = False) -> DataFrame:
    """The first row of each key. An aggregate of one struct: rows are reduced before they are shuffled, and no key's rows are sorted in one task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    return df.groupBy(*keys).agg((F.max(row) if descending else F.min(row)).alias("_")).select(*keys, *(F.col(f"_.{c}").alias(c) for c in [*order, *rest])).select(*df.columns)


def neighbours(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The previous and the next value of `order` within the keys."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("previous", F.lag(order).over(w)).withColumn("next", F.lead(order).over(w))


def top_per(df: DataFrame, keys: list[str], order: list[Column], limit: Column | int) -> DataFrame:
    """The first so many rows of each key; the limit may differ by key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("position", n).where(F.col("position") <= limit)


def collision_free(df: DataFrame, slug: Column, longer: Column, longest: Column) -> DataFrame:
    """A slug; where several rows share it the longer form for all of them, and once more. Shared slugs are counted first, so no slug's rows meet in one task; rows are written with their slug, so it is made once."""

    def shared(rows: DataFrame, c: str) -> DataFrame:
        return rows.groupBy(F.col(c).alias("_c")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_c", F.lit(True).alias("_twice"))

    def replaced(rows: DataFrame, c: str, by: Column, name: str) -> DataFrame:
        return rows.join(shared(rows, c), F.col(c).eqNullSafe(F.col("_c")), "left").withColumn(name, F.when(F.col("_twice"), by).otherwise(F.col(c))).drop("_c", "_twice")

    once = replaced(kept(df.withColumn("_s", slug), "slugs"), "_s", longer, "_t")
    return replaced(once, "_t", longest, "slug").drop("_s", "_t")


def placed_in_groups(df: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """Each row with its position (from 1) in its group, by a number that rows are ordered by. No group's rows meet in one task or cell."""
    group = df.withColumn("_group", F.struct(*keys))
    return with_total_before(group, "_group", [order], F.lit(1), "_before").select(*df.columns, (F.col("_before") + 1).alias("position"))


def page_of_groups(df: DataFrame, keys: list[str], order: list[Column], page: int, size: int = 7) -> DataFrame:
    """The rows of a page of groups, each with its position in its group. The page's keys are a top-k of the groups; only their rows go on."""
    groups = df.select(*keys).distinct().orderBy(*order).offset((page - 1) * size).limit(size)
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_page_{k}"))
    # `size` rows: a proven bound for the broadcast.
    mine = df.join(F.broadcast(groups.select(*(F.col(k).alias(f"_page_{k}") for k in keys))), on, "left_semi")
    return placed_in_groups(mine, keys)


def one_per_week(df: DataFrame, at: str, key: str) -> DataFrame:
    """The first backup of each ISO week's Mondays."""
    mondays = df.where(F.weekday(at) == 0)
    return mondays.groupBy(F.date_trunc("week", at).cast("date").alias("week")).agg(F.min(key).alias(key))


def latest_day_with_data(df: DataFrame, at: str, today: Column, back: int = 5) -> DataFrame:
    """The last of the days before today that has rows."""
    return df.where(F.col(at).between(F.date_sub(today, back), F.date_sub(today, 1))).agg(F.max(at).alias("day"))


def with_total_before(rows: DataFrame, key: str, order: list[str], amount: Column, name: str, width: int = 64, below: int | None = None) -> DataFrame:
    """name: the sum of `amount` over a key's earlier rows (order's first column is a number, nulls last); with `below`, only rows whose sum is less.

    Totals are made by key and bin (`width` numbers of the first column) first, so no task has to hold or sort all rows of a key.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = rows.withColumn("_bin", F.coalesce(F.floor(F.col(order[0]) / width), F.lit((1 << 63) - 1))).withColumn("_amount", amount.cast("long"))
    bins = held.groupBy(key, "_bin").agg(F.sum("_amount").alias("_all"))
    bins = bins.select(key, "_bin", (F.sum("_all").over(Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_all")).alias("_from"))
    if below is not None:
        bins = bins.where(F.col("_from") < below)
    earlier = Window.partitionBy(key, "_bin").orderBy(*(F.col(c).asc_nulls_last() for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    # Dealt out by number, as rows that compress well would be put into few tasks; summed before the join, which takes the window's order, so a task sorts its rows once.
    within = held.repartition(n, key, "_bin").withColumn("_within", F.sum("_amount").over(earlier) - F.col("_amount"))
    out = within.join(bins, [key, "_bin"]).withColumn(name, F.col("_from") + F.col("_within"))
    return (out if below is None else out.where(F.col(name) < below)).drop("_bin", "_amount", "_from", "_within")


def joined_text(rows: DataFrame, key: str, order: list[str], text: str, most: int) -> DataFrame:
    """A key's texts (null and empty ones left out) in order with a space between, cut at `most` characters; only the texts that begin before are collected."""
    begun = with_total_before(rows.where(F.col(text) != ""), key, order, F.length(text) + 1, "_at", below=most)
    parts = F.array_sort(F.collect_list(F.struct("_at", F.substring(text, 1, most).alias("_t"))))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = begun.select(key, "_at", text).repartition(n, key).groupBy(key).agg(F.substring(F.array_join(F.transform(parts, lambda x: x["_t"]), " "), 1, most).alias("text"))
    keys = rows.where(F.col(key).isNotNull()).select(key).distinct()
    return keys.join(found, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))
