"""Checks of tables against each other, one row per check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, column: str, allowed: DataFrame | list[str]) -> DataFrame:
    """Rows whose value is in no vocabulary; null is allowed."""
    if isinstance(allowed, list):
        return df.where(~F.col(column).isin(allowed))
    return df.where(F.col(column).isNotNull()).join(allowed.select(F.col(allowed.columns[0]).alias("_v")), F.col(column) == F.col("_v"), "left_anti")


def checked_value(value: str, vocabulary: dict[str, list[str]], name: str) -> str:
    """The value; errors of three kinds for an unknown vocabulary, an empty one and a value that isn't in it."""
    if name not in vocabulary:
        raise KeyError(f"no vocabulary {name}")
    if not vocabulary[name]:
        raise RuntimeError(f"vocabulary {name} is empty, so nothing can be written yet")
    if value not in vocabulary[name]:
        raise ValueError(f"{value!r} is not in {name}")
    return value


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """Check and its number of issues, in one job."""
    each = [df.select(F.lit(name).alias("check")) for name, df in checks.items()]
    names = each[0].sparkSession.createDataFrame([(n,) for n in checks], "check string")
    counted = reduce(DataFrame.union, each).groupBy("check").agg(F.count(F.lit(1)).alias("_n"))
    return names.join(counted, "check", "left").select("check", F.coalesce("_n", F.lit(0)).alias("issues"))


def reclassified(df: DataFrame, old: str, new: str) -> DataFrame:
    """How many rows change from one class to another."""
    return df.where(~F.col(old).eqNullSafe(F.col(new))).groupBy(old, new).agg(F.count(F.lit(1)).alias("n"))


def over_cap(df: DataFrame, owner: str, cap: int) -> DataFrame:
    """Owners at or over their number of rows."""
    return df.groupBy(owner).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= cap)


def retention(keys: DataFrame, at: str, today, daily: int = 30, weekly: int = 84) -> DataFrame:
    """BR: what becomes of each backup: keep, promote (an older Monday), keep weekly, delete. keys: kind (daily or weekly) and a date."""
    age = F.datediff(today, at)
    action = F.when((F.col("kind") == "weekly") & (age <= weekly), "keep").when(F.col("kind") == "weekly", "delete").when(age <= daily, "keep").when(F.weekday(at) == 0, "promote").otherwise("delete")
    return keys.withColumn("action", action)


def guarded(plan: DataFrame, most_daily: int = 60, most_weekly: int = 15) -> DataFrame:
    """BR: the plan, or an error if it would delete too much."""
    n = {r["kind"]: r["n"] for r in plan.where("action = 'delete'").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per kind
    if n.get("daily", 0) > most_daily or n.get("weekly", 0) > most_weekly:
        raise RuntimeError(f"too many deletions: {n}")
    return plan
