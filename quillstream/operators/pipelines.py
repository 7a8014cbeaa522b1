"""Composite pipelines over speech rows and engagements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T
from ..functions.dates import in_range


def topic_sections(speeches: DataFrame, ministers: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """TC: speech rows to a row per date and title: deduplicated, in range, roles by name, the group's level and section.

    speeches: url, speaker, date, title, source, words, relevance, id. ministers: key (a person's key), role.
    """
    key = F.when(F.col("url").isNull(), F.concat(F.lit("id "), "id")).otherwise(F.concat_ws(" ", "url", "speaker"))
    row = F.struct("id", "speaker", "date", "title", "source", "words", "relevance")
    once = speeches.where(in_range(F.col("date"), start, end)).groupBy(key.alias("_key")).agg(F.min(row).alias("_")).select("_.*")
    roles = ministers.groupBy("key").agg(F.min("role").alias("role"))
    known = once.withColumn("key", T.person_key(F.col("speaker"))).join(roles, "key", "left")
    hits = F.count_if(F.col("relevance") > 50000)
    groups = known.groupBy("date", "title", "source").agg(F.count(F.lit(1)).alias("speeches"), F.bool_or(F.col("role").isNotNull()).alias("has_minister"), F.max("words").alias("longest"), F.when(hits >= 3, "high").when(hits >= 1, "medium").otherwise("low").alias("level"))
    return groups.withColumn("section", C.debate_section(F.col("title"), F.col("source"), F.col("longest")))


def department_scan(rows: DataFrame, bills_only: bool | None, themes: DataFrame, most: int = 120) -> DataFrame:
    """DS: contributions per title and date; the newest groups by theme, the rest in one bucket. rows: title, date, id. themes: title, theme."""
    bill = F.lower("title").rlike(r"\b(bill|amendment)\b")
    kept = rows if bills_only is None else rows.where(bill if bills_only else ~bill)
    groups = kept.groupBy(T.debate_key(F.col("title")).alias("title"), "date").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    newest = groups.orderBy(F.desc("date"), "id").limit(most).select("id", F.lit(True).alias("_new"))
    named = themes.groupBy("title").agg(F.min("theme").alias("theme"))
    marked = groups.join(newest, "id", "left").join(named, "title", "left")
    return marked.groupBy(F.when(F.col("_new").isNull(), "Older").otherwise(F.coalesce("theme", F.lit("General / Uncategorized"))).alias("theme")).agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("contributions"))


def stakeholder_timeline(sources: dict[str, DataFrame], start: str | None, end: str | None, most: int = 8) -> DataFrame:
    """SS: the newest rows of each source in range, in one list. Each frame: date, title, url."""
    from .joins import union_all
    from .windows import top_per

    every = union_all([df.select("date", "title", "url", F.lit(name).alias("source")) for name, df in sources.items()])
    return top_per(every.where(in_range(F.col("date"), start, end)), ["source"], [F.desc("date"), F.col("url"), F.col("title")], most)


def member_brief(members: DataFrame, speeches: DataFrame, questions: DataFrame, today: Column, days: int = 180) -> DataFrame:
    """MB, DP, S25, S44: per member the speeches and recent questions: counts, latest and most used heading. Each table is reduced to its members first."""
    s = speeches.where("member_id IS NOT NULL").groupBy("member_id").agg(F.count(F.lit(1)).alias("speeches"), F.max("date").alias("last_speech"))
    recent = questions.where(F.col("member_id").isNotNull() & (F.col("tabled_date") >= F.date_sub(today, days)))
    per = recent.groupBy("member_id", "heading").agg(F.count(F.lit(1)).alias("n"))
    q = per.groupBy("member_id").agg(F.sum("n").alias("questions"), F.max(F.struct("n", "heading")).alias("_")).select("member_id", "questions", F.col("_.heading").alias("top_heading"))
    joined = members.select(F.col("id").alias("member_id"), T.display_name(F.col("name")).alias("name")).join(s, "member_id", "left").join(q, "member_id", "left")
    return joined.select("member_id", "name", F.coalesce("speeches", F.lit(0)).alias("speeches"), "last_speech", F.coalesce("questions", F.lit(0)).alias("questions"), "top_heading")
