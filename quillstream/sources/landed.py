"""Landed rows of the remote interfaces in one form, and the small scans beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T

#: Columns of a speech row.
SPEECH_ROW = ["listurl", "body_clean", "body_export", "body_word_count", "speaker_name", "speaker_party", "hdate", "debate_title", "source", "source_label", "debate_type"]


def speech_rows(df: DataFrame, url: Column, body: Column, speaker: Column, date: Column, title: Column, source: Column) -> DataFrame:
    """Rows of any source as speech rows: text for display and export is cut, words are counted over all of it."""
    clean = T.clean_body(body)
    return df.select(
        url.alias("listurl"), F.substring(clean, 1, 500).alias("body_clean"), F.substring(clean, 1, 3000).alias("body_export"), F.when(clean == "", 0).otherwise(F.size(F.split(clean, r"\s+"))).alias("body_word_count"),
        T.attributed_name(speaker).alias("speaker_name"), T.trailing_party(speaker).alias("speaker_party"), date.alias("hdate"), title.alias("debate_title"), source.alias("source"), C.source_label(source).alias("source_label"), C.debate_label(title, source).alias("debate_type"),
    )


def without_errors(df: DataFrame) -> DataFrame:
    """Rows that carry no error."""
    return df.where("_error IS NULL").drop("_error") if "_error" in df.columns else df


def prioritised(frames: list[DataFrame], key: str) -> DataFrame:
    """An ordered union; of equal keys the row of the first frame that has it."""
    marked = [f.withColumn("_p", F.lit(i)) for i, f in enumerate(frames)]
    every = marked[0]
    for f in marked[1:]:
        every = every.unionByName(f, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in (key, "_p")]
    return every.groupBy(key).agg(F.min(F.struct("_p", *rest)).alias("_")).select(key, *(F.col(f"_.{c}").alias(c) for c in rest))


def completed(df: DataFrame, full: DataFrame, key: str, column: str, least: int = 300) -> DataFrame:
    """A text under so many characters gives way to the full one, where there is one."""
    there = full.select(F.col(key).alias("_k"), F.col(column).alias("_full"))
    short = F.length(column) < least
    return df.join(there, F.col(key) == F.col("_k"), "left").select(*(F.when(short, F.coalesce("_full", column)).otherwise(F.col(column)).alias(c) if c == column else F.col(c) for c in df.columns))


def id_list(spark: SparkSession, text: str | None, known: DataFrame, key: str) -> DataFrame:
    """The ids of a comma-separated list that are numbers; all known ones without a list."""
    if not (text or "").strip():
        return known.select(key).distinct()
    return spark.createDataFrame([(text,)], "t string").select(F.explode(F.split("t", ",")).alias(key)).select(F.trim(key).try_cast("long").alias(key)).where(F.col(key).isNotNull()).distinct()


def named_dimension(ids: DataFrame, dimension: DataFrame, key: str, name: str, label: str) -> DataFrame:
    """A dimension's rows by id, with a name made of the id for those it lacks."""
    there = dimension.select(F.col(key).alias("_k"), F.col(name).alias("_n"))
    return ids.join(there, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("_n", F.concat(F.lit(f"{label} "), F.col(key))).alias(name))


def first_feed(sites: DataFrame, paths: list[str], feeds: DataFrame) -> DataFrame:
    """Of each site's candidate paths in order, the first that is a known feed. sites: site. feeds: url."""
    tried = sites.select("site", F.posexplode(F.array(*map(F.lit, paths))).alias("_i", "_p")).withColumn("url", F.concat(F.rtrim("site", F.lit("/")), "_p"))
    return tried.join(feeds.select("url").distinct(), "url").groupBy("site").agg(F.min_by("url", "_i").alias("feed"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Names, sizes and times of a folder's objects; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def columns_of(tables: dict[str, DataFrame]) -> DataFrame:
    """Table, column and type of frames, for comparison with what is expected."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(t, c, k) for t, df in tables.items() for c, k in df.dtypes], "name string, column string, type string")


def vocabulary(spark: SparkSession, values: list[str] | dict[str, object]) -> DataFrame:
    """A list or the keys of a mapping as a small table, with the mapping's values as JSON."""
    import json

    rows = [(k, json.dumps(v)) for k, v in values.items()] if isinstance(values, dict) else [(v, None) for v in values]
    return spark.createDataFrame(rows, "value string, meta string")
