"""What tables consist of, read from Parquet footers, and vocabularies from files.

A footer tells a file's columns, types, row groups and their ranges without its rows. Footers are read in tasks, a file each; what is
scanned grows with the number of files and not with their rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import files_of

FOOTERS = "name string, file string, row_group int, column string, position int, type string, rows long, nulls long, low string, high string, compressed long, uncompressed long, codec string"
#: Types by what a footer calls them.
LOGICAL = {"STRING": "VARCHAR", "DATE": "DATE", "JSON": "JSON"}
PHYSICAL = {"BOOLEAN": "BOOLEAN", "INT32": "INTEGER", "INT64": "BIGINT", "INT96": "TIMESTAMP", "FLOAT": "FLOAT", "DOUBLE": "DOUBLE", "BYTE_ARRAY": "BLOB", "FIXED_LEN_BYTE_ARRAY": "BLOB"}


def _type(column: object) -> str:
    """A leaf column's type as SQL says it; a list's has brackets."""
    logical = json.loads(column.logical_type.to_json()) if column.logical_type.type != "NONE" else {}
    kind = logical.get("Type", "NONE").upper()
    if kind == "TIMESTAMP":
        base = "TIMESTAMP" + {"nanoseconds": "_NS", "milliseconds": "_MS"}.get(logical.get("timeUnit"), "") + (" WITH TIME ZONE" if logical.get("isAdjustedToUTC") else "")
    elif kind == "DECIMAL":
        base = f"DECIMAL({logical['precision']},{logical['scale']})"
    else:
        base = LOGICAL.get(kind, PHYSICAL[column.physical_type])
    return base + "[]" * column.max_repetition_level


def footers(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each file, row group and leaf column of Parquet tables, given by name; low and high are texts of its range, null where the footer has none (or the table no rows)."""
    files = spark.createDataFrame([(name, file) for name, df in tables.items() for file in df.inputFiles()], "name string, file string")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.parse import unquote

        import pyarrow.parquet as pq

        for frame in frames:
            for name, file in zip(frame["name"], frame["file"], strict=True):
                system, path = files_of(unquote(file))
                with system.open_input_file(path) as source:
                    footer = pq.ParquetFile(source).metadata
                first = {}
                for k in range(footer.num_columns):
                    first.setdefault(footer.schema.column(k).path.split(".")[0], len(first))
                rows = []
                for group in range(footer.num_row_groups):
                    part = footer.row_group(group)
                    for k in range(part.num_columns):
                        leaf, chunk = footer.schema.column(k), part.column(k)
                        stats = chunk.statistics if chunk.is_stats_set else None
                        top = leaf.path.split(".")[0]
                        ranged = stats is not None and stats.has_min_max
                        rows.append((name, file, group, top, first[top], _type(leaf), part.num_rows, stats.null_count if stats is not None and stats.has_null_count else None, str(stats.min) if ranged else None, str(stats.max) if ranged else None, chunk.total_compressed_size, chunk.total_uncompressed_size, chunk.compression))
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in FOOTERS.split(", ")], dtype=object)

    return files.repartition(max(1, min(files.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))).mapInPandas(read, FOOTERS)


def catalogue(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """A row per table and column: name, column, position, type (types, if files differ), rows, nulls, low and high (of whole numbers), bytes, files and row groups."""
    number = lambda c: F.when(F.col("type").isin("INTEGER", "BIGINT"), F.col(c).try_cast("long"))
    return footers(spark, tables).groupBy("name", "column").agg(
        F.min("position").alias("position"), F.array_join(F.array_sort(F.collect_set("type")), " | ").alias("type"), F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"),
        F.min(number("low")).alias("low"), F.max(number("high")).alias("high"), F.sum("compressed").alias("bytes"), F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("row_groups"),
    )


def evolution(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected and found: name, column, type. Where they differ: name, column, change (add: to be added; extra: not expected; retype: with either type), found, expected."""
    a = found.select("name", "column", F.col("type").alias("found"))
    b = expected.select("name", "column", F.col("type").alias("expected"))
    both = a.join(b, ["name", "column"], "full")
    change = F.when(F.col("found").isNull(), "add").when(F.col("expected").isNull(), "extra").otherwise("retype")
    return both.where(~F.col("found").eqNullSafe(F.col("expected"))).select("name", "column", change.alias("change"), "found", "expected")


def evolved(df: DataFrame, changes: DataFrame, name: str) -> DataFrame:
    """Df with the columns that a table of this name lacks, empty; a change of type is an error. changes: of `evolution`, a row per differing column."""
    own = changes.where(F.col("name") == name).collect()
    if wrong := sorted(r["column"] for r in own if r["change"] == "retype"):
        raise ValueError(f"{name}: {', '.join(wrong)} would change type")
    kinds = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "BLOB": "binary"}
    added = {r["column"]: r["expected"] for r in own if r["change"] == "add"}
    return df.withColumns({c: F.lit(None).cast(kinds.get(t, t.lower())) for c, t in sorted(added.items())}) if added else df


def _parsed(text: str) -> object:
    try:
        import yaml
    except ImportError:  # JSON is what YAML and the library have in common then
        return json.loads(text)
    return yaml.safe_load(text)


def vocabulary_file(spark: SparkSession, path: str, section: str) -> DataFrame:
    """A section of a vocabulary file (YAML or JSON): value, weight (of a mapping to numbers) and meta (of a mapping to mappings, as JSON), in the file's order by `position`.

    A list, a mapping to numbers, or a mapping to mappings; an absent or empty section has no rows, and a file is read where it lies.
    """
    rows = spark.read.text(path, wholetext=True).collect()  # one small file
    data = _parsed(rows[0]["value"]) if rows else None
    values = (data or {}).get(section) or []
    if isinstance(values, dict):
        found = [(str(k), float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None, json.dumps(v, ensure_ascii=False, sort_keys=True) if isinstance(v, dict) else None) for k, v in values.items()]
    else:
        found = [(str(v), None, None) for v in values]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(found)], "position int, value string, weight double, meta string")
