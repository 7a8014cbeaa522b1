"""Writers that may run again: new rows by key, upserts, run logs, CSV with a preamble, XML.

A target is a folder of numbered steps: whole versions (v-N), partitions written anew (p-N) and rows added (d-N). The newest
complete version, with what later steps say, is the table. A writer that dies leaves the table as it was, and a second run of
the same rows changes nothing. There is one writer at a time.

Where a writer is given `part`, a column that never changes for a key (a date, say), steps are folders of its values, and an
update reads and writes only the values that its rows have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Steps after which the next one writes a whole version.
STEPS = 64
#: Column that names a step's folders.
PART = "quillstream_part"


def _steps(spark: SparkSession, target: str) -> list[tuple[int, str]]:
    """Number and kind (v, p, d) of the complete steps, in order."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path)]
    return sorted((int(p.getName()[2:]), p.getName()[0]) for p in names if p.getName()[:2] in ("v-", "p-", "d-") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _live(spark: SparkSession, target: str, steps: list[tuple[int, str]]) -> list[tuple[str, str | None]]:
    """The folders that hold the table, oldest first, each with the name of its value of `part` (None: all values)."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out, hidden = [], set()
    for n, kind in reversed(steps):
        step = f"{target}/{kind}-{n}"
        names = [s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(step)) if s.isDirectory() and s.getPath().getName().startswith(f"{PART}=")]
        out += [(f"{step}/{name}", name) for name in names if name not in hidden] or ([] if names else [(step, None)])
        if kind == "p":
            hidden |= set(names)
        if kind == "v":
            break
    return out[::-1]


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.option("mergeSchema", len(paths) > 1).parquet(*paths)


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The table, or None if there is none. Columns that only later steps have are null elsewhere."""
    found = _live(spark, target, _steps(spark, target))
    return _read(spark, [path for path, _ in found]) if found else None


def _folder(part: str) -> Column:
    """The name of a value's folder, which needs no escapes."""
    return F.coalesce(F.md5(F.col(part).cast("string")), F.lit("null"))


def _put(df: DataFrame, target: str, kind: str, part: str | None) -> None:
    steps = _steps(df.sparkSession, target)
    out = df.withColumn(PART, _folder(part)).write.partitionBy(PART) if part else df.write
    out.mode("overwrite").parquet(f"{target}/{kind}-{(steps[-1][0] if steps else 0) + 1}")


def replace(df: DataFrame, target: str, part: str | None = None) -> None:
    """The next version."""
    _put(df, target, "v", part)


def _add(df: DataFrame, target: str, old: DataFrame, part: str | None = None) -> None:
    """Rows beside those that are there; a whole version after many steps."""
    if len(_steps_since(df.sparkSession, target)) > STEPS:
        return replace(old.unionByName(df, allowMissingColumns=True), target, part)
    of = {f.name: f.dataType for f in old.schema}
    _put(df.select(*(F.col(c).cast(of[c]).alias(c) if c in of else F.col(c) for c in df.columns)), target, "d", part)


def _steps_since(spark: SparkSession, target: str) -> list[tuple[int, str]]:
    """The newest version and the steps after it."""
    steps = _steps(spark, target)
    whole = max((n for n, kind in steps if kind == "v"), default=0)
    return [(n, kind) for n, kind in steps if n >= whole]


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_old_{k}"))
    return out


def insert_new(df: DataFrame, target: str, keys: list[str], part: str | None = None) -> None:
    """Adds rows whose keys (nulls alike) are new, each once. Of what is there only the keys are read, and nothing is written again."""
    rows = df.dropDuplicates(keys)
    old = current(df.sparkSession, target)
    if old is None:
        return replace(rows, target, part)
    fresh = rows.join(old.select(*(F.col(k).alias(f"_old_{k}") for k in keys)), _same(keys), "left_anti")
    _add(fresh, target, old, part)


def load(df: DataFrame, target: str, keys: list[str]) -> dict[str, int]:
    """insert_new, then the count after it: the source's keys, the target's rows, and the source's keys that the target still lacks, which is an error."""
    insert_new(df, target, keys)
    there = current(df.sparkSession, target)
    own = df.select(*keys).distinct()
    lost = own.join(there.select(*(F.col(k).alias(f"_old_{k}") for k in keys)), _same(keys), "left_anti").count()
    if lost:
        raise RuntimeError(f"{lost} keys are not in {target}")
    return {"keys": own.count(), "rows": there.count()}


def upsert(df: DataFrame, target: str, keys: list[str], columns: list[str] | None = None, only_if: str | None = None, newer_by: str | list[str] | None = None, part: str | None = None) -> None:
    """Adds new keys and updates the others: all columns or those named, where `only_if` (over the old row as o) holds, and not by an older row (by the columns `newer_by`, then all others: of rows of equal time the larger one stays, whichever comes first). df: one row per key. With `part` only its values in df are read and written again."""
    spark = df.sparkSession
    found = _live(spark, target, _steps(spark, target))
    if not found:
        return replace(df, target, part)
    whole = part is None or any(name is None for _, name in found) or len(_steps_since(spark, target)) > STEPS
    if whole:
        old = _read(spark, [path for path, _ in found])
    else:
        touched = {f"{PART}={r[0]}" for r in df.select(_folder(part)).distinct().collect()}  # a row per value of `part`
        schema = _read(spark, [path for path, _ in found]).schema
        here = [path for path, name in found if name in touched]
        old = spark.read.schema(schema).parquet(*here) if here else spark.createDataFrame([], schema)
    fresh = df.select(*(F.col(c).alias(f"_new_{c}") for c in df.columns), F.lit(True).alias("_is_new"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"o.{k}").eqNullSafe(F.col(f"_new_{k}"))
    both = old.withColumn("_is_old", F.lit(True)).alias("o").join(fresh, on, "full")
    first = [newer_by] if isinstance(newer_by, str) else newer_by or []
    ranked = [*first, *sorted(c for c in old.columns if c not in [*first, *keys])]
    # As structs, which sort nulls first: the same order as that of first_per within a batch.
    newer = F.struct(*(F.col(f"_new_{c}").alias(c) for c in ranked)) >= F.struct(*(F.col(f"o.{c}").alias(c) for c in ranked)) if first else F.lit(True)
    take = F.col("_is_new").isNotNull() & (F.col("_is_old").isNull() | ((F.expr(only_if) if only_if else F.lit(True)) & newer))
    value = lambda c: F.when(take & (F.lit(columns is None or c in columns) | F.col("_is_old").isNull()), F.col(f"_new_{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    _put(both.select(*(value(c) for c in old.columns)), target, "v" if whole else "p", part)


def delete(spark: SparkSession, target: str, condition: Column) -> None:
    """The rows for which the condition is true go."""
    replace(current(spark, target).where(~F.coalesce(condition, F.lit(False))), target)


def log_run(spark: SparkSession, target: str, name: str, counters: DataFrame) -> None:
    """A row with a run's name, time and counters (outcome, n) as a map."""
    row = counters.agg(F.map_from_entries(F.collect_list(F.struct("outcome", "n"))).alias("counters")).select(F.lit(name).alias("service"), F.current_timestamp().alias("finished_at"), "counters")
    old = current(spark, target)
    if old is None:
        return replace(row, target)
    _add(row, target, old)


def csv_report(df: DataFrame, path: str, preamble: list[tuple[str, str]]) -> None:
    """CSV with a byte-order mark, lines of metadata, an empty line, a header and the rows in order, in part files whose names are in that order (a small report is one)."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    spark = df.sparkSession
    head = [f'"{a}","{b}"' for a, b in preamble] + ["", ",".join(f'"{c}"' for c in df.columns)]
    head[0] = "﻿" + head[0]
    top = spark.createDataFrame([(i, t) for i, t in enumerate(head)], "_n long, value string")
    rows = df.select(F.concat_ws(",", *(quote(F.col(c)) for c in df.columns)).alias("value"))
    numbered = rows.select((F.lit(len(head)) + F.monotonically_increasing_id()).alias("_n"), "value")
    top.unionByName(numbered).repartitionByRange("_n").sortWithinPartitions("_n").select("value").write.mode("overwrite").text(path)


def sitemap(urls: DataFrame, path: str) -> None:
    """Loc and lastmod as XML."""
    urls.select("loc", F.col("lastmod").cast("string").alias("lastmod")).write.mode("overwrite").format("xml").option("rootTag", "urlset").option("rowTag", "url").save(path)


def json_rows(df: DataFrame, path: str) -> None:
    """K14, K15."""
    df.write.mode("overwrite").json(path)
