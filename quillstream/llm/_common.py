"""What the operators of this subpackage share: the shared folder, staged tables, slices of Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import root

#: Bytes of text that a Python worker turns into words at once.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir as a URI."""
    found = root(spark)
    return found if ":/" in found else f"file://{found}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's URI under the shared root; every executor and the driver can read and write it."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: the lineage ends, and a lost executor costs nothing."""
    path = path or shared_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI. file:///x, file:/x and plain paths are local."""
    if uri.startswith("file:/"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if ":/" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: str) -> Column:
    """A text column as UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; ASCII texts take the faster way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null ids fall into the fold of the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows whose column holds about `size` bytes (one row at least), with that column as a list."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < len(ends):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + size, "right")))
            part = batch.slice(begin, end - begin)
            yield part, part.column(column).to_pylist()
            begin = end


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, train: Column, most: int) -> list:
    """At most `most` labelled rows (text bytes, 0/1) that satisfy `train`, taken by a hash of the id, equal counts of either label where there are enough.

    The bound makes what the driver collects independent of the corpus. Ids with contradictory labels keep the larger one, repeated ids their first text.
    """
    marked = labels.where(F.col(target).isin(0, 1)).where(train).groupBy("doc_id").agg(F.max(target).cast("int").alias("_y"))
    half = most // 2
    picked = [
        marked.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half) for y in (0, 1)
    ]
    ids = picked[0].unionByName(picked[1])
    # At most `most` rows of two numbers: a proven bound for the broadcast.
    rows = docs.select(F.col("doc_id"), utf8("text").alias("_text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("_text").alias("_text"), F.max("_y").alias("_y"))
    return sorted(((r["doc_id"], bytes(r["_text"]), r["_y"]) for r in rows.select("doc_id", "_text", "_y").toLocalIterator()), key=lambda r: (r[0], r[1]))
