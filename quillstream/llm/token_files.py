"""Token-ID / binary output: flat unsigned integer files with 64-bit document offsets, read back by memory map, or by ranges where
the folder is remote.

A folder holds, per partition p of the documents in ascending id order:

* ``tokens-p.bin``  the ids, little-endian unsigned; 16 bits where the vocabulary allows, else 32
* ``tokens-p.idx``  n + 1 offsets into it, little-endian signed 64-bit, counted in ids
* ``tokens-p.doc``  n document ids, little-endian signed 64-bit; the least value stands for null

and a Parquet ``manifest`` (part, file, n_docs, n_tokens, base, width) whose ``base`` is the prefix sum of the ids before
the partition. A task writes each file under a name of its own attempt and then renames it, so repeated and speculative
attempts leave the same bytes.

Defined cases: null text counts as empty; an empty text has the end id alone; equal ids stay in the order of their texts;
a null id sorts first; other columns are ignored; an empty table gives an empty manifest and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bpe
from ._common import files_of, shared_path, shuffle_partitions, slices, table, utf8

MANIFEST = "part int, file string, n_docs long, n_tokens long, base long, width int"
NO_ID = np.iinfo(np.int64).min
#: Documents of which the reader makes rows at once, and their ids (one document at least).
ROWS, IDS = 20_000, 8_000_000


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Writes the folder and returns its manifest. docs: doc_id, text; only these are shuffled, by id range."""
    spark = docs.sparkSession
    width = 2 if max(_bpe.vocabulary_size(tokenizer) - 1, end_id) < 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    ordered = rows.repartitionByRange(partitions or shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    files, folder = files_of(path)
    files.create_dir(folder, recursive=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), _bpe.encoder(tokenizer).encode
        files, folder = files_of(path)
        own, name = f".{uuid.uuid4().hex}", f"{folder}/tokens-{part:07d}"
        n, total, out = 0, 0, None
        try:
            for batch, texts in slices(batches, "text"):
                if out is None:
                    out = {x: files.open_output_stream(f"{name}.{x}{own}") for x in ("bin", "idx", "doc")}
                    out["idx"].write(np.zeros(1, "<i8").tobytes())
                ids, bounds = encode([t.decode("utf-8", "replace") for t in texts], end_id)
                out["bin"].write(ids.astype(f"<u{width}").tobytes())
                out["idx"].write((bounds[1:] + total).astype("<i8").tobytes())
                out["doc"].write(np.asarray(batch.column(0).fill_null(NO_ID), "<i8").tobytes())
                n, total = n + len(texts), total + len(ids)
        finally:
            for x in (out or {}).values():
                x.close()
        if n:
            for x in out:
                files.move(f"{name}.{x}{own}", f"{name}.{x}")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"tokens-{part:07d}"], "n_docs": pa.array([n], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

    # One small row per file comes to the driver, whatever the number of documents.
    found = sorted(ordered.mapInArrow(put, "part int, file string, n_docs long, n_tokens long").collect())
    bases = accumulate((r["n_tokens"] for r in found), initial=0)
    manifest = spark.createDataFrame([(*r, base, width) for r, base in zip(found, bases, strict=False)], MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def _mapped(path: str, name: str, dtype: str) -> np.ndarray:
    files, folder = files_of(path)
    if files.type_name == "local":
        return np.memmap(f"{folder}/{name}", dtype, "r")
    with files.open_input_file(f"{folder}/{name}") as f:
        return np.frombuffer(f.read_buffer(), dtype)


def documents(path: str, name: str, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of documents of one file: ids of the documents, offsets (one more), and the token ids from the first offset to the last."""
    offsets, ids = _mapped(path, f"{name}.idx", "<i8"), _mapped(path, f"{name}.doc", "<i8")
    files, folder = files_of(path)
    tokens = _mapped(path, f"{name}.bin", f"<u{width}") if files.type_name == "local" else None
    a = 0
    while a < len(ids):
        b = min(a + ROWS, max(a + 1, int(np.searchsorted(offsets, offsets[a] + IDS, "right")) - 1), len(ids))
        first, last = int(offsets[a]), int(offsets[b])
        if tokens is not None:
            yield ids[a:b], offsets[a : b + 1], tokens[first:last]
        else:
            with files.open_input_file(f"{folder}/{name}.bin") as f:
                f.seek(first * width)
                yield ids[a:b], offsets[a : b + 1], np.frombuffer(f.read_buffer((last - first) * width), f"<u{width}")
        a = b


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids as array<long>."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def get(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file in frame.itertuples():
                for ids, offsets, tokens in documents(path, file.file, file.width):
                    at = (offsets - offsets[0]).tolist()
                    each = [np.asarray(tokens[a:b], "<u4") for a, b in zip(at[:-1], at[1:], strict=True)]
                    out = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "start": file.base + offsets[:-1], "n_tokens": np.diff(offsets), "ids_crc32": [zlib.crc32(x) for x in each]})
                    out.loc[ids == NO_ID, "doc_id"] = pd.NA
                    if with_ids:
                        out["ids"] = [x.astype(np.int64) for x in each]
                    yield out

    # A file each to a task; the files' rows are a few numbers.
    return manifest.repartition(shuffle_partitions(spark), "part").mapInPandas(get, schema)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    write(table(spark, sf_dir, "documents"), path, _bpe.public_tokenizer(), end_id=0)
    return read(spark, path)
