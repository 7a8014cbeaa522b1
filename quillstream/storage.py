"""Where intermediate results are kept: the folder of spark.checkpoint.dir, which every executor reads."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset and Spark runs in this process alone (tests), a new local one, which is then set."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillstream-')}"
        context.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def version(df: DataFrame) -> str:
    """A name for the files that df reads, as they are now: their names, sizes and times."""
    spark = df.sparkSession
    state, conf = [], spark._jsc.hadoopConfiguration()
    for file in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        status = path.getFileSystem(conf).getFileStatus(path)
        state.append((file, status.getLen(), status.getModificationTime()))
    return hashlib.sha256(repr(state).encode()).hexdigest()[:32]


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in that folder, read again: the plan ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
