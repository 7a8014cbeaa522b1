"""A training corpus from `documents`: toxicity, quality, near duplicates, benchmark leaks, packing.

Each stage works on all that its predecessor kept, as Parquet in the shared folder, and all but the last return the columns
they were given.

Defined cases: null text counts as empty everywhere, and such documents are scored, linked and packed (as the end id alone) like
any other; null ids pass every stage; of documents whose texts are near copies the one with the smallest id stays, a null id last,
and of rows that repeat id and text one; an empty table gives no rows; other columns pass all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstream.llm import decontaminate, packing, quality, simhash, toxicity
from quillstream.llm._bpe import public_tokenizer
from quillstream.llm._common import staged, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a toxicity score of 0.7 or more."""
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), 0.7, keep=docs.columns)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a quality score under 0.3."""
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), 0.3, keep=docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of fingerprints within 3 bits."""
    return simhash.first_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item, up to a tenth of it edited."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizer())


STAGES = [("toxicity", without_toxic), ("quality", of_quality), ("near_duplicates", without_near_copies), ("decontamination", without_benchmark), ("packing", packed)]
#: SQL expresses none of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
