"""Vectors: alert matching of a stated set of topics against all items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import kept

#: Topics of one broadcast block; similarities that a worker holds at once.
BLOCK, CELLS = 4096, 1 << 20


def near(own: np.ndarray, wanted: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, topic, similarity) of the pairs of at least the threshold, some rows at a time. wanted: unit vectors."""
    step = max(1, CELLS // max(1, len(wanted)))
    for at in range(0, len(own), step):
        part = own[at : at + step]
        score = part @ wanted.T
        score /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-300)
        i, j = np.nonzero(score >= threshold)
        if len(i):
            yield at + i, j, score[i, j]


def matches(items: DataFrame, topics: DataFrame, threshold: float = 0.62) -> DataFrame:
    """J20, AL: pairs topic, id, similarity of at least the threshold. items: id, vector. topics: topic, vector: the query set, broadcast in blocks of bounded size. Of several blocks one is held at a time, and its pairs are written to the shared folder."""
    spark, out = items.sparkSession, None
    n = topics.count()
    for k in range(max(1, -(-n // BLOCK))):
        part = topics if n <= BLOCK else topics.where(F.pmod(F.xxhash64("topic"), F.lit(-(-n // BLOCK))) == k)
        rows = part.select("topic", "vector").collect()
        if not rows:
            continue
        matrix = np.array([r["vector"] for r in rows], np.float64)
        shared = spark.sparkContext.broadcast(([r["topic"] for r in rows], matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)))

        def compare(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, wanted = np.array(shared.value[0]), shared.value[1]
            for frame in frames:
                if not len(frame):
                    continue
                own, ids = np.stack(frame["vector"].to_numpy()).astype(np.float64), frame["id"].to_numpy()
                for i, j, score in near(own, wanted, threshold):
                    yield pd.DataFrame({"topic": names[j], "id": ids[i], "similarity": score})

        found = items.select("id", "vector").where("vector IS NOT NULL").mapInPandas(compare, "topic long, id long, similarity double")
        if n > BLOCK:
            found = kept(found, "matches")
            shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "topic long, id long, similarity double") if out is None else out
