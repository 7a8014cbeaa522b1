"""Best-fit packing, the best-two-fit rule: a sequence is filled greedily with the longest piece that fits; then its smallest
piece gives way to two unpacked pieces if these fit the expanded gap more tightly.

Pieces are at most `capacity` tokens long, so which pieces meet in a sequence depends on how many there are of each length
alone. The driver packs that histogram (at most `capacity` numbers, whatever the corpus): each step finds a pattern of
lengths and uses it as often as its lengths last, which is what packing sequence after sequence would do. The tasks then give
each piece its rank among those of its length, by prefix sums over task counts, and look up the rank's place.

Defined cases: null text counts as empty; an empty text is one piece with the end id alone; repeated ids and texts are
documents of their own; a null id stays null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _bpe
from ._common import slices, staged, table, utf8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, task_rank long"


def _pair(lengths: list[int], left: dict[int, int], used: Counter, room: int) -> tuple[int, int] | None:
    """Two lengths still to be had whose sum is the largest up to room."""
    free = [x for x in lengths if left[x] > used[x]]
    best, low, high = None, 0, len(free) - 1
    while low <= high:
        a, b = free[low], free[high]
        if a + b > room:
            high -= 1
            continue
        if (low < high or left[a] - used[a] > 1) and (best is None or a + b > sum(best)):
            best = (b, a)
        low += 1
    return best


def best_two_fit(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths in a sequence, number of such sequences) that hold every piece of the histogram once."""
    left = {k: n for k, n in histogram.items() if n > 0}
    lengths = sorted(left)
    out = []
    while lengths:
        used: Counter = Counter()
        pattern: list[int] = []
        gap = capacity
        while True:
            at = bisect_right(lengths, gap) - 1
            while at >= 0 and left[lengths[at]] <= used[lengths[at]]:
                at -= 1
            if at < 0:
                break
            pattern.append(lengths[at])
            used[lengths[at]] += 1
            gap -= lengths[at]
        if gap and len(pattern) > 1:
            smallest = pattern[-1]
            used[smallest] -= 1
            two = _pair(lengths, left, used, gap + smallest)
            if two and sum(two) > smallest:
                pattern[-1:] = two
                used.update(two)
            else:
                used[smallest] += 1
        times = min(left[k] // n for k, n in used.items() if n)
        out.append((pattern, times))
        for k, n in used.items():
            left[k] -= n * times
        lengths = [k for k in lengths if left[k]]
    return out


def places(patterns: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each slot of each pattern, in ascending order of key: length * 2**48 + first rank, first sequence, offset."""
    rank: Counter = Counter()
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rows.append(((length << 48) + rank[length], sequence, offset))
            rank[length] += times
            offset += length
        sequence += times
    found = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return found[:, 0].copy(), found[:, 1].copy(), found[:, 2].copy()


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """The documents' pieces, longer ones cut so that all but the first piece are full; task and task_rank count equal lengths."""
    schema = PIECES + ", ids array<long>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encode, seen = TaskContext.get().partitionId(), _bpe.encoder(tokenizer).encode, np.zeros(capacity + 1, np.int64)
        for batch, texts in slices(batches, "text"):
            ids, bounds = encode([t.decode("utf-8", "replace") for t in texts], end_id)
            total = np.diff(bounds)
            n = -(-total // capacity)
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            first = (total - 1) % capacity + 1
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[doc], capacity)
            at = bounds[:-1][doc] + start
            words = ids.astype("<u4")
            rank = np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            runs = np.flatnonzero(np.diff(length[order], prepend=-1))
            size = np.diff(runs, append=len(order))
            rank[order] = np.arange(len(order)) - np.repeat(runs, size) + np.repeat(seen[length[order][runs]], size)
            seen += np.bincount(length, minlength=capacity + 1)
            out = {
                "doc_id": batch.column(0).take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": start, "length": length,
                "ids_crc32": pa.array([zlib.crc32(words[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)], pa.int64()), "task": pa.array(np.full(len(doc), task), pa.int32()), "task_rank": rank,
            }
            if with_ids:
                out["ids"] = pa.array([words[a : a + k].astype(np.int64) for a, k in zip(at, length, strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with_ids the ids themselves."""
    spark = docs.sparkSession
    cut = staged(pieces(docs, tokenizer, end_id, capacity, with_ids), "pieces")  # ranks hold for these rows; they must not be made anew
    counts = staged(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    found = spark.sparkContext.broadcast(places(best_two_fit(histogram, capacity)))  # bounded by capacity as well
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # The bases are a row per task and length, which grows with the corpus: both sides are shuffled, as pieces are short rows.
    ranked = cut.join(bases.hint("shuffle_hash"), ["task", "length"]).withColumn("rank", F.col("base") + F.col("task_rank")).drop("task", "task_rank", "base")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids + ", sequence_id long, offset long"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sequence, offset = found.value
        for batch in batches:
            wanted = (batch.column("length").to_numpy() << 48) + batch.column("rank").to_numpy()
            at = np.searchsorted(key, wanted, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence[at] + wanted - key[at]), pa.array(offset[at])], names=[*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(put, schema)


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), _bpe.public_tokenizer())
