"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are folded (A-Z to lower case, ASCII punctuation and white space to single spaces). A region of a
text matches an item of m bytes if it is within k = ERRORS * m edits of the whole item. Such a region shares at least
m - Q + 1 - k * Q of the item's q-grams with it, on diagonals that differ by k at most. So per item the shared q-grams are
counted in overlapping bands of diagonals (each twice as wide as the step between them, so that one band holds them all),
bands that reach the bound are kept, neighbours are joined to regions, and each region is verified by an alignment over its
band of diagonals.

A place of the text counts once for a band, however often its q-gram stands there in the item: the alignment takes each shared
q-gram at another place, so the bound holds for places too. Equal q-grams of an item that lie within a band's step are one run,
so repetitive texts and items cost a few bands a place. Texts are read in parts whose counts are added up, and wide regions are
aligned in overlapping parts, so what a task holds depends on neither a text's length nor its repetitions.

The items' q-grams are broadcast in blocks of at most about BLOCK_BYTES of items. A larger benchmark takes a pass over the
texts for each block, all in one stage; the documents of all passes are then taken out by one join. Every text is read whole;
a match may lie anywhere.

Defined cases: null text counts as empty; null items, and items of under LEAST folded bytes (a few words, which any text may
hold by chance), match nothing; equal items match each by its own id; repeated rows give repeated results; a region of several
equally good alignments gives the first; other columns, whatever their names, are ignored and kept by ``clean``; an empty table
on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import slices, table, unused, utf8

#: Bytes of a q-gram (one 64-bit word), edits per byte of an item, least bytes of an item.
Q, ERRORS, LEAST = 8, 0.1, 24
#: Bytes of benchmark items that one pass holds.
BLOCK_BYTES = 8_000_000
#: Places of a text that are looked up at once, bands that are counted at once, diagonals that are aligned at once.
PLACES, BANDS, WIDE = 1 << 18, 1 << 20, 1 << 16
_FOLD = bytes.maketrans(bytes(range(48)) + b":;<=>?@[\\]^_`{|}~\x7f", b" " * 66)
_MIX = np.uint64(0x9E3779B97F4A7C15)
MATCHES = "doc_id long, item_id long, edits int, item_bytes int, similarity double, first_byte long, end_byte long, match string"


def fold(text: bytes) -> bytes:
    return b" ".join(text.lower().translate(_FOLD).split())


def budget(m: int) -> int:
    """Edits that an item of m bytes allows: few enough for the lemma to ask for a q-gram at least."""
    return min(int(ERRORS * m), (m - Q) // Q)


def grams(data: bytes) -> np.ndarray:
    return np.ndarray((max(0, len(data) - Q + 1),), "<u8", data, strides=(1,)).copy() if len(data) >= Q else np.empty(0, np.uint64)


class Items(NamedTuple):
    ids: list
    texts: list[bytes]
    gram: np.ndarray  # distinct, ascending
    first: np.ndarray  # of each gram in item, low and high; one more
    item: np.ndarray
    low: np.ndarray  # first and last place of a run of the gram in the item, each at most a step after the one before
    high: np.ndarray
    filter: np.ndarray  # by the top 22 bits of a gram's product
    size: np.ndarray  # of each item: bytes, step between bands, least shared q-grams
    step: np.ndarray
    least: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int, bytes]]) -> Items:
        kept = [(i, t) for i, t in ((i, fold(t)) for i, t in rows) if len(t) >= LEAST]
        every = [grams(t) for _, t in kept]
        n = np.array([len(g) for g in every], np.int64)
        size = np.array([len(t) for _, t in kept], np.int64)
        allowed = np.array([budget(m) for m in size.tolist()], np.int64)
        gram = np.concatenate([np.empty(0, np.uint64), *every])
        item = np.repeat(np.arange(len(kept)), n)
        place = np.arange(len(gram)) - np.repeat(np.cumsum(n) - n, n)
        order = np.argsort(gram, kind="stable")  # by item and place among equal ones
        gram, item, place = gram[order], item[order], place[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (item[1:] != item[:-1]) | (np.diff(place) > allowed[item[1:]] + 1)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(gram))
        distinct, first = np.unique(gram[begin], return_index=True)
        bits = np.zeros(1 << 22, bool)
        bits[(distinct * _MIX >> np.uint64(42)).astype(np.int64)] = True
        return Items([i for i, _ in kept], [t for _, t in kept], distinct, np.append(first, len(begin)), item[begin], place[begin], place[end - 1] if len(begin) else place[:0], bits, size, allowed + 1, size - Q + 1 - allowed * Q)


def spread(first: np.ndarray, n: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, first[row] + 0 .. n[row] - 1) of all rows, about `most` at a time (one row at least)."""
    ends, begin = np.cumsum(n), 0
    while begin < len(n):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
        own = n[begin:end]
        row = np.repeat(np.arange(begin, end), own)
        yield row, np.repeat(first[begin:end] - np.cumsum(own) + own, own) + np.arange(own.sum())
        begin = end


def band_counts(items: Items, data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys (item * span + band, ascending), how many places of data share a q-gram with the item in that band, and span."""
    longest = int(items.size.max(initial=0))
    span = len(data) + longest + 2
    keys, counts, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0

    def add_up() -> None:
        key, row = np.unique(np.concatenate(keys), return_inverse=True)
        keys[:], counts[:] = [key], [np.bincount(row, np.concatenate(counts), len(key)).astype(np.int64)]

    for begin in range(0, max(0, len(data) - Q + 1), PLACES):
        g = grams(data[begin : begin + PLACES + Q - 1])
        at = np.flatnonzero(items.filter[(g * _MIX >> np.uint64(42)).astype(np.int64)])
        if not len(at) or not len(items.gram):
            continue
        found = np.searchsorted(items.gram, g[at])
        found[found == len(items.gram)] = 0
        same = items.gram[found] == g[at]
        at, found = at[same] + begin, found[same]
        for row, run in spread(items.first[found], items.first[found + 1] - items.first[found], BANDS):
            item = items.item[run]
            low = (at[row] - items.high[run] + longest) // items.step[item]  # never negative
            high = (at[row] - items.low[run] + longest) // items.step[item]
            for pair, band in spread(low, high - low + 1, BANDS):
                key, n = np.unique(item[pair] * span + band, return_counts=True)
                keys.append(key)
                counts.append(n)
                held += len(key)
                if held > BANDS:
                    add_up()
                    held = 0
    add_up()
    return keys[0], counts[0], span


def regions(items: Items, data: bytes) -> Iterator[tuple[int, int, int]]:
    """(item, first diagonal, end diagonal) of the joined bands that reach the bound. A diagonal is a place in data less one in the item."""
    key, count, span = band_counts(items, data)
    joined = count.copy()  # of a band and the next one
    joined[:-1] += np.where(np.diff(key) == 1, count[1:], 0)
    good = np.flatnonzero(joined >= items.least[key // span])
    if not len(good):
        return
    longest = int(items.size.max())
    # A band with none of its own but enough in the next one begins at that next one as well, so nothing is lost by these keys.
    begins = np.flatnonzero((np.diff(key[good], prepend=-9) > 2) | np.append(True, np.diff(key[good] // span) > 0))
    for a, b in zip(begins, np.append(begins[1:], len(good)), strict=True):
        i = int(key[good[a]] // span)
        step = int(items.step[i])
        yield i, int(key[good[a]] % span * step - longest), int((key[good[b - 1]] % span + 2) * step - longest)


def align(item: bytes, data: bytes, low: int, high: int, begin: int, end: int) -> tuple[int, int, int] | None:
    """Edits, start and end of the best match of the item in data[begin:end] along diagonals from `low` to `high`; None beyond the budget."""
    k, m = budget(len(item)), len(item)
    exact = data.find(item, max(begin, low), min(end, high + m))
    if exact >= 0:
        return 0, exact, exact + m
    low, high = max(low - k, begin - k), min(high + k, end)
    best = None
    for at in range(low, high + 1, WIDE):  # an alignment stays within k of the diagonal that it starts on
        found = _align(item, data, max(low, at - k), min(high, at + WIDE - 1 + k), begin, end)
        if found and (best is None or found[0] < best[0]):
            best = found
    return best


def _align(item: bytes, data: bytes, low: int, high: int, begin: int, end: int) -> tuple[int, int, int] | None:
    k, m = budget(len(item)), len(item)
    width = high - low + 1
    text = np.frombuffer(data, np.uint8)
    far = 1 << 30
    diagonal = low + np.arange(width)
    # Row i, diagonal d: the cheapest way to spend i bytes of the item and end before place i + d. A start costs nothing.
    cost = np.where((diagonal >= begin) & (diagonal <= end), 0, far)
    start = diagonal.copy()
    ramp = np.arange(width)
    for i in range(1, m + 1):
        place = diagonal + i - 1
        inside = (place >= begin) & (place < end)
        same = text[np.clip(place, 0, len(text) - 1)] == item[i - 1]
        change = np.where(inside, cost + ~same, far)
        drop = np.append(cost[1:] + 1, far)  # a byte of the item is left out: the diagonal falls by one
        better = drop < change
        now = np.where(better, drop, change)
        now = np.where((place + 1 < begin) | (place + 1 > end), far, now)
        own = np.where(better, np.append(start[1:], 0), start)
        # Extra bytes of the text: the diagonal rises, one edit each.
        least = np.minimum.accumulate(now - ramp)
        source = np.maximum.accumulate(np.where(now - ramp == least, ramp, 0))
        cost, start = np.minimum(least + ramp, far), own[source]
        if cost.min() > k:
            return None
    at = int(np.argmin(cost))
    return (int(cost[at]), int(start[at]), int(diagonal[at] + m)) if cost[at] <= k else None


def matches_in(items: Items, texts: list[bytes]) -> list[tuple]:
    """(number of the text, item, edits, first, end, matched bytes) over folded texts."""
    folded = [fold(t) for t in texts]
    data = b"\n".join(folded) + b"\n"
    bounds = np.cumsum([0, *(len(t) + 1 for t in folded)])
    out = []
    for item, low, high in regions(items, data):
        # The region may run over several texts.
        a = int(np.searchsorted(bounds, max(low, 0), "right")) - 1
        b = int(np.searchsorted(bounds, min(high + len(items.texts[item]) + budget(len(items.texts[item])), len(data) - 1), "right"))
        for doc in range(a, min(b, len(folded))):
            begin, end = int(bounds[doc]), int(bounds[doc + 1]) - 1
            if end - begin >= len(items.texts[item]) - budget(len(items.texts[item])) and (found := align(items.texts[item], data, low, high, begin, end)):
                edits, first, last = found
                out.append((doc, item, edits, first - begin, last - begin, data[first:last]))
    return out


def _size(benchmark: DataFrame) -> int:
    return benchmark.agg(F.sum(F.octet_length(F.col("text").cast("binary")))).first()[0] or 0


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The benchmark's items in blocks by a hash of their ids."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    n = -(-_size(benchmark) // block_bytes)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Items.of(sorted(((r["item_id"], bytes(r["text"])) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def _passes(docs: DataFrame, benchmark: DataFrame, block_bytes: int, one: Callable[[Iterator[pa.RecordBatch], Items], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """docs mapped with each block of the benchmark, which the driver holds one at a time."""
    out = None
    for items in blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # bounded by block_bytes
        found = docs.mapInArrow(lambda batches, shared=shared: one(batches, shared.value), schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and matched region: doc_id, item_id, edits, item_bytes, similarity, and the place and bytes of the match in the folded text."""

    def find(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            found = matches_in(items, texts)
            if found:
                doc, item, edits, first, end, match = zip(*found, strict=True)
                size = [len(items.texts[i]) for i in item]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(doc)), pa.array([items.ids[i] for i in item], pa.int64()), pa.array(edits, pa.int32()), pa.array(size, pa.int32()),
                    pa.array([1 - e / s for e, s in zip(edits, size, strict=True)]), pa.array(first, pa.int64()), pa.array(end, pa.int64()), pa.array([m.decode("utf-8", "replace") for m in match]),
                ], names=[x.split()[0] for x in MATCHES.split(", ")])

    return _passes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")), benchmark, block_bytes, find, MATCHES)


def clean(docs: DataFrame, benchmark: DataFrame, keep: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """These columns of the documents in which no item is found."""
    out = docs.select(*keep)
    text = unused(docs, "utf8")
    size = _size(benchmark)
    if not size:
        return out
    if size <= block_bytes:  # one pass, which needs no join

        def drop(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
            for batch, texts in slices(batches, text):
                good = np.ones(len(texts), bool)
                good[[m[0] for m in matches_in(items, texts)]] = False
                yield batch.filter(pa.array(good)).drop_columns([text])

        return _passes(docs.select(*keep, utf8("text").alias(text)), benchmark, block_bytes, drop, out.schema)

    def bad(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            rows = sorted({m[0] for m in matches_in(items, texts)})
            if rows:
                yield batch.select(["hash"]).take(pa.array(rows))

    # Whether an item is found depends on the text alone, so texts are taken out, by their hash.
    hash_ = F.sha2(utf8("text"), 256)
    found = _passes(docs.select(utf8("text").alias("text"), hash_.alias("hash")), benchmark, block_bytes, bad, "hash string").distinct()
    own = unused(docs, "hash_of_text")
    return docs.withColumn(own, hash_).join(found.withColumnRenamed("hash", own), own, "left_anti").select(*keep)


def op9_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "edits", "item_bytes", "similarity", "first_byte", "end_byte")
