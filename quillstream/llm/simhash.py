"""SimHash near-duplicates by pivot distance tables.

1. A task makes each document's 64-bit fingerprint from XXH64 of its word shingles.
2. Equal fingerprints become one class. Each class is keyed sixteen ways: of four 16-bit blocks and, in the other 48 bits, four
   12-bit blocks, two fingerprints within 3 bits agree in one block of either level, so every link has a key in common.
3. Within a key a task computes the Hamming distances of each fingerprint to the pivots, discards pairs whose distances to
   any pivot differ by more than the limit (the triangle inequality), and verifies the others. It returns links that join the
   same fingerprints as all links do, at most one less than the key has fingerprints. Fingerprints of a key of over BUCKET are
   keyed again, four ways by 9-bit blocks of the 36 bits left, where near ones agree in a block again; what is still over BUCKET
   is dealt out as pairs of chunks, so no task holds a large one and no pair is left out.
4. Components come from large-star and small-star rounds over the links, until every component is a star.

Defined cases: null text counts as empty, and texts without words have fingerprint zero, linked like any other; null ids take
part but never name a component unless all its ids are null; repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import shuffle_partitions, slices, staged, table, unused, utf8

SEED = 42
#: Reference fingerprints: fixed, from a seeded generator.
PIVOTS = np.random.default_rng(64).integers(0, 1 << 63, 24, np.uint64) * np.uint64(2) + np.random.default_rng(65).integers(0, 2, 24, np.uint64)
#: Fingerprints of one key that a task compares at once.
BUCKET = 2048
#: Pairs whose pivot distances a task compares at once.
PAIRS = 4_000_000


def fingerprint(text: bytes, width: int = 3) -> int:
    words = text.lower().split()  # bytes: A-Z and the six ASCII white spaces alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1]
        parts = [joined[a:b] for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16_384):
        part = hashes[at : at + 16_384]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, the fingerprint as a long (the same 64 bits) and xxhash64 of the text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            found = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), batch.column(2)], names=["doc_id", "fp", "text_hash"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"), F.xxhash64(utf8("text")).alias("text_hash")).mapInArrow(of, "doc_id long, fp long, text_hash long")


def keys(fp: Column) -> Column:
    """The sixteen keys: 4 bits of their number, 16 bits of a block, 12 bits of a block of the rest."""
    out = []
    for i in range(4):
        block = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))
        low = fp.bitwiseAND(F.lit((1 << 16 * i) - 1))
        high = F.shiftleft(F.shiftrightunsigned(fp, 16 * i + 16), 16 * i) if i < 3 else F.lit(0).cast("long")
        rest = low.bitwiseOR(high)
        for j in range(4):
            part = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(F.lit(0xFFF))
            out.append(F.lit((4 * i + j) << 28).cast("long").bitwiseOR(F.shiftleft(block, 12)).bitwiseOR(part))
    return F.array(*out)


def further_keys(fp: str, key: str) -> Column:
    """Four keys within a key of keys(): 2 bits of their number, 9 bits of a block of the 36 bits that the key leaves."""
    without = lambda x, at, n: f"({x} & (shiftleft(1L, {at}) - 1L) | shiftleft(shiftrightunsigned(shiftrightunsigned({x}, {at}), {n}), {at}))"
    i, j = f"cast(16 * ({key} >> 30) AS INT)", f"cast(12 * ({key} >> 28 & 3) AS INT)"
    rest = without(without(fp, i, 16), j, 12)
    return F.array(*(F.expr(f"{m << 9}L | shiftrightunsigned({rest}, {9 * m}) & 511L") for m in range(4)))


def near_pairs(fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs a < b of fingerprints within limit bits, by the pivot distances: each is met with those alone whose distance to the pivot that tells most apart is near its own."""
    tables = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    first = int(tables.std(axis=0).argmax()) if len(fps) else 0
    order = np.argsort(tables[:, first], kind="stable")
    tables, sorted_ = tables[order], fps[order]
    at = np.arange(len(fps))
    widths = np.searchsorted(tables[:, first], tables[:, first] + limit, "right") - at - 1  # later ones within the limit
    sums = np.cumsum(widths)
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    begin = 0
    while begin < len(fps):
        end = max(begin + 1, int(np.searchsorted(sums, (sums[begin - 1] if begin else 0) + PAIRS, "right")))
        width = widths[begin:end]
        a = np.repeat(at[begin:end], width)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(width) - width, width)
        for k in range(len(PIVOTS)):
            if k != first and len(a):
                keep = np.abs(tables[a, k] - tables[b, k]) <= limit
                a, b = a[keep], b[keep]
        keep = np.bitwise_count(sorted_[a] ^ sorted_[b]) <= limit
        out_a.append(order[a[keep]])
        out_b.append(order[b[keep]])
        begin = end
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return np.minimum(a, b), np.maximum(a, b)


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs, those that first join two sets."""
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        s, t = top(x), top(y)
        if s != t:
            root[max(s, t)] = min(s, t)
            out.append((x, y))
    return out


def links(classes: DataFrame, limit: int = 3, bucket: int = BUCKET) -> DataFrame:
    """classes: fp, distinct. Returns a, b: links with the components of all pairs within limit (at most 3) bits."""
    if not 0 <= limit <= 3:
        raise ValueError("the sixteen keys find pairs within 3 bits")
    spark = classes.sparkSession
    keyed = classes.select("fp", F.explode(keys(F.col("fp"))).alias("key"))
    large = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("key")
    small = keyed.join(large, "key", "left_anti").select("key", F.lit(-1).cast("long").alias("part"), F.lit(0).alias("low"), F.lit(0).alias("high"), "fp")
    parted = keyed.join(large, "key", "left_semi").select("key", F.explode(further_keys("fp", "key")).alias("part"), "fp")
    chunked = parted.groupBy("key", "part").agg(F.ceil(F.count(F.lit(1)) / F.lit(bucket // 2)).cast("int").alias("chunks")).where(F.col("chunks") > 2)
    # A row of a large part goes to a group with each other chunk of it; all other rows have the group 0, 0.
    own, chunks = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"), F.col("chunks")
    others = F.when(chunks > 2, F.filter(F.sequence(F.lit(0), chunks - 1), lambda x: x != F.col("own"))).otherwise(F.array(F.lit(0)))
    dealt = (
        parted.join(chunked, ["key", "part"], "left").withColumn("own", F.when(chunks > 2, own).otherwise(0))
        .withColumn("other", F.explode(others))
        .select("key", "part", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    )
    groups = ["key", "part", "low", "high"]
    sorted_ = small.unionByName(dealt).repartition(shuffle_partitions(spark), *groups).sortWithinPartitions(*groups)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((0, 5), np.int64)  # the last group so far, which may go on in the next batch
        for batch in _then_none(batches):
            rows = rest if batch is None else np.concatenate([rest, np.stack([c.to_numpy() for c in batch.columns], axis=1).astype(np.int64)])
            if not len(rows):
                continue
            starts = np.flatnonzero(np.concatenate([[True], (rows[1:, :4] != rows[:-1, :4]).any(axis=1)]))
            last = len(rows) if batch is None else starts[-1]
            rest = rows[last:]
            bounds = np.append(starts, len(rows))
            out = []
            for k in np.flatnonzero(np.diff(bounds) > 1):
                if bounds[k + 1] <= last:
                    fps = np.unique(rows[bounds[k] : bounds[k + 1], 4].view(np.uint64))
                    a, b = near_pairs(fps, limit)
                    if len(a):
                        signed = fps.view(np.int64)
                        out += [(signed[x], signed[y]) for x, y in spanning(len(fps), a, b)]
            if out:
                found = np.array(out, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return sorted_.mapInArrow(compare, "a long, b long").where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one link to a smaller node, which has none itself, or none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (of one type that sorts). Returns node, root: the smallest node of its component. Each round is written to the shared folder; rounds go on until all components are stars."""
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        edges = staged(small, "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, limit: int = 3) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id, root (a fingerprint that names the component) and text_hash."""
    prints = staged(fingerprints(docs, width), "fingerprints")
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    # A node sorts by its class's smallest id, so a component's smallest node names it and no component is gathered anywhere.
    node = classes.select("fp", F.struct(F.col("least").isNull().alias("none"), "least", "fp").alias("node"))
    edges = links(classes.select("fp"), limit)
    for end in ("a", "b"):
        edges = edges.join(node.select(F.col("fp").alias(end), F.col("node").alias(f"node_{end}")), end)
    roots = components(edges.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))).select(F.col("node.fp").alias("fp"), F.col("root.least").alias("_l"), F.col("root.fp").alias("_r"))
    named = staged(classes.join(roots, "fp", "left").select("fp", F.coalesce("_l", "least").alias("component_id"), F.coalesce("_r", "fp").alias("root")), "named")
    # A join by itself, so that Spark can split the partition of a fingerprint that very many documents have.
    return prints.join(named, "fp").select("doc_id", "fp", "component_id", "root", "text_hash")


def first_of_each(docs: DataFrame, width: int = 3, limit: int = 3) -> DataFrame:
    """docs without all but one document of each component: the one with the smallest id, a null id last; of rows that repeat id and text, one."""
    found = near_duplicates(docs, width, limit)
    own, id_, hash_ = (unused(docs, name) for name in ("text_hash", "kept_id", "kept_hash"))
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("_")).select(F.col("_.doc_id").alias(id_), F.col("_.text_hash").alias(hash_))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(hash_))
    return docs.withColumn(own, F.xxhash64(utf8("text"))).join(kept, same, "left_semi").dropDuplicates(["doc_id", own]).select(*docs.columns)


def op10_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
