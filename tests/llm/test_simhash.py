import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillstream.llm import simhash

from .conftest import ROWS


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(fps, limit=3):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_odd_rows(spark, odd_docs, no_docs):
    found = simhash.near_duplicates(odd_docs).collect()
    assert len(found) == len(ROWS)
    ids = [i for i, _, _ in ROWS]
    fps = [plain_fingerprint(t) for _, t, _ in ROWS]
    roots = plain_components(fps)
    for r in found:
        k = ids.index(r["doc_id"])
        assert r["fp"] % (1 << 64) == fps[k]
        named = [ids[j] for j in range(len(ids)) if roots[j] == roots[k] and ids[j] is not None]
        assert r["component_id"] == (min(named) if named else None)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_links_against_all_pairs(spark):
    """Clusters, chains, a dense ball of fingerprints that is dealt out in chunks, and noise."""
    rng = np.random.default_rng(5)
    fps = set(rng.integers(0, 1 << 62, 300).tolist())
    for base in list(fps)[:20]:
        x = base
        for _ in range(6):
            x ^= sum(1 << int(k) for k in rng.integers(0, 64, 3))
            fps.add(x)
    ball = int(rng.integers(0, 1 << 62))
    fps |= {ball ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (150, 2))}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    classes = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = plain_components(fps)
    for bucket in (16, 2048):
        edges = simhash.links(classes, bucket=bucket)
        of = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
        groups = {}
        for x, r in zip(signed, roots, strict=True):
            groups.setdefault(r, set()).add(of.get(x, x))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_pivots_lose_no_pair():
    fps = np.random.default_rng(2).integers(0, 64, 200).astype(np.uint64)
    a, b = simhash.near_pairs(fps, 3)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(i, j) for j in range(200) for i in range(j) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3}


def test_further_keys_keep_near_pairs(spark):
    """Two fingerprints within 3 bits that share a key agree in one of its four further keys."""
    rng = np.random.default_rng(9)
    rows = []
    for x in rng.integers(-(1 << 63), 1 << 63, 300).tolist():
        flips = sum(1 << int(k) for k in set(rng.integers(0, 64, 3).tolist()))
        rows.append((x, (x ^ flips) if (x ^ flips) < 1 << 63 and flips < 1 << 63 else x ^ 1))
    both = spark.createDataFrame(rows, "a long, b long").select(
        F.posexplode(F.arrays_zip(simhash.keys(F.col("a")).alias("x"), simhash.keys(F.col("b")).alias("y"))).alias("n", "k"), "a", "b"
    ).where("k.x = k.y").withColumn("key", F.col("k.x"))
    shared = F.arrays_overlap(simhash.further_keys("a", "key"), simhash.further_keys("b", "key"))
    assert both.where(~shared).isEmpty() and both.select("a").distinct().count() == len({a for a, _ in rows})


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["root"] for r in simhash.components(edges).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert simhash.components(edges.limit(0)).count() == 0
