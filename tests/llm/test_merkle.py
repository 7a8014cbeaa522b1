"""Merkle manifests against trees built whole, and the query's SQL."""

import hashlib
import zlib
from itertools import groupby

import duckdb
import pytest
from pyspark.sql import functions as F

from quillstream.llm import merkle as M


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def runs(levels, i):
    """Place in its run and the run of node i, level by level."""
    for nodes in levels[:-1]:
        yield i % 16, nodes[i // 16 * 16 : i // 16 * 16 + 16]
        i //= 16


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text). Sorted tuples of the query's columns."""
    key = lambda r: (r[1] is not None, (r[1] or "").encode())
    lower = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    made = [(key(r), (r[0] is not None, r[0] or 0), sha(*map(field, r)), sha(*map(field, [*r[:4], lower(r[4])])), r[0]) for r in rows]
    trees = [list(g) for _, g in groupby(sorted(made), key=lambda x: x[0])]
    lower_levels = [levels_of([x[2] for x in t]) for t in trees]
    upper = levels_of([x[-1][0] for x in lower_levels])
    out = []
    for k, (t, own) in enumerate(zip(trees, lower_levels, strict=True)):
        top = list(runs(upper, k))
        for i, (_, _, leaf, other, doc_id) in enumerate(t):
            path = [*runs(own, i), *top]
            node = other if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 else leaf
            for at, run in path:
                node = sha(*run[:at], node, *run[at + 1 :])
            proof = sha(*(x for at, run in path for j, x in enumerate(run) if j != at))
            out.append((str(doc_id), leaf, own[-1][0], upper[-1][0], proof, node, node == upper[-1][0]))
    return sorted(out)


def found(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((str(r[0]), *r[1:]) for r in M.op11_merkle_manifest(spark, str(tmp_path)).select(*columns).collect())


def test_traversal_gives_every_path():
    for n in (1, 2, 15, 16, 17, 255, 256, 257, 300, 4096, 4100, 5000):
        leaves = [sha(str(i)) for i in range(n)]
        levels = levels_of(leaves)
        walk = M.Traversal([x.encode() for x in leaves], len(levels) - 1)
        for i in range(n):
            assert [(at, [x.decode() for x in run]) for at, run in walk.path()] == list(runs(levels, i))
            assert sum(len(run) for t in walk.ahead for run in t.open) <= 16 * len(levels) ** 2 and all(len(t.nodes) <= 16 for t in walk.ahead)
            walk.advance()


def test_blocks_that_end_in_one_leaf():
    made = M.Treehash(2)
    made.push(b"x")
    made.close()
    assert made.nodes == [M.parent([M.parent([b"x"])])] and [M.height(n) for n in (1, 2, 16, 17, 256, 257)] == [0, 1, 1, 2, 2, 2]


def test_three_tiers_and_many_groups(spark, tmp_path):
    rows = [(i, "hot", "en", i % 7, f"Text {i}") for i in range(66_000)]
    rows += [(i, f"source {i % 300}", None, None, None if i % 11 else "") for i in range(100_000, 101_000)] + [(1, None, "en", 3, "no source"), (2, "", "en", 0, "empty source"), (3, "-", "en", 0, "ÄB")]
    assert found(spark, rows, tmp_path) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 257])
def test_small_tables(spark, tmp_path, n):
    rows = [(i, "s", "en", 1, f"T{i}") for i in range(n)]
    assert found(spark, rows, tmp_path) == plain(rows)


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    odd_docs.withColumnsRenamed({"root": "node", "hash": "rank", "block": "path", "class": "tree"}).write.parquet(f"{tmp_path}/documents.parquet")
    wanted = plain([tuple(r) for r in odd_docs.select(*columns).collect()])
    assert sorted((str(r[0]), *r[1:]) for r in M.op11_merkle_manifest(spark, str(tmp_path)).collect()) == wanted
    assert M.manifest(no_docs, [F.col(c) for c in columns], F.col("doc_id"), F.col("source")).count() == 0


def test_paths_are_returned(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", f"t{i}") for i in range(100)], "doc_id long, source string, text string")
    for r in M.manifest(docs, [F.col("text")], F.col("doc_id"), F.col("source"), with_paths=True).collect():
        assert r["proof_sha256"] == sha(*(x for level in r["path"] for x in level)) and r["folded_root"] == r["root"] and r["leaf"] not in sum(r["path"], [])


def test_query_and_sql(spark, sf_dir):
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted((str(r[0]), *r[1:]) for r in M.op11_merkle_manifest(spark, sf_dir).select(*columns).collect()) == plain(docs)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted((str(r[0]), *r[1:]) for r in c.sql(M.OP11_SQL).fetchall()) == plain(docs)
