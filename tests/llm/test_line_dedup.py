"""Line dedup against a plain version, on odd rows, and its SQL."""

import hashlib
import random

import duckdb
import pytest

from quillstream.llm import line_dedup as L

SPACE = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def plain(rows):
    """rows: (doc_id, text). Returns (doc_id, kept text, n_lines, n_dropped), in the rows' order."""
    order = lambda i: (i is None, i or 0)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(lower(line.strip(SPACE)), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(k := lower(x.strip(SPACE))) < 10 or min(holders[k], key=order) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def made(seed, n=120):
    rng = random.Random(seed)
    pool = ["", "short", "Exactly 10", "exactly 10", "  A License Line, all rights reserved\r", "a license line, all rights reserved", "ÉTÉ À LA PLAGE", "Été à la plage", " a license line, all rights reserved", "日本語の行はここにある", *(f"line number {i} of many" for i in range(40))]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))) for i in range(n)]
    rows += [(None, "\n".join(pool)), (None, "a license line, all rights reserved\nonly in a row without an id"), (5, rows[7][1]), (5, rows[5][1]), (9, None), (n, "A very common line of text\n" * 3000 + "the end of it all")]
    return rows


@pytest.mark.parametrize("share", [1000, 2])
def test_against_a_plain_version(spark, share):
    for seed in range(2):
        rows = made(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        found = L.deduplicated(docs, L.keep_bitmaps(docs, share=share))
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, plain(rows)))


def test_frequent_keys_take_the_other_way(spark):
    docs = spark.createDataFrame(made(3), "doc_id long, text string")
    lines = L.hashes(docs)
    top = L.frequent(lines, 1000)
    assert 0 < len(top) < 2000 and len(L.frequent(lines, 3)) == 1
    by = lambda share: sorted(map(str, L.repeats(lines, share).collect()))
    assert by(1000) == by(2) == by(50)


def test_bitmaps_in_runs(spark):
    lines = ["first line of it", "second line of it", "third line of it", "fourth line of it", "fifth line of it"]
    docs = spark.createDataFrame([(1, "\n".join(lines[1:4])), (2, "\n".join(["own first line", lines[1], lines[2], "own last line"])), (3, "\n".join([lines[3], "another own line", lines[2]])), (4, "nothing like it at all")], "doc_id long, text string")
    assert {r["doc_id"]: (r["n_dropped"], r["keep"]) for r in L.keep_bitmaps(docs).collect()} == {2: (2, [1, 2]), 3: (2, [0, 1, 1, 1])}


def test_odd_rows(spark, odd_docs, no_docs):
    found = L.deduplicated(odd_docs, L.keep_bitmaps(odd_docs))
    assert found.columns == [*odd_docs.columns, "n_lines", "n_dropped"]
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    assert sorted((str(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in found.collect()) == sorted((str(i), *rest) for i, *rest in plain(rows))
    clash = odd_docs.withColumnsRenamed({"fp": "n_lines", "root": "n_dropped", "block": "keep", "class": "row", "hash": "h1"})
    assert L.deduplicated(clash, L.keep_bitmaps(clash)).columns == [*clash.columns, "n_lines_", "n_dropped_"]
    assert L.keep_bitmaps(no_docs).count() == 0 == L.deduplicated(no_docs, L.keep_bitmaps(no_docs)).count()


def test_query_and_sql(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    wanted = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in plain(docs))
    assert sorted(map(tuple, L.op13_line_dedup(spark, sf_dir).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())) == wanted
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(c.sql(L.OP13_SQL).fetchall()) == wanted
