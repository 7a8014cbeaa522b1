import tracemalloc
from itertools import product

import numpy as np

from quillstream.llm import decontaminate as D


def plain(item, text):
    """Least edits of the whole item within the text."""
    before = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        row = [i]
        for j, b in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (a != b)))
        before = row
    return min(before)


def made(rng, n):
    parts = ["an", "er", "th", "in", "on", "re", "ti", "st", "ou", "ed", "le", "ha"]
    return " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(n))


def test_regions_and_edits_against_full_alignment():
    rng = np.random.default_rng(8)
    texts = [made(rng, int(rng.integers(5, 40))) for _ in range(25)] + ["too short"]
    items = D.Items.of([(i, t.encode()) for i, t in enumerate(texts)])
    assert len(items.texts) == 25
    for _ in range(60):
        i = int(rng.integers(25))
        s = bytearray(items.texts[i])
        for _ in range(int(rng.integers(0, D.budget(len(s)) + 3))):
            p, kind = int(rng.integers(len(s))), int(rng.integers(3))
            if kind == 0:
                s[p] = 97 + int(rng.integers(8))
            elif kind == 1:
                del s[p]
            else:
                s.insert(p, 97 + int(rng.integers(8)))
        text = D.fold(made(rng, int(rng.integers(0, 30))).encode() + b" " + bytes(s) + b"! " + made(rng, int(rng.integers(0, 30))).encode())
        edits = plain(items.texts[i], text)
        got = [m for m in D.matches_in(items, [made(rng, 9).encode(), text, b""]) if m[1] == i]
        assert bool(got) == (edits <= D.budget(len(items.texts[i])))
        for doc, _, e, a, b, match in got:
            assert doc == 1 and e == edits and text[a:b] == match and plain(items.texts[i], match) == e


def test_frames(spark, odd_docs, no_docs):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    items = [made(rng, 30) for _ in range(6)]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)] + [(6, items[0], 1), (7, None, 1), (8, "", 1), (None, items[1], 1), (9, "short", 1)], "item_id long, text string, doc_id int").withColumn("hash", F.lit("clash"))
    rows = [(100, made(rng, 50) + ".\n" + items[0].upper().replace(" ", ",  ") + "\n" + made(rng, 5000)), (101, items[1]), (101, items[1]), (102, items[2][: len(items[2]) // 2]), (103, None), (None, "x " + items[3])]
    docs = odd_docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    for size in (D.BLOCK_BYTES, 300):
        found = sorted((str(r["doc_id"]), str(r["item_id"])) for r in D.contaminated(docs, benchmark, size).collect())
        assert found == sorted([("100", "0"), ("100", "6"), *[("101", "1"), ("101", "None")] * 2, ("None", "3")])
        kept = D.clean(docs, benchmark, docs.columns, size)
        assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    assert D.contaminated(no_docs, benchmark).count() == 0 == D.contaminated(docs, benchmark.limit(0)).count()
    assert D.clean(docs, benchmark.limit(0), docs.columns).count() == docs.count()


def test_repetitive_texts_against_full_alignment():
    """Runs of equal q-grams, whose places are counted by bands."""
    rng = np.random.default_rng(12)
    items = [b"a" * 60, b"ab" * 30, b"abc" * 20, b"a" * 30 + b"b" + b"a" * 30, b"ab" * 15 + b"xyz" + b"ab" * 15]
    held = D.Items.of(list(enumerate(items)))
    for k, source in product(range(8), range(len(items))):
        text = bytearray(items[source] * 2 if k % 2 else b"q" * 25 + items[source] + b"r" * 9)
        for _ in range(int(rng.integers(0, 9))):
            text[int(rng.integers(len(text)))] = 97 + int(rng.integers(3))
        for parts in (1 << 18, 16):
            D.PLACES, before = parts, D.PLACES
            got = {}
            for m in D.matches_in(held, [bytes(text)]):
                got[m[1]] = min(got.get(m[1], 99), m[2])
            D.PLACES = before
            wanted = {i: e for i, t in enumerate(items) if (e := plain(t, bytes(text))) <= D.budget(len(t))}
            assert got == wanted


def test_memory_of_a_long_repetitive_text(monkeypatch):
    held = D.Items.of([(1, b"a" * 400), (2, b"ab" * 200), (3, b"a" * 200 + b"b" + b"a" * 199)])
    text = b"a" * 10_000_000
    tracemalloc.start()
    keys, counts, span = D.band_counts(held, text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6 and set((keys // span).tolist()) == {0, 2} and counts.max() <= len(text)
    monkeypatch.setattr(D, "WIDE", 500)
    short = b"a" * 3000
    assert sorted({(m[1], m[2]) for m in D.matches_in(held, [short])}) == [(0, 0), (2, 1)]
