import math
import re
import tracemalloc
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from quillstream.llm import lattice as L
from quillstream.llm._bpe import public_tokenizer

from .conftest import ROWS

PIECES = sorted({b" ", b"a", b"b", b" a", b"ab", b"ba", b"aba", b" ab", b"bb", b" abab"})


def segmentations(word, pieces):
    if not word:
        return [[]]
    return [[p, *rest] for n in range(1, len(word) + 1) if (p := word[:n]) in pieces for rest in segmentations(word[n:], pieces)]


def paths(word):
    """Of each segmentation its (kind, piece number) pairs."""
    for path in segmentations(b" " + word, set(PIECES)):
        kinds = [L.WHOLE] if len(path) == 1 else [L.FIRST, *[L.INNER] * (len(path) - 2), L.LAST]
        yield [(k, PIECES.index(p)) for k, p in zip(kinds, path, strict=True)]


def expected_by_enumeration(counts, scores):
    """Log probability of each word, and expected counts of the pieces, over all segmentations."""
    found, expected = {}, np.zeros((4, len(PIECES)))
    for word, n in counts.items():
        weights = [(path, math.exp(sum(scores[k][p] for k, p in path))) for path in paths(word)]
        total = sum(x for _, x in weights)
        found[word] = math.log(total) if total else -math.inf
        for path, x in weights:
            for k, p in path if total else ():
                expected[k, p] += n * x / total
    return found, expected


def random_scores():
    begins = np.array([p[:1] == b" " for p in PIECES])
    x = np.random.default_rng(0).random((4, len(PIECES)))
    return L.normal(x * np.where(begins, np.array([1, 1, 0, 0])[:, None], np.array([0, 0, 1, 1])[:, None]))


@pytest.mark.parametrize("long, chunk", [(40, 1 << 14), (2, 1 << 14), (0, 3), (0, 1)])
def test_forward_sums_all_segmentations(long, chunk, monkeypatch):
    monkeypatch.setattr(L, "LONG", long)
    monkeypatch.setattr(L, "CHUNK", chunk)
    scores = random_scores()
    words = [bytes(w) for n in range(1, 8) for w in product(b"ab", repeat=n)] + [b"c", b""]
    lattice = L.Lattice(PIECES, scores)
    found = lattice.forward(words)
    times = np.arange(1.0, len(words) + 1)
    wanted, counts = expected_by_enumeration(dict(zip(words[:-1], times, strict=False)), scores)
    assert np.allclose(found[:-1], [wanted[w] for w in words[:-1]])
    assert np.isneginf(found[-2]) and found[-1] == 0
    expected = np.zeros((4, len(PIECES) + 1))
    lattice.expect(words, times, expected)
    assert np.allclose(expected[:, :-1], counts)


def test_a_very_long_word_in_bounded_memory(monkeypatch):
    pieces, weight = L.vocabulary(public_tokenizer("piece_bpe_32k.model"))
    lattice = L.Lattice(pieces, L.first_scores(pieces, weight))
    word = (b"thequickbrownfoxjumpsoverthelazydog" + bytes(range(128, 256))) * 2500  # 0.4 MB
    tracemalloc.start()
    whole, expected = lattice.forward([word])[0], np.zeros((4, len(pieces) + 1))
    lattice.expect([word[:100_000]], np.array([2.0]), expected)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and -np.inf < whole < 0
    lengths = np.array([len(p) for p in pieces])
    assert (expected[:, :-1].sum(axis=0) * lengths).sum() == pytest.approx(2 * 100_001)  # every byte, and the space, is in one piece of each segmentation
    monkeypatch.setattr(L, "CHUNK", 999)
    assert lattice.forward([word])[0] == pytest.approx(whole, rel=1e-12)


def test_learned_numbers_keep_the_order_of_the_files_scores():
    pieces, weight = L.vocabulary(public_tokenizer("piece_bpe_32k.model"))
    rng = np.random.default_rng(1)
    begins = np.array([p[:1] == b" " for p in pieces])
    count = np.where(begins, np.array([1, 1, 0, 0])[:, None], np.array([0, 0, 1, 1])[:, None]) * rng.poisson(weight * 1e5, (4, len(pieces))) * np.array([3, 1, 2, 1])[:, None]
    got = L.fitted(pieces, weight, count)
    assert np.exp(got[:2]).sum() == pytest.approx(1) == np.exp(got[2:]).sum()
    assert np.exp(got[0]).sum() == pytest.approx(0.75, abs=0.03) and (L.features(pieces).sum(axis=1) == 3).all()
    alike = [i for i, p in enumerate(pieces) if len(p) == 5 and p[:2] == b" s" and p[-1:] == b"e"]
    assert len(alike) > 5 and (np.diff(got[0, alike][np.argsort(weight[alike])]) >= 0).all()
    none = L.fitted(pieces, weight, np.zeros_like(count))
    assert np.allclose(np.exp(none), np.exp(L.first_scores(pieces, weight)))


def test_probabilities_of_words_sum_to_one():
    pieces = [b" ", b" a", b"a", b"b", b"ab"]
    lattice = L.Lattice(pieces, L.first_scores(pieces, np.array([0.1, 0.5, 0.2, 0.1, 0.1])))
    mass = [np.exp(lattice.forward([bytes(w) for w in product(b"ab", repeat=n)])).sum() for n in range(1, 13)]
    assert 0.97 < sum(mass) + np.exp(lattice.scores[L.WHOLE, 0]) <= 1 + 1e-9  # the space alone is the word without letters; longer words hold the rest


def test_vocabulary_covers_all_bytes():
    pieces, weight = L.vocabulary(public_tokenizer("piece_bpe_32k.model"))
    assert weight.min() > 0 and weight.sum() == pytest.approx(1) and len(pieces) == len(set(pieces)) == len(weight)
    assert weight[pieces.index(b" the")] > weight[pieces.index(b" therefore")]
    lattice = L.Lattice(pieces, L.first_scores(pieces, weight))
    letters = [bytes([b]) for b in range(256) if not 65 <= b <= 90 and b not in b" \t\n\r\v\f"]
    assert np.isfinite(lattice.forward(letters)).all() and np.isfinite(lattice.forward([b"".join(letters), b"\xff" * 5000])).all()


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_base_columns_and_defined_cases(spark, odd_docs, no_docs):
    from pyspark.sql import functions as F

    docs = odd_docs.withColumn("t", F.col("doc_id").isNull() | (F.col("doc_id") != 6))
    rows = L.score(docs, "t", block_bytes=20_000).collect()
    assert len(rows) == len(ROWS)
    tokens = {(i, t): [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None] for i, t, _ in ROWS}
    count = Counter(x for i, t, _ in ROWS if i != 6 for x in tokens[i, t])
    total, distinct = sum(count.values()), len(count)
    for r in rows:
        own = next(v for (i, _), v in tokens.items() if i == r["doc_id"])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(count[x] > 0 for x in own), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in own))
        assert math.isfinite(r["score"]) and r["score"] < 0
    again = {str(r["doc_id"]): r["score"] for r in L.score(docs, "t").collect()}
    assert all(again[str(r["doc_id"])] == pytest.approx(r["score"], rel=1e-4) for r in rows)
    assert L.score(no_docs.withColumn("t", F.lit(True)), "t").count() == 0
    unseen = L.score(docs.withColumn("t", F.lit(False)), "t").collect()
    assert len(unseen) == len(ROWS) and {(r["n_known"], r["train_tokens"]) for r in unseen} == {(0, 0)} and all(math.isfinite(r["score"]) for r in unseen)


def test_query_against_enumeration(spark, tmp_path, monkeypatch):
    """op6's scores from the enumeration of all segmentations, training included."""
    weight = np.arange(1.0, len(PIECES) + 1) / (len(PIECES) * (len(PIECES) + 1) / 2)
    monkeypatch.setattr(L, "vocabulary", lambda path: (PIECES, weight))
    rng = np.random.default_rng(5)
    rows = [(i, " ".join("".join("ab"[x] for x in rng.integers(0, 2, rng.integers(1, 5))) for _ in range(rng.integers(0, 9)))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in L.op6_subword_lattice(spark, str(tmp_path)).collect()}
    training = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    assert {i for i, r in got.items() if not r["held_out"]} == {r[0] for r in training} and len(got) == len(rows) > len(training)
    words = lambda rows: Counter(w.encode() for r in rows for w in r[1].split())
    scores = L.first_scores(PIECES, weight)
    for _ in range(L.ROUNDS):
        scores = L.fitted(PIECES, weight, expected_by_enumeration(words(training), scores)[1])
    size = sum(words(training).values()) + len(training)
    end = (len(training) + 1) / (size + 2)
    for i, text in rows:
        own = expected_by_enumeration(words([(i, text)]), scores)[0]
        total = end * math.prod((1 - end) * math.exp(own[w.encode()]) for w in text.split())
        assert got[i]["score"] == pytest.approx(math.log10(total), rel=1e-6)
        assert (got[i]["train_tokens"], got[i]["n_tokens"]) == (size, len(text.split()) + 1)


def test_the_files_scores_decide(spark, sf_dir, monkeypatch):
    """With equal scores for all pieces, held-out texts are clearly less probable."""
    pieces, weight = L.vocabulary(public_tokenizer("piece_bpe_32k.model"))
    held = []
    for w in (weight, np.full(len(weight), 1 / len(weight))):
        monkeypatch.setattr(L, "vocabulary", lambda path, w=w: (pieces, w))
        rows = [r for r in L.op6_subword_lattice(spark, sf_dir).collect() if r["held_out"]]
        held.append(sum(r["score"] for r in rows) / sum(r["n_tokens"] for r in rows))
    assert held[0] > held[1] + 0.1


def test_rates_are_the_likeliest_that_keep_the_files_order():
    """Against the formula by maxima of minima of means, piece by piece; pieces of one score have one rate."""
    pieces = [b"xaz", b"xbz", b"xcz", b"xdz", b"xez", b"yaz", b"ybz", b" "]
    weight = np.array([1, 2, 3, 3, 5, 4, 1, 1.0]) / 20
    count = np.array([40, 10, 90, 30, 50, 7, 9, 5.0]) * np.array([0, 0, 1, 2])[:, None] + np.eye(8)[7] * np.array([5, 5, 0, 0])[:, None]
    got = np.exp(L.fitted(pieces, weight, count))
    for k in (L.INNER, L.LAST):
        wanted = np.zeros(8)
        for own in ([0, 1, 2, 3, 4], [6, 5]):
            mean = lambda a, b, k=k, own=own: np.mean([count[k, i] + L.PRIOR * weight[i] for i in own if a <= weight[i] <= b])
            for i in own:
                wanted[i] = max(min(mean(a, b) for b in weight[own] if b >= weight[i]) for a in weight[own] if a <= weight[i])
        assert np.allclose(got[k, :7] / got[k, 4], wanted[:7] / wanted[4])
    assert got[2, 2] == pytest.approx(got[2, 3])


def test_frequent_words_are_parts_of_longer_words_alone(spark, tmp_path, monkeypatch):
    """The query with learned parts, against the enumeration of all segmentations."""
    weight = np.arange(1.0, len(PIECES) + 1) / (len(PIECES) * (len(PIECES) + 1) / 2)
    monkeypatch.setattr(L, "vocabulary", lambda path: (PIECES, weight))
    monkeypatch.setattr(L, "LEAST", 4)
    monkeypatch.setattr(L, "SHORTEST", 2)
    rng = np.random.default_rng(6)
    rows = [(i, " ".join("".join("ab"[x] for x in rng.integers(0, 2, rng.integers(1, 6))) for _ in range(rng.integers(0, 9)))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = lambda rows: Counter(w.encode() for r in rows for w in r[1].split())
    training = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    count = words(training)
    often = {w: n for w, n in count.items() if n >= 4 and 2 <= len(w) <= 4}
    found = L.frequent(spark.createDataFrame(list(count.items()), "word binary, n long"), 5)
    assert found == often and len(often) > 3
    monkeypatch.setattr(L, "PARTS", 2)
    assert len(few := L.frequent(spark.createDataFrame(list(count.items()), "word binary, n long"), 5)) <= 2 and min(few.values(), default=99) >= max(n for w, n in often.items() if w not in few)
    monkeypatch.setattr(L, "PARTS", 4096)
    got = {r["doc_id"]: r["score"] for r in L.op6_subword_lattice(spark, str(tmp_path)).collect()}
    parts, first = L.learned_parts(PIECES, often)
    assert sorted(parts) == sorted({p for w in often for p in (w, b" " + w)} - set(PIECES))
    scores = L.extended(L.first_scores(PIECES, weight), first, np.full(2, L.SHARE))
    monkeypatch.setitem(globals(), "PIECES", PIECES + parts)
    own = len(PIECES) - len(parts)
    for _ in range(L.ROUNDS):
        assert np.exp(scores[:2]).sum() == pytest.approx(1) == np.exp(scores[2:]).sum() and np.isneginf(scores[L.WHOLE, own:]).all()
        scores = L.refitted(PIECES[:own], weight, expected_by_enumeration(count, scores)[1])
    end = (len(training) + 1) / (sum(count.values()) + len(training) + 2)
    for i, text in rows:
        probability = expected_by_enumeration(words([(i, text)]), scores)[0]
        assert got[i] == pytest.approx(math.log10(end * math.prod((1 - end) * math.exp(probability[w.encode()]) for w in text.split())), rel=1e-6)


def test_held_out_scores_are_near_the_base(spark, sf_dir):
    rows = L.op6_subword_lattice(spark, sf_dir).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["score"] is not None and math.isfinite(r["score"]) for r in rows) and len(held) > 20
    tokens, base, score = (sum(r[c] for r in held) for c in ("n_tokens", "base_score", "score"))
    assert score / tokens > base / tokens - 1.1  # log10
