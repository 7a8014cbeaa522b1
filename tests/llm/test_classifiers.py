"""Toxicity and quality: held-out accuracy, gradients' effect, odd rows."""

import numpy as np
import pytest

from quillstream.llm import quality, toxicity

from .conftest import ROWS


@pytest.fixture(scope="module")
def prose():
    rng = np.random.default_rng(4)
    syllables = ["an", "er", "th", "in", "on", "re", "ti", "st", "ou", "ed"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    return rng, lambda n: [word() for _ in range(n)]


def toxic_set(rng, words, n, bad):
    texts, labels = [], []
    for i in range(n):
        own = words(int(rng.integers(20, 300)))
        if i % 2:
            for _ in range(2 + len(own) // 60):
                own.insert(int(rng.integers(len(own))), str(rng.choice(bad)))
        texts.append(" ".join(own).encode())
        labels.append(i % 2)
    return texts, np.array(labels)


def test_toxicity_learns_words_and_their_misspellings(prose):
    rng, words = prose
    model = toxicity.train(*toxic_set(rng, words, 600, ["zwumpkin", "blorfous", "quaxhead"]))
    scorer = toxicity.Scorer(model)
    texts, labels = toxic_set(rng, words, 200, ["zwumpkin", "blorfous", "quaxhead"])
    assert ((scorer(texts) >= 0.7) == labels).mean() > 0.97
    texts, labels = toxic_set(rng, words, 200, ["zwumpkinn", "blorfouss", "quaxxhead", "zwumpk1n"])
    assert ((scorer(texts) >= 0.7) == labels).mean() > 0.9
    assert 0 <= scorer([b""])[0] < 0.7
    long = b" ".join([texts[0]] * 200)
    assert scorer([long])[0] < 0.7 < scorer([long + b" zwumpkin blorfous quaxhead zwumpkin" * 3])[0]


def test_toxicity_reads_long_words_to_their_end(prose):
    rng, words = prose
    bad = ["zwumpkin", "blorfous", "quaxhead"]

    def joined(n):
        texts, labels = [], []
        for i in range(n):
            own = "".join(words(int(rng.integers(60, 200))))
            at = int(rng.integers(60, len(own)))
            texts.append((own[:at] + str(rng.choice(bad)) * (i % 2) + own[at:]).encode())
            labels.append(i % 2)
        return texts, np.array(labels)

    spaced, of_spaced = toxic_set(rng, words, 400, bad)
    runs, of_runs = joined(400)
    scorer = toxicity.Scorer(toxicity.train(spaced + runs, np.append(of_spaced, of_runs)))
    runs, labels = joined(200)
    assert ((scorer(runs) >= 0.7) == labels).mean() > 0.9
    spaced, labels = toxic_set(rng, words, 200, bad)
    assert ((scorer(spaced) >= 0.7) == labels).mean() > 0.95
    start = b"an" * 30
    assert scorer([start + b"er"])[0] != scorer([start + b"th"])[0]
    w = start + b"zwumpkin"
    parts = toxicity.apart([w, b"an"])
    assert parts[0] == [b"an"] and all(any(held[k : k + 5] in p[1:-8] for p in parts[1]) for held in [b"<" + w + b">"] for k in range(len(held) - 4))


def test_quality_finds_the_bad_passage(prose):
    rng, words = prose

    def made(n):
        texts, labels = [], []
        for i in range(n):
            own = words(int(rng.integers(30, 600)))
            if i % 2 == 0:
                kind, k = i // 2 % 4, len(own) // 2
                bad = own[:k]
                own = [w.upper() + "!!" for w in bad] if kind == 0 else [w + "***" for w in bad] if kind == 1 else [x for w in bad for x in (w, "|")] if kind == 2 else [w for w in bad[: k // 10 + 1] for _ in range(12)]
                own += words(20)
            texts.append(" ".join(own).encode())
            labels.append(i % 2)
        return texts, np.array(labels, float)

    model = quality.train(*made(400))
    texts, labels = made(200)
    assert ((quality.forward(model, *quality.Passages()(texts))[0] >= 0.3) == labels).mean() > 0.95


def test_quality_gradients_against_differences(prose):
    rng, words = prose
    texts = [" ".join(words(int(rng.integers(1, 300)))).encode() for _ in range(9)]
    x, counts = quality.Passages()(texts)
    labels, weight = rng.integers(0, 2, 9).astype(float), rng.random(9)
    model = {k: rng.normal(0, 0.5, n) for k, n in (("w", (quality.FEATURES, 16)), ("b", 16), ("v", (16, 8)), ("u", (16, 8)), ("a", 8), ("c", 16), ("d", 1))} | {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 1e-3}

    def loss():
        p = quality.forward(model, x, counts)[0]
        return -(weight * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum()

    found = quality.gradients(model, x, counts, labels, weight)
    for k, gradient in found.items():
        for at in {tuple(int(rng.integers(n)) for n in gradient.shape) for _ in range(6)}:
            before = model[k][at]
            model[k][at] = before + 1e-5
            more = loss()
            model[k][at] = before - 1e-5
            less = loss()
            model[k][at] = before
            assert gradient[at] == pytest.approx((more - less) / 2e-5, rel=1e-3, abs=1e-7)


def test_quality_subwords():
    found = quality.subwords([b"Word", b"word", b"words", b"\xff", b"a"])
    assert (found[0] == found[1]).all() and 0 < np.abs(found[1] - found[2]).sum() < np.abs(found[1]).sum() + np.abs(found[2]).sum() and np.isfinite(found).all()


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(spark, odd_docs, no_docs, module):
    column = "toxic" if module is toxicity else "quality"
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 10)] + [(None, 1, 1), (3, None, None), (77, 1, 0)], "doc_id long, quality int, toxic int")
    model = module.fit(odd_docs, labels)
    rows = module.score(odd_docs, model).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _, _ in ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (6, 7)}) == 1
    assert module.score(no_docs, model).count() == 0
    kept = module.score(odd_docs, model, keep=odd_docs.columns)
    assert kept.columns == odd_docs.columns
    for labels_ in (labels.limit(0), labels.where(f"{column} = 1")):
        scores = {r["score"] for r in module.score(odd_docs, module.fit(odd_docs, labels_)).collect()}
        assert len(scores) == 1
    assert module.score(no_docs, module.fit(no_docs, labels)).count() == 0
