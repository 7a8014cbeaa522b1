from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from quillstream.llm import _bpe, decontaminate, quality, simhash, toxicity
from quillstream.llm._common import staged, table

from .conftest import ROWS


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(staged(stage(spark, out[-1], sf_dir), name))
    return out


def test_stages_take_effect_and_keep_columns(spark, sf_dir, steps):
    docs, clean, good, single, unseen, packed = steps
    for df in (clean, good, single, unseen):
        assert df.dtypes == docs.dtypes
    ids = [Counter(r["doc_id"] for r in df.select("doc_id").collect()) for df in steps[:5]]
    assert all(not (b - a) for a, b in zip(ids, ids[1:], strict=False)) and ids[0] != ids[1] != ids[2] != ids[3]
    scorer = toxicity.Scorer(toxicity.fit(docs, table(spark, sf_dir, "labels")))
    rows = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    assert set(ids[1]) == {i for i, t in rows.items() if scorer([t])[0] < 0.7}
    model, passages = quality.fit(clean, table(spark, sf_dir, "labels")), quality.Passages()
    assert set(ids[2]) == {i for i in ids[1] if quality.forward(model, *passages([rows[i]]))[0][0] >= 0.3}
    prints = {i: simhash.fingerprint(rows[i]) for i in ids[2]}
    root = {i: i for i in prints}
    for i in sorted(prints):
        for j in sorted(prints):
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 3 and root[i] != root[j]:
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    assert set(ids[3]) == set(root.values())
    items = [decontaminate.fold(r["text"].encode()) for r in table(spark, sf_dir, "benchmark").collect()]
    assert not any(t in decontaminate.fold(rows[i]) for i in ids[4] for t in items)
    assert all(decontaminate.matches_in(decontaminate.Items.of(list(enumerate(items))), [rows[i]]) for i in set(ids[3]) - set(ids[4]))
    tokenizer = Tokenizer.from_file(_bpe.public_tokenizer())
    sizes = Counter()
    for r in packed.collect():
        sizes[r["doc_id"]] += r["length"]
    assert sizes == {i: len(tokenizer.encode(rows[i].decode(), add_special_tokens=False).ids) + 1 for i in ids[4]}


def test_odd_rows_and_empty_tables(spark, sf_dir, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in P.STAGES[:-1]:
            docs = staged(stage(spark, docs, sf_dir), "odd")
            assert docs.columns == odd_docs.columns
        P.STAGES[-1][1](spark, docs, sf_dir).collect()
    kept = simhash.first_of_each(odd_docs).collect()
    # Ids 2, 3 and 4 have no words, 6 and 7 (twice) one text; every other row is its own.
    assert Counter(r["doc_id"] for r in kept) == Counter({i for i, _, _ in ROWS} - {3, 4, 7})


def test_run(spark, sf_dir, steps):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert rows(P.run(spark, sf_dir)) == rows(steps[-1])
