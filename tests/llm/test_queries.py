"""The registered queries themselves, on the smallest tables, against plain versions of what they promise."""

import hashlib
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from quillstream.llm import _bpe, audio, decontaminate, quality, toxicity
from quillstream.llm.queries import QUERIES, SQL

SPACE = b" \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def ids(docs):
    t = Tokenizer.from_file(_bpe.public_tokenizer("byte_bpe_50k.json"))
    return {i: t.encode(text, add_special_tokens=False).ids for i, text in docs}


def rows(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir).collect()


def crc(tokens):
    return zlib.crc32(np.asarray(tokens, "<u4").tobytes())


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    wanted = c.sql(SQL[name])
    df = QUERIES[name](spark, sf_dir).select(*wanted.columns)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, wanted.fetchall()))


def test_op2(spark, sf_dir, docs, ids):
    at, wanted = 0, []
    for i, _ in docs:
        own = [*ids[i], 0]
        wanted.append((i, at, len(own), crc(own)))
        at += len(own)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(spark, sf_dir, "op2_token_files")) == wanted


@pytest.mark.parametrize("name, module, column, modulus, held, threshold", [("op3_subword_toxicity", toxicity, "toxic", 3, 1, 0.7), ("op4_passage_quality", quality, "quality", 5, 0, 0.3)])
def test_op3_and_op4(spark, sf_dir, docs, name, module, column, modulus, held, threshold):
    """Folds and predictions, and each score as the model gives it to that text alone."""
    table = lambda x: spark.read.parquet(f"{sf_dir}/{x}.parquet")
    model = module.fit(table("documents"), table("labels"))
    alone = (lambda t: toxicity.Scorer(model)([t])[0]) if module is toxicity else lambda t: quality.forward(model, *quality.Passages()([t]))[0][0]
    texts = dict(docs)
    found = rows(spark, sf_dir, name)
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= threshold)
        assert r["score"] == pytest.approx(float(alone(texts[r["doc_id"]].encode())), rel=1e-5, abs=1e-7)
    marked = {r["doc_id"]: r[column] for r in table("labels").collect()}
    # labels of the held-out fold are not read
    other = table("labels").selectExpr("doc_id", *(f"CASE WHEN pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), {modulus}) = {held} THEN 1 - {c} ELSE {c} END AS {c}" if c == column else c for c in ("quality", "toxic")))
    again = module.fit(table("documents"), other)
    text = next(t for i, t in docs if i in marked).encode()
    assert alone(text) == (toxicity.Scorer(again)([text])[0] if module is toxicity else quality.forward(again, *quality.Passages()([text]))[0][0])


def test_op5(spark, sf_dir, docs):
    found, texts = {r["doc_id"]: r for r in rows(spark, sf_dir, "op5_telephony_audio")}, dict(docs)
    assert set(found) == set(texts)
    alike = defaultdict(set)
    for i, r in found.items():
        raw = texts[i].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] > r["payload_bytes"] and len(r["media_sha256"]) == 64 and len(r["pcm"]) == r["payload_bytes"] * 2 * audio.PCM_RATE // audio.RATE
        alike[texts[i]].add((r["media_sha256"], r["feature"]))
    assert all(len(x) == 1 for x in alike.values())


def test_op8(spark, sf_dir, docs, ids):
    found, used = defaultdict(list), defaultdict(list)
    for r in rows(spark, sf_dir, "op8_best_two_fit"):
        found[r["doc_id"]].append(r)
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(found) == set(ids)
    for i, own in found.items():
        tokens, at = [*ids[i], 2], 0
        for n, r in enumerate(sorted(own, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (n, at) and r["ids_crc32"] == crc(tokens[at : at + r["length"]]) and (r["length"] == 1024 or n == 0)
            at += r["length"]
        assert at == len(tokens) and (len(own) == 1 or len(tokens) > 1024)
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(used) <= -(-sum(len(x) + 1 for x in ids.values()) // 1024) + 3


def fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op10(spark, sf_dir, docs):
    prints = {i: fingerprint(t) for i, t in docs}
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3 and top(a) != top(b):
            root[max(top(a), top(b))] = min(top(a), top(b))
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows(spark, sf_dir, "op10_simhash_pivots")) == [(i, f"{prints[i]:016x}", top(i)) for i in sorted(prints)]
    assert max(Counter(map(top, prints)).values()) > 1


def test_op9(spark, sf_dir, docs):
    """Some items against full alignments with every document."""
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in rows(spark, sf_dir, "op9_qgram_decontamination")}
    items = {r["item_id"]: decontaminate.fold(r["text"].encode()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    texts = [decontaminate.fold(t.encode()) for _, t in docs]
    gap = b"\x01" * 120  # wider than any budget
    whole = np.frombuffer(gap.join(texts) + gap, np.uint8)
    ends = np.cumsum([len(t) + len(gap) for t in texts])
    place = np.arange(len(whole) + 1, dtype=np.int32)
    hit = sorted({i for _, i in found})[:3]
    chosen = [*hit, *[i for i in sorted(items, key=lambda i: len(items[i])) if i not in hit][:3]]
    assert hit
    for i in chosen:
        row = np.zeros(len(whole) + 1, np.int32)
        for n, byte in enumerate(items[i], 1):
            new = np.minimum(row[1:] + 1, row[:-1] + (whole != byte))
            row = np.minimum.accumulate(np.concatenate([[n], new]) - place) + place
        for (doc, _), a, b in zip(docs, [0, *ends[:-1]], ends, strict=True):
            least = int(row[a : b + 1].min())
            assert found.get((doc, i)) == (least if least <= decontaminate.budget(len(items[i])) else None), (doc, i)
