"""Token files, packing, audio and WARC: exact round trips and brute force."""

import gzip
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstream.llm import _bpe, audio, packing, token_files, warc
from quillstream.llm._common import shared_path

from .conftest import ROWS


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(_bpe.public_tokenizer())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_word_encoder_equals_library(plain):
    rng = np.random.default_rng(3)
    parts = [" ", "  ", "\n", "\t", "a", "Word", "é", "ß", "1", "²", "½", "_", "'s", "'", "日", "\x1c", "\x85", "\xa0", "\r\n", "<|endoftext|>", "🙂", "́", "×", "ª", "​", "\x00", "٣"]
    encoder = _bpe.WordEncoder(_bpe.public_tokenizer())
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(3000)]
    ids, bounds = encoder.encode(texts, 7)
    for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == [*plain(t), 7], repr(t)


def test_other_tokenizers_go_through_the_library():
    path = _bpe.public_tokenizer("word_bpe_49k.json")
    encoder = _bpe.WordEncoder(path)
    assert not encoder.by_word
    ids, bounds = encoder.encode(["Hello there", ""], 5)
    assert ids[bounds[0] : bounds[1]].tolist() == [*Tokenizer.from_file(path).encode("Hello there", add_special_tokens=False).ids, 5] and bounds[2] - bounds[1] == 1


def test_token_files_round_trip(spark, odd_docs, no_docs, plain):
    path = shared_path(spark, "test")
    manifest = token_files.write(odd_docs, path, _bpe.public_tokenizer(), 0, 3)
    rows = token_files.read(spark, path, with_ids=True).collect()
    by_start = sorted(rows, key=lambda r: r["start"])
    expected = sorted(((i is not None, i, t or "") for i, t, _ in ROWS), key=lambda r: (r[0], r[1] or 0, r[2].encode()))
    at = 0
    for r, (_, i, t) in zip(by_start, expected, strict=True):
        ids = [*plain(t), 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (i, at, len(ids), crc(ids), ids)
        at += len(ids)
    assert sum(r["n_tokens"] for r in manifest.collect()) == at and {r["width"] for r in manifest.collect()} == {2}
    empty = shared_path(spark, "test")
    token_files.write(no_docs, empty, _bpe.public_tokenizer())
    assert token_files.read(spark, empty).count() == 0


def test_token_files_in_runs(tmp_path, monkeypatch):
    """Runs of few documents and ids, mapped and, as on remote storage, read by ranges."""
    rng = np.random.default_rng(4)
    tokens, sizes = rng.integers(0, 60_000, 500).astype("<u2"), rng.multinomial(500, np.ones(40) / 40)
    offsets = np.append(0, np.cumsum(sizes))
    for end, data in (("bin", tokens), ("idx", offsets.astype("<i8")), ("doc", np.arange(40).astype("<i8"))):
        (tmp_path / f"x.{end}").write_bytes(data.tobytes())
    remote = fs.SubTreeFileSystem("/", fs.LocalFileSystem())
    for most_rows, most_ids in ((7, 8_000_000), (20_000, 3), (20_000, 60), (20_000, 8_000_000)):
        monkeypatch.setattr(token_files, "ROWS", most_rows)
        monkeypatch.setattr(token_files, "IDS", most_ids)
        for files in (fs.LocalFileSystem(), remote):
            monkeypatch.setattr(token_files, "files_of", lambda path, files=files: (files, path))
            runs = list(token_files.documents(str(tmp_path), "x", 2))
            assert np.concatenate([r[0] for r in runs]).tolist() == list(range(40)) and np.array_equal(np.concatenate([r[2] for r in runs]), tokens)
            for ids, at, part in runs:
                assert len(ids) == len(at) - 1 <= most_rows and len(part) == at[-1] - at[0] and (len(ids) == 1 or len(part) <= most_ids)
                assert np.array_equal(part, tokens[at[0] : at[-1]])


def test_packing_whole_and_gapless(spark, odd_docs, no_docs, plain):
    rows = packing.pack(odd_docs, _bpe.public_tokenizer(), 2, 64, with_ids=True).collect()
    texts = defaultdict(list)
    for i, t, _ in ROWS:
        texts[i].append([*plain(t), 2])
    for i, wanted in texts.items():
        own = [r for r in rows if r["doc_id"] == i]
        assert sum(r["length"] for r in own) == sum(map(len, wanted))
        for k in {(r["piece"], r["start"], tuple(r["ids"])) for r in own}:
            assert list(k[2]) == wanted[0][k[1] : k[1] + len(k[2])]
        assert all(r["length"] == 64 for r in own if r["piece"]) and all(crc(r["ids"]) == r["ids_crc32"] for r in own)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for used in bins.values():
        at = 0
        for offset, length in sorted(used):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 64) + 1
    assert packing.pack(no_docs, _bpe.public_tokenizer()).count() == 0


def test_best_two_fit_uses_each_piece_once_and_beats_greedy():
    rng = np.random.default_rng(0)
    for capacity in (10, 100, 1024):
        sizes = rng.integers(1, capacity + 1, 3000)
        histogram = dict(zip(*map(np.ndarray.tolist, np.unique(sizes, return_counts=True)), strict=True))
        found = packing.best_two_fit(histogram, capacity)
        used = defaultdict(int)
        for pattern, n in found:
            assert sum(pattern) <= capacity and n > 0
            for x in pattern:
                used[x] += n
        assert used == histogram
        assert sum(n for _, n in found) <= 1.1 * sizes.sum() / capacity + sum(n for k, n in histogram.items() if k > capacity * 0.6)
    # 6 takes 3, leaving 1; the 3 gives way to 2 + 2, which fills the gap
    assert sorted(packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0][0]) == [2, 2, 6]


def one_at_a_time(sizes, capacity):
    """Best-two-fit, sequence after sequence, by looking at every piece and every pair."""
    left, out = sorted(sizes), []
    while left:
        own, gap = [], capacity
        while (fit := [x for x in left if x <= gap]):
            own.append(fit[-1])
            left.remove(fit[-1])
            gap -= fit[-1]
        if gap and len(own) > 1:
            room = gap + own[-1]
            pairs = [(left[i] + left[j], i, j) for i in range(len(left)) for j in range(i) if left[i] + left[j] <= room]
            best = max(pairs, default=(0, 0, 0))
            if best[0] > own[-1]:
                two = [left[best[1]], left[best[2]]]
                for x in two:
                    left.remove(x)
                left = sorted([*left, own.pop()])
                own += two
        out.append(sum(own))
    return out


def test_best_two_fit_against_one_sequence_at_a_time():
    rng = np.random.default_rng(4)
    for _ in range(60):
        capacity = int(rng.integers(6, 40))
        sizes = rng.integers(1, capacity + 1, int(rng.integers(1, 60))).tolist()
        histogram = dict(zip(*map(np.ndarray.tolist, np.unique(sizes, return_counts=True)), strict=True))
        found = [sum(pattern) for pattern, n in packing.best_two_fit(histogram, capacity) for _ in range(n)]
        assert found == one_at_a_time(sizes, capacity)


def decoded(block):
    value, index, out = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88), []
    out.append(value)
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(audio.MOVES[code & 7])))
            out.append(value)
    return out


def test_audio_tables_and_blocks():
    assert audio.MU_LAW[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0] and audio.A_LAW[[0xD5, 0x55, 0x2A, 0xAA]].tolist() == [8, -8, -32256, 32256]
    blocks = np.random.default_rng(1).integers(0, 256, (50, 64)).astype(np.uint8)
    assert audio.decode_adpcm(blocks).tolist() == [decoded(bytes(b)) for b in blocks]
    assert audio.resample(np.array([0, 10, 4], np.int16), np.array([2, 3]), 16000).tolist() == [0, 5, 10, 10, 4, 4]
    assert audio.resample(np.array([0, 10, 4, -7], np.int16), np.array([2, 4])).tolist() == [5, -2]
    for rate in (3000, 12000, 500):
        with pytest.raises(ValueError):
            audio.resample(np.zeros(8, np.int16), np.array([2, 8]), rate)


def test_audio_round_trip(spark, odd_docs, no_docs):
    path = shared_path(spark, "test")
    audio.store(odd_docs, path)
    rows = audio.load(spark, path, pcm=16000).collect()
    stored = {str(r["doc_id"]): r for r in audio.load(spark, path, pcm=4000).collect()}
    wanted = defaultdict(list)
    for i, t, _ in ROWS:
        wanted[i].append((t or "").encode())
    assert len(rows) == len(ROWS)
    for r in rows:
        raw = wanted[r["doc_id"]][0]
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        media = audio.container(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        samples = audio.MU_LAW[np.frombuffer(payload, np.uint8)].astype(int)
        slow = ((samples[::2] + samples[1::2]) // 2).astype("<i2").tobytes()
        assert len(r["pcm"]) == 4 * len(payload) and np.frombuffer(r["pcm"], "<i2")[::2].tolist() == samples.tolist()
        assert bytes(stored[str(r["doc_id"])]["pcm"]) == slow and r["feature"].endswith(f"pcm4k={len(payload) // 2}/{zlib.crc32(slow):08x}")
    assert len({r["feature"] for r in rows if r["doc_id"] in (6, 7)}) == 1 == len({r["feature"] for r in rows if r["doc_id"] in (2, 3)})
    empty = shared_path(spark, "test")
    audio.store(no_docs, empty)
    assert audio.load(spark, empty).count() == 0


def test_warc_round_trip_and_filters(spark, tmp_path):
    big, line = "<p>ü</p>\r\n\r\nWARC/1.1\r\n" * 60, "short"
    rows = [(1, "http://a/1", big), (2, "http://b/2", big), (5, None, big), (5, None, big), (None, "http://a/null", big), (3, "http://a/3", None), (4, "http://a/ 4\n", line), (6, "u", line), (7, "u", "x" * 1000), (8, "u", "")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    path = shared_path(spark, "test")
    assert sum(r["records"] for r in warc.write(pages, path).collect()) == len(rows)
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["record_id"].removeprefix("urn:page:")
        html = next(h or "" for k, _, h in rows if str(k).replace("None", "null") == i).encode()
        revisit = html == big.encode() and i != "5"
        assert r["record_type"] == ("revisit" if revisit else "response") and r["refers_to"] == ("urn:page:5" if revisit else None)
        assert r["payload_bytes"] == len(html) and r["payload_digest"] == hashlib.sha1(html).hexdigest() and r["payload"] == (None if revisit else html)
    frame = warc.read(spark, path)
    assert frame.where("record_type = 'revisit'").count() == 3
    assert frame.where("target_uri LIKE 'http://a/%' AND record_type IN ('response', 'x')").count() == 2
    assert warc.read(spark, path, "skip").agg({"payload": "count"}).first()[0] == 0
    # a plain file and one gzip stream over all records, as other writers make them
    other = tmp_path / "other"
    other.mkdir()
    raw = b"".join(b"".join(warc.record(i, f"http://x/{i}", h.encode(), hashlib.sha1(h.encode()).hexdigest(), None)) for i, h in ((70, big * 9000), (71, ""), (72, line)))
    (other / "a.warc").write_bytes(raw)
    (other / "b.warc.gz").write_bytes(gzip.compress(raw[: len(raw) // 2]) + gzip.compress(raw[len(raw) // 2 :]))
    assert gzip.decompress(warc.member(raw)) == raw
    for kind in ("bytes", "skip"):
        assert sorted((r["record_id"][-2:], r["payload_bytes"]) for r in warc.read(spark, f"file://{other}", kind).collect()) == sorted([("70", len((big * 9000).encode())), ("71", 0), ("72", 5)] * 2)
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert len(list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 3)]))) == 1 and len(reader.wanted) == 1
    assert warc.write(pages.limit(0), shared_path(spark, "test")).count() == 0
    empty = shared_path(spark, "test")
    warc.write(pages.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


def test_warc_records_of_every_kind_and_cut_files(spark, tmp_path):
    """Blocks that are no HTTP are payloads as they are, empty lines and all; a record that its file ends in is marked."""

    def other(kind, type_, block):
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{kind}>\r\n" + (f"Content-Type: {type_}\r\n" if type_ else "") + f"Content-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    blocks = {"warcinfo": ("application/warc-fields", b"software: x\r\nformat: WARC\r\n\r\n"), "conversion": ("text/plain", b'{"a":1}\n\nsecond part'), "resource": (None, b"\n\nlines\n\n"), "metadata": ("application/warc-fields", b""), "response": ("application/http; msgtype=response", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody\r\n\r\nmore")}
    payloads = {k: b"body\r\n\r\nmore" if k == "response" else block for k, (_, block) in blocks.items()}
    whole = b"".join(other(k, *x) for k, x in blocks.items())
    folder = tmp_path / "kinds"
    folder.mkdir()
    for name, data in (("a.warc", whole), ("b.warc.gz", gzip.compress(whole)), ("c.warc.gz", b"".join(warc.member(other(k, *x)) for k, x in blocks.items()))):
        (folder / name).write_bytes(data)
        for kind in ("bytes", "digest", "skip"):
            got = {r["record_type"]: r for r in warc.read(spark, f"file://{folder}", kind).collect()}
            assert set(got) == set(blocks) and not any(r["truncated"] for r in got.values())
            for k, r in got.items():
                assert r["payload_bytes"] == len(payloads[k]) and r["content_type"] == blocks[k][0]
                assert kind != "bytes" or r["payload"] == payloads[k]
                assert kind != "digest" or r["payload_digest"] == hashlib.sha1(payloads[k]).hexdigest()
        assert warc.read(spark, f"file://{folder}").where("content_type = 'text/plain'").count() == 1
        (folder / name).unlink()
    long = other("conversion", "text/plain", b"x" * 2_000_000)
    for name, data in (("a.warc", whole + long[:-900_000]), ("b.warc.gz", gzip.compress(whole + long)[:-700]), ("c.warc.gz", gzip.compress(whole + long[:-900_000]))):
        (folder / name).write_bytes(data)
        got = warc.read(spark, f"file://{folder}").orderBy("payload_bytes").collect()
        assert len(got) == 6 and [r["truncated"] for r in got] == [False] * 5 + [True] and 100_000 < got[-1]["payload_bytes"] < 2_000_000
        (folder / name).unlink()


def test_warc_files_are_read_in_parts(spark):
    """Ranges of a file hold each record once; other readers see nothing of the index."""
    path = shared_path(spark, "test")
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("http://x").alias("url"), F.repeat(F.md5(F.col("id").cast("string")), (F.col("id") % 50).cast("int")).alias("html")).coalesce(1)
    warc.write(pages, path, mark=500)
    ranges = warc.WarcReader({"path": path, "split": "3000"}).partitions()
    assert len(ranges) > 10 > len({r.name for r in ranges}) and {r.begin for r in ranges} == {0, *(r.end for r in ranges if r.end)}
    want = sorted((f"urn:page:{r['page_id']}", r["html"].encode()) for r in pages.collect())
    for split in (3000, 1 << 30):
        assert sorted((r["record_id"], r["payload"]) for r in warc.read(spark, path, split=split).collect()) == want
    files, folder = warc.files_of(path)
    name = ranges[0].name
    with files.open_input_file(f"{folder}/{name}") as raw:
        places = warc.indexed(raw)
        raw.seek(0)
        text = gzip.decompress(raw.read())
        assert places and text.endswith(b"\r\n\r\n")
        for at in places:
            raw.seek(at)
            assert raw.read(4) == b"\x1f\x8b\x08\x04"
    assert len(warc.index(list(range(20_000)))) < 65_536 + 64


def test_word_encoder_forgets_and_learns_anew(plain, monkeypatch):
    monkeypatch.setattr(_bpe, "MOST_WORDS", 40)
    encoder, rng = _bpe.WordEncoder(_bpe.public_tokenizer()), np.random.default_rng(6)
    for _ in range(60):
        texts = [" ".join(f"w{int(rng.zipf(1.3)) % 300}x" for _ in range(rng.integers(0, 30))) for _ in range(5)]
        ids, bounds = encoder.encode(texts, 9)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [[*plain(t), 9] for t in texts]
        assert len(encoder.rows) == encoder.known
