"""Quality: attention-based multiple-instance learning over a text's passages.

A passage of WIDTH words is encoded by one tanh layer from its words' subwords (character 3- to 5-grams, hashed with a sign into
SUBWORDS numbers, the mean over the passage) and from what the words look like (lengths, cases, digits, symbols, words that repeat). Gated attention weighs the encoded passages of a text, and a logistic unit scores their weighted mean. All weights
are learned together, by gradient descent in numpy, from document labels alone. The driver trains on at most SAMPLE labelled
rows, whatever the corpus; tasks score every whole text.

Defined cases: null text counts as empty; a text without words has one passage whose features are zero; repeated rows and
null ids stay; other columns are ignored; without labels of both kinds every score is the share of label 1 (1 without
labels, so that nothing is rejected unseen); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fold, labelled_sample, slices, table, unused, utf8
from ._text import Rows, newest, windows

#: Labelled rows that training takes at most.
SAMPLE = 6000
WIDTH, HIDDEN, GATE, STEPS, RATE = 64, 16, 8, 100, 0.05
#: Numbers that hold a word's subwords; how much steeper weights of theirs are drawn to zero than the others (1e-5).
SUBWORDS, DECAY = 32, 100.0
#: Words that a worker remembers; beyond it starts anew.
MOST_WORDS = 200_000
#: Bytes of text that become passages at once; words whose features are made at once.
SLICE_BYTES, PART = 500_000, 10_000
#: Distances at which a word is compared with earlier ones.
LAGS = (1, 2, 3, 5, 8)
_KINDS = np.zeros((256, 8), np.float32)
for _kind, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b".,;:", b"!?", b"|", [*b"#$%&*+/<=>@\\^_`{}~"], range(128, 256))):
    _KINDS[list(_bytes), _kind] = 1
WORD_FEATURES, FEATURES = 20 + SUBWORDS, 20 + SUBWORDS + len(LAGS)


def word_features(words: list[bytes]) -> np.ndarray:
    """Of each word: length, shares of its kinds of bytes, whether it is all of one kind, kind of its last byte."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(size)
    kinds = np.add.reduceat(_KINDS[code], ends - size, axis=0)
    share = kinds / size[:, None]
    capitals = (kinds[:, 1] > 1) & (kinds[:, 0] == 0)
    title = (kinds[:, 1] == 1) & (kinds[:, 0] > 0)
    return np.column_stack([np.minimum(size, 40) / 10, size > 30, share, capitals, title, _KINDS[code[ends - 1]], subwords(words)]).astype(np.float32)


def subwords(words: list[bytes]) -> np.ndarray:
    """Of each word, A-Z in lower case and with its bounds: the mean over its n-grams, each one of SUBWORDS numbers with a sign, by a hash."""
    held = [b"<" + w.lower() + b">" for w in words]
    size = np.fromiter(map(len, held), np.int64, len(held))
    code = np.frombuffer(b"".join(held), np.uint8).astype(np.uint64)
    ends, of = np.repeat(np.cumsum(size), size), np.repeat(np.arange(len(held)), size)
    out = np.zeros(len(held) * SUBWORDS)
    for n in (3, 4, 5):
        at = np.flatnonzero(np.arange(len(code)) + n <= ends)
        h = np.full(len(at), 1469598103934665603 + n, np.uint64)
        for k in range(n):
            h = (h ^ code[at + k]) * np.uint64(1099511628211)
        h ^= h >> np.uint64(29)
        out += np.bincount(of[at] * SUBWORDS + (h % np.uint64(SUBWORDS)).astype(np.int64), 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float64), len(out))
    grams = sum(np.maximum(size - n + 1, 0) for n in (3, 4, 5))
    return out.reshape(-1, SUBWORDS) / grams[:, None]


class Passages:
    """Turns texts into passages; remembers each word's features."""

    def __init__(self) -> None:
        self.rows, self.known, self.features = Rows(), 0, np.empty((1 << 14, WORD_FEATURES), np.float32)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Features of each passage, and the number of passages of each text."""
        if len(self.rows) > MOST_WORDS:
            self.rows, self.known = Rows(), 0
        own = [t.split() or [b" "] for t in texts]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        row = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(own)), np.int64, int(sizes.sum()))
        while len(self.rows) > len(self.features):
            self.features = np.concatenate([self.features, np.empty_like(self.features)])
        for part in (new[k : k + PART] for new in [newest(self.rows, self.known)] for k in range(0, len(new), PART)):
            self.features[self.known : self.known + len(part)] = word_features(part)
            self.known += len(part)
        starts, text = windows(sizes, WIDTH)
        length = np.diff(starts, append=len(row))
        mean = np.add.reduceat(self.features[row], starts, axis=0) / length[:, None]
        place = np.arange(len(row)) - np.repeat(starts, length)
        same = [np.add.reduceat((place >= k) & (row == np.roll(row, k)), starts, dtype=np.float32) / length for k in LAGS]
        return np.column_stack([mean, *same]).astype(np.float32), np.bincount(text, minlength=len(texts))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def forward(model: dict, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, tuple]:
    first = np.cumsum(counts) - counts
    h = np.tanh(((x - model["mean"]) / model["scale"]) @ model["w"] + model["b"])
    t, s = np.tanh(h @ model["v"]), sigmoid(h @ model["u"])
    e = (t * s) @ model["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), counts))
    attention = e / np.repeat(np.add.reduceat(e, first), counts)
    z = np.add.reduceat(attention[:, None] * h, first, axis=0)
    return sigmoid(z @ model["c"] + model["d"]), (h, t, s, attention, z, first)


def gradients(model: dict, x: np.ndarray, counts: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict:
    """Of the weighted cross entropy of the texts' labels, by each array that is learned."""
    inputs, of = (x - model["mean"]) / model["scale"], np.repeat(np.arange(len(counts)), counts)
    p, (h, t, s, attention, z, first) = forward(model, x, counts)
    g = (p - labels) * weight
    d_z = g[:, None] * model["c"]
    inner = (h * d_z[of]).sum(axis=1)
    d_e = attention * (inner - np.repeat(np.add.reduceat(attention * inner, first), counts))
    d_t, d_s = d_e[:, None] * model["a"] * s * (1 - t * t), d_e[:, None] * model["a"] * t * s * (1 - s)
    d_h = (attention[:, None] * d_z[of] + d_t @ model["v"].T + d_s @ model["u"].T) * (1 - h * h)
    return {"w": inputs.T @ d_h, "b": d_h.sum(axis=0), "v": h.T @ d_t, "u": h.T @ d_s, "a": (t * s).T @ d_e, "c": z.T @ g, "d": np.array([g.sum()])}


def train(texts: list[bytes], labels: np.ndarray, seed: int = 0) -> dict:
    rng = np.random.default_rng(seed)
    model = {"w": rng.normal(0, 0.3, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "v": rng.normal(0, 0.3, (HIDDEN, GATE)), "u": rng.normal(0, 0.3, (HIDDEN, GATE)), "a": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1), "mean": np.zeros(FEATURES), "scale": np.ones(FEATURES)}
    share = float(np.mean(labels)) if len(labels) else 1.0
    if share in (0.0, 1.0):
        return model | {"c": np.zeros(HIDDEN), "d": np.array([30.0 if share else -30.0])}
    passages = Passages()
    x, counts = (np.concatenate(x) for x in zip(*(passages(texts[k : k + 200]) for k in range(0, len(texts), 200)), strict=True))
    del passages
    model["mean"], model["scale"] = x.mean(axis=0), x.std(axis=0) + 1e-3
    weight = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    learned = ["w", "b", "v", "u", "a", "c", "d"]
    decay = np.where((np.arange(FEATURES) >= 20) & (np.arange(FEATURES) < WORD_FEATURES), DECAY, 1.0)[:, None]
    moments = {k: (np.zeros_like(model[k]), np.zeros_like(model[k])) for k in learned}
    for step in range(1, STEPS + 1):
        gradient = gradients(model, x, counts, labels, weight)
        for k in learned:
            m, v = moments[k]
            d = gradient[k] + 1e-5 * model[k] * (decay if k == "w" else 1.0)
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            model[k] = model[k] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def score(docs: DataFrame, model: dict, threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """doc_id, score and predicted of every row; with `keep`, instead these columns of the rows that are predicted 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred numbers

    text = unused(docs, "utf8")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages()
        for batch, texts in slices(batches, text, SLICE_BYTES):
            found = forward(shared.value, *passages(texts))[0]
            if keep is not None:
                yield batch.filter(pa.array(found >= threshold)).drop_columns([text])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.astype(np.float64)), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    if keep is not None:
        return docs.select(*keep, utf8("text").alias(text)).mapInArrow(of, docs.select(*keep).schema)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias(text)).mapInArrow(of, "doc_id long, score double, predicted int")


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> dict:
    """Learns from rows whose crc32(doc_id) mod 5 is not 0."""
    sample = labelled_sample(docs, labels, "quality", fold("doc_id", 5) != 0, most)
    return train([t for _, t, _ in sample], np.array([y for _, _, y in sample], np.float64))


def op4_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
