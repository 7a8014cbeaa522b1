"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character 3- to 5-grams (with word bounds) and of the word itself, all
hashed into one table, so a misspelling shares most of its vectors with the word. A text is cut into windows of WINDOW words;
the mean vector of a window's words goes through a linear softmax, and the text's score is that of its highest window.
A word of over LONGEST bytes (scripts without spaces, joined words) is cut into overlapping parts that hold all of its n-grams;
each part, with the vector of the whole word, is a window of its own, so such a word counts as its highest part.
Table and softmax are learned together by gradient descent on document labels. The driver trains on at most SAMPLE labelled
rows, whatever the corpus; tasks score every whole text. As the softmax is linear, a word adds one number per class, which a
task computes once per distinct word.

Defined cases: null text counts as empty; a text without words scores by the bias alone; repeated rows and null ids stay;
other columns are ignored; without labels of both kinds every score is the share of label 1 (0 without labels); an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fold, labelled_sample, slices, table, unused, utf8
from ._text import Rows, newest, windows

#: Labelled rows that training takes at most.
SAMPLE = 6000
WINDOW, BUCKETS, DIMENSION = 8, 1 << 16, 8
#: Rounds of training and steps in each; the steps' size; the gradient below which a vector's steps shrink, so that rare n-grams learn little.
ROUNDS, STEPS, RATE, FLOOR = 10, 25, 0.15, 1e-3
#: Words that a worker remembers; beyond it starts anew.
MOST_WORDS = 400_000
#: Words whose n-grams are made at once.
PART = 20_000
#: Bytes of the longest word that counts as one, and of the parts of longer ones; parts overlap by half or more.
LONGEST = 48
_FOLD = bytes.maketrans(bytes(range(33, 48)) + b":;<=>?@[\\]^_`{|}~", b" " * 32)


class Model(NamedTuple):
    table: np.ndarray  # BUCKETS x DIMENSION
    weight: np.ndarray  # DIMENSION x 2
    bias: np.ndarray  # 2


def words_of(text: bytes) -> list[bytes]:
    """Words between white space and ASCII punctuation, A-Z in lower case."""
    return text.lower().translate(_FOLD).split()


def apart(words: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Words of at most LONGEST bytes, and the parts of the others: a space, LONGEST bytes of the word with its bounds, the whole word's hash."""
    if max(map(len, words), default=0) <= LONGEST:
        return words, []
    parts = []
    for w in words:
        if len(w) > LONGEST:
            held = b"<" + w + b">"
            whole = xxhash.xxh64_intdigest(held, 3).to_bytes(8, "little")
            last = len(held) - LONGEST
            parts += [b" " + held[k : k + LONGEST] + whole for k in chain(range(0, last, LONGEST // 2), (last,))]
    return [w for w in words if len(w) <= LONGEST], parts


def subwords(words: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the n-grams of all words and parts of words, and how many each has. An n-gram is of UTF-8 bytes."""
    held = [w[1:-8] if w.startswith(b" ") else b"<" + w + b">" for w in words]
    size = np.fromiter(map(len, held), np.int64, len(held))
    code = np.frombuffer(b"".join(held), np.uint8).astype(np.uint64)
    ends = np.repeat(np.cumsum(size), size)
    of = np.repeat(np.arange(len(held)), size)
    found, owner = [], []
    for n in (3, 4, 5):
        at = np.flatnonzero(np.arange(len(code)) + n <= ends)
        h = np.full(len(at), 1469598103934665603 + n, np.uint64)
        for k in range(n):
            h = (h ^ code[at + k]) * np.uint64(1099511628211)
        found.append(h)
        owner.append(of[at])
    whole = np.fromiter((int.from_bytes(w[-8:], "little") if w.startswith(b" ") else xxhash.xxh64_intdigest(h, 3) for w, h in zip(words, held, strict=True)), np.uint64, len(held))
    found.append(whole)
    owner.append(np.arange(len(held)))
    grams, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    grams = grams[order]
    return ((grams ^ (grams >> np.uint64(29))) % np.uint64(buckets)).astype(np.int32), np.bincount(owner, minlength=len(held)).astype(np.int32)


def windows_of(sizes: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows over all texts' words, which all texts' parts follow, and the text of each. A part is a window."""
    starts, text = windows(sizes, WINDOW)
    return np.append(starts, sizes.sum() + np.arange(parts.sum())), np.append(text, np.repeat(np.arange(len(parts)), parts))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[bytes], labels: np.ndarray, seed: int = 0) -> Model:
    """Rounds of: pick windows by the model so far (of label 1 each text's highest; of label 0 each round's highest, all kept), then steps on them."""
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32), rng.normal(0, 0.3, (DIMENSION, 2)), np.zeros(2))
    share = float(np.mean(labels)) if len(labels) else 0.0
    if share in (0.0, 1.0):
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros_like(model.table), model.weight, np.log(np.array([1 - p, p])))
    rows = Rows()
    flat = [[np.fromiter(map(rows.__getitem__, x), np.int32) for x in apart(words_of(t))] for t in texts]
    sizes = np.array([[len(x) for x in both] for both in flat], np.int64)
    word, y, sizes = np.concatenate([both[i] for i in range(2) for both in flat]), labels[sizes.any(axis=1)].astype(np.int64), sizes[sizes.any(axis=1)]
    starts, text = windows_of(*sizes.T)
    length = np.diff(starts, append=len(word))
    del flat
    parts = [subwords(list(islice(rows, k, k + PART))) for k in range(0, len(rows), PART)]  # parts keep what numpy holds at once small
    grams, counts = (np.concatenate([p[i] for p in parts]) for i in range(2))
    at = np.cumsum(counts, dtype=np.int64) - counts
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in model]
    step, hard = 0, np.empty(0, np.int64)
    for round_ in range(ROUNDS):
        if round_ == 0:
            order = rng.permutation(len(text))
            nth = np.empty(len(text), np.int64)  # of its text, in random order
            by_text = order[np.argsort(text[order], kind="stable")]
            nth[by_text] = np.arange(len(text)) - np.flatnonzero(np.diff(text[by_text], prepend=-1))[text[by_text]]
            chosen = np.flatnonzero(nth < 4)
        else:
            by_bucket = model.table @ (model.weight[:, 1] - model.weight[:, 0])
            by_word = np.concatenate([np.add.reduceat(by_bucket[g], np.cumsum(n) - n) / n for g, n in parts])
            margin = np.add.reduceat(by_word[word], starts) / length
            order = np.lexsort((margin, text))
            top = order[np.append(np.flatnonzero(np.diff(text[order])), len(order) - 1)]
            hard = np.union1d(hard, top[y[text[top]] == 0])
            chosen = np.concatenate([top[y[text[top]] == 1], hard])
        spans = np.repeat(starts[chosen] - np.cumsum(length[chosen]) + length[chosen], length[chosen]) + np.arange(length[chosen].sum())
        of = np.repeat(np.arange(len(chosen)), length[chosen])
        used, slot = np.unique(word[spans], return_inverse=True)
        own = np.repeat(at[used] - np.cumsum(counts[used]) + counts[used], counts[used]) + np.arange(counts[used].sum())
        bag, bag_word, bag_at = grams[own], np.repeat(np.arange(len(used)), counts[used]), np.cumsum(counts[used]) - counts[used]
        target = y[text[chosen]]
        weight = np.where(target == 1, 0.4 / max(1, target.sum()), 0.6 / max(1, (1 - target).sum()))
        begin = np.cumsum(length[chosen]) - length[chosen]
        for _ in range(STEPS):
            vectors = np.add.reduceat(model.table[bag], bag_at, axis=0) / counts[used][:, None]
            bags = np.add.reduceat(vectors[slot], begin, axis=0) / length[chosen][:, None]
            g = (softmax(bags @ model.weight + model.bias) - np.eye(2)[target]) * weight[:, None]
            d_bags = (g @ model.weight.T) / length[chosen][:, None]
            d_vectors = np.stack([np.bincount(slot, d_bags[of, k], len(used)) for k in range(DIMENSION)], axis=1) / counts[used][:, None]
            d_table = np.stack([np.bincount(bag, d_vectors[bag_word, k], BUCKETS) for k in range(DIMENSION)], axis=1)
            step += 1
            for x, d, (m, v), floor in zip(model, (d_table, bags.T @ g, g.sum(axis=0)), moments, (FLOOR, 1e-8, 1e-8), strict=True):
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                x -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + floor)).astype(x.dtype)
    return model


class Scorer:
    """Scores texts; remembers each word's margin (class 1 less class 0)."""

    def __init__(self, model: Model):
        self.model, self.rows, self.margin = model, Rows(), np.zeros(1 << 14, np.float64)
        self.known = 0

    def _learn(self) -> None:
        new = newest(self.rows, self.known)
        while len(self.rows) > len(self.margin):
            self.margin = np.concatenate([self.margin, np.zeros_like(self.margin)])
        difference = (self.model.weight[:, 1] - self.model.weight[:, 0]).astype(np.float64)
        by_bucket = self.model.table @ difference
        for at in range(0, len(new), PART):
            part = new[at : at + PART]
            grams, counts = subwords(part)
            self.margin[self.known : self.known + len(part)] = np.add.reduceat(by_bucket[grams], np.cumsum(counts) - counts) / counts
            self.known += len(part)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if len(self.rows) > MOST_WORDS:
            self.rows, self.known = Rows(), 0
        own = [apart(words_of(t)) for t in texts]
        sizes = np.array([[len(x) for x in both] for both in own], np.int64).reshape(-1, 2)
        row = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(both[i] for i in range(2) for both in own)), np.int64, int(sizes.sum()))
        if len(self.rows) > self.known:
            self._learn()
        top = np.full(len(texts), -np.inf)
        starts, text = windows_of(*sizes.T)
        if len(starts):
            np.maximum.at(top, text, np.add.reduceat(self.margin[row], starts) / np.diff(starts, append=len(row)))
        top[~sizes.any(axis=1)] = 0.0
        return 1 / (1 + np.exp(-np.clip(top + float(self.model.bias[1]) - float(self.model.bias[0]), -500, 500)))


def score(docs: DataFrame, model: Model, threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """doc_id, score and predicted of every row; with `keep`, instead these columns of the rows that are not predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    scorers: dict = {}

    text = unused(docs, "utf8")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorers.setdefault(0, Scorer(shared.value))
        for batch, texts in slices(batches, text):
            found = scorer(texts)
            if keep is not None:
                yield batch.filter(pa.array(found < threshold)).drop_columns([text])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    if keep is not None:
        rows = docs.select(*keep, utf8("text").alias(text))
        return rows.mapInArrow(of, docs.select(*keep).schema)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias(text)).mapInArrow(of, "doc_id long, score double, predicted int")


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Learns from rows whose crc32(doc_id) mod 3 is not 1."""
    sample = labelled_sample(docs, labels, "toxic", fold("doc_id", 3) != 1, most)
    return train([t for _, t, _ in sample], np.array([y for _, _, y in sample], np.int64))


def op3_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
