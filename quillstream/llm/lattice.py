"""Language-model scoring by a subword lattice.

The arcs of a word's lattice are the pieces of a published subword vocabulary, weighted by the scores that its file gives them. A
word's probability is the sum over all its segmentations, by a forward recursion in log space; a text's is the product over its
words and the end token. No word has an arc of its own: seen or not, it is worth what its segmentations are.

A piece has one score as a whole word, as a word's first piece, in its middle and at its end; scores of the first two kinds sum
to one, and those of the last two, so that the probabilities of all words do. Training documents set the scores by rounds of expected
counts over all segmentations of all training words, each as often as it occurs. Among pieces alike (`features`: of one length, first and last byte)
the order by scores stays the file's: a piece that the file holds likelier never gets a smaller score.

Published vocabularies lack the stems and endings of a corpus of its own kind. So training words that come often are parts of other words too: up to PARTS
of them, at least SHORTEST bytes long and LEAST times in training texts, begin, continue or end longer words. They are never an arc of their own word.

Jobs: texts are dealt into blocks of about BLOCK_BYTES; each block yields its distinct words with their training counts and
places (numbers within the block); counts are summed by word; each distinct word's lattice is run once; an equality join by
word takes the results back to the places, of which a word has one a block, so that Spark can split it; each text's sums are
taken there. What is shuffled grows with the corpus; what reaches the driver is a row per piece and kind, and the words that are parts.
A word of over LONG bytes is run in pieces of CHUNK bytes with a window of the sums before, so memory doesn't grow with its length.

Defined cases: null text counts as empty, with the end token alone; repeated rows and null ids stay (all null ids share one
fold); other columns are ignored; without training documents N and V are zero and the file's scores stand; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain
from math import exp, inf, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bpe import public_tokenizer
from ._common import fold, shuffle_partitions, slices, staged, table, utf8
from ._text import Rows

BLOCK_BYTES = 12_000_000
#: Rounds of expected counts over all training words; pieces of each kind of arcs that are counted beside them, as the file's scores have them.
ROUNDS, PRIOR = 3, 1000.0
#: Training words that may be parts of others, their fewest occurrences and bytes (the file has the shorter ones), and their share of arcs before the first round.
PARTS, LEAST, SHORTEST, SHARE = 4096, 10, 4, 0.5
#: Kinds of arcs: a whole word, its first piece, one inside, its last piece.
WHOLE, FIRST, INNER, LAST = range(4)
#: Bytes of text that a worker turns into words at once; words of which it runs the lattices at once; longest word for which numpy runs along words.
PART_BYTES, PART_WORDS, LONG = 2_000_000, 20_000, 40
#: Bytes of a longer word whose arcs are held at once; lengths of pieces that are told apart.
CHUNK, LENGTHS = 1 << 14, 12
_P = np.uint64(0x9E3779B97F4A7C15)


@cache
def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Of a sentencepiece file: the pieces as bytes (a word begins with a space), without capitals and white space inside, and their probabilities.

    The file is of the byte-pair kind, whose score is minus the rank of a piece; by Zipf's law its probability is in proportion to 1 / (rank + 3). Single bytes that
    have no score get the smallest one, so every word has a segmentation.
    """
    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]): 0.0 for b in range(256)}
    for i in range(file.get_piece_size()):
        if not (file.is_unknown(i) or file.is_control(i) or file.is_byte(i) or file.is_unused(i)):
            piece = file.id_to_piece(i).replace("▁", " ").encode()
            if piece == piece.lower() and not set(piece[1:]) & set(b" \t\n\r\v\f"):
                found[piece] = 1 / (3 - file.get_score(i))
    pieces = sorted(p for p in found if p not in (b"\t", b"\n", b"\r", b"\v", b"\f") and not 65 <= p[0] <= 90)
    weight = np.array([found[p] for p in pieces])
    weight[weight == 0] = weight[weight > 0].min(initial=1.0)
    return pieces, weight / weight.sum()


def normal(counts: np.ndarray) -> np.ndarray:
    """Natural logs of counts (.. x 4 x pieces): the first two kinds of arcs sum to one, and so do the other two."""
    with np.errstate(divide="ignore"):
        return np.log(np.concatenate([x / x.sum(axis=(-2, -1), keepdims=True) for x in (counts[..., :INNER, :], counts[..., INNER:, :])], axis=-2))


def first_scores(pieces: list[bytes], weight: np.ndarray) -> np.ndarray:
    """Scores (4 x pieces) from the file's alone: pieces that begin with a space begin words; an arc ends its word or not, equally likely."""
    begins = np.array([p[:1] == b" " for p in pieces])
    return normal(np.where(begins, weight, 0) * np.array([1, 1, 0, 0])[:, None] + np.where(begins, 0, weight) * np.array([0, 0, 1, 1])[:, None])


def features(pieces: list[bytes]) -> np.ndarray:
    """What a piece's weight may depend on besides the file's: its length in bytes (LENGTHS or more are one), first and last byte, as ones among zeros."""
    bare = [p.lstrip(b" ") or b" " for p in pieces]
    columns = []
    for values in (np.array([min(len(p), LENGTHS) for p in pieces]), np.array([p[0] for p in bare]), np.array([p[-1] for p in bare])):
        columns.append(values[:, None] == np.unique(values)[None, :])
    return np.concatenate(columns, axis=1).astype(float)


def rising(sums: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Rates of levels of so many pieces, whose counts are summed, that don't fall within a group and are the likeliest such: neighbours out of order are pooled."""
    total, size, levels, own = [], [], [], []
    for s, n, g in zip(sums.tolist(), sizes.tolist(), group.tolist(), strict=True):
        total.append(s)
        size.append(n)
        levels.append(1)
        own.append(g)
        while len(own) > 1 and own[-2] == g and total[-2] * size[-1] >= total[-1] * size[-2]:
            own.pop()
            for held in (total, size, levels):
                last = held.pop()
                held[-1] += last
    return np.repeat(np.array(total) / np.array(size), levels)


def fitted(pieces: list[bytes], weight: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Scores (4 x pieces) that make the expected counts likeliest, of those that keep the file's order among pieces alike, kind by kind. Without counts they are the file's."""
    begins, rates = np.array([p[:1] == b" " for p in pieces]), np.zeros((4, len(pieces)))
    alike = np.unique(features(pieces).nonzero()[1].reshape(len(pieces), -1), axis=0, return_inverse=True)[1].reshape(-1)
    for kinds, which in (((WHOLE, FIRST), np.flatnonzero(begins)), ((INNER, LAST), np.flatnonzero(~begins))):
        order = which[np.lexsort((weight[which], alike[which]))]
        first = np.diff(alike[order], prepend=-1) != 0
        first |= np.diff(weight[order], prepend=-1) != 0  # pieces alike of one score have one rate
        level = np.cumsum(first) - 1
        for k in kinds:
            sums = np.bincount(level, expected[k, order] + PRIOR * weight[order])
            rates[k, order] = rising(sums, np.bincount(level), alike[order][first])[level]
    return normal(rates)


def learned_parts(pieces: list[bytes], words: dict[bytes, int]) -> tuple[list[bytes], np.ndarray]:
    """What words add to the pieces, each after a space (where longer words begin) and without, and first counts by kind (4 x parts)."""
    have = set(pieces)
    found = {p: n for word, n in sorted(words.items()) for p in (b" " + word, word) if p not in have}
    begins = np.array([p[:1] == b" " for p in found], bool)
    return list(found), np.array(list(found.values()), float) * np.stack([begins & False, begins, ~begins, ~begins])


def extended(scores: np.ndarray, parts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Scores (4 x pieces and parts): the file's pieces' and after them those of parts by their counts, which hold such shares of the first two kinds of arcs and of the other two."""
    if not parts.shape[1]:
        return scores
    sums = parts.reshape(2, -1).sum(axis=1)
    share = np.where(sums > 0, share, 0)
    rates = parts * np.repeat(share / np.where(sums > 0, sums, 1), 2)[:, None]
    with np.errstate(divide="ignore"):
        return np.concatenate([scores + np.repeat(np.log1p(-share), 2)[:, None], np.log(rates)], axis=1)


def refitted(pieces: list[bytes], weight: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Scores by the expected counts of the file's pieces and of the parts after them."""
    parts = expected[:, len(pieces) :]
    return extended(fitted(pieces, weight, expected[:, : len(pieces)]), parts, parts.reshape(2, -1).sum(axis=1) / (expected.reshape(2, -1).sum(axis=1) + PRIOR))


def kind(begin: int, end: int, n: int) -> int:
    return (WHOLE if end == n else FIRST) if begin == 0 else (LAST if end == n else INNER)


class Lattice:
    """Forward and backward sums over words; each word is read with a leading space. scores: 4 x pieces, natural logs."""

    def __init__(self, pieces: list[bytes], scores: np.ndarray):
        self.scores = np.column_stack([scores, np.full(4, -np.inf)])  # the last column for what is no piece
        self.longest = max(map(len, pieces))
        size = 1 << 20
        self.slots = np.full(size, len(pieces), np.int64)
        self.codes = np.zeros(len(pieces) + 1, np.uint64)
        for n in range(1, self.longest + 1):
            own = [i for i, p in enumerate(pieces) if len(p) == n]
            if own:
                code = np.zeros(len(own), np.uint64)
                with np.errstate(over="ignore"):
                    for column in np.array([list(pieces[i]) for i in own], np.uint64).T:
                        code = code * _P + column + np.uint64(1)
                self.codes[own] = code
        for i, at in enumerate(self._slot(self.codes[:-1]).tolist()):
            while self.slots[at] != len(pieces):
                at = (at + 1) % size
            self.slots[at] = i

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return ((code ^ (code >> np.uint64(31))) * _P >> np.uint64(44)).astype(np.int64)

    def find(self, code: np.ndarray) -> np.ndarray:
        """Piece number of each hash; the number of pieces if there is none."""
        none = len(self.codes) - 1
        at = self._slot(code)
        out = self.slots[at]
        wrong = np.flatnonzero((out != none) & (self.codes[out] != code))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) % len(self.slots)
            out[wrong] = self.slots[at[wrong]]
            wrong = wrong[(out[wrong] != none) & (self.codes[out[wrong]] != code[wrong])]
        return out

    def _arcs(self, words: list[bytes]) -> Iterator[tuple[int, int, np.ndarray]]:
        """For words of one length: (begin, end, piece of each word) of every span that is a piece in some word."""
        letters = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1).astype(np.uint64)
        n = letters.shape[1] + 1
        letters = np.column_stack([np.full(len(words), 32, np.uint64), letters])
        prefix, powers = [np.zeros(len(words), np.uint64)], [np.uint64(1)]
        with np.errstate(over="ignore"):
            for column in letters.T:
                prefix.append(prefix[-1] * _P + column + np.uint64(1))
                powers.append(powers[-1] * _P)
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                found = self.find(prefix[j] - prefix[i] * powers[j - i])
                if (found != len(self.codes) - 1).any():
                    yield i, j, found

    def _by_length(self, words: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """(length with the space, numbers of the words) of words short enough for numpy."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(size[(size > 0) & (size <= LONG)]).tolist():
            yield n + 1, np.flatnonzero(size == n)

    def forward(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's probability; of the empty word 0."""
        out = np.zeros(len(words))
        for n, own in self._by_length(words):
            ahead = np.full((n + 1, len(own)), -np.inf)
            ahead[0] = 0
            for i, j, found in self._arcs([words[k] for k in own]):
                np.logaddexp(ahead[j], ahead[i] + self.scores[kind(i, j, n)][found], out=ahead[j])
            out[own] = ahead[n]
        for k, word in enumerate(words):
            if len(word) > LONG:
                for _, _, sums in self._ahead(b" " + word):
                    out[k] = sums[-1]
        return out

    def expect(self, words: list[bytes], times: np.ndarray, expected: np.ndarray) -> None:
        """Adds to expected (4 x pieces and one more) the pieces' expected counts over words that occur so many times."""
        for n, own in self._by_length(words):
            arcs, weight = list(self._arcs([words[k] for k in own])), times[own]
            ahead, behind = np.full((2, n + 1, len(own)), -np.inf)
            ahead[0] = behind[n] = 0
            for i, j, found in arcs:
                np.logaddexp(ahead[j], ahead[i] + self.scores[kind(i, j, n)][found], out=ahead[j])
            whole = np.where(ahead[n] > -np.inf, ahead[n], np.inf)  # a word without a segmentation counts for nothing
            for i, j, found in sorted(arcs, key=lambda a: -a[0]):
                reached = behind[j] + self.scores[kind(i, j, n)][found]
                np.add.at(expected[kind(i, j, n)], found, np.exp(ahead[i] + reached - whole) * weight)
                np.logaddexp(behind[i], reached, out=behind[i])
        for k, word in enumerate(words):
            if len(word) > LONG and times[k]:
                self._expect_long(b" " + word, float(times[k]), expected)

    def _spans(self, letters: np.ndarray, begin: int, end: int) -> list[list[tuple[int, int, int]]]:
        """Of each place from begin + 1 to end of a word the arcs that end there: (kind, first place, piece)."""
        n, first = len(letters), max(0, begin - self.longest)
        code, powers = np.zeros(end - first + 1, np.uint64), np.ones(self.longest + 1, np.uint64)
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(end - begin)]
        with np.errstate(over="ignore"):
            # Hashes of the last so many bytes before each place, a byte more each time.
            for size in range(1, min(self.longest, end) + 1):
                code[size:] += (letters[first : end - size + 1].astype(np.uint64) + np.uint64(1)) * powers[size - 1]
                powers[size] = powers[size - 1] * _P
                places = np.arange(max(begin + 1, first + size), end + 1)
                found = self.find(code[places - first])
                for at in np.flatnonzero(found != len(self.codes) - 1).tolist():
                    j = int(places[at])
                    out[j - begin - 1].append((kind(j - size, j, n), j - size, int(found[at])))
        return out

    def _ahead(self, word: bytes, begins: list[int] | None = None, known: list[float] | None = None) -> Iterator[tuple[int, list, list[float]]]:
        """The forward sums of one word, chunk after chunk: the chunk's begin, its arcs, and sums from `longest` places before it (or the word's begin) on."""
        letters, n = np.frombuffer(word, np.uint8), len(word)
        window = known or [0.0]
        for begin in begins if begins is not None else range(0, n, CHUNK):
            arcs, first, sums = self._spans(letters, begin, min(begin + CHUNK, n)), begin - len(window) + 1, list(window)
            for spans in arcs:
                terms = [sums[i - first] + self.scores[k, r] for k, i, r in spans]
                top = max(terms, default=-inf)
                sums.append(top + log(sum(exp(t - top) for t in terms)) if top > -inf else -inf)
            yield begin, arcs, sums
            window = sums[-min(len(sums), self.longest) :]

    def _expect_long(self, word: bytes, times: float, expected: np.ndarray) -> None:
        """Forward once, keeping what each chunk begins with; then chunk by chunk from the last one, forward again and backward."""
        held, whole, n = [], -inf, len(word)
        window = [0.0]
        for begin, _, sums in self._ahead(word):
            held.append((begin, window))
            window, whole = sums[-min(len(sums), self.longest) :], sums[-1]
        if whole == -inf:
            return
        behind = {n: 0.0}  # backward sums of the places that arcs may still begin or end at
        for begin, window in reversed(held):
            _, arcs, sums = next(self._ahead(word, [begin], window))
            first, kinds, rows, shares = begin - len(window) + 1, [], [], []
            for at in range(len(arcs) - 1, -1, -1):
                after = behind.pop(begin + at + 1, -inf)
                for k, i, r in arcs[at]:
                    reached = after + self.scores[k, r]
                    kinds.append(k)
                    rows.append(r)
                    shares.append(sums[i - first] + reached - whole)
                    before = behind.get(i, -inf)
                    top = max(before, reached)
                    behind[i] = top + log(exp(before - top) + exp(reached - top)) if top > -inf else -inf
            np.add.at(expected, (np.array(kinds, np.int64), np.array(rows, np.int64)), np.exp(shares) * times)


def tokens(text: bytes) -> list[bytes]:
    """Words between the six ASCII white spaces, A-Z in lower case. The end token is the empty word."""
    return text.lower().split()


def _numbered(texts: list[bytes], rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of the texts, each ended by the end token, and the texts' sizes."""
    own = [[*tokens(t), b""] for t in texts]
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    return np.fromiter(map(rows.__getitem__, chain.from_iterable(own)), np.int64, int(sizes.sum())), sizes


def dealt(docs: DataFrame, blocks: int) -> DataFrame:
    """docs: doc_id, text, train. Adds the block and packs the text, which is shuffled twice."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(1).compress
        for batch, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(press, texts), pa.binary()), batch.column(2), batch.column(3)], names=["doc_id", "text", "train", "block"])

    rows = docs.select("doc_id", "text", "train", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))
    return rows.mapInArrow(pack, "doc_id long, text binary, train boolean, block int")


def _parts(packed: list[bytes]) -> Iterator[tuple[int, int, list[bytes]]]:
    unpack = zstandard.ZstdDecompressor().decompress
    begin, held, texts = 0, 0, []
    for i, t in enumerate(packed):
        texts.append(unpack(t) if t else b"")
        held += len(texts[-1])
        if held >= PART_BYTES or i + 1 == len(packed):
            yield begin, i + 1, texts
            begin, held, texts = i + 1, 0, []


def _ordered(group: pa.Table) -> pa.Table:
    """A block's rows by id and text: shuffles give no order, and words are numbered as they appear."""
    rows = list(zip(group.column("doc_id").to_pylist(), group.column("text").to_pylist(), strict=True))
    return group.take(sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][1])))


def block_words(rows: DataFrame) -> DataFrame:
    """Of each block its distinct words: block, place (the word's number in order of appearance), word, and how often it is in the block's training texts."""

    def count(group: pa.Table) -> pa.Table:
        words, found, group = Rows(), np.zeros(1 << 12, np.int64), _ordered(group)
        train = group.column("train").to_numpy()
        for a, b, texts in _parts(group.column("text").to_pylist()):
            row, sizes = _numbered(texts, words)
            while len(words) > len(found):
                found = np.concatenate([found, np.zeros_like(found)])
            found += np.bincount(row[np.repeat(train[a:b], sizes)], minlength=len(found))
        n = len(words)
        block = np.full(n, group.column("block")[0].as_py(), np.int32)
        return pa.Table.from_arrays([pa.array(block), pa.array(np.arange(n, dtype=np.int32)), pa.array(list(words), pa.binary()), pa.array(found[:n])], names=["block", "place", "word", "n"])

    return rows.groupBy("block").applyInArrow(count, "block int, place int, word binary, n long")


class Model(NamedTuple):
    """Sums over the training documents (tokens, distinct tokens), pieces, their scores, and the end token's probability (natural logs)."""

    total: int
    distinct: int
    pieces: list[bytes]
    scores: np.ndarray
    end: float

    def base(self, count: np.ndarray) -> np.ndarray:
        """log10 of the add-one probability of words of these counts."""
        return np.log10((count + 1) / (self.total + self.distinct + 1))

    def words(self, lattice: Lattice, words: list[bytes]) -> np.ndarray:
        """Natural log of each token's probability; the empty word is the end token."""
        ends = np.fromiter((not w for w in words), bool, len(words))
        return lattice.forward(words) + np.where(ends, self.end, np.log1p(-np.exp(self.end)))


def frequent(trained: DataFrame, longest: int) -> dict[bytes, int]:
    """trained: word, n. The words that may be parts, with their counts: all above the lowest level of counts (a 16th of a doubling) down to which they are PARTS at most."""
    size = F.octet_length("word")
    able = trained.where((F.col("n") >= LEAST) & (size >= SHORTEST) & (size < longest)).withColumn("level", F.floor(F.log2("n") * 16))
    cut, held = inf, 0
    for level, n in sorted(map(tuple, able.groupBy("level").count().collect()), reverse=True):  # a few hundred rows
        held += n
        if held > PARTS:
            break
        cut = level
    return {bytes(word): n for word, n in able.where(F.col("level") >= cut).select("word", "n").collect()} if cut < inf else {}


def train(totals: DataFrame, tokenizer: str) -> Model:
    """totals: word, and its count n in training documents."""
    pieces, weight = vocabulary(tokenizer)
    ends = F.octet_length("word") == 0
    sums = totals.agg(F.count_if(F.col("n") > 0).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(ends, F.col("n"))), F.lit(0)).alias("docs")).first()
    trained = totals.where(~ends & (F.col("n") > 0)).select("word", "n")
    parts, count = learned_parts(pieces, frequent(trained, max(map(len, pieces))))
    every, scores = pieces + parts, extended(first_scores(pieces, weight), count, np.full(2, SHARE))
    for _ in range(ROUNDS if sums["n"] else 0):
        shared = totals.sparkSession.sparkContext.broadcast((every, scores))  # four numbers a piece of the vocabulary

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice, expected = Lattice(*shared.value), np.zeros((4, len(shared.value[0]) + 1))
            for batch in batches:
                words, times = batch.column("word").to_pylist(), batch.column("n").to_numpy()
                for at in range(0, len(words), PART_WORDS):
                    lattice.expect(words[at : at + PART_WORDS], times[at : at + PART_WORDS], expected)
            place = np.nonzero(expected[:, :-1])
            yield pa.RecordBatch.from_arrays([*map(pa.array, place), pa.array(expected[:, :-1][place])], names=["kind", "piece", "n"])

        found = trained.mapInArrow(expect, "kind long, piece long, n double").groupBy("kind", "piece").agg(F.sum("n").alias("n")).toArrow()  # a row per kind and piece
        count = np.zeros((4, len(every)))
        count[tuple(found.column(c).to_numpy() for c in ("kind", "piece"))] = found.column("n").to_numpy()
        scores = refitted(pieces, weight, count)
    return Model(sums["n"], sums["v"], every, scores, log((sums["docs"] + 1) / (sums["n"] + 2)))


def score(docs: DataFrame, train_column: str, tokenizer: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs: doc_id, text and a boolean column named by `train_column`. Returns doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"), F.coalesce(F.col(train_column), F.lit(False)).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = shuffle_partitions(spark)  # asked for by number, as few bytes are much work here: Spark would put them into fewer tasks
    packed = dealt(rows, max(n, -(-size // block_bytes))).repartition(n, "block")
    places = staged(block_words(packed), "word-places")
    totals = staged(places.repartition(n, "word").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    model = train(totals, tokenizer or public_tokenizer("piece_bpe_32k.model"))
    shared = spark.sparkContext.broadcast(model)  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lattice = Lattice(model.pieces, model.scores)
        for batch in batches:
            for at in range(0, batch.num_rows, PART_WORDS):
                part = batch.slice(at, PART_WORDS)
                yield pa.RecordBatch.from_arrays([part.column("word"), part.column("n"), pa.array(model.words(lattice, part.column("word").to_pylist()))], names=["word", "n", "log"])

    scored = totals.mapInArrow(run, "word binary, n long, log double")
    back = places.select("word", "block", "place").join(scored, "word").select("block", "place", "n", "log").repartition(n, "block")
    out = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def sum_up(left: pa.Table, right: pa.Table) -> pa.Table:
        model = shared.value
        left, order = _ordered(left), np.argsort(right.column("place").to_numpy())
        total, logs = right.column("n").to_numpy()[order], right.column("log").to_numpy()[order]
        base, words, parts = model.base(total), Rows(), [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2]
        for _, _, texts in _parts(left.column("text").to_pylist()):
            row, sizes = _numbered(texts, words)  # the same numbers as in block_words
            first = np.cumsum(sizes) - sizes
            parts.append((sizes, np.add.reduceat((total[row] > 0).astype(np.int64), first), np.add.reduceat(base[row], first), np.add.reduceat(logs[row], first) / log(10)))
        sizes, seen, base_score, own = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.Table.from_arrays([left.column("doc_id"), pa.array(sizes), pa.array(seen), pa.array(np.full(len(sizes), model.total)), pa.array(base_score), pa.array(own)], names=out)

    return packed.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(sum_up, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 7) == 2
    found = score(table(spark, sf_dir, "documents").withColumn("_train", ~held_out), "_train")
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
