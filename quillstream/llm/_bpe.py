"""Token ids by the tokenizers library, at the speed of a word table.

A byte-level BPE encodes each pre-token by itself, so a worker asks the library once per distinct pre-token and
looks the rest up. Tokenizers of any other make go through the library's own batch call.
"""

from __future__ import annotations

import json
import re
from functools import cache
from itertools import chain, islice

import numpy as np
import regex
from tokenizers import Tokenizer

#: The pre-token pattern of byte-level BPE files that use the built-in split.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same on texts of ASCII and the Latin letters U+00C0 to U+024F alone.
_SPACE = r"\t-\r "
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^{_SPACE}{_LETTER}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

_words = regex.compile(PATTERN).findall
_latin_words = re.compile(LATIN).findall
_other = re.compile(f"[^\x00-\x7f{_LETTER}]").search
#: Pre-tokens that a worker remembers (about 80 MB); beyond, it keeps those that came again, half as many at most.
MOST_WORDS = 400_000


def pre_tokens(text: str) -> list[str]:
    return _words(text) if _other(text) else _latin_words(text)


class _Rows(dict):
    """Pre-token to row number; a new one gets the next number."""

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        return row


class WordEncoder:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        kind = json.loads(self.library.to_str())
        split = kind["pre_tokenizer"] or {}
        self.by_word = kind["model"]["type"] == "BPE" and kind["normalizer"] is None and kind["post_processor"] is None and kind["model"].get("dropout") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        self.newline = self.library.encode("\n", add_special_tokens=False).ids
        self._reset()

    def _reset(self) -> None:
        self.rows, self.ids, self.used, self.known = _Rows(), np.empty(1 << 16, np.uint32), 0, 0
        self.start, self.size, self.seen = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _trim(self) -> None:
        """Forgets the pre-tokens that came once since the last time."""
        n = len(self.rows)
        again = np.flatnonzero(self.seen[:n] > 1)
        if len(again) > MOST_WORDS // 2:
            again = np.sort(again[np.argpartition(-self.seen[again], MOST_WORDS // 2)[: MOST_WORDS // 2]])
        words, start, size, ids = list(self.rows), self.start[again], self.size[again], self.ids
        self._reset()
        for i in again.tolist():
            self.rows[words[i]]
        self._room()
        self._keep(np.arange(len(again)), size, ids[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())])
        self.known = len(again)

    def _room(self) -> None:
        while len(self.rows) > len(self.start):
            self.start, self.size, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.seen))

    def _learn(self) -> None:
        """Asks the library for the pre-tokens that are new."""
        new = list(islice(reversed(self.rows), len(self.rows) - self.known))[::-1]
        self._room()
        plain = [i for i, w in enumerate(new) if not w[0].isspace() or (w[0] == " " and len(w) > 1 and not w[1].isspace())]
        rest = set(range(len(new))) - set(plain)
        for at in range(0, len(plain), 20_000):  # a line each; the line feed is a pre-token of its own
            part = plain[at : at + 20_000]
            ids = np.asarray(self.library.encode_batch_fast(["\n".join([new[i] for i in part])], add_special_tokens=False)[0].ids, np.uint32)
            feeds = np.flatnonzero(ids == self.newline[0]) if len(self.newline) == 1 else []
            if len(feeds) + 1 == len(part):
                self._keep(np.asarray(part), np.diff(feeds, prepend=-1, append=len(ids)) - 1, ids[ids != self.newline[0]])
            else:
                rest.update(part)
        rest = sorted(rest)
        found = [np.asarray(e.ids, np.uint32) for e in self.library.encode_batch_fast([new[i] for i in rest], add_special_tokens=False)]
        if rest:
            self._keep(np.asarray(rest), np.fromiter(map(len, found), np.int64, len(found)), np.concatenate(found))
        self.known = len(self.rows)

    def _keep(self, new: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[self.known + new] = size
        self.start[self.known + new] = self.used + np.cumsum(size) - size
        self.used += len(ids)

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, `end` after each text, and the bounds of each text in it (one more than texts)."""
        if not self.by_word:
            each = [np.asarray([*e.ids, end], np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([np.empty(0, np.uint32), *each]), np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])
        if len(self.rows) > MOST_WORDS:
            self._trim()
        words = [pre_tokens(t) for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        row = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        if len(self.rows) > self.known:
            self._learn()
        self.seen[: self.known] += np.bincount(row, minlength=self.known)
        size = self.size[row]
        ends = np.cumsum(size)
        of_text = np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(counts)]])
        total = int(of_text[-1])
        ids = self.ids[np.repeat(self.start[row] - ends + size, size) + np.arange(total)]
        bounds = of_text + np.arange(len(of_text))
        out = np.empty(total + len(texts), np.uint32)
        keep = np.ones(len(out), bool)
        keep[bounds[1:] - 1] = False
        out[keep] = ids
        out[~keep] = end
        return out, bounds


@cache
def encoder(path: str) -> WordEncoder:
    """One per worker process."""
    return WordEncoder(path)


@cache
def vocabulary_size(path: str) -> int:
    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
