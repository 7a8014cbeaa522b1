"""Words as row numbers, and windows over the joined words of many texts."""

from __future__ import annotations

from itertools import islice

import numpy as np


class Rows(dict):
    """Word to row number; a new word gets the next number."""

    def __missing__(self, word) -> int:
        self[word] = row = len(self)
        return row


def newest(rows: Rows, known: int) -> list:
    """The words from row `known` on."""
    return list(islice(reversed(rows), len(rows) - known))[::-1]


def windows(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows over joined texts of `sizes` words, and the text of each. The last window of a text is up to twice as short or long."""
    n = np.maximum(1, np.round(sizes / width).astype(np.int64))
    n[sizes == 0] = 0
    text = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    begin = np.cumsum(sizes) - sizes
    return begin[text] + k * width, text
