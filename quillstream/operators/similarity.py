"""how alike two names are, whole batches at a time.

Common words and the words after them are array functions; the longest common subsequences of all pairs of a batch are computed at once,
each pair a lane of 64-bit words, a column of the first name's places in its bits and one step for each character of the second.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Characters that the lanes of one step compare at once.
CELLS = 4_000_000


def codes(texts: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of code points for each text, filled up, and the texts' lengths."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full((len(texts), int(sizes.max(initial=0))), fill, np.uint32)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out, sizes


def common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of a[i] and b[i], for all i."""
    longest = np.fromiter((max(len(x), 1) for x in a), np.int64, len(a))
    order, out, begin = np.argsort(longest, kind="stable"), np.zeros(len(a), np.int64), 0
    while begin < len(order):
        # Sorted by length, so that little of a row is filling.
        room = longest[order[begin:]] * np.arange(1, len(order) - begin + 1)
        end = begin + max(1, int(np.searchsorted(room, CELLS, "right")))
        lanes = order[begin:end]
        out[lanes] = _lanes([a[i] for i in lanes], [b[i] for i in lanes])
        begin = end
    return out


def _lanes(a: list[str], b: list[str]) -> np.ndarray:
    (left, n), (right, _) = codes(a, 0xFFFFFFFF), codes(b, 0xFFFFFFFE)
    words = -(-max(left.shape[1], 1) // 64)
    state = np.full((len(a), words), np.uint64(0xFFFFFFFFFFFFFFFF))
    match = np.zeros((len(a), words * 8), np.uint8)
    for j in range(right.shape[1]):
        packed = np.packbits(left == right[:, j : j + 1], axis=1, bitorder="little")
        match[:, : packed.shape[1]] = packed
        hit = match.view(np.uint64)
        both, carry, kept = state & hit, np.zeros(len(a), np.uint64), state & ~hit
        for k in range(words):  # an addition over words: what one overflows goes into the next
            part = state[:, k] + both[:, k]
            whole = part + carry
            carry = ((part < both[:, k]) | (whole < carry)).astype(np.uint64)
            state[:, k] = whole | kept[:, k]
    # Places whose bit is gone are the subsequence's; filling never matches, so its bits stay.
    return words * 64 - np.bitwise_count(state).sum(axis=1, dtype=np.int64)


@F.pandas_udf(LongType())
def _common_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(common_lengths(a.tolist(), b.tolist()), dtype="int64")


def words(name: Column) -> Column:
    """A name's distinct words."""
    return F.array_distinct(F.filter(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda w: w != ""))


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 if one's words are all the other's, else the best ratio among the common words and either name's words after them."""
    x, y = (words(F.col(c) if isinstance(c, str) else c) for c in (a, b))
    joined = lambda own: F.array_join(F.array_sort(own), " ")
    common, left, right = joined(F.array_intersect(x, y)), joined(F.array_except(x, y)), joined(F.array_except(y, x))
    one, two = (F.trim(F.concat(common, F.lit(" "), rest)) for rest in (left, right))
    n, m, c = F.length(one), F.length(two), F.length(common)
    # The common words begin both, so they are their own longest subsequence with either.
    best = F.greatest(2 * _common_length(one, two) / (n + m), F.when(c > 0, 2 * c / (c + n)).otherwise(0.0), F.when(c > 0, 2 * c / (c + m)).otherwise(0.0))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when((c > 0) & ((left == "") | (right == "")), 1.0).otherwise(best)
