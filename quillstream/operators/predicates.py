"""Filters that are more than one comparison."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import stem_hits

# Fixed values that results depend on.
PLACEHOLDERS = ["intentionally blank", "none", "n/a", "nil return", "not applicable", "various"]


def singular(word: str) -> str:
    return word[:-1] if word.endswith("s") and len(word) > 4 else word


def root(word: str) -> str:
    from ..functions.text import STEM_SUFFIXES

    return next((word[: -len(s)] for s in STEM_SUFFIXES if word.endswith(s) and len(word) - len(s) >= 4), word)


def stems_match(text: Column, query: str) -> Column:
    """Two of the query's stems, or the one it has; stems may stand anywhere in a word."""
    stems = [singular(w) for w in query.lower().split() if len(w) > 3]
    return stem_hits(F.lower(text), stems) >= min(2, len(stems)) if stems else F.lit(True)


def subjects_match(text: Column, subjects: str) -> Column:
    """For one of the comma-separated subjects, two of its distinct roots (or its one)."""
    out = F.lit(False)
    for subject in subjects.lower().split(","):
        roots = sorted({root(w) for w in subject.split() if len(w) >= 3})
        if roots:
            out = out | (stem_hits(F.lower(text), roots) >= min(2, len(roots)))
    return out


def half_match(text: Column, query: str) -> Column:
    """Half of the stems, one at least."""
    stems = [singular(w) for w in query.lower().split() if len(w) > 3]
    return stem_hits(F.lower(text), stems) >= max(1, len(stems) // 2) if stems else F.lit(True)


def any_word(text: Column, query: str) -> Column:
    """One of the query's words of four letters; no such word lets all pass."""
    words = [w for w in query.lower().split() if len(w) >= 4]
    return stem_hits(F.lower(text), words) > 0 if words else F.lit(True)


def cascade(df: DataFrame, first: Column, second: Column) -> DataFrame:
    """Rows of the first condition; if it has none, of the second. One scalar decides."""
    found = df.agg(F.coalesce(F.bool_or(first), F.lit(False))).scalar()
    return df.where(F.when(found, first).otherwise(second))


def whole_word(c: Column, variants: list[str]) -> Column:
    """The first variant that a text holds as whole words, in any case; else null."""
    out = F.lit(None).cast("string")
    for v in reversed(variants):
        out = F.when(c.rlike(rf"(?iU)(?<!\w){re.escape(v)}(?!\w)"), F.lit(v)).otherwise(out)
    return out


def is_placeholder(c: Column) -> Column:
    """P20."""
    return F.lower(F.trim(c)).isin(PLACEHOLDERS)


def truncated(c: Column, answered: Column) -> Column:
    """An answer so short that it was cut."""
    return answered & (F.length(c) < 300)


def safe_url(c: Column) -> Column:
    """Http or https, a host, no more than 2,048 characters, no private address."""
    host = F.lower(F.try_parse_url(c, F.lit("HOST")))
    return F.coalesce(F.try_parse_url(c, F.lit("PROTOCOL")).isin("http", "https") & (F.length(c) <= 2048) & (host != "") & ~host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|0\.0\.0\.0|\[)"), F.lit(False))


def domain_allowed(email: Column, domains: list[str]) -> Column:
    """P34."""
    out = F.lit(False)
    for d in domains:
        out = out | F.lower(F.trim(email)).endswith(d)
    return out


def like_any(c: Column, wanted: list[str], unwanted: list[str] = ()) -> Column:
    """One of the patterns and none of the others."""
    out, no = F.lit(False), F.lit(False)
    for p in wanted:
        out = out | F.lower(c).like(p)
    for p in unwanted:
        no = no | F.lower(c).like(p)
    return out & ~no
