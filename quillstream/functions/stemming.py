"""English stems: the Snowball project's "English" (Porter2) algorithm, as used by full-text search.

The rules are steps over a word and its regions R1 and R2. Each step is one SQL expression over the columns of the step before, in
functions that Spark and DuckDB share, so a vocabulary is stemmed by built-in functions alone. It is meant for distinct words:
`stems_of` reduces to those first, and the result is joined back.

Defined cases: null has no stem; words of one or two letters, and words in other scripts, are their own stems; words are taken in lower case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the published algorithm: irregular words, words that end the steps early, suffixes with their replacements.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize"]
LI_ENDINGS = "cdeghkmnrt"
DOUBLES = ["bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"]
REGION_PREFIXES = ["gener", "commun", "arsen"]

VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
SHORT_END = f"({OTHER}{VOWEL}[^aeiouywxY]|^{VOWEL}{OTHER})$"


def _has(text: str, pattern: str) -> str:
    return f"regexp_extract({text}, '{pattern}', 0) <> ''"


def _cut(n: int, word: str = "w") -> str:
    return f"left({word}, length({word}) - {n})"


def _longest(rules: dict[str, tuple[str, str]], otherwise: str = "w") -> str:
    """The longest suffix that w has decides; its rule applies if the condition holds. rules: suffix to (condition, result)."""
    whens = [f"WHEN w LIKE '%{s}' THEN CASE WHEN {rules[s][0]} THEN {rules[s][1]} ELSE w END" for s in sorted(rules, key=lambda s: (-len(s), s))]
    return f"CASE {' '.join(whens)} ELSE {otherwise} END"


def _in(region: str, suffix: str) -> str:
    return f"length(w) - {len(suffix)} >= {region}"


def _swapped(suffix: str, replacement: str) -> str:
    return f"{_cut(len(suffix))} || '{replacement}'" if replacement else _cut(len(suffix))


def _steps() -> list[dict[str, str]]:
    """Columns that each step sets, in order; other columns stay. w is the word so far, done tells that it is final, r1 and r2 are lengths before the regions."""
    marked = "CASE WHEN w LIKE 'y%' THEN 'Y' || substr(w, 2) ELSE w END"
    for v in "aeiouy":
        marked = f"replace({marked}, '{v}y', '{v}Y')"
    region = lambda text: f"CASE WHEN {_has(text, f'^{OTHER}*{VOWEL}+{OTHER}')} THEN length(regexp_extract({text}, '^{OTHER}*{VOWEL}+{OTHER}', 0)) ELSE length({text}) END"
    first = f"CASE {' '.join(f'''WHEN w LIKE '{p}%' THEN {len(p)}''' for p in REGION_PREFIXES)} ELSE {region('w')} END"
    before = lambda n: _has(_cut(n), VOWEL)
    plural = _longest({"sses": ("TRUE", _cut(2)), "ied": ("TRUE", f"CASE WHEN length(w) > 4 THEN {_cut(2)} ELSE {_cut(1)} END"), "ies": ("TRUE", f"CASE WHEN length(w) > 4 THEN {_cut(2)} ELSE {_cut(1)} END"), "us": ("FALSE", "w"), "ss": ("FALSE", "w"), "s": (before(2), _cut(1))})
    # What follows a removed ending is mended in the next step; x holds the removed form.
    ended = {s: (before(len(s)), _cut(len(s))) for s in ("ed", "edly", "ing", "ingly")} | {s: (_in("r1", "eed" if s == "eed" else "eedly"), f"{_cut(len(s))} || 'ee'") for s in ("eed", "eedly")}
    past = _longest(ended)
    was_cut = f"w <> x AND NOT ({' OR '.join(f'''x LIKE '%{s}' ''' for s in ('eed', 'eedly'))})"
    mended = f"CASE WHEN {was_cut} THEN CASE WHEN w LIKE '%at' OR w LIKE '%bl' OR w LIKE '%iz' THEN w || 'e' WHEN {' OR '.join(f'''w LIKE '%{d}' ''' for d in DOUBLES)} THEN {_cut(1)} WHEN length(w) <= r1 AND {_has('w', SHORT_END)} THEN w || 'e' ELSE w END ELSE w END"
    final_y = f"CASE WHEN length(w) > 2 AND {_has('w', f'{OTHER}[yY]$')} THEN {_cut(1)} || 'i' ELSE w END"
    step_2 = {s: (_in("r1", s), _swapped(s, r)) for s, r in STEP_2.items()} | {"ogi": (f"{_in('r1', 'ogi')} AND w LIKE '%logi'", _cut(1)), "li": (f"{_in('r1', 'li')} AND {_has('w', f'[{LI_ENDINGS}]li$')}", _cut(2))}
    step_3 = {s: (_in("r1", s), _swapped(s, r)) for s, r in STEP_3.items()} | {"ative": (_in("r2", "ative"), _cut(5))}
    step_4 = {s: (_in("r2", s), _cut(len(s))) for s in STEP_4} | {"ion": (f"{_in('r2', 'ion')} AND {_has('w', '[st]ion$')}", _cut(3))}
    step_5 = {"e": (f"{_in('r2', 'e')} OR {_in('r1', 'e')} AND NOT {_has(_cut(1), SHORT_END)}", _cut(1)), "l": (f"{_in('r2', 'l')} AND w LIKE '%ll'", _cut(1))}
    rest = lambda value: f"CASE WHEN done THEN w ELSE {value} END"
    return [
        {"w": f"CASE {' '.join(f'''WHEN w = '{a}' THEN '{b}' ''' for a, b in IRREGULAR.items())} ELSE w END", "done": f"length(w) <= 2 OR w IN ({', '.join(map(repr, IRREGULAR))})"},
        {"w": rest(marked)},
        {"r1": first},
        {"r2": f"r1 + {region('substr(w, r1 + 1)')}"},
        {"w": rest(plural)},
        {"done": f"done OR w IN ({', '.join(map(repr, KEPT_AFTER_PLURAL))})"},
        {"w": rest(past), "x": "w"},
        {"w": rest(mended)},
        *({"w": rest(s)} for s in (final_y, *map(_longest, (step_2, step_3, step_4, step_5)))),
        {"w": "replace(w, 'Y', 'y')"},
    ]


def stemmed(words: DataFrame, column: str, out: str) -> DataFrame:
    """words with one column more, the stem of a column of words in lower case. Meant for distinct words."""
    kept = [F.col(c).alias(f"_{i}") for i, c in enumerate(words.columns)]
    frame = words.select(*kept, F.col(column).alias("w"))
    for step in _steps():
        frame = frame.withColumns({c: F.expr(e) for c, e in step.items()})
    return frame.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(words.columns)), F.col("w").alias(out))


def stems_of(words: DataFrame, column: str, out: str = "stem") -> DataFrame:
    """The distinct words of a column, each with its stem."""
    return stemmed(words.select(column).where(F.col(column).isNotNull()).distinct(), column, out)


def sql_stemmed(source: str, column: str, out: str = "stem") -> str:
    """The same as SQL: a query of the columns of `source` (a table or a query in brackets) and the stem of one of them."""
    query, known = f"SELECT *, {column} AS w FROM {source}", {"w"}
    for step in _steps():
        old = ", ".join(c for c in step if c in known)
        query = f"SELECT *{f' EXCLUDE ({old})' if old else ''}, {', '.join(f'{e} AS {c}' for c, e in step.items())} FROM ({query})"
        known |= set(step)
    return f"SELECT * EXCLUDE ({', '.join(sorted(known))}), w AS {out} FROM ({query})"
