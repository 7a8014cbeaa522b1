"""Text expressions: cleaning, slugs, names, parties, stems. All are built-in functions but `ascii_fold` and `decode_entities`."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values that results depend on.
SLUG_STOP_WORDS = ["the", "and", "of", "in", "a", "an", "to", "for", "on", "at", "by", "with", "from", "or"]
NOT_PARTIES = ["Maiden Speech", "Valedictory Speech", "Urgent Question", "Maiden", "Your Party", "Restore Britain"]
SALUTATIONS = ["Mr", "Mrs", "Ms", "Miss", "Dr"]
PARTIES = {
    "snp": "Scottish National Party", "ld": "Liberal Democrat", "lib dem": "Liberal Democrat", "con": "Conservative", "lab": "Labour", "green": "Green Party", "dup": "Democratic Unionist Party", "uup": "Ulster Unionist Party",
    "sdlp": "Social Democratic and Labour Party", "pc": "Plaid Cymru", "reform": "Reform UK", "ind": "Independent", "alba": "Alba Party", "sf": "Sinn Féin", "alliance": "Alliance Party of Northern Ireland", "crossbench": "Crossbench",
}
NAME_PREFIXES = ["the rt hon ", "the right hon ", "rt hon ", "right hon ", "the baroness ", "baroness ", "the lord ", "lord ", "dame ", "sir ", "dr ", "mr ", "mrs ", "ms ", "miss "]
POST_NOMINALS = ["obe", "cbe", "mbe", "pc", "qc", "kc", "dbe", "kbe", "mp", "obe mp", "cbe mp", "mbe mp"]
STEM_SUFFIXES = ["ments", "ment", "tions", "tion", "ings", "ing", "ers", "es", "s"]
LEGAL_SUFFIXES = r"(?iU)\b(ltd|limited|plc|llp|llc|inc\.?|incorporated|co\.?ltd|cic|community interest company|charitable incorporated organisation|cio)\b"
NEGATIVE_WORDS = [
    "crisis", "failure", "fail", "cut", "cuts", "closure", "closures", "lost", "concern", "problem", "criticism", "shortage", "scandal", "row", "backlash", "warning", "threat", "decline", "collapse", "protest", "underfund", "underfunded",
    "anger", "outrage", "catastrophe", "catastrophic", "devastating",
]
POSITIVE_WORDS = ["invest", "investment", "growth", "support", "success", "improve", "improvement", "boost", "achieve", "achievement", "celebrate", "award", "record", "launch", "fund", "expand", "expansion", "progress", "reform"]
PAGE_CHROME = ["head", "script", "style", "nav", "header", "footer"]


def lookup(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def strip_tags(c: Column) -> Column:
    """tags become spaces."""
    return F.trim(F.regexp_replace(c, "<[^>]+>", " "))


def squeeze(c: Column) -> Column:
    """runs of white space become one space."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_body(c: Column) -> Column:
    """F01 and F02; empty for null."""
    return F.coalesce(squeeze(strip_tags(c)), F.lit(""))


@F.pandas_udf(StringType())
def decode_entities(c: pd.Series) -> pd.Series:
    """HTML entities as characters, all of the standard's names."""
    return c.map(html.unescape, na_action="ignore")


def strip_html(c: Column) -> Column:
    """tags, entities, white space."""
    return F.coalesce(squeeze(decode_entities(strip_tags(c))), F.lit(""))


def paragraphs(c: Column) -> Column:
    """text with a blank line between paragraphs, line breaks inside them joined."""
    t = F.regexp_replace(c, "\r\n?", "\n")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?i)</p>\s*<p[^>]*>", "\n\n")
    t = F.regexp_replace(t, "<[^>]+>", "")
    parts = F.transform(F.split(t, "\n{2,}"), squeeze)
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n\n")


def page_text(c: Column, most: int = 60_000) -> Column:
    """a page without its chrome and tags, cut after `most` characters."""
    for tag in PAGE_CHROME:
        c = F.regexp_replace(c, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    return F.substring(squeeze(strip_tags(c)), 1, most)


def label_slug(c: Column) -> Column:
    """F08."""
    t = F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(t, r"\s+", "-"), "-+", "-")


@F.pandas_udf(StringType())
def ascii_fold(c: pd.Series) -> pd.Series:
    """Compatibility decomposition, ASCII characters alone."""
    return c.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode(), na_action="ignore")


def title_slug(c: Column, most: int = 60, fold: bool = True) -> Column:
    """words without stop words, joined while the slug has at most `most` characters; the first word is cut, no word gives `session`."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), "[\r\n ]", " ")
    t = F.regexp_replace(t, "[‘’‚‛′ʼ]", "")
    t = F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), "[:/-]", " ")
    t = F.lower(t)
    t = F.regexp_replace(ascii_fold(t) if fold else t, r"[^a-z0-9\s]", "")
    words = F.filter(F.split(t, r"\s+"), lambda w: (w != "") & ~w.isin(SLUG_STOP_WORDS))
    start = F.struct(F.lit("").alias("slug"), F.lit(False).alias("full"))

    def add(acc: Column, w: Column) -> Column:
        room = F.length(acc["slug"]) + 1 + F.length(w) <= most
        first = acc["slug"] == ""
        slug = F.when(acc["full"], acc["slug"]).when(first, F.substring(w, 1, most)).when(room, F.concat(acc["slug"], F.lit("-"), w)).otherwise(acc["slug"])
        return F.struct(slug.alias("slug"), (acc["full"] | F.when(first, F.length(w) > most).otherwise(~room)).alias("full"))

    slug = F.aggregate(words, start, add)["slug"]
    return F.when(slug == "", "session").otherwise(slug)


def session_slug(title: Column, ext_id: Column, suffix: int = 4, fold: bool = True) -> Column:
    """the slug and the last characters of the id."""
    return F.concat_ws("-", title_slug(title, fold=fold), F.lower(F.right(ext_id, F.lit(suffix))))


def pascal_title(c: Column) -> Column:
    """F12."""
    words = F.split(F.trim(F.regexp_replace(c, r"[^a-zA-Z0-9\s]", "")), r"\s+")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1000)))), "")


def groups_of(c: Column) -> Column:
    """Texts in parentheses, in order."""
    return F.regexp_extract_all(c, F.lit(r"\(([^)]+)\)"), 1)


def last_group_party(c: Column) -> Column:
    """the last of at least two groups unless it names no party."""
    groups = groups_of(c)
    last = F.trim(F.get(groups, F.size(groups) - 1))
    return F.when((F.size(groups) >= 2) & ~last.isin(NOT_PARTIES), last)


def attribution(c: Column) -> Column:
    """struct of name, role and party of an attribution; the form "The role (name)" names a role."""
    raw = F.trim(c)
    proxy = raw.rlike(r"^The\s+[^(]+\([^)]+\)\s*$")
    base = F.trim(F.regexp_replace(raw, r"\s*\([^)]+\)", ""))
    bare = F.regexp_replace(base, rf"^({'|'.join(SALUTATIONS)})\s+(?=\S)", "")
    name = F.when(F.coalesce(raw, F.lit("")) == "", "Speaker").when(proxy, F.trim(F.regexp_extract(raw, r"\(([^)]+)\)", 1))).when(bare == "", raw).otherwise(bare)
    role = F.when(proxy, F.trim(F.regexp_extract(raw, r"^(The\s+[^(]+)", 1))).otherwise("")
    return F.struct(name.alias("name"), role.alias("role"), F.when(~proxy, last_group_party(raw)).alias("party"))


def trailing_party(c: Column) -> Column:
    """the last group, by its abbreviation's full name."""
    found = F.trim(F.regexp_extract(c, r"\(([^)]+)\)\s*$", 1))
    return F.coalesce(lookup(PARTIES)[F.lower(found)], found, F.lit(""))


def attributed_name(c: Column) -> Column:
    """F16: what stands before the first group, or the first group if a slash stands before it."""
    before = F.trim(F.substring_index(c, "(", 1))
    inner = F.trim(F.regexp_extract(c, r"\(([^)]+)\)", 1))
    return F.coalesce(F.when(before == "", F.trim(c)).when(before.contains("/") & (inner != ""), inner).otherwise(before), F.lit(""))


def party_name(c: Column) -> Column:
    """a party's full name; other text as it is."""
    return F.coalesce(lookup(PARTIES)[F.lower(F.trim(c))], F.trim(c), F.lit(""))


def person_key(c: Column) -> Column:
    """a name without titles (two at most) and letters after it."""
    t = F.regexp_replace(F.lower(F.trim(c)), rf"\s+({'|'.join(POST_NOMINALS)})\s*$", "")
    once = rf"^({'|'.join(NAME_PREFIXES)})"
    return F.trim(F.regexp_replace(F.regexp_replace(t, once, ""), once, ""))


def display_name(c: Column) -> Column:
    """as F18, but Lord and Baroness stay and the case too."""
    t = F.regexp_replace(F.trim(c), "^(The Rt Hon |The Right Hon |Rt Hon |Right Hon |The )", "")
    t = F.regexp_replace(t, "^(Dame |Sir |Dr |Mr |Mrs |Ms |Miss )", "")
    return F.trim(F.regexp_replace(t, r"\s+(MP|OBE|CBE|MBE|PC|QC|KC|DBE|KBE)(\b.*)?$", ""))


def peer_name(c: Column) -> Column:
    """F20."""
    return F.regexp_replace(F.trim(c), r"(?i)^(the\s+)?(lord|baroness|baron|lady|viscount|viscountess|earl|countess|duke|duchess|marquess|prince|princess)\s+", "")


def word_root(c: Column) -> Column:
    """without the first of the suffixes that leaves four letters."""
    out = c
    for s in reversed(STEM_SUFFIXES):
        out = F.when(c.endswith(s) & (F.length(c) - len(s) >= 4), F.left(c, F.length(c) - F.lit(len(s)))).otherwise(out)
    return out


def singular(c: Column) -> Column:
    """F22."""
    return F.when(c.endswith("s") & (F.length(c) > 4), F.left(c, F.length(c) - F.lit(1))).otherwise(c)


def organisation_key(c: Column, aliases: Column | None = None) -> Column:
    """a name for matching: alias, legal suffixes, case, punctuation, white space. aliases: a map of lower-case alias to name."""
    t = F.trim(c)
    if aliases is not None:
        t = F.coalesce(aliases[F.lower(t)], t)
    t = F.lower(F.trim(F.regexp_replace(t, LEGAL_SUFFIXES, "")))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def normal_title(c: Column) -> Column:
    """without the draft prefix and the chamber suffix, in lower case."""
    t = F.regexp_replace(F.trim(c), r"(?i)^\s*draft\s+", "")
    return F.lower(squeeze(F.regexp_replace(t, r"(?i)\s*\[lords\]\s*$", "")))


def debate_key(c: Column) -> Column:
    """a title up to its chamber or its reading."""
    chamber = F.regexp_extract(c, r"^(.+?)\s+[-—]\s+(?:Commons|Lords)\b", 1)
    reading = F.regexp_extract(c, r"(?i)^(.+?)\s+[-—]\s+(?:Second|Third|Report|Committee)\s+Reading", 1)
    return F.when(chamber != "", F.trim(chamber)).when(reading != "", F.trim(reading)).otherwise(c)


def listing_id(c: Column) -> Column:
    """the id in a listing URL."""
    return F.nullif(F.regexp_extract(c, r"\?id=([^&#]+)", 1), F.lit(""))


def listing_section(c: Column) -> Column:
    """that id without its last part."""
    return F.regexp_replace(listing_id(c), r"\.[^.]*$", "")


def title_queries(c: Column, most: int = 6) -> Column:
    """the text, its quoted phrases, its first two words; each once."""
    quotes = F.regexp_extract_all(c, F.lit('"([^"]+)"'), 1)
    words = F.filter(F.split(F.replace(c, F.lit('"'), F.lit("")), r"\s+"), lambda w: w != "")
    short = F.when(F.size(words) >= 2, F.array(F.array_join(F.slice(words, 1, 2), " "))).otherwise(F.array().cast("array<string>"))
    rest = F.concat(quotes, F.array_except(short, quotes))
    return F.slice(F.when(F.array_contains(rest, c), rest).otherwise(F.concat(F.array(c), rest)), 1, most)


def tolerant_json(c: Column, schema: str) -> Column:
    """from_json of a text with code fences, trailing commas or other text around the outermost object."""
    text = F.trim(F.regexp_replace(c, r"```(json)?\s*", ""))
    loose = lambda t: F.regexp_replace(t, r",\s*([}\]])", "$1")
    inner = F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)
    good = lambda t: F.try_parse_json(t).isNotNull()
    return F.from_json(F.when(good(text), text).when(good(loose(text)), loose(text)).when(good(inner), inner).when(good(loose(inner)), loose(inner)), schema)


def sentiment(title: Column, summary: Column) -> Column:
    """negative, positive or neutral by distinct words of either list."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", title, F.coalesce(summary, F.lit("")))), F.lit(r"(?U)(\b\w+\b)"), 1))
    bad, good = (F.size(F.array_intersect(words, F.array(*map(F.lit, x)))) for x in (NEGATIVE_WORDS, POSITIVE_WORDS))
    return F.when(bad > good, "negative").when(good > bad, "positive").otherwise("neutral")


def ellipsis(c: Column, most: int = 300) -> Column:
    """F62."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("…"))).otherwise(c)


def phrase_query(topic: Column, terms: Column, most: int = 6) -> Column:
    """quoted terms joined by OR; the topic itself first if it has at most four words."""
    own = F.when(F.size(F.split(F.trim(topic), r"\s+")) <= 4, F.array(topic)).otherwise(F.array().cast("array<string>"))
    every = F.concat(own, F.slice(terms, 1, most))
    return F.concat(F.lit("("), F.array_join(F.transform(every, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR "), F.lit(")"))


def url_title_date(c: Column) -> Column:
    """struct of the three parts of url||title||date, with defaults."""
    parts = F.split(c, r"\|\|")
    part = lambda i, d: F.coalesce(F.nullif(F.get(parts, F.lit(i)), F.lit("")), F.lit(d))
    return F.struct(F.get(parts, F.lit(0)).alias("url"), part(1, "Untitled").alias("title"), part(2, "").alias("date"))
