"""Classifiers: one chain of conditions each, in the order that decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
CONTAINER_TAGS = ["hs_6bdepartment", "hs_3mainhdg", "hs_3oralanswers", "hs_6bpetitions", "hs_venue"]
ANCHOR_TITLES = ["backbench business", "business without debate", "business before questions", "business of the house", "business of the house (today)", "opposition day", "delegated legislation", "bill presented", "bills presented", "ways and means", "estimates day"]
PROCEDURAL_STARTS = [
    "arrangement of business", "business of the house", "oaths and affirmations", "retirement of a member", "retirements of members", "lord speaker's statement", "standing orders", "clerk of the parliaments", "leave of absence",
    "deaths of members", "message from the king", "royal assent",
]
SKIPPED_ITEM_TYPES = ["Timestamp", "Amendment"]
SKIPPED_TAGS = [
    "hs_columnumber", "hs_columnnumber", "hs_clheading", "hs_clchairman", "hs_clmember", "hs_clstaff", "hs_debatetype", "hs_amendmentheading", "hs_tabledby", "hs_procedure", "hs_76fchair", "hs_brev", "hs_clclerks", "hs_amendmentlevel0",
    "hs_amendmentlevel1", "hs_amendmentlevel2", "hs_amendmentlevel3", "err_tablewrapper",
]
QUESTION_DEPARTMENTS = ["education", "health", "treasury", "home office", "defence", "justice", "transport", "environment", "science", "work and pensions", "cabinet office", "foreign", "culture", "housing", "digital", "northern ireland", "business"]
MORE_QUESTION_DEPARTMENTS = ["wales", "scotland", "attorney general", "leader of the house", "women and equalities", "energy security", "levelling up", "international trade", "international development"]
GENERIC_DEPARTMENT_WORDS = ["department", "for", "of", "the", "hm", "ministry", "and", "office"]
CATEGORIES = {
    "Department for Education": "Education", "Department of Health and Social Care": "Health & Social Care", "HM Treasury": "Economics & Finance", "Home Office": "Home Affairs", "Ministry of Defence": "Defence", "Ministry of Justice": "Justice",
    "Department for Science, Innovation and Technology": "Science & Technology", "Cabinet Office": "Government & Public Administration",
}
SOURCES = {"commons": "Commons", "westminsterhall": "Westminster Hall", "lords": "Lords", "wrans": "Written Answer", "wms": "Ministerial Statement"}


def any_of(test, values: list) -> Column:
    """True if the test holds for one of the values."""
    out = F.lit(False)
    for v in values:
        out = out | test(v)
    return out


def session_type(title: Column, location: Column, tag: Column) -> Column:
    """procedure, then venue, then tag, then title."""
    t, where, tag = (F.lower(F.coalesce(c, F.lit(""))) for c in (title, location, tag))
    has = t.contains
    questions = F.when((t == "engagements") | has("prime minister") | has("pmq"), "pmqs").otherwise("oral_questions")
    return (
        F.when(any_of(t.startswith, PROCEDURAL_STARTS), "other")
        .when(where.contains("westminster hall"), "westminster_hall")
        .when(where.contains("grand committee") | where.contains("public bill committee"), "committee_stage")
        .when(where.contains("general committee"), "statutory_instrument")
        .when(tag.isin("hs_8question", "hs_3oralanswers"), questions)
        .when(tag == "hs_2curgenquestion", "oral_questions")
        .when(tag == "hs_2cstatement", F.when(has("humble address"), "debate").otherwise("ministerial_statement"))
        .when(tag.isin("hs_2cbilltitle", "hs_2billtitle", "hs_2debbill", "hs_2cdebatedmotion", "hs_2debatedmotion", "hs_2cso24application"), "debate")
        .when(tag == "hs_2businesswodebate", "statutory_instrument")
        .when(tag.isin("hs_8petition", "hs_6bpetitions"), "petition")
        .when(tag.isin("hs_3coppositionday", "hs_3cmainhdg"), "other")
        .when(has("written ministerial statement") | (has("statement") & has("ministerial")), "ministerial_statement")
        .when(has("statutory instrument") | has("delegated legislation") | (has("draft") & (has("regulation") | has("order"))) | t.rlike(r"\b(regulations|orders?|rules)\s+\d{4}\b"), "statutory_instrument")
        .when(any_of(has, ["bill", "reading", "amendment", "committee stage", "debate", "motion"]), "debate")
        .otherwise("other")
    )


def is_container(tag: Column, title: Column, untagged: list[str] = ("oral answers to questions", "petitions", "prayers", "westminster hall")) -> Column:
    """By tag, by one of a few titles where there is no tag, or by an anchor title."""
    t = F.lower(F.coalesce(title, F.lit("")))
    return F.coalesce(F.lower(tag).isin(CONTAINER_TAGS), F.lit(False)) | (tag.isNull() & t.isin(*untagged)) | t.isin(ANCHOR_TITLES)


def is_speech_item(kind: Column, tag: Column, text: Column) -> Column:
    """No skipped type or tag, and some text."""
    return ~F.coalesce(kind.isin(SKIPPED_ITEM_TYPES), F.lit(False)) & ~F.coalesce(F.lower(tag).isin(SKIPPED_TAGS), F.lit(False)) & (F.length(F.trim(F.coalesce(text, F.lit("")))) > 0)


def debate_label(title: Column, source: Column) -> Column:
    """F35."""
    t = F.lower(title)
    has = t.contains
    return (
        F.when(source == "wms", "Ministerial Statement")
        .when(source == "westminsterhall", "Westminster Hall")
        .when(has("written answer"), "Written Answer")
        .when(has("urgent question"), "Urgent Question")
        .when(has("oral answers") | has("question time") | (has("prime minister") & has("question")), "Oral Question")
        .when((source == "commons") & any_of(t.startswith, [d + ":" for d in QUESTION_DEPARTMENTS]), "Oral Question")
        .when(has("statement"), "Ministerial Statement")
        .when(has("statutory instrument") | has("affirmative") | has("delegated legislation") | (has("draft") & (has("regulation") | has("order"))), "Statutory Instrument")
        .when(has("bill") | has("reading") | has("amendment"), "Legislation")
        .when(has("motion"), "Motion")
        .otherwise("General Debate")
    )


def inquiry_status(report: Column, closed: Column) -> Column:
    """F36."""
    return F.when(F.coalesce(report, F.lit("")) != "", "reported").when(F.coalesce(closed, F.lit("")) != "", "closed").otherwise("open")


def debate_section(title: Column, source: Column, most_words: Column) -> Column:
    """the section of a group of speeches, by title and then by its longest speech."""
    t = F.lower(title)
    has, dashed = t.contains, F.rtrim(F.regexp_replace(t, "[–—]", "-"))
    return (
        F.when(source == "wms", "statement")
        .when(has("written answer"), "wq")
        .when(t.rlike(r"\bbill\b") | any_of(has, ["second reading", "third reading", "committee stage", "report stage", "lords amendments", "royal assent"]), "legislation")
        .when(has("urgent question"), "urgent")
        .when((source == "commons") & has("statement"), "statement")
        .when(has("oral answers") | has("question time") | (has("prime minister") & has("question")), "oral")
        .when((source == "lords") & (dashed.contains("- oral question") | dashed.contains("- question")), "oral")
        .when((source == "commons") & any_of(t.startswith, [d + ":" for d in QUESTION_DEPARTMENTS + MORE_QUESTION_DEPARTMENTS]), "oral")
        .when(has("topical question"), "oral")
        .when(source.isin("commons", "lords") & (most_words > 0) & (most_words < 400), "oral")
        .otherwise("debate")
    )


def section_source(house: Column, section: Column) -> Column:
    """F38."""
    s = F.lower(F.coalesce(section, F.lit("")))
    return F.when(s.contains("written statement"), "wms").when(s.contains("written answer"), "wrans").when(s.contains("westminster hall"), "westminsterhall").when(F.lower(house) == "lords", "lords").otherwise("commons")


def question_kind(house: Column, named_day: Column) -> Column:
    """F39."""
    return F.when(F.lower(house) == "lords", "LORDS").when(named_day, "NAMED_DAY").otherwise("ORDINARY")


def is_holding(answer: Column, withdrawn: Column) -> Column:
    """answered for now: "I will write" early in the answer."""
    return (F.coalesce(answer, F.lit("")) != "") & ~withdrawn & F.lower(F.left(answer, F.lit(200))).contains("i will write")


def answer_status(withdrawn: Column, holding: Column, answered: Column) -> Column:
    """F40."""
    return F.when(withdrawn, "WITHDRAWN").when(holding, "HOLDING ANSWER").when(answered, "ANSWERED").otherwise("UNANSWERED")


def names_department(title: Column, departments: list[str]) -> Column:
    """A department's name, or one of its words that says something."""
    t = F.lower(title)
    words = [w.lower() for d in departments for w in d.split() if w.lower() not in GENERIC_DEPARTMENT_WORDS and len(w) > 3]
    return any_of(t.contains, [d.lower() for d in departments] + words)


def department_category(c: Column) -> Column:
    """F64."""
    from .text import lookup

    return F.coalesce(lookup(CATEGORIES)[c], F.nullif(c, F.lit("")), F.lit("Other"))


def source_label(c: Column) -> Column:
    """F66."""
    from .text import lookup

    return F.coalesce(lookup(SOURCES)[c], F.initcap(c))


def role_text(house: Column, place: Column) -> Column:
    """F69."""
    return F.when(house == "Lords", "Life Peer").otherwise(F.concat(F.lit("MP for "), place))


def stem_hits(text: Column, stems: list[str]) -> Column:
    """How many of the stems a text holds, anywhere in its words."""
    return sum((text.contains(s).cast("int") for s in stems), F.lit(0))
