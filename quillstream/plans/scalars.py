"""Scalar functions, predicates and scores over the domain's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import dates as D
from ..functions import scoring as S
from ..functions import text as T
from ..operators import predicates as P
from .domain import Tables, quoted
from .registry import query

CHROME = "html"
for _tag in T.PAGE_CHROME:
    CHROME = f"regexp_replace({CHROME}, '<{_tag}\\b.*?</{_tag}>', ' ', 'gis')"


def sql_in(values: list[str]) -> str:
    return ", ".join(map(quoted, values))


@query("f01_f02_f05_clean_text", "SELECT id, trim(regexp_replace(question_text, '<[^>]+>', ' ', 'g')) AS stripped, trim(regexp_replace(question_text, '\\s+', ' ', 'g')) AS squeezed, trim(regexp_replace(trim(regexp_replace(question_text, '<[^>]+>', ' ', 'g')), '\\s+', ' ', 'g')) AS clean FROM question")
def _(t: Tables) -> DataFrame:
    q = F.col("question_text")
    return t.question.select("id", T.strip_tags(q).alias("stripped"), T.squeeze(q).alias("squeezed"), T.clean_body(q).alias("clean"))


@query("f03_strip_html", "SELECT id, trim(regexp_replace(replace(regexp_replace(question_text, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '\\s+', ' ', 'g')) AS clean FROM question")
def _(t: Tables) -> DataFrame:
    return t.question.select("id", T.strip_html(F.col("question_text")).alias("clean"))


@query("f04_paragraphs", "WITH p AS (SELECT id, replace('<p>' || replace(coalesce(question_text, ''), '  ', '</p> <p>') || '<br/>last</p>', '<br/>', chr(10)) AS h FROM question), q AS (SELECT id, regexp_split_to_array(regexp_replace(regexp_replace(h, '</p>\\s*<p[^>]*>', chr(10) || chr(10), 'g'), '<[^>]+>', '', 'g'), '\\n{2,}') AS parts FROM p) SELECT id, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM q")
def _(t: Tables) -> DataFrame:
    html = F.concat(F.lit("<p>"), F.replace(F.coalesce("question_text", F.lit("")), F.lit("  "), F.lit("</p> <p>")), F.lit("<br/>last</p>"))
    return t.question.select("id", T.paragraphs(html).alias("text"))


@query("f06_f07_f48_dates", "SELECT id, CAST(day(date) AS VARCHAR) || strftime(date, ' %B %Y') AS long, lower(CAST(day(date) AS VARCHAR) || strftime(date, '-%B-%Y')) AS url, date AS back, house || ' — ' || CAST(day(date) AS VARCHAR) || strftime(date, ' %B %Y') AS header FROM session")
def _(t: Tables) -> DataFrame:
    d = F.col("date")
    return t.session.select("id", D.long_date(d).alias("long"), D.url_date(d).alias("url"), D.from_url_date(D.url_date(d)).alias("back"), F.concat("house", F.lit(" — "), D.long_date(d)).alias("header"))


@query("f08_label_slug", "SELECT id, regexp_replace(regexp_replace(regexp_replace(lower(trim(title)), '[^a-z0-9\\s-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g') AS slug FROM session")
def _(t: Tables) -> DataFrame:
    return t.session.select("id", T.label_slug(F.col("title")).alias("slug"))


@query("f09_s31_page_text", f"SELECT id, substr(trim(regexp_replace(trim(regexp_replace({CHROME}, '<[^>]+>', ' ', 'g')), '\\s+', ' ', 'g')), 1, 60000) AS text FROM page")
def _(t: Tables) -> DataFrame:
    return t.page.select("id", T.page_text(F.col("html")).alias("text"))


SLUG_WORDS = f"list_filter(regexp_split_to_array(regexp_replace(lower(regexp_replace(replace(title, '&', ' and '), '[:/-]', ' ', 'g')), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ({sql_in(T.SLUG_STOP_WORDS)}))"
FITTING = "array_to_string(list_filter(w, lambda x, i: i = 1 OR length(array_to_string(w[1:i], '-')) <= 60), '-')"


@query("f10_f11_w08_slugs", f"WITH w AS (SELECT id, ext_id, {SLUG_WORDS} AS w FROM session), s AS (SELECT id, ext_id, {FITTING} AS slug FROM w) SELECT id, slug || '-' || lower(right(ext_id, 4)) AS short, CASE WHEN count(*) OVER (PARTITION BY slug || '-' || lower(right(ext_id, 4))) > 1 THEN CASE WHEN count(*) OVER (PARTITION BY slug || '-' || lower(right(ext_id, 6))) > 1 THEN slug || '-' || lower(ext_id) ELSE slug || '-' || lower(right(ext_id, 6)) END ELSE slug || '-' || lower(right(ext_id, 4)) END AS slug FROM s")
def _(t: Tables) -> DataFrame:
    """Slugs, longer where they collide."""
    from ..operators.windows import collision_free

    rows = t.session.select("id", "ext_id", T.title_slug(F.col("title"), fold=False).alias("base"))
    form = lambda n: F.concat_ws("-", "base", F.lower(F.right("ext_id", F.lit(n)))) if n else F.concat_ws("-", "base", F.lower("ext_id"))
    return collision_free(rows, form(4), form(6), form(0)).select("id", form(4).alias("short"), "slug")


@query("f10_ascii_slug")
def _(t: Tables) -> DataFrame:
    """F10 with folding of accents, over the documents' first lines."""
    return t.speech.select("id", T.title_slug(F.substring_index("text", "\n", 1)).alias("slug"))


@query("f12_pascal_title", "SELECT id, array_to_string(list_transform(regexp_split_to_array(trim(regexp_replace(title, '[^a-zA-Z0-9\\s]', '', 'g')), '\\s+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS slug FROM session")
def _(t: Tables) -> DataFrame:
    return t.session.select("id", T.pascal_title(F.col("title")).alias("slug"))


GROUPS = "regexp_extract_all(attribution, '\\(([^)]+)\\)', 1)"
PARTY_CASES = "CASE lower({0}) " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in T.PARTIES.items()) + " ELSE {0} END"


@query(
    "f13_f16_attributions",
    f"""SELECT id, CASE WHEN len({GROUPS}) >= 2 AND trim({GROUPS}[-1]) NOT IN ({sql_in(T.NOT_PARTIES)}) THEN trim({GROUPS}[-1]) END AS party,
    CASE WHEN attribution IS NULL THEN 'Speaker' WHEN regexp_matches(attribution, '^The\\s+[^(]+\\([^)]+\\)\\s*$') THEN {GROUPS}[1] ELSE regexp_replace(trim(regexp_replace(attribution, '\\s*\\([^)]+\\)', '', 'g')), '^(Mr|Mrs|Ms|Miss|Dr)\\s+', '') END AS name,
    CASE WHEN regexp_matches(attribution, '^The\\s+[^(]+\\([^)]+\\)\\s*$') THEN trim(split_part(attribution, '(', 1)) ELSE '' END AS role,
    coalesce({PARTY_CASES.format("regexp_extract(attribution, '\\(([^)]+)\\)\\s*$', 1)")}, '') AS trailing,
    coalesce(CASE WHEN contains(split_part(attribution, '(', 1), '/') THEN {GROUPS}[1] ELSE trim(split_part(attribution, '(', 1)) END, '') AS attributed FROM member""",
)
def _(t: Tables) -> DataFrame:
    """Party, name and role of an attribution."""
    a = F.col("attribution")
    parts = T.attribution(a)
    return t.member.select("id", T.last_group_party(a).alias("party"), parts["name"].alias("name"), parts["role"].alias("role"), T.trailing_party(a).alias("trailing"), T.attributed_name(a).alias("attributed"))


PREFIX = "^(" + "|".join(T.NAME_PREFIXES) + ")"


@query(
    "f17_f20_names",
    f"""SELECT id, coalesce({PARTY_CASES.format("trim(party)")}, '') AS party, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '\\s+({"|".join(T.POST_NOMINALS)})\\s*$', ''), '{PREFIX}', ''), '{PREFIX}', '')) AS key,
    trim(regexp_replace(regexp_replace(regexp_replace(trim(name), '^(The Rt Hon |The Right Hon |Rt Hon |Right Hon |The )', ''), '^(Dame |Sir |Dr |Mr |Mrs |Ms |Miss )', ''), '\\s+(MP|OBE|CBE|MBE|PC|QC|KC|DBE|KBE)(\\b.*)?$', '')) AS display,
    regexp_replace(trim(name), '^(the\\s+)?(lord|baroness)\\s+', '', 'i') AS peer FROM member""",
)
def _(t: Tables) -> DataFrame:
    n = F.col("name")
    return t.member.select("id", T.party_name(F.col("party")).alias("party"), T.person_key(n).alias("key"), T.display_name(n).alias("display"), T.peer_name(n).alias("peer"))


ROOT = "CASE " + " ".join(f"WHEN suffix(w, '{s}') AND length(w) >= {len(s) + 4} THEN left(w, length(w) - {len(s)})" for s in T.STEM_SUFFIXES) + " ELSE w END"


@query("f21_f22_stems", f"WITH w AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS w FROM benchmark) SELECT w, {ROOT} AS root, CASE WHEN suffix(w, 's') AND length(w) > 4 THEN left(w, length(w) - 1) ELSE w END AS singular FROM w")
def _(t: Tables) -> DataFrame:
    words = t.raw("benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("w")).distinct()
    return words.select("w", T.word_root(F.col("w")).alias("root"), T.singular(F.col("w")).alias("singular"))


@query("f23_f24_organisation_key", "SELECT id, trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(CASE WHEN canonical_name = 'Customer#000000001' THEN 'First Customer' ELSE canonical_name END, '\\b(ltd|limited|plc|llp)\\b', '', 'gi'))), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM organisation")
def _(t: Tables) -> DataFrame:
    aliases = F.create_map(F.lit("customer#000000001"), F.lit("First Customer"))
    return t.organisation.select("id", T.organisation_key(F.col("canonical_name"), aliases).alias("key"))


@query("f26_p33_urls", "SELECT id, lower(regexp_extract(url, '^[A-Za-z]+://([^/]+)', 1)) AS host FROM organisation WHERE url IS NOT NULL")
def _(t: Tables) -> DataFrame:
    """host with its port."""
    return t.organisation.where("url IS NOT NULL").select("id", F.lower(F.try_parse_url("url", F.lit("AUTHORITY"))).alias("host"))


DATED = "CASE id % 6 WHEN 0 THEN strftime(date, '%Y-%m-%d') WHEN 1 THEN strftime(date, '%d/%m/%Y') WHEN 2 THEN day(date) || '-30 ' || strftime(date, '%B %Y') WHEN 3 THEN day(date) || strftime(date, ' %B %Y') WHEN 4 THEN strftime(date, '%B %Y') ELSE 'soon' END"


@query("f27_noted_dates", f"WITH r AS (SELECT id, date, {DATED} AS raw FROM session) SELECT id, CAST(CASE WHEN id % 6 < 4 THEN date WHEN id % 6 = 4 THEN date_trunc('month', date) END AS DATE) AS date, CASE id % 6 WHEN 2 THEN 'date range recorded as \"' || raw || '\"; used start date' WHEN 4 THEN 'no specific day in date \"' || raw || '\"; used 1st of month' END AS note FROM r")
def _(t: Tables) -> DataFrame:
    d = F.col("date")
    forms = [F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "dd/MM/yyyy"), F.concat(F.dayofmonth(d), F.lit("-30 "), F.date_format(d, "MMMM yyyy")), D.long_date(d), F.date_format(d, "MMMM yyyy"), F.lit("soon")]
    raw = F.get(F.array(*forms), (F.col("id") % 6).cast("int"))
    return t.session.select("id", D.noted_date(raw).alias("_")).select("id", "_.date", "_.note")


@query("f28_split_organisations", "SELECT id, unnest(list_filter(list_transform(string_split(canonical_name || '; ;Second ' || type || ';', ';'), lambda x: trim(x)), lambda x: x <> '')) AS name FROM organisation")
def _(t: Tables) -> DataFrame:
    parts = F.filter(F.transform(F.split(F.concat("canonical_name", F.lit("; ;Second "), "type", F.lit(";")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return t.organisation.select("id", F.explode(parts).alias("name"))


@query("f29_f30_f49_date_texts", "SELECT id, CAST(CASE WHEN id % 5 = 0 THEN NULL ELSE date END AS DATE) AS iso, CASE WHEN id % 5 > 0 THEN strftime(date, '%Y%m%d') ELSE '' END || '..' || strftime(date + 40, '%Y%m%d') AS range, CASE WHEN year(date) = year(date + 40) THEN CAST(year(date) AS VARCHAR) ELSE year(date) || '–' || year(date + 40) END AS years FROM session")
def _(t: Tables) -> DataFrame:
    d, later = F.col("date"), F.date_add("date", 40)
    iso = D.iso_date(F.when(F.col("id") % 5 == 0, "not a date").otherwise(F.concat(d.cast("string"), F.lit("T10:00:00"))))
    return t.session.select("id", iso.alias("iso"), D.range_text(iso, later).alias("range"), D.year_range(d, later).alias("years"))


@query("f31_k08_cache_key", "SELECT id, substr(sha256(house || ':' || title), 1, 32) AS key FROM session")
def _(t: Tables) -> DataFrame:
    return t.session.select("id", F.left(F.sha2(F.concat_ws(":", "house", "title"), 256), F.lit(32)).alias("key"))


@query("f33_a33_sentiment", f"WITH w AS (SELECT id, list_distinct(regexp_extract_all(lower(concat_ws(' ', heading, coalesce(answer_text, ''))), '\\w+')) AS w FROM question), n AS (SELECT id, len(list_intersect(w, [{sql_in(T.NEGATIVE_WORDS)}])) AS bad, len(list_intersect(w, [{sql_in(T.POSITIVE_WORDS)}])) AS good FROM w) SELECT CASE WHEN bad > good THEN 'negative' WHEN good > bad THEN 'positive' ELSE 'neutral' END AS sentiment, count(*) AS n FROM n GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.question.select(T.sentiment(F.col("heading"), F.col("answer_text")).alias("sentiment")).groupBy("sentiment").agg(F.count(F.lit(1)).alias("n"))


SESSION_TYPE = f"""WITH x AS (SELECT id, lower(title) AS t, lower(coalesce(location, '')) AS w, lower(coalesce(hrs_tag, '')) AS g, hrs_tag, title FROM session)
SELECT id, CASE WHEN {" OR ".join(f"starts_with(t, {quoted(p)})" for p in C.PROCEDURAL_STARTS)} THEN 'other' WHEN contains(w, 'westminster hall') THEN 'westminster_hall' WHEN contains(w, 'grand committee') THEN 'committee_stage' WHEN contains(w, 'general committee') THEN 'statutory_instrument'
WHEN g = 'hs_8question' THEN CASE WHEN t = 'engagements' OR contains(t, 'prime minister') OR contains(t, 'pmq') THEN 'pmqs' ELSE 'oral_questions' END WHEN g = 'hs_2curgentquestion' AND FALSE THEN '' WHEN g = 'hs_2cstatement' THEN CASE WHEN contains(t, 'humble address') THEN 'debate' ELSE 'ministerial_statement' END
WHEN g = 'hs_2cbilltitle' THEN 'debate' WHEN g = 'hs_8petition' THEN 'petition' WHEN g = 'hs_3cmainhdg' THEN 'other' WHEN contains(t, 'statement') AND contains(t, 'ministerial') THEN 'ministerial_statement'
WHEN contains(t, 'statutory instrument') OR contains(t, 'delegated legislation') OR (contains(t, 'draft') AND (contains(t, 'regulation') OR contains(t, 'order'))) OR regexp_matches(t, '\\b(regulations|orders?|rules)\\s+\\d{{4}}\\b') THEN 'statutory_instrument'
WHEN regexp_matches(t, 'bill|reading|amendment|committee stage|debate|motion') THEN 'debate' ELSE 'other' END AS kind,
coalesce(g IN ({sql_in(C.CONTAINER_TAGS)}), FALSE) OR (hrs_tag IS NULL AND t IN ('oral answers to questions', 'petitions', 'prayers', 'westminster hall')) OR t IN ({sql_in(C.ANCHOR_TITLES)}) AS container FROM x"""


@query("f34_p27_session_type", SESSION_TYPE)
def _(t: Tables) -> DataFrame:
    c = F.col
    return t.session.select("id", C.session_type(c("title"), c("location"), c("hrs_tag")).alias("kind"), C.is_container(c("hrs_tag"), c("title")).alias("container"))


STARTS = lambda names: " OR ".join(f"starts_with(t, {quoted(d + ':')})" for d in names)


@query(
    "f35_debate_label",
    f"""WITH x AS (SELECT id, lower(title) AS t, lower(house) AS s FROM session) SELECT id, CASE WHEN contains(t, 'written answer') THEN 'Written Answer' WHEN contains(t, 'urgent question') THEN 'Urgent Question' WHEN contains(t, 'oral answers') OR contains(t, 'question time') OR (contains(t, 'prime minister') AND contains(t, 'question')) THEN 'Oral Question'
    WHEN s = 'commons' AND ({STARTS(C.QUESTION_DEPARTMENTS)}) THEN 'Oral Question' WHEN contains(t, 'statement') THEN 'Ministerial Statement' WHEN contains(t, 'statutory instrument') OR contains(t, 'affirmative') OR contains(t, 'delegated legislation') OR (contains(t, 'draft') AND (contains(t, 'regulation') OR contains(t, 'order'))) THEN 'Statutory Instrument'
    WHEN regexp_matches(t, 'bill|reading|amendment') THEN 'Legislation' WHEN contains(t, 'motion') THEN 'Motion' ELSE 'General Debate' END AS label FROM x""",
)
def _(t: Tables) -> DataFrame:
    return t.session.select("id", C.debate_label(F.col("title"), F.lower("house")).alias("label"))


@query(
    "f37_debate_section",
    f"""WITH x AS (SELECT s.id, lower(title) AS t, lower(house) AS s, coalesce(m, 0) AS m FROM session s LEFT JOIN (SELECT session_id, max(word_count) AS m FROM contribution GROUP BY 1) c ON c.session_id = s.id)
    SELECT id, CASE WHEN contains(t, 'written answer') THEN 'wq' WHEN regexp_matches(t, '\\bbill\\b') OR regexp_matches(t, 'second reading|third reading|committee stage|report stage|lords amendments|royal assent') THEN 'legislation' WHEN contains(t, 'urgent question') THEN 'urgent' WHEN s = 'commons' AND contains(t, 'statement') THEN 'statement'
    WHEN contains(t, 'oral answers') OR contains(t, 'question time') OR (contains(t, 'prime minister') AND contains(t, 'question')) THEN 'oral' WHEN s = 'lords' AND contains(t, '- question') THEN 'oral' WHEN s = 'commons' AND ({STARTS(C.QUESTION_DEPARTMENTS + C.MORE_QUESTION_DEPARTMENTS)}) THEN 'oral'
    WHEN contains(t, 'topical question') THEN 'oral' WHEN m > 0 AND m < 400 THEN 'oral' ELSE 'debate' END AS section FROM x""",
)
def _(t: Tables) -> DataFrame:
    longest = t.contribution.groupBy(F.col("session_id").alias("id")).agg(F.max("word_count").alias("m"))
    return t.session.select("id", "title", "house").join(longest, "id", "left").select("id", C.debate_section(F.col("title"), F.lower("house"), F.coalesce("m", F.lit(0))).alias("section"))


@query("f36_f38_f61_f69_labels", "SELECT id, CASE WHEN id % 3 = 0 THEN 'reported' WHEN id % 3 = 1 THEN 'closed' ELSE 'open' END AS status, CASE WHEN location = 'Westminster Hall' THEN 'westminsterhall' WHEN house = 'Lords' THEN 'lords' ELSE 'commons' END AS source, CASE WHEN house = 'Lords' THEN 'Life Peer' ELSE 'MP for ' || coalesce(department, 'Ely') END AS role, CASE id % 4 WHEN 1 THEN 'Commons' WHEN 2 THEN 'Lords' WHEN 3 THEN 'Joint' ELSE 'Unknown' END AS house_name FROM session")
def _(t: Tables) -> DataFrame:
    report, closed = F.when(F.col("id") % 3 == 0, "r"), F.when(F.col("id") % 3 == 1, "2024-01-01")
    code = F.coalesce(F.create_map(*(F.lit(x) for x in (1, "Commons", 2, "Lords", 3, "Joint")))[(F.col("id") % 4).cast("int")], F.lit("Unknown"))
    return t.session.select("id", C.inquiry_status(report, closed).alias("status"), C.section_source(F.col("house"), F.col("location")).alias("source"), C.role_text(F.col("house"), F.coalesce("department", F.lit("Ely"))).alias("role"), code.alias("house_name"))


@query("f39_f41_p22_answer_status", "WITH x AS (SELECT *, coalesce(answer_text, '') <> '' AS answered FROM question), y AS (SELECT *, answered AND NOT is_withdrawn AND contains(lower(left(answer_text, 200)), 'i will write') AS holding FROM x) SELECT id, CASE WHEN house = 'Lords' THEN 'LORDS' WHEN is_named_day THEN 'NAMED_DAY' ELSE 'ORDINARY' END AS kind, CASE WHEN is_withdrawn THEN 'WITHDRAWN' WHEN holding THEN 'HOLDING ANSWER' WHEN answered THEN 'ANSWERED' ELSE 'UNANSWERED' END AS status FROM y")
def _(t: Tables) -> DataFrame:
    answered = F.coalesce("answer_text", F.lit("")) != ""
    status = C.answer_status(F.col("is_withdrawn"), C.is_holding(F.col("answer_text"), F.col("is_withdrawn")), answered)
    return t.question.select("id", C.question_kind(F.col("house"), F.col("is_named_day")).alias("kind"), status.alias("status"))


@query("f42_opening_phrase", f"SELECT s.id FROM session s JOIN (SELECT session_id, speech_text FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY speech_order, id) AS n FROM contribution) WHERE n = 1) c ON c.session_id = s.id WHERE s.house = 'Lords' AND starts_with(lower(trim(c.speech_text)), {quoted('to ask his majesty')})")
def _(t: Tables) -> DataFrame:
    """sessions whose first speech asks a question."""
    from ..operators.windows import first_per

    first = first_per(t.contribution.select("session_id", "speech_order", "id", "speech_text"), ["session_id"], ["speech_order", "id"]).where(F.lower(F.trim("speech_text")).startswith("to ask his majesty"))
    return t.session.where("house = 'Lords'").select("id").join(first.select(F.col("session_id").alias("id")), "id", "left_semi")


@query("f43_f44_title_keys", "SELECT id, lower(trim(regexp_replace(regexp_replace(regexp_replace(trim(title), '^\\s*draft\\s+', '', 'i'), '\\s*\\[lords\\]\\s*$', '', 'i'), '\\s+', ' ', 'g'))) AS normal, CASE WHEN regexp_extract(title, '^(.+?)\\s+[-—]\\s+(?:Second|Third|Report|Committee)\\s+Reading', 1) <> '' THEN regexp_extract(title, '^(.+?)\\s+[-—]\\s+(?:Second|Third|Report|Committee)\\s+Reading', 1) ELSE title END AS key FROM session")
def _(t: Tables) -> DataFrame:
    return t.session.select("id", T.normal_title(F.col("title")).alias("normal"), T.debate_key(F.col("title")).alias("key"))


@query("f45_listing_ids", "SELECT id, regexp_extract(url, '\\?id=([^&#]+)', 1) AS listing, regexp_replace(regexp_extract(url, '\\?id=([^&#]+)', 1), '\\.[^.]*$', '') AS section FROM contribution WHERE url IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return t.contribution.where("url IS NOT NULL").select("id", T.listing_id(F.col("url")).alias("listing"), T.listing_section(F.col("url")).alias("section"))


@query("f46_f65_f56_topics", "WITH x AS (SELECT id, '\"' || department || '\" OR \"' || title || '\"' AS q, title FROM session WHERE department IS NOT NULL) SELECT id, q || '|' || array_to_string(regexp_extract_all(q, '\"([^\"]+)\"', 1), '|') || '|' || array_to_string(string_split_regex(replace(q, '\"', ''), '\\s+')[1:2], ' ') AS queries, '(' || CASE WHEN len(string_split_regex(trim(title), '\\s+')) <= 4 THEN '\"' || title || '\" OR ' ELSE '' END || '\"one\" OR \"two\")' AS phrase, left(trim(regexp_extract(title, '^[^.?]*')), 150) AS topic FROM x")
def _(t: Tables) -> DataFrame:
    rows = t.session.where("department IS NOT NULL")
    q = F.concat(F.lit('"'), "department", F.lit('" OR "'), "title", F.lit('"'))
    short = F.array_join(F.slice(F.split(F.replace(q, F.lit('"'), F.lit("")), r"\s+"), 1, 2), " ")
    queries = F.array_join(T.title_queries(q), "|")
    # The SQL lists the two words even if they are a phrase already.
    queries = F.when(F.array_contains(F.regexp_extract_all(q, F.lit('"([^"]+)"'), 1), short), F.concat(queries, F.lit("|"), short)).otherwise(queries)
    return rows.select("id", queries.alias("queries"), T.phrase_query(F.col("title"), F.array(F.lit("one"), F.lit("two"))).alias("phrase"), F.left(F.trim(F.regexp_extract("title", r"^[^.?]*", 0)), F.lit(150)).alias("topic"))


@query("f47_tolerant_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t: Tables) -> DataFrame:
    e = t.raw("events")
    broken = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.replace("props", F.lit("}"), F.lit(",}"))).otherwise(F.concat(F.lit("Here it is: "), "props", F.lit(" Done.")))
    return e.select("event_id", T.tolerant_json(broken, "k long")["k"].alias("k"))


@query("f51_f54_rk_scores", "SELECT id, round(1.0 / (1 + date_diff('day', date, DATE '2002-01-01') / 45.0), 6) AS recency, round(least(1.0, ln(1 + id % 150) / ln(101)), 4) AS level, round(least(1.0, (id % 5) / 3.0), 6) AS breadth, round(pow(0.5, date_diff('day', date, DATE '2002-01-01') / 1825.0), 6) AS halved, round(0.4 * (id % 3) / 2.0 + 0.35 / (1 + date_diff('day', date, DATE '2002-01-01') / 45.0) + 0.15 * least(1.0, ln(1 + id % 150) / ln(101)) + 0.1 * least(1.0, (id % 5) / 3.0), 4) AS rank FROM session")
def _(t: Tables) -> DataFrame:
    """F51-F54, RK."""
    i, age = F.col("id"), F.datediff(F.lit("2002-01-01").cast("date"), "date")
    return t.session.select("id", F.round(S.recency(age), 6).alias("recency"), F.round(S.engagement_level(i % 150), 4).alias("level"), F.round(S.breadth(i % 5), 6).alias("breadth"), F.round(S.halved(age), 6).alias("halved"), F.round(S.blended((i % 3) / 2.0, age, i % 150, i % 5), 4).alias("rank"))


WEIGHT = "CASE source_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.WEIGHTS.items()) + " ELSE 0.0 END"


@query(
    "rs_a27_relevance",
    f"""SELECT organisation_id, round(sum({WEIGHT} * pow(0.5, greatest(0, date_diff('day', engagement_date, DATE '2001-12-31')) / 1825.0) * CASE WHEN cited_in_outcome THEN 2.5 ELSE 1.0 END * CASE WHEN policy_area = 'skills' THEN 2.0 ELSE 1.0 END * CASE WHEN department = 'HM Treasury' THEN 1.5 ELSE 1.0 END), 6) AS score, count(*) AS n
    FROM engagement WHERE engagement_date BETWEEN DATE '1996-01-01' AND DATE '2001-12-31' GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    """RS, A27: relevance per organisation for a policy area and a department."""
    c = F.col
    score = S.engagement_score(c("source_type"), c("engagement_date"), c("cited_in_outcome"), c("policy_area"), c("department"), F.lit("2001-12-31").cast("date"), "skills", "HM Treasury")
    return t.engagement.where(D.in_range(c("engagement_date"), "1996-01-01", "2001-12-31")).groupBy("organisation_id").agg(F.round(F.sum(score), 6).alias("score"), F.count(F.lit(1)).alias("n"))


@query("f50_explanations", f"SELECT id, 'Weight ' || format('{{:.2f}}', CAST({WEIGHT} AS DOUBLE)) || ', recency ' || format('{{:.2f}}', pow(0.5, date_diff('day', engagement_date, DATE '2002-01-01') / 1825.0)) || CASE WHEN cited_in_outcome THEN ', cited in outcome' ELSE '' END || CASE WHEN policy_area = 'skills' THEN ', policy area match' ELSE '' END || ': 1.00' AS text FROM engagement")
def _(t: Tables) -> DataFrame:
    c = F.col
    days = F.datediff(F.lit("2002-01-01").cast("date"), "engagement_date")
    return t.engagement.select("id", S.explanation(S.weight(c("source_type")), days, c("cited_in_outcome"), F.coalesce(c("policy_area") == "skills", F.lit(False)), F.lit(False), F.lit(1.0)).alias("text"))


@query("f55_iso_weeks", "SELECT id, strftime(date, '%G-W%V') AS week, CAST(date_trunc('week', date) AS DATE) AS monday FROM session")
def _(t: Tables) -> DataFrame:
    return t.session.select("id", D.iso_week(F.col("date")).alias("week"), D.monday(F.col("date")).alias("monday"))


@query("f57_f63_periods", "SELECT id, date - 60 AS from_60, date - 365 AS from_365, strftime(date, '%Y-%m') || '–' || CASE WHEN id % 3 = 0 THEN 'present' ELSE strftime(date + 100, '%Y-%m') END AS period FROM session")
def _(t: Tables) -> DataFrame:
    d = F.col("date")
    return t.session.select("id", F.date_sub(d, 60).alias("from_60"), F.date_sub(d, 365).alias("from_365"), D.period_text(d.cast("string"), F.when(F.col("id") % 3 != 0, F.date_add(d, 100).cast("string"))).alias("period"))


@query("f58_f60_evidence_fields", "SELECT id, CASE WHEN id % 2 = 0 THEN id % 300 END AS inquiry, 'https://committees.example.org/publications/' || id || '/documents' AS url, concat_ws(', ', 'Person ' || id % 9, CASE WHEN id % 3 > 0 THEN 'Chair' END) AS role FROM engagement")
def _(t: Tables) -> DataFrame:
    """The first of an array or the single struct, the evidence's URL, a person with their role."""
    i = F.col("id")
    many, one = F.when(i % 4 == 0, F.array(F.struct((i % 300).alias("id")))).otherwise(F.array().cast("array<struct<id:bigint>>")), F.when(i % 4 == 2, F.struct((i % 300).alias("id")))
    return t.engagement.select("id", F.coalesce(F.get(many, F.lit(0))["id"], one["id"]).alias("inquiry"), F.format_string("https://committees.example.org/publications/%d/documents", i).alias("url"), F.concat_ws(", ", F.concat(F.lit("Person "), i % 9), F.when(i % 3 > 0, "Chair")).alias("role"))


@query("f62_f64_f66_f67_f68_small", "SELECT id, CASE WHEN length(title) > 12 THEN left(title, 12) || '…' ELSE title END AS short, CASE department WHEN 'Department for Education' THEN 'Education' WHEN 'HM Treasury' THEN 'Economics & Finance' WHEN 'Home Office' THEN 'Home Affairs' ELSE 'Other' END AS category, CASE WHEN house = 'Lords' THEN 'Lords' ELSE 'Commons' END AS label, CASE WHEN id % 2 = 0 THEN title ELSE 'Untitled' END AS part, CASE WHEN id % 3 = 0 THEN FALSE ELSE id % 3 = 1 END AS flag FROM session")
def _(t: Tables) -> DataFrame:
    i = F.col("id")
    packed = F.concat_ws("||", F.lit("http://x"), F.when(i % 2 == 0, F.col("title")))
    return t.session.select("id", T.ellipsis(F.col("title"), 12).alias("short"), C.department_category(F.col("department")).alias("category"), C.source_label(F.lower("house")).alias("label"), T.url_title_date(packed)["title"].alias("part"), F.coalesce(F.when(i % 3 == 0, F.lit(None)).otherwise((i % 3 == 1).cast("int")).cast("boolean"), F.lit(False)).alias("flag"))


# Predicates


def sql_hits(c: str, stems: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({c}), {quoted(s)}) AS INT)" for s in stems) + ")"


@query("p11_p13_stem_filters", f"SELECT id, {sql_hits('question_text', ['student', 'loan', 'repayment'])} >= 2 AS two, {sql_hits('question_text', ['flood', 'river'])} >= 2 OR {sql_hits('question_text', ['hospital'])} >= 1 AS subjects, {sql_hits('question_text', ['school', 'teacher', 'loan', 'waiting'])} >= 2 AS half, {sql_hits('question_text', ['rivers', 'about'])} > 0 AS word FROM question")
def _(t: Tables) -> DataFrame:
    q = F.col("question_text")
    return t.question.select("id", P.stems_match(q, "student loans repayments").alias("two"), P.subjects_match(q, "floods rivers, hospitals").alias("subjects"), P.half_match(q, "schools teachers loans waiting").alias("half"), P.any_word(q, "rivers about x").alias("word"))


@query("p14_g05_cascade", "SELECT id FROM question WHERE CASE WHEN (SELECT bool_or(contains(question_text, 'zebra')) FROM question) THEN contains(question_text, 'zebra') ELSE department = 'HM Treasury' END")
def _(t: Tables) -> DataFrame:
    return P.cascade(t.question.select("id", "question_text", "department"), F.col("question_text").contains("zebra"), F.col("department") == "HM Treasury").select("id")


@query("p15_p16_filters", "SELECT id FROM session WHERE house = 'Lords' AND date >= DATE '1996-02-01'")
def _(t: Tables) -> DataFrame:
    """A malformed bound and an unknown value are left out."""
    return t.session.where((F.col("house") == "Lords") & D.in_range(F.col("date"), "1996-02-01", "31/12/x")).select("id")


@query("p19_p20_name_filters", "SELECT id, CASE WHEN contains(lower(department), 'hm treasury') THEN 'HM Treasury' WHEN contains(lower(department), 'home office') THEN 'Home Office' END AS internal, lower(trim(CASE WHEN id % 7 = 0 THEN ' N/A ' ELSE heading END)) IN ('none', 'n/a') AS placeholder FROM question WHERE heading IS NOT NULL")
def _(t: Tables) -> DataFrame:
    name = F.when(F.col("id") % 7 == 0, " N/A ").otherwise(F.col("heading"))
    return t.question.where("heading IS NOT NULL").select("id", P.whole_word(F.col("department"), ["HM Treasury", "Home Office", "Treasur"]).alias("internal"), P.is_placeholder(name).alias("placeholder"))


@query("p21_p26_p29_row_filters", "SELECT c.id, length(c.speech_text) < 25 AS short FROM contribution c WHERE stance <> 'R' AND coalesce(member_name, '') <> ''")
def _(t: Tables) -> DataFrame:
    kind, tag = F.when(F.col("stance") == "R", "Timestamp").otherwise("Contribution"), F.lit(None).cast("string")
    return t.contribution.where(C.is_speech_item(kind, tag, F.col("member_name"))).select("id", (F.length("speech_text") < 25).alias("short"))


@query("p23_p25_title_filters", "SELECT id, regexp_matches(lower(title), '\\b(bill|amendment)\\b') AS bill, contains(lower(title), 'department for education') OR contains(lower(title), 'education') AS named, NOT contains(lower(title), 'oral answers to questions') OR contains(lower(title), 'education') AS kept FROM session")
def _(t: Tables) -> DataFrame:
    named = C.names_department(F.col("title"), ["Department for Education"])
    return t.session.select("id", F.col("title").rlike(r"(?i)\b(bill|amendment)\b").alias("bill"), named.alias("named"), (~F.lower("title").contains("oral answers to questions") | named).alias("kept"))


@query("p30_t08_fresh", "SELECT id FROM run WHERE started_at >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 24 HOUR")
def _(t: Tables) -> DataFrame:
    return t.run.where(D.fresh(F.col("started_at"), F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), 24)).select("id")


@query("p31_p36_patterns", "SELECT id FROM session WHERE (lower(title) LIKE '%bill%' OR lower(title) LIKE 'draft_%') AND NOT lower(title) LIKE '%lords%' AND ext_id LIKE 'S_1%'")
def _(t: Tables) -> DataFrame:
    return t.session.where(P.like_any(F.col("title"), ["%bill%", "draft_%"], ["%lords%"]) & F.col("ext_id").like("S_1%")).select("id")


@query("p32_s22_long_speeches", "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY member_id, session_id ORDER BY speech_order, id, word_count, spoken_at) AS n FROM contribution WHERE member_id IS NOT NULL) WHERE n = 1 AND word_count >= 50 ORDER BY spoken_at DESC, id LIMIT 25")
def _(t: Tables) -> DataFrame:
    """The first speech of each section, then the word floor, then the newest."""
    from ..operators.windows import first_per

    rows = t.contribution.where("member_id IS NOT NULL").select("member_id", "session_id", "speech_order", "id", "word_count", "spoken_at")
    return first_per(rows, ["member_id", "session_id"], ["speech_order", "id"]).where("word_count >= 50").orderBy(F.desc("spoken_at"), "id").limit(25).select("id")


@query("p34_domains", "SELECT id FROM organisation WHERE suffix('user@' || CASE WHEN id % 3 = 0 THEN 'parliament.uk' WHEN id % 3 = 1 THEN 'x.gov.uk' ELSE 'mail.com' END, '.gov.uk') OR id % 3 = 0")
def _(t: Tables) -> DataFrame:
    email = F.concat(F.lit("User@"), F.get(F.array(F.lit("Parliament.uk "), F.lit("x.gov.uk"), F.lit("mail.com")), (F.col("id") % 3).cast("int")))
    return t.organisation.where(P.domain_allowed(email, [".gov.uk", "@parliament.uk"])).select("id")


@query("p38_p39_lookups", "SELECT id FROM question WHERE uin = upper('hl17') UNION ALL SELECT id FROM session WHERE date = DATE '1998-03-03' ORDER BY id")
def _(t: Tables) -> DataFrame:
    return t.question.where(F.col("uin") == F.upper(F.lit("hl17"))).select("id").union(t.session.where(F.col("date") == F.lit("1998-03-03").cast("date")).select("id")).orderBy("id")


@query("p40_p41_splits", "SELECT house, count(*) FILTER (contains(lower(title), 'statement')) AS statements, count(*) FILTER (NOT contains(lower(title), 'statement')) AS rest FROM session GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Disjoint parts of one table in one pass."""
    statement = F.lower("title").contains("statement")
    return t.session.groupBy("house").agg(F.count_if(statement).alias("statements"), F.count_if(~statement).alias("rest"))


# Projections


@query("p02_p03_question_rows", "SELECT id, nullif(trim(heading), '') AS heading, nullif(trim(answer_text), '') AS answer, substr(question_text, 1, 20) AS shown, CAST(len(string_split_regex(trim(question_text), '\\s+')) AS INTEGER) AS words FROM question")
def _(t: Tables) -> DataFrame:
    """Display text is cut, words are counted over all of it."""
    return t.question.select("id", F.nullif(F.trim("heading"), F.lit("")).alias("heading"), F.nullif(F.trim("answer_text"), F.lit("")).alias("answer"), F.substring("question_text", 1, 20).alias("shown"), F.size(F.split(F.trim("question_text"), r"\s+")).alias("words"))


@query("p05_p06_uniform_view", "SELECT id, canonical_name AS name, type AS category, 'organisation' AS kind, 'Represented by ' || canonical_name || coalesce(' — ' || registration_number, '') AS subject FROM organisation UNION ALL SELECT organisation_id, alias_name, 'Other', 'alias', 'Represented by ' || alias_name FROM alias")
def _(t: Tables) -> DataFrame:
    a = t.organisation.select("id", F.col("canonical_name").alias("name"), F.col("type").alias("category"), F.lit("organisation").alias("kind"), "registration_number")
    b = t.alias.select(F.col("organisation_id").alias("id"), F.col("alias_name").alias("name"), F.lit("alias").alias("kind"))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.select("id", "name", F.coalesce("category", F.lit("Other")).alias("category"), "kind", F.concat(F.lit("Represented by "), F.concat_ws(" — ", "name", "registration_number")).alias("subject"))


@query("p07_p08_flattened", "SELECT id, unnest([{'k': 'posts', 'v': substr(name, 1, 9)}, {'k': 'houses', 'v': house}], recursive := true) FROM member")
def _(t: Tables) -> DataFrame:
    """Nested categories as rows, texts cut."""
    pairs = F.array(F.struct(F.lit("posts").alias("k"), F.substring("name", 1, 9).alias("v")), F.struct(F.lit("houses").alias("k"), F.col("house").alias("v")))
    return t.member.select("id", F.inline(pairs))


@query("p09_p10_evidence_pack", "SELECT department, string_agg(n || '. ' || title, chr(10) ORDER BY n) AS pack FROM (SELECT *, row_number() OVER (PARTITION BY department ORDER BY date DESC, id) AS n FROM session WHERE department IS NOT NULL) WHERE n <= 8 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """The first eight rows of each source as numbered lines."""
    from ..operators.windows import top_per

    rows = top_per(t.session.where("department IS NOT NULL").select("id", "department", "date", "title"), ["department"], [F.desc("date"), F.col("id")], 8)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", "title"))), lambda x: F.concat(x["position"], F.lit(". "), x["title"]))
    return rows.groupBy("department").agg(F.array_join(lines, "\n").alias("pack"))
