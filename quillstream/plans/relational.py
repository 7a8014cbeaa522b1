"""Joins, aggregates, windows, pages and set operations over the domain's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins as J
from ..operators import windows as W
from .domain import Tables
from .registry import query


# Joins


@query("j01_theme_last_modified", "SELECT theme, max(s.ingested_at) AS last_modified, count(*) AS n FROM theme t JOIN session s ON t.session_id = s.id GROUP BY theme HAVING count(*) >= 5")
def _(t: Tables) -> DataFrame:
    """Last change per theme of at least five sessions."""
    joined = t.theme.join(t.session.select("id", "ingested_at"), F.col("session_id") == F.col("id"))
    return joined.groupBy("theme").agg(F.max("ingested_at").alias("last_modified"), F.count(F.lit(1)).alias("n")).where("n >= 5")


@query("j02_member_sessions", "SELECT DISTINCT member_id, s.id AS session_id, s.date FROM contribution c JOIN session s ON c.session_id = s.id WHERE NOT s.is_container AND member_id IS NOT NULL")
def _(t: Tables) -> DataFrame:
    """Sessions in which a member spoke; pairs are made distinct before the join."""
    spoke = t.contribution.where("member_id IS NOT NULL").select("member_id", "session_id").distinct()
    return spoke.join(t.session.where(~F.col("is_container")).select(F.col("id").alias("session_id"), "date"), "session_id").select("member_id", "session_id", "date")


FIRST_SPEECH = "SELECT session_id, id, speech_order, member_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY speech_order, id, member_id NULLS FIRST) AS n FROM contribution) WHERE n = 1"


@query("j03_w01_first_speech", f"SELECT f.session_id, f.id, f.speech_order, f.member_id, s.house FROM ({FIRST_SPEECH}) f JOIN session s ON f.session_id = s.id")
def _(t: Tables) -> DataFrame:
    """The first speech of each session."""
    first = W.first_per(t.contribution.select("session_id", "id", "speech_order", "member_id"), ["session_id"], ["speech_order", "id", "member_id"])
    return first.join(t.session.select(F.col("id").alias("session_id"), "house"), "session_id")


@query("j04_j11_policy_sessions", "SELECT s.id, s.title, s.date FROM session s WHERE EXISTS (SELECT 1 FROM theme t WHERE t.session_id = s.id AND t.theme = 'theme 2' AND t.theme_type = 'policy_area')")
def _(t: Tables) -> DataFrame:
    """Sessions with a policy area, once each."""
    return J.having(t.session.select("id", "title", "date"), t.theme.where("theme = 'theme 2' AND theme_type = 'policy_area'"), "id", "session_id")


@query("j05_question_policy", "SELECT DISTINCT q.id, q.heading FROM question q JOIN question_theme t ON t.question_id = q.id WHERE t.theme = 'theme 4' AND t.theme_type = 'policy_area'")
def _(t: Tables) -> DataFrame:
    return J.having(t.question.select("id", "heading"), t.question_theme.where("theme = 'theme 4' AND theme_type = 'policy_area'"), "id", "question_id")


@query("j07_a10_matching_sessions", "SELECT s.house, count(DISTINCT s.id) AS n FROM session s LEFT JOIN contribution c ON c.session_id = s.id AND c.speech_text LIKE '%loans%' WHERE c.id IS NOT NULL OR s.title LIKE '%Bill%' GROUP BY s.house")
def _(t: Tables) -> DataFrame:
    """Sessions matched by a speech or by title; the speeches are reduced to their sessions first."""
    hit = t.contribution.where(F.col("speech_text").contains("loans")).select(F.col("session_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    return t.session.join(hit, "id", "left").where(F.col("hit") | F.col("title").contains("Bill")).groupBy("house").agg(F.count(F.lit(1)).alias("n"))


@query("j08_silent_organisations", "SELECT o.id, o.canonical_name FROM organisation o LEFT JOIN (SELECT * FROM engagement WHERE cited_in_outcome AND engagement_date >= DATE '2001-01-01') e ON e.organisation_id = o.id GROUP BY ALL HAVING count(e.id) = 0")
def _(t: Tables) -> DataFrame:
    """Organisations without a cited engagement this year."""
    return J.not_in(t.organisation.select("id", "canonical_name"), t.engagement.where("cited_in_outcome AND engagement_date >= DATE '2001-01-01'"), "id", "organisation_id")


@query("j09_untagged_sessions", "SELECT id, title FROM session s WHERE NOT is_container AND NOT EXISTS (SELECT 1 FROM theme t WHERE t.session_id = s.id) AND debate_type <> 'other'")
def _(t: Tables) -> DataFrame:
    """Sessions still to tag; a null type is left out as the comparison says."""
    return J.not_in(t.session.where(~F.col("is_container") & (F.col("debate_type") != "other")).select("id", "title"), t.theme, "id", "session_id")


@query("j10_untagged_questions", "SELECT id, uin FROM question q WHERE NOT EXISTS (SELECT 1 FROM question_theme t WHERE t.question_id = q.id)")
def _(t: Tables) -> DataFrame:
    return J.not_in(t.question.select("id", "uin"), t.question_theme, "id", "question_id")


@query("j12_organisations_by_engagement", "SELECT id FROM organisation o WHERE EXISTS (SELECT 1 FROM engagement e WHERE e.organisation_id = o.id AND e.source_type = 'ministerial_meeting') AND EXISTS (SELECT 1 FROM engagement e WHERE e.organisation_id = o.id AND e.engagement_date >= DATE '2000-01-01')")
def _(t: Tables) -> DataFrame:
    """J12 as one aggregate over the engagements and one semi-join."""
    e = t.engagement.groupBy("organisation_id").agg(F.bool_or(F.col("source_type") == "ministerial_meeting").alias("met"), F.bool_or(F.col("engagement_date") >= F.lit("2000-01-01").cast("date")).alias("late")).where("met AND late")
    return J.having(t.organisation.select("id"), e, "id", "organisation_id")


@query("j13_stub_rows", "SELECT id, title, '' AS speech_text FROM session s WHERE title LIKE '%Order%' AND NOT EXISTS (SELECT 1 FROM contribution c WHERE c.session_id = s.id AND c.speech_text LIKE '%schools%') UNION ALL SELECT s.id, s.title, c.speech_text FROM session s JOIN contribution c ON c.session_id = s.id WHERE c.speech_text LIKE '%schools%'")
def _(t: Tables) -> DataFrame:
    """Speeches that match, and a row without text for sessions that match by title alone."""
    speech = t.contribution.where(F.col("speech_text").contains("schools")).select("session_id", "speech_text")
    sessions = t.session.select("id", "title")
    return J.union_all([sessions.join(speech, F.col("id") == F.col("session_id")).drop("session_id"), J.not_in(sessions.where(F.col("title").contains("Order")), speech, "id", "session_id").withColumn("speech_text", F.lit(""))])


@query("j14_dangling_references", "SELECT DISTINCT f.organisation_id FROM flag f WHERE NOT EXISTS (SELECT 1 FROM alias o WHERE o.organisation_id = f.organisation_id)")
def _(t: Tables) -> DataFrame:
    return J.not_in(t.flag.select("organisation_id").distinct(), t.alias, "organisation_id", "organisation_id")


@query("j15_a06_speaker_counts", "SELECT s.id, s.title, coalesce(n, 0) AS speakers FROM session s LEFT JOIN (SELECT session_id, count(*) AS n FROM contribution WHERE member_name IS NOT NULL GROUP BY 1) c ON c.session_id = s.id")
def _(t: Tables) -> DataFrame:
    """Speeches by named speakers per session, 0 without."""
    counts = t.contribution.where("member_name IS NOT NULL").groupBy("session_id").agg(F.count(F.lit(1)).alias("speakers"))
    return J.with_lookup(t.session.select("id", "title"), counts, "id", "session_id", {"speakers": 0})


@query("j16_a37_tags_by_type", "SELECT session_id, coalesce(string_agg(DISTINCT theme, ',' ORDER BY theme) FILTER (theme_type = 'policy_area'), '') AS areas, coalesce(string_agg(DISTINCT theme, ',' ORDER BY theme) FILTER (theme_type = 'specific'), '') AS topics FROM theme GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Sorted tags of either type."""
    tags = lambda kind: F.array_join(F.sort_array(F.collect_set(F.when(F.col("theme_type") == kind, F.col("theme")))), ",")
    return t.theme.groupBy("session_id").agg(tags("policy_area").alias("areas"), tags("specific").alias("topics"))


@query("j17_speaker_roles", "SELECT c.id, c.member_name, m.house IS NOT NULL AS is_minister, coalesce(m.house, '') AS role FROM contribution c LEFT JOIN (SELECT DISTINCT 'member ' || id AS k, house FROM member WHERE id % 5 = 0) m ON lower(trim(c.member_name)) = m.k")
def _(t: Tables) -> DataFrame:
    """A speaker's role by normalised name."""
    ministers = t.member.where("id % 5 = 0").select(F.concat(F.lit("member "), F.col("id")).alias("k"), F.col("house").alias("role"))
    return J.with_lookup(t.contribution.select("id", "member_name", T.person_key(F.col("member_name")).alias("k")), ministers.distinct(), "k", "k", {"role": ""}).select("id", "member_name", (F.col("role") != "").alias("is_minister"), "role")


@query("j18_two_index_lookup", "SELECT a.alias_name, coalesce(x.id, y.id) AS organisation_id FROM alias a LEFT JOIN (SELECT lower(canonical_name) AS k, max(id) AS id FROM organisation GROUP BY 1) x ON x.k = lower(a.alias_name) LEFT JOIN (SELECT lower(alias_name) AS k, max(organisation_id) AS id FROM alias GROUP BY 1) y ON y.k = lower(a.alias_name)")
def _(t: Tables) -> DataFrame:
    """An organisation by canonical name, else by alias; the last of equal names."""
    names, aliases = t.organisation.select(F.lower("canonical_name").alias("k"), "id"), t.alias.select(F.lower("alias_name").alias("k"), F.col("organisation_id").alias("id"))
    return J.first_of_lookups(t.alias.select("alias_name", F.lower("alias_name").alias("k")), [(names, "k", "id"), (aliases, "k", "id")], "k", "organisation_id").drop("k")


RELATED = """SELECT id, count(*) AS n, min(ids) AS nearest FROM (SELECT a.id, {'d': abs(date_diff('day', a.date, b.date)), 'id': b.id} AS ids
FROM k a JOIN k b ON a.key = b.key AND a.id <> b.id AND abs(date_diff('day', a.date, b.date)) <= 30) GROUP BY id"""
NORMAL = "lower(trim(regexp_replace(regexp_replace(regexp_replace(trim(title), '^\\s*draft\\s+', '', 'i'), '\\s*\\[lords\\]\\s*$', '', 'i'), '\\s+', ' ', 'g')))"


@query("t01_related_sessions", f"WITH k AS (SELECT id, date, {NORMAL} || house || debate_type AS key FROM session) SELECT id, n, CAST(nearest.d AS INTEGER) AS days, nearest.id AS nearest_id FROM ({RELATED})")
def _(t: Tables) -> DataFrame:
    """Sessions of an equal normal title near in time: how many, and the nearest."""
    return J.related_summary(t.session, F.concat(T.normal_title(F.col("title")), "house", "debate_type"), 30)


@query(["j22_interval_join", "j22_interval_join_all"], "WITH p AS (SELECT organisation_id, policy_area, date_trunc('month', engagement_date) AS a, CASE WHEN id % 3 > 0 THEN date_trunc('month', engagement_date) + INTERVAL 60 DAY END AS b, id FROM engagement) SELECT e.id, p.id AS span_id FROM engagement e JOIN p ON e.organisation_id = p.organisation_id AND p.a <= e.engagement_date AND (p.b IS NULL OR p.b >= e.engagement_date)")
def _(t: Tables) -> DataFrame:
    """J22 with a span of every engagement."""
    start = F.date_trunc("month", "engagement_date")
    spans = t.engagement.select("id", "organisation_id", start.alias("a"), F.when(F.col("id") % 3 > 0, start + F.expr("INTERVAL 60 DAY")).alias("b"))
    return J.during(t.engagement.select("id", "organisation_id", "engagement_date"), spans, "organisation_id", "engagement_date", "a", "b").select("id", "span_id")


@query("j22_covering_spans", "WITH p AS (SELECT organisation_id, CAST(date_trunc('month', engagement_date) AS DATE) AS a, CASE WHEN id % 3 > 0 THEN CAST(date_trunc('month', engagement_date) + INTERVAL 60 DAY AS DATE) END AS b FROM engagement) SELECT e.id, (SELECT count(*) FROM p WHERE p.organisation_id = e.organisation_id AND p.a <= e.engagement_date AND (p.b IS NULL OR p.b >= e.engagement_date)) AS spans FROM engagement e")
def _(t: Tables) -> DataFrame:
    """How many spans cover each engagement, without pairs."""
    start = F.date_trunc("month", "engagement_date").cast("date")
    spans = t.engagement.select("organisation_id", start.alias("a"), F.when(F.col("id") % 3 > 0, F.date_add(start, 60)).alias("b"))
    return J.covers(t.engagement.select("id", "organisation_id", "engagement_date"), spans, "organisation_id", "engagement_date", "a", "b").select("id", "spans")


@query("x01_as_of_join", "WITH v AS (SELECT user_id, max(value) AS value, ts FROM events WHERE event_type = 'view' GROUP BY user_id, ts), p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') SELECT p.event_id, v.value, v.ts AS seen_at FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts")
def _(t: Tables) -> DataFrame:
    """An extension of J22: the last view before each purchase."""
    e = t.raw("events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return J.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "ts", ["value"]).select("event_id", F.col("asof_value").alias("value"), F.col("asof_at").alias("seen_at"))


@query("j23_department_from_parent", "SELECT s.id, coalesce(s.department, p.department) AS department FROM session s LEFT JOIN session p ON p.id = s.parent_id")
def _(t: Tables) -> DataFrame:
    """A child's missing department from its container."""
    parents = t.session.select(F.col("id").alias("parent"), F.col("department").alias("theirs"))
    return t.session.join(parents, F.col("parent_id") == F.col("parent"), "left").select("id", F.coalesce("department", "theirs").alias("department"))


@query("j24_flagged_relations", "SELECT DISTINCT f.organisation_id, o.id AS related_id, o.canonical_name FROM flag f JOIN organisation o ON o.id = TRY_CAST(regexp_extract(f.detail, 'org_id=(\\d+)', 1) AS BIGINT) WHERE NOT f.resolved AND f.flag_type = 'possible_duplicate'")
def _(t: Tables) -> DataFrame:
    """Organisations that open flags name in their text."""
    named = t.flag.where("NOT resolved AND flag_type = 'possible_duplicate'").select("organisation_id", F.regexp_extract("detail", r"org_id=(\d+)", 1).try_cast("long").alias("related_id")).distinct()
    return named.join(t.organisation.select(F.col("id").alias("related_id"), "canonical_name"), "related_id").select("organisation_id", "related_id", "canonical_name")


@query("j26_retry_set", "SELECT uin, min(id) AS id, count(*) AS n FROM question q WHERE NOT EXISTS (SELECT 1 FROM question_theme t WHERE t.question_id = q.id) GROUP BY uin")
def _(t: Tables) -> DataFrame:
    """What a batch's answers left out."""
    return J.not_in(t.question.select("id", "uin"), t.question_theme, "id", "question_id").groupBy("uin").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))


@query("j27_positional_join", "WITH a AS (SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY id) AS n FROM contribution), b AS (SELECT session_id, theme, row_number() OVER (PARTITION BY session_id ORDER BY theme) AS n FROM theme) SELECT a.id, a.n AS position, b.theme AS new_theme FROM a JOIN b ON a.session_id = b.session_id AND a.n = b.n")
def _(t: Tables) -> DataFrame:
    return J.by_position(t.contribution.select("id", "session_id"), t.theme.select("session_id", "theme"), "session_id", "id", "theme", "theme").select("id", F.col("position").cast("long").alias("position"), "new_theme")


@query("j28_a15_two_level_counts", "SELECT house, round(avg(n), 1) AS mean, min(n) AS least, max(n) AS most, count(*) AS sessions FROM (SELECT s.id, s.house, (SELECT count(*) FROM contribution c WHERE c.session_id = s.id) AS n FROM session s) GROUP BY house")
def _(t: Tables) -> DataFrame:
    """Speeches per session, then over the sessions of each house."""
    n = t.contribution.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    each = J.with_lookup(t.session.select("id", "house"), n, "id", "session_id", {"n": 0})
    return each.groupBy("house").agg(F.round(F.avg("n"), 1).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("sessions"))


@query("j29_same_asker", "SELECT a.id, count(*) AS n FROM question a JOIN question b ON a.member_id = b.member_id AND a.id <> b.id AND a.department = b.department AND a.heading = b.heading AND b.tabled_date BETWEEN a.tabled_date - INTERVAL 90 DAY AND a.tabled_date GROUP BY a.id")
def _(t: Tables) -> DataFrame:
    """An asker's other questions of the last 90 days on the same heading: counted by date, then over a range of dates."""
    keys = ["member_id", "department", "heading"]
    q = t.question.where("member_id IS NOT NULL AND department IS NOT NULL AND heading IS NOT NULL").select("id", *keys, "tabled_date")
    daily = q.groupBy(*keys, "tabled_date").agg(F.count(F.lit(1)).alias("n"))
    recent = Window.partitionBy(*keys).orderBy(F.unix_date("tabled_date")).rangeBetween(-90, 0)
    totals = daily.withColumn("n", F.sum("n").over(recent) - 1).where("n > 0")
    return q.join(totals, [*keys, "tabled_date"]).select("id", "n")


@query("j30_s40_member_enrichment", "SELECT c.id, coalesce(c.party, m.party, 'Unknown') AS party, coalesce(m.house, 'Commons') AS house FROM contribution c LEFT JOIN member m ON m.id = c.member_id")
def _(t: Tables) -> DataFrame:
    """Names and parties from the members, with defaults."""
    found = J.with_lookup(t.contribution.select("id", "member_id", F.col("party").alias("own")), t.member.select("id", "party", "house"), "member_id", "id", {"party": None, "house": "Commons"})
    return found.select("id", F.coalesce("own", "party", F.lit("Unknown")).alias("party"), "house")


@query("j31_theme_buckets", "SELECT coalesce(t.theme, 'General / Uncategorized') AS theme, count(*) AS n FROM session s LEFT JOIN (SELECT session_id, min(theme) AS theme FROM theme WHERE theme_type = 'specific' GROUP BY 1) t ON t.session_id = s.id GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Sessions by theme, the rest in a bucket of its own."""
    one = t.theme.where("theme_type = 'specific'").groupBy("session_id").agg(F.min("theme").alias("theme"))
    return J.with_lookup(t.session.select("id"), one, "id", "session_id", {"theme": "General / Uncategorized"}).groupBy("theme").agg(F.count(F.lit(1)).alias("n"))


@query("j32_j36_members_to_fetch", "SELECT DISTINCT member_id FROM question q WHERE member_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM member m WHERE m.id = q.member_id AND m.house = 'Lords')")
def _(t: Tables) -> DataFrame:
    """Distinct ids in none of the caches."""
    return J.not_in(t.question.where("member_id IS NOT NULL").select("member_id").distinct(), t.member.where("house = 'Lords'"), "member_id", "id")


@query(["j34_first_variant", "j34_first_variant_all"], "WITH v AS (SELECT id, unnest([canonical_name, replace(canonical_name, ' Ltd', ''), 'Customer#000000001']) AS v, unnest([0, 1, 2]) AS pos FROM organisation), h AS (SELECT c_name AS k, c_custkey AS hit FROM customer), m AS (SELECT id, min({'pos': pos, 'hit': hit}) AS x FROM v JOIN h ON v.v = h.k GROUP BY id) SELECT id, x.hit AS hit FROM m")
def _(t: Tables) -> DataFrame:
    """J34, S41, S42 over all organisations; the constant last variant is looked up once."""
    variants = F.array("canonical_name", F.replace("canonical_name", F.lit(" Ltd"), F.lit("")))
    hits = t.raw("customer").select(F.col("c_name").alias("k"), F.col("c_custkey").alias("hit"))
    found = J.first_match(t.organisation, variants, hits, "k", "hit", "id")
    last = hits.where("k = 'Customer#000000001'").agg(F.min("hit").alias("_last"))
    return t.organisation.select("id").distinct().join(found, "id", "left").crossJoin(F.broadcast(last)).select("id", F.coalesce("hit", "_last").alias("hit")).where("hit IS NOT NULL")


@query(["j35_new_alerts", "j35_new_alerts_all"], "SELECT c.id, c.url FROM contribution c WHERE c.url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM contribution a WHERE a.stance = 'R' AND a.url = c.url)")
def _(t: Tables) -> DataFrame:
    """Contributions whose address is none of those already alerted, which a data column tells."""
    return J.not_in(t.contribution.where("url IS NOT NULL").select("id", "url"), t.contribution.where("stance = 'R'").select("url"), "url", "url")


# Aggregates


@query("a01_totals", "SELECT (SELECT count(*) FROM organisation) AS organisations, (SELECT count(*) FROM engagement) AS engagements, (SELECT count(*) FROM session) AS sessions, (SELECT count(*) FROM question) AS questions")
def _(t: Tables) -> DataFrame:
    """Counts of several tables in one job."""
    names = ["organisation", "engagement", "session", "question"]
    each = J.union_all([getattr(t, n).select(F.lit(n).alias("name")) for n in names])
    return each.agg(*(F.count_if(F.col("name") == n).alias(f"{n}s") for n in names))


@query("a02_a32_by_type", "SELECT source_type, count(*) AS n FROM engagement GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.engagement.groupBy("source_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source_type")


@query("a03_a04_organisation_summary", "SELECT o.id, o.canonical_name, coalesce(n, 0) AS engagements, latest, coalesce(types, '') AS types FROM organisation o LEFT JOIN (SELECT organisation_id, count(*) AS n, max(engagement_date) AS latest, string_agg(DISTINCT source_type, ',' ORDER BY source_type) AS types FROM engagement GROUP BY 1) e ON e.organisation_id = o.id")
def _(t: Tables) -> DataFrame:
    """Engagements, latest date and sorted types per organisation."""
    e = t.engagement.groupBy("organisation_id").agg(F.count(F.lit(1)).alias("engagements"), F.max("engagement_date").alias("latest"), F.array_join(F.sort_array(F.collect_set("source_type")), ",").alias("types"))
    return J.with_lookup(t.organisation.select("id", "canonical_name"), e, "id", "organisation_id", {"engagements": 0, "latest": None, "types": ""})


@query("a05_ranges_by_group", "SELECT CASE WHEN source_type LIKE '%committee%' THEN 'evidence' WHEN source_type = 'ministerial_meeting' THEN 'meetings' WHEN source_type LIKE 'lobbying%' THEN 'lobbying' ELSE 'other' END AS kind, min(engagement_date) AS first, max(engagement_date) AS last FROM engagement GROUP BY 1")
def _(t: Tables) -> DataFrame:
    kind = F.when(F.col("source_type").contains("committee"), "evidence").when(F.col("source_type") == "ministerial_meeting", "meetings").when(F.col("source_type").startswith("lobbying"), "lobbying").otherwise("other")
    return t.engagement.groupBy(kind.alias("kind")).agg(F.min("engagement_date").alias("first"), F.max("engagement_date").alias("last"))


@query("a07_policy_tag_counts", "SELECT session_id, count(*) AS n, avg(confidence) AS confidence FROM theme WHERE theme_type = 'policy_area' GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.theme.where("theme_type = 'policy_area'").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"))


@query("a09_duplicate_names", "SELECT canonical_name, count(*) AS n FROM organisation GROUP BY 1 HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    return t.organisation.groupBy("canonical_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("a11_extremes", "SELECT max(date) AS last, max(ingested_at) AS ingested, min(date) AS first FROM session")
def _(t: Tables) -> DataFrame:
    return t.session.agg(F.max("date").alias("last"), F.max("ingested_at").alias("ingested"), F.min("date").alias("first"))


@query("a12_t09_recent", "SELECT count(*) AS n FROM run WHERE started_at >= (SELECT max(started_at) FROM run) - INTERVAL 24 HOUR")
def _(t: Tables) -> DataFrame:
    """Rows of the last 24 hours, counted from the newest."""
    newest = t.run.agg(F.max("started_at")).scalar()
    return t.run.where(F.col("started_at") >= newest - F.expr("INTERVAL 24 HOURS")).agg(F.count(F.lit(1)).alias("n"))


@query("a13_last_per_department", "SELECT department, max(date) AS last FROM session WHERE department IS NOT NULL GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.session.where("department IS NOT NULL").groupBy("department").agg(F.max("date").alias("last"))


@query("a14_status_over_tables", "SELECT status, count(*) AS n FROM (SELECT status FROM organisation UNION ALL SELECT status FROM run UNION ALL SELECT CASE WHEN resolved THEN 'resolved' ELSE 'open' END FROM flag) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """One count over three tables."""
    return J.union_all([t.organisation.select("status"), t.run.select("status"), t.flag.select(F.when(F.col("resolved"), "resolved").otherwise("open").alias("status"))]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


BUCKET = "CASE WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 6 THEN '4-6' ELSE '7+' END"


@query("a16_a17_p35_histogram", f"SELECT {BUCKET} AS bucket, count(*) AS sessions, min(n) AS least, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share FROM (SELECT session_id, count(*) AS n FROM contribution GROUP BY 1) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Sessions by number of speeches, with shares; the total is over the buckets, a handful of rows."""
    each = t.contribution.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    buckets = each.groupBy(F.expr(BUCKET).alias("bucket")).agg(F.count(F.lit(1)).alias("sessions"), F.min("n").alias("least"))
    return buckets.select("bucket", "sessions", "least", F.round(100.0 * F.col("sessions") / buckets.agg(F.sum("sessions")).scalar(), 2).alias("share"))


@query("a18_t02_high_water_mark", "WITH m AS (SELECT department, source_type, max(engagement_date) AS d FROM engagement WHERE source_type LIKE '%committee' GROUP BY ALL) SELECT department, CAST(CASE WHEN count(*) < 2 THEN DATE '1990-01-01' ELSE min(d) - INTERVAL 14 DAY END AS DATE) AS since FROM m GROUP BY department")
def _(t: Tables) -> DataFrame:
    """From when to read again: the earlier type's newest date less 14 days; all if a type is missing."""
    newest = t.engagement.where(F.col("source_type").like("%committee")).groupBy("department", "source_type").agg(F.max("engagement_date").alias("d"))
    return newest.groupBy("department").agg(F.when(F.count(F.lit(1)) < 2, F.lit("1990-01-01").cast("date")).otherwise(F.date_sub(F.min("d"), 14)).alias("since"))


@query("a19_a20_debate_groups", "SELECT date, title, bool_or(member_id % 5 = 0) AS has_minister, count(*) AS n, CASE WHEN count(*) FILTER (relevance > 50000) >= 3 THEN 'high' WHEN count(*) FILTER (relevance > 50000) >= 1 THEN 'medium' ELSE 'low' END AS level, max(word_count) AS longest FROM contribution c JOIN session s ON s.id = c.session_id GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    """Speeches by date and title: with ministers or not, how relevant, how long."""
    rows = t.contribution.join(t.session.select(F.col("id").alias("session_id"), "date", "title"), "session_id")
    hits = F.count_if(F.col("relevance") > 50000)
    return rows.groupBy("date", "title").agg(F.bool_or(F.col("member_id") % 5 == 0).alias("has_minister"), F.count(F.lit(1)).alias("n"), F.when(hits >= 3, "high").when(hits >= 1, "medium").otherwise("low").alias("level"), F.max("word_count").alias("longest"))


@query("a21_title_groups", "SELECT title, date, count(*) AS n, min(id) AS first_id, arg_min(house, id) AS house FROM session GROUP BY title, date")
def _(t: Tables) -> DataFrame:
    """Groups with the first row's other columns."""
    return t.session.groupBy("title", "date").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.min_by("house", "id").alias("house"))


@query("a22_by_heading", "SELECT coalesce(heading, 'Other') AS heading, count(*) AS n FROM question GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.question.groupBy(F.coalesce("heading", F.lit("Other")).alias("heading")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@query("a23_by_date_and_theme", "SELECT tabled_date, CASE WHEN heading IS NULL THEN 'Uncategorized' ELSE split_part(heading, ' - ', 1) END AS theme, count(*) AS n FROM question GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return t.question.groupBy("tabled_date", F.coalesce(F.substring_index("heading", " - ", 1), F.lit("Uncategorized")).alias("theme")).agg(F.count(F.lit(1)).alias("n"))


@query("a24_session_groups", "SELECT date, house, department, id, row_number() OVER (PARTITION BY date, house, department ORDER BY id) AS position FROM session")
def _(t: Tables) -> DataFrame:
    """The sessions of each group, a row each."""
    return W.placed_in_groups(t.session.select("date", "house", "department", "id"), ["date", "house", "department"])


@query("a25_frequent_speakers", "SELECT member_id, count(*) AS n, max({'relevance': relevance, 'id': id}).id AS best FROM contribution WHERE member_id IS NOT NULL AND word_count < 200 GROUP BY 1 HAVING count(*) >= 2")
def _(t: Tables) -> DataFrame:
    """The best speech of those who spoke at least twice."""
    return t.contribution.where("member_id IS NOT NULL AND word_count < 200").groupBy("member_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("relevance", "id")).alias("_")).where("n >= 2").select("member_id", "n", F.col("_.id").alias("best"))


@query("a26_a36_outcomes", "SELECT service_name, count(*) AS runs, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'failed') AS failed, CAST(sum(ingested) AS BIGINT) AS ingested FROM run GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Counters by outcome."""
    return t.run.groupBy("service_name").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("ingested").alias("ingested"))


@query("a28_link_stats", "SELECT count(*) AS total, count(registration_number) AS resolved, count(*) FILTER (status = 'provisional') AS failed, count(*) - count(registration_number) - count(*) FILTER (status = 'provisional') AS pending FROM organisation")
def _(t: Tables) -> DataFrame:
    return t.organisation.agg(F.count(F.lit(1)).alias("total"), F.count("registration_number").alias("resolved"), F.count_if(F.col("status") == "provisional").alias("failed")).withColumn("pending", F.expr("total - resolved - failed"))


@query(["a29_a40_names_by_type", "a29_a40_all_names_by_type"], "SELECT DISTINCT type, canonical_name AS name FROM organisation")
def _(t: Tables) -> DataFrame:
    """A29, A40 over all organisations: a row per distinct name of a type, in order."""
    return t.organisation.select("type", F.col("canonical_name").alias("name")).distinct().orderBy("type", "name")


@query(["a30_session_text", "a30_session_text_4000"], "SELECT session_id, coalesce(substr(string_agg(speech_text, ' ' ORDER BY speech_order, id, speech_text) FILTER (speech_text <> ''), 1, 4000), '') AS text FROM contribution WHERE session_id IS NOT NULL GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """A30 as in the reference: a session's speeches in order, cut at 4,000 characters; only those that begin before are collected."""
    return W.joined_text(t.contribution.select("session_id", "speech_order", "id", "speech_text"), "session_id", ["speech_order", "id", "speech_text"], "speech_text", 4000)


@query("a31_sources_per_organisation", "SELECT organisation_id, count(DISTINCT source_url) AS sources FROM engagement GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.engagement.groupBy("organisation_id").agg(F.countDistinct("source_url").alias("sources"))


@query(["a34_questions_by_member", "a34_questions_ranked"], "SELECT member_id, id, uin, row_number() OVER (PARTITION BY member_id ORDER BY id) AS rank, count(*) OVER (PARTITION BY member_id) AS n FROM question WHERE member_id IS NOT NULL")
def _(t: Tables) -> DataFrame:
    """A row per question with its rank among its member's, and their number."""
    own = t.question.where("member_id IS NOT NULL").select("member_id", "id", "uin")
    ranked = W.with_total_before(own, "member_id", ["id"], F.lit(1), "_before", width=4096)
    counts = own.groupBy("member_id").agg(F.count(F.lit(1)).alias("n"))
    return ranked.join(counts, "member_id").select("member_id", "id", "uin", (F.col("_before") + 1).alias("rank"), "n")


@query("a35_distinct_values", "SELECT DISTINCT department, house FROM session WHERE department IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return t.session.where("department IS NOT NULL").select("department", "house").distinct().orderBy("department", "house")


@query("a38_labels_in_order", "SELECT title, min(id) AS first FROM session GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Distinct labels in the order in which they first stand."""
    return t.session.groupBy("title").agg(F.min("id").alias("first")).orderBy("first")


@query(["a41_regroup", "a41_regroup_all"], "SELECT DISTINCT theme, min(question_id) OVER (PARTITION BY theme) AS first, question_id FROM question_theme WHERE theme IS NOT NULL")
def _(t: Tables) -> DataFrame:
    """A41 over all questions: a row per distinct theme and question, with the theme's first question."""
    pairs = t.question_theme.select("theme", "question_id").distinct()
    return pairs.join(t.question_theme.groupBy("theme").agg(F.min("question_id").alias("first")), "theme").select("theme", "first", "question_id")


# Windows


@query("w02_best_speech", "SELECT session_id, id, relevance FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY relevance DESC, id DESC) AS n FROM contribution) WHERE n = 1")
def _(t: Tables) -> DataFrame:
    """W02, FT3: the best speech of each session."""
    return W.first_per(t.contribution.select("session_id", "relevance", "id"), ["session_id"], ["relevance", "id"], descending=True)


@query("w03_neighbours", "SELECT id, lag(id) OVER w AS previous, lead(id) OVER w AS next FROM session WINDOW w AS (PARTITION BY date, house ORDER BY id)")
def _(t: Tables) -> DataFrame:
    return W.neighbours(t.session.select("id", "date", "house"), ["date", "house"], "id").select("id", "previous", "next")


@query("w05_balanced_selection", "SELECT id, session_id, bucket FROM (SELECT *, row_number() OVER (PARTITION BY session_id, bucket ORDER BY relevance DESC, id) AS n FROM (SELECT *, CASE WHEN member_id % 5 = 0 THEN 'minister' WHEN party IN ('Lab', 'LD') THEN 'opposition' ELSE 'other' END AS bucket FROM contribution)) WHERE n <= CASE bucket WHEN 'minister' THEN 2 ELSE 1 END")
def _(t: Tables) -> DataFrame:
    """The most relevant speeches of each kind of speaker, more of ministers."""
    bucket = F.when(F.col("member_id") % 5 == 0, "minister").when(F.col("party").isin("Lab", "LD"), "opposition").otherwise("other")
    rows = t.contribution.select("id", "session_id", "relevance", bucket.alias("bucket"))
    return W.top_per(rows, ["session_id", "bucket"], [F.desc("relevance"), F.col("id")], F.when(F.col("bucket") == "minister", 2).otherwise(1)).select("id", "session_id", "bucket")


@query("w07_g08_first_seen", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY CASE WHEN url IS NULL THEN 'id ' || id WHEN url LIKE 'https://a.%' THEN url || ' ' || coalesce(member_name, '') ELSE url END ORDER BY id) AS n FROM contribution) WHERE n = 1")
def _(t: Tables) -> DataFrame:
    """The first row by URL, by URL and speaker on one host; rows without URL all stay."""
    url = F.col("url")
    key = F.when(url.isNull(), F.concat(F.lit("id "), "id")).when(url.startswith("https://a."), F.concat(url, F.lit(" "), F.coalesce("member_name", F.lit("")))).otherwise(url)
    return t.contribution.groupBy(key.alias("key")).agg(F.min("id").alias("id")).select("id")


@query("w09_o05_group_page", "WITH p AS (SELECT DISTINCT date, house FROM session ORDER BY date DESC, house LIMIT 7 OFFSET 7) SELECT date, house, id, row_number() OVER (PARTITION BY date, house ORDER BY id) AS position FROM session JOIN p USING (date, house)")
def _(t: Tables) -> DataFrame:
    """The second page of seven groups."""
    return W.page_of_groups(t.session.select("date", "house", "id"), ["date", "house"], [F.desc("date"), F.col("house")], 2)


@query("w11_br_weekly_backups", "SELECT CAST(date_trunc('week', tabled_date) AS DATE) AS week, min(uin) AS uin FROM question WHERE isodow(tabled_date) = 1 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return W.one_per_week(t.question, "tabled_date", "uin")


@query("w12_last_run", "SELECT service_name, max({'s': started_at, 'id': id}).id AS id FROM run GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.run.groupBy("service_name").agg(F.max(F.struct("started_at", "id")).alias("_")).select("service_name", F.col("_.id").alias("id"))


@query("w13_t10_latest_day", "SELECT max(date) AS day FROM session WHERE date BETWEEN DATE '1998-05-01' - 5 AND DATE '1998-05-01' - 1")
def _(t: Tables) -> DataFrame:
    return W.latest_day_with_data(t.session, "date", F.lit("1998-05-01").cast("date"))


@query("w14_first_url", "SELECT member_id, arg_min(url, id) AS url FROM contribution WHERE url IS NOT NULL AND member_id IS NOT NULL GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.contribution.where("url IS NOT NULL AND member_id IS NOT NULL").groupBy("member_id").agg(F.min_by("url", "id").alias("url"))


# Sorts and pages


@query("o01_o02_page", "SELECT id, title, date, CAST((SELECT greatest(1, ceil(count(*) / 25.0)) FROM session WHERE house = 'Lords') AS BIGINT) AS pages FROM session WHERE house = 'Lords' ORDER BY date DESC, id LIMIT 25 OFFSET 50")
def _(t: Tables) -> DataFrame:
    """The third page of 25, ties by id, and the number of pages."""
    rows = t.session.where("house = 'Lords'").select("id", "title", "date")
    pages = rows.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / 25))).scalar()
    return rows.orderBy(F.desc_nulls_last("date"), "id").offset(50).limit(25).withColumn("pages", pages)


@query("o03_top_ranked", "SELECT id, relevance FROM contribution ORDER BY relevance DESC, id LIMIT 20")
def _(t: Tables) -> DataFrame:
    return t.contribution.select("id", "relevance").orderBy(F.desc("relevance"), "id").limit(20)


@query("o04_exact_first", "WITH n AS (SELECT organisation_id, count(*) AS n FROM engagement GROUP BY 1) SELECT o.id, o.canonical_name, coalesce(n.n, 0) AS n FROM organisation o LEFT JOIN n ON n.organisation_id = o.id WHERE contains(lower(o.canonical_name), 'customer#00000001') ORDER BY lower(o.canonical_name) = 'customer#000000011' DESC, 3 DESC, 1 LIMIT 10")
def _(t: Tables) -> DataFrame:
    """Exact matches first, then by engagements."""
    hits = t.organisation.where(F.lower("canonical_name").contains("customer#00000001")).select("id", "canonical_name")
    counted = J.with_lookup(hits, t.engagement.groupBy("organisation_id").agg(F.count(F.lit(1)).alias("n")), "id", "organisation_id", {"n": 0})
    return counted.orderBy((F.lower("canonical_name") == "customer#000000011").desc(), F.desc("n"), "id").limit(10)


@query("o06_o07_group_order", "SELECT date, bool_or(debate_type = 'statement') AS has_statement, count(*) AS n FROM session GROUP BY date ORDER BY 2 DESC, 1 DESC LIMIT 30")
def _(t: Tables) -> DataFrame:
    return t.session.groupBy("date").agg(F.bool_or(F.col("debate_type") == "statement").alias("has_statement"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("has_statement"), F.desc("date")).limit(30)


@query("o10_first_sections", "SELECT session_id, min(id) AS id FROM contribution GROUP BY 1 ORDER BY 2 LIMIT 15")
def _(t: Tables) -> DataFrame:
    """The first fifteen sections."""
    return t.contribution.groupBy("session_id").agg(F.min("id").alias("id")).orderBy("id").limit(15)


@query("o11_first_candidate", "SELECT id, ext_id FROM session WHERE title = 'Education' ORDER BY date, id LIMIT 1")
def _(t: Tables) -> DataFrame:
    return t.session.where("title = 'Education'").orderBy("date", "id").select("id", "ext_id").limit(1)


@query("o12_sample", "SELECT id, title FROM session ORDER BY md5('7 ' || id), id LIMIT 20")
def _(t: Tables) -> DataFrame:
    """A seeded random sample of twenty, the same however the rows are partitioned."""
    return t.session.select("id", "title").orderBy(F.md5(F.concat(F.lit("7 "), F.col("id").cast("string"))), "id").limit(20)


@query("o15_nulls_last", "SELECT id, department FROM session ORDER BY department DESC NULLS LAST, id LIMIT 40")
def _(t: Tables) -> DataFrame:
    return t.session.select("id", "department").orderBy(F.desc_nulls_last("department"), "id").limit(40)


@query("o16_busy_day", "SELECT date, count(*) AS n FROM session GROUP BY 1 HAVING count(*) > 5 ORDER BY date DESC LIMIT 1")
def _(t: Tables) -> DataFrame:
    return t.session.groupBy("date").agg(F.count(F.lit(1)).alias("n")).where("n > 5").orderBy(F.desc("date")).limit(1)


# Sets


@query("u01_u02_id_sets", "WITH e AS (SELECT id FROM organisation WHERE lower(canonical_name) = 'customer#000000001' UNION SELECT organisation_id FROM alias WHERE lower(alias_name) = 'the supplier#000000007') SELECT id, TRUE AS exact FROM e UNION ALL SELECT id, FALSE FROM (SELECT id FROM organisation WHERE contains(lower(canonical_name), '00001') EXCEPT SELECT id FROM e)")
def _(t: Tables) -> DataFrame:
    """Exact hits of name or alias, then partial hits that are not exact."""
    exact = t.organisation.where(F.lower("canonical_name") == "customer#000000001").select("id").union(t.alias.where(F.lower("alias_name") == "the supplier#000000007").select("organisation_id")).distinct()
    partial = t.organisation.where(F.lower("canonical_name").contains("00001")).select("id").subtract(exact)
    return exact.withColumn("exact", F.lit(True)).union(partial.withColumn("exact", F.lit(False)))


@query("u03_priority_union", "SELECT id, min(p) AS priority FROM (SELECT id, 1 AS p FROM session WHERE contains(title, 'Education') UNION ALL SELECT session_id, 2 FROM theme WHERE theme = 'theme 7' UNION ALL SELECT session_id, 3 FROM contribution WHERE contains(speech_text, 'loans')) GROUP BY id")
def _(t: Tables) -> DataFrame:
    """Matches of title, theme and text; the best counts."""
    parts = [t.session.where(F.col("title").contains("Education")).select("id", F.lit(1).alias("p")), t.theme.where("theme = 'theme 7'").select(F.col("session_id").alias("id"), F.lit(2).alias("p")), t.contribution.where(F.col("speech_text").contains("loans")).select(F.col("session_id").alias("id"), F.lit(3).alias("p"))]
    return J.union_all(parts).groupBy("id").agg(F.min("p").alias("priority"))


@query("u06_vocabulary_diff", "SELECT 'added' AS side, x.v AS value FROM (SELECT unnest(['ministerial_meeting', 'new_type']) AS v) x WHERE x.v NOT IN (SELECT source_type FROM engagement) UNION ALL SELECT DISTINCT 'removed', source_type FROM engagement WHERE source_type NOT IN ('ministerial_meeting', 'new_type')")
def _(t: Tables) -> DataFrame:
    """Values on one side alone."""
    wanted, there = t.spark.createDataFrame([("ministerial_meeting",), ("new_type",)], "value string"), t.engagement.select(F.col("source_type").alias("value")).distinct()
    return wanted.subtract(there).select(F.lit("added").alias("side"), "value").union(there.subtract(wanted).select(F.lit("removed").alias("side"), "value"))


@query("u07_k13_sitemap", "SELECT 'https://x.example.org/about' AS loc, CAST(NULL AS DATE) AS lastmod UNION ALL SELECT DISTINCT 'https://x.example.org/date/' || strftime(date, '%Y-%m-%d'), date FROM session UNION ALL SELECT 'https://x.example.org/theme/' || replace(theme, ' ', '-'), max(date) FROM theme t JOIN session s ON s.id = t.session_id GROUP BY theme UNION ALL SELECT 'https://x.example.org/session/' || id, date FROM session WHERE NOT is_container UNION ALL SELECT 'https://x.example.org/member/' || member_id, max(date) FROM contribution c JOIN session s ON s.id = c.session_id WHERE member_id IS NOT NULL GROUP BY member_id UNION ALL SELECT 'https://x.example.org/department/' || replace(lower(department), ' ', '-'), max(date) FROM session WHERE department IS NOT NULL GROUP BY department")
def _(t: Tables) -> DataFrame:
    """All pages of a site with the date of their last change."""
    s, at = t.session, "https://x.example.org/"
    dated = s.select(F.col("id").alias("session_id"), "date")
    url = lambda kind, c: F.concat(F.lit(f"{at}{kind}/"), c).alias("loc")
    return J.union_all([
        t.spark.range(1).select(F.lit(f"{at}about").alias("loc"), F.lit(None).cast("date").alias("lastmod")),
        s.select("date").distinct().select(url("date", F.date_format("date", "yyyy-MM-dd")), F.col("date").alias("lastmod")),
        t.theme.join(dated, "session_id").groupBy("theme").agg(F.max("date").alias("lastmod")).select(url("theme", T.label_slug(F.col("theme"))), "lastmod"),
        s.where(~F.col("is_container")).select(url("session", F.col("id")), F.col("date").alias("lastmod")),
        t.contribution.where("member_id IS NOT NULL").join(dated, "session_id").groupBy("member_id").agg(F.max("date").alias("lastmod")).select(url("member", F.col("member_id")), "lastmod"),
        s.where("department IS NOT NULL").groupBy("department").agg(F.max("date").alias("lastmod")).select(url("department", T.label_slug(F.col("department"))), "lastmod"),
    ])


@query("u08_promoted", "SELECT id FROM (SELECT id FROM contribution ORDER BY relevance DESC, id LIMIT 50) EXCEPT SELECT id FROM (SELECT id FROM contribution ORDER BY word_count DESC, id LIMIT 50)")
def _(t: Tables) -> DataFrame:
    """In the top after, not before."""
    top = lambda c: t.contribution.orderBy(F.desc(c), "id").select("id").limit(50)
    return top("relevance").subtract(top("word_count"))


@query("u09_multi_subject", "SELECT uin, min(id) AS id FROM question WHERE contains(lower(question_text), 'flood') OR contains(lower(question_text), 'school') GROUP BY uin")
def _(t: Tables) -> DataFrame:
    """Questions on either subject, once per number."""
    text = F.lower("question_text")
    return t.question.where(text.contains("flood") | text.contains("school")).groupBy("uin").agg(F.min("id").alias("id"))
