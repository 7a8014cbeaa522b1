"""Search, resolution, graphs, vectors, pipelines, audits, incremental and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stemming import sql_stemmed
from ..operators import audit, graph, pipelines, resolve, search, vectors
from ..sources import sinks
from ..storage import kept, new_path
from ..streaming import incremental as I
from ..streaming import pages, state
from .domain import Tables
from .registry import query

BREAK = search.WORD_BREAK
STOPS = ", ".join(map(repr, search.STOP_WORDS))


def sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '{BREAK}'), lambda w: w <> '' AND w NOT IN ({STOPS}))"


def sql_index(docs: str, query: str) -> str:
    """CTEs: the docs' words (key, owner, field, place, word), their stems, and the query's."""
    words = ", ".join(map(repr, search.query_words(query)))
    return f"""doc AS ({docs}), tok AS MATERIALIZED (SELECT key, owner, field, unnest(ws) AS word, unnest(range(len(ws))) AS place FROM (SELECT key, owner, field, {sql_words("text")} AS ws FROM doc)),
    voc AS MATERIALIZED ({sql_stemmed("(SELECT DISTINCT word FROM tok)", "word")}), q AS MATERIALIZED ({sql_stemmed(f"(SELECT unnest([{words}]) AS word, unnest(range({len(search.query_words(query))})) AS i)", "word")}),
    hit AS (SELECT key, owner, field, count(DISTINCT stem) AS s, count(*) AS n FROM tok JOIN voc USING (word) WHERE stem IN (SELECT stem FROM q) GROUP BY ALL),
    rank AS (SELECT key, owner, field, n / (1.0 + ln(1 + words)) AS r FROM hit JOIN (SELECT key, owner, field, count(*) AS words FROM tok GROUP BY ALL) USING (key, owner, field) WHERE s = (SELECT count(DISTINCT stem) FROM q))"""


BOTH = """SELECT id, round(3.0 * coalesce(t, 0) + coalesce(b, 0), 6) AS rank, speech_id FROM
    (SELECT owner AS id, max(CASE WHEN field = 't' THEN r END) AS t, max(CASE WHEN field = 'b' THEN r END) AS b, max_by(key, CASE WHEN field = 'b' THEN {'r': r, 'k': key} END) AS speech_id FROM rank GROUP BY 1)"""
SPEECHES = "SELECT id AS key, id AS owner, 't' AS field, split_part(text, chr(10), 1) AS text FROM speech UNION ALL SELECT id, id, 'b', text FROM speech"
BODIES = "SELECT id AS key, id AS owner, 'b' AS field, text FROM speech"


def documents_index(t: Tables, field: str) -> search.Index:
    """The documents as sections titled by their first line: the index of the titles or of the texts."""
    text = F.substring_index("text", "\n", 1) if field == "titles" else F.col("text")
    return search.stored(t.speech.select(F.col("id").alias("key"), F.col("id").alias("owner"), text.alias("text")), f"documents-{field}")


@query("ft_search", f"WITH {sql_index(SPEECHES, 'tion and')} SELECT * FROM ({BOTH}) ORDER BY rank DESC, id LIMIT 100")
def _(t: Tables) -> DataFrame:
    """FT1-FT7: all terms, best speech per section, titles three times, the first hundred by bounds of blocks."""
    return search.top("tion and", 100, documents_index(t, "titles"), documents_index(t, "texts"))


@query("ft_count", f"WITH {sql_index(SPEECHES, 'tion')} SELECT count(DISTINCT owner) AS n FROM rank")
def _(t: Tables) -> DataFrame:
    """FT7: how many sections match."""
    return search.count("tion", documents_index(t, "titles"), documents_index(t, "texts"))


FILTERS = "NOT is_container AND house = 'Commons' AND contains(lower(department), 'education') AND date BETWEEN DATE '1994-01-01' AND DATE '1999-06-30' AND id IN (SELECT session_id FROM theme WHERE theme = 'theme 3' AND theme_type = 'policy_area')"
WANTED = ["the reforming of school", "schools bills", "flooded and repayment", '"reforms of the schools"', "schools reform"]
SECTIONS = "SELECT id AS key, id AS owner, 't' AS field, title AS text FROM session UNION ALL SELECT id, session_id, 'b', speech_text FROM contribution"


def sql_phrase(query: str) -> str:
    """Of rank, the rows whose text has the query's stems one after the other."""
    if not search.query_mode(query)[0]:
        return ""
    return """, ordered AS (SELECT key, owner, field, ' ' || string_agg(stem, ' ' ORDER BY place) || ' ' AS stems FROM tok JOIN voc USING (word) GROUP BY ALL),
    phrase AS (SELECT r.* FROM rank r JOIN ordered USING (key, owner, field) WHERE contains(stems, (SELECT ' ' || string_agg(stem, ' ' ORDER BY i) || ' ' FROM q)))"""


def sql_filtered(wanted: str) -> str:
    found = BOTH.replace("FROM rank", "FROM phrase") if search.query_mode(wanted)[0] else BOTH
    return f"SELECT '{wanted}' AS query, * FROM (WITH {sql_index(SECTIONS, wanted)}{sql_phrase(wanted)} {found}) WHERE id IN (SELECT id FROM session WHERE {FILTERS})"


@query("ft_filtered", " UNION ALL ".join(map(sql_filtered, WANTED)))
def _(t: Tables) -> DataFrame:
    """FT1, FT3, FT4, FT6: the best of a section's speeches, several terms in other forms than the texts', a phrase, no containers, and the filters: house, department, dates and policy area."""
    titles = search.stored(t.session.select(F.col("id").alias("key"), F.col("id").alias("owner"), F.col("title").alias("text")), "sections-titles")
    speeches = search.stored(t.contribution.select(F.col("id").alias("key"), F.col("session_id").alias("owner"), F.col("speech_text").alias("text")), "sections-speeches")
    policy = t.theme.where("theme = 'theme 3' AND theme_type = 'policy_area'")
    wanted = kept(search.allowed(t.session, house="Commons", department="education", since="1994-01-01", until="1999-06-30", policy=policy).select("id"), "allowed")
    found = None
    for text in WANTED:
        own = search.search(text, titles, speeches, wanted).select(F.lit(text).alias("query"), "id", "rank", "speech_id")
        found = own if found is None else found.unionByName(own)
    return found


@query("ft_phrase", f"WITH {sql_index(BODIES, chr(34) + 'une le' + chr(34))}{sql_phrase(chr(34) + 'une le' + chr(34))} SELECT owner AS id FROM phrase")
def _(t: Tables) -> DataFrame:
    """FT1: a phrase in quotes."""
    return search.search('"une le"', documents_index(t, "texts"), None).select("id")


@query(
    "ft_headlines",
    f"""WITH {sql_index(BODIES, "tion")}, wanted AS (SELECT list(DISTINCT word) AS ws FROM voc WHERE stem IN (SELECT stem FROM q)),
    parts AS (SELECT id, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '') AS p FROM speech WHERE id IN (SELECT owner FROM rank)),
    flags AS (SELECT id, p, list_transform(p, lambda w: list_has_any(regexp_split_to_array(lower(w), '{BREAK}'), ws)) AS h FROM parts, wanted),
    cut AS (SELECT id, p, h, greatest(list_position(h, true) - 10, 1) AS b FROM flags)
    SELECT id, array_to_string(list_transform(range(b, least(b + 35, len(p) + 1)), lambda i: CASE WHEN h[i] THEN '<mark>' || p[i] || '</mark>' ELSE p[i] END), ' ') AS headline FROM cut""",
)
def _(t: Tables) -> DataFrame:
    """FT8: fragments around the first hit, of all that match."""
    texts = documents_index(t, "texts")
    found = search.search("tion", texts, None).select("id")
    return t.speech.join(found, "id", "left_semi").select("id", search.headline(F.col("text"), search.inflections(texts, "tion")).alias("headline"))


@query("ft_postings", f"WITH {sql_index(BODIES, 'tion')} SELECT stem, count(DISTINCT key) AS docs, count(*) AS n FROM tok JOIN voc USING (word) GROUP BY stem")
def _(t: Tables) -> DataFrame:
    """FT2: the index of all documents, summed by stem."""
    lists = t.spark.read.parquet(f"{documents_index(t, 'texts').path}/postings")
    # A text is in one block, so texts are told apart within it: two words of a stem may have the same one.
    n = F.aggregate("docs", F.lit(0).cast("long"), lambda total, d: total + d["n"])
    each = lists.select("stem", "block", F.col("docs.key").alias("keys"), n.alias("n")).groupBy("stem", "block").agg(F.size(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("docs"), F.sum("n").alias("n"))
    return each.groupBy("stem").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def names(t: Tables) -> DataFrame:
    """Organisation names made of the documents' first words, and whether the document's source counts as a register of known ones."""
    words = F.slice(F.filter(F.split(F.substring_index("text", "\n", 1), " "), lambda w: F.length(w) > 3), 1, 3)
    return t.speech.select("id", "source", T.organisation_key(F.array_join(words, " ")).alias("key"))


def registered(t: Tables) -> DataFrame:
    return names(t).where("source RLIKE '[02468]$' AND key <> ''").select("id", "key")


@query("er_resolve")
def _(t: Tables) -> DataFrame:
    """ER0-ER9, T06, M09: names of the documents of some sources held against those of the others; rows that have no name fail alone."""
    aliases = t.alias.select("organisation_id", T.organisation_key(F.col("alias_name")).alias("key"))
    staging = names(t).where("source NOT RLIKE '[02468]$'").select("id", "key", F.lit("pending").alias("status"))
    return resolve.process(staging, registered(t), aliases)


@query("er_status_counts", f"SELECT CASE WHEN key IS NULL OR key = '' THEN 'errored' ELSE 'committed' END AS status, count(*) AS n FROM (SELECT array_to_string(list_filter(string_split(split_part(text, chr(10), 1), ' '), lambda w: length(w) > 3)[1:3], ' ') AS key, source FROM speech) WHERE NOT regexp_matches(source, '[02468]$') GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """How many rows would take each status, without writing them."""
    staging = names(t).where("source NOT RLIKE '[02468]$'").select("id", "key", F.lit("pending").alias("status"))
    return resolve.dry_run(staging)


@query("o13_did_you_mean")
def _(t: Tables) -> DataFrame:
    """The three most similar of all organisations' names, at 45 of 100 or more, for a stated set of names that none has."""
    wanted = t.spark.createDataFrame([("custmer#000000042 trust",), ("customers 7",), ("zzz",), ("customer#00000001 plc",)], "name string")
    return resolve.closest(wanted, t.organisation.select("id", F.lower("canonical_name").alias("name")))


@query(["er_exact_tier", "er_exact_tier_all"], "WITH o AS (SELECT lower(canonical_name) AS key, max(id) AS id FROM organisation GROUP BY 1), a AS (SELECT lower(alias_name) AS key, max(organisation_id) AS id FROM alias GROUP BY 1) SELECT s.id, coalesce(o.id, a.id) AS match FROM (SELECT id, lower(canonical_name) AS key FROM organisation) s LEFT JOIN o USING (key) LEFT JOIN a USING (key)")
def _(t: Tables) -> DataFrame:
    """ER1 over all organisations."""
    from ..operators.joins import first_of_lookups

    key = F.lower("canonical_name").alias("key")
    return first_of_lookups(t.organisation.select("id", key), [(t.organisation.select(key, "id"), "key", "id"), (t.alias.select(F.lower("alias_name").alias("key"), F.col("organisation_id").alias("id")), "key", "id")], "key", "match").select("id", "match")


@query("er4_corroborated", "WITH o AS (SELECT id, lower(regexp_extract(url, '^[A-Za-z]+://([^/]+)', 1)) AS host, registration_number AS r FROM organisation), p AS (SELECT min(id) OVER (PARTITION BY host) AS a, id AS b FROM o WHERE host IS NOT NULL UNION SELECT min(id) OVER (PARTITION BY r), id FROM o WHERE r IS NOT NULL) SELECT a, b FROM p WHERE a <> b")
def _(t: Tables) -> DataFrame:
    return resolve.corroborated(t.organisation.select("id", F.lower(F.try_parse_url("url", F.lit("AUTHORITY"))).alias("host"), "registration_number"))


@query("er7_commit", "SELECT e.organisation_id, min(e.engagement_date) AS first, count(*) AS engagements, lower(o.canonical_name) <> lower(max(e.source_url)) AS needs_alias FROM engagement e JOIN organisation o ON o.id = e.organisation_id GROUP BY e.organisation_id, o.canonical_name")
def _(t: Tables) -> DataFrame:
    """ER7: what committing gives each organisation."""
    e = t.engagement.groupBy("organisation_id").agg(F.min("engagement_date").alias("first"), F.count(F.lit(1)).alias("engagements"), F.max("source_url").alias("_s"))
    return e.join(t.organisation.select(F.col("id").alias("organisation_id"), "canonical_name"), "organisation_id").select("organisation_id", "first", "engagements", (F.lower("canonical_name") != F.lower("_s")).alias("needs_alias"))


GRAPH = "SELECT id AS a, id + 3 AS b FROM session UNION ALL SELECT id, id - 3 FROM session UNION ALL SELECT parent_id, id FROM session WHERE parent_id IS NOT NULL"


@query("gw_graph_walk", f"WITH RECURSIVE e AS ({GRAPH}), w AS (SELECT id AS node FROM session WHERE id % 1000 = 0 UNION SELECT e.b FROM w JOIN session s ON s.id = w.node AND year(s.date) IN (1996, 1998, 1999) JOIN e ON e.a = w.node) SELECT node FROM w")
def _(t: Tables) -> DataFrame:
    """GW: from seeds over next, previous and child links; only nodes of the wanted years lead on."""
    s = t.session
    edges = s.select(F.col("id").alias("a"), F.explode(F.array(F.col("id") + 3, F.col("id") - 3)).alias("b")).union(s.where("parent_id IS NOT NULL").select("parent_id", "id"))
    open_nodes = s.where(F.year("date").isin(1996, 1998, 1999)).select(F.col("id").alias("node"))
    return graph.walk(s.where("id % 1000 = 0").select(F.col("id").alias("node")), edges, open_nodes).select("node")


@query("f32_j20_alert_matches", "SELECT a.vec_id AS topic, b.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS similarity FROM embeddings a JOIN embeddings b ON list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.62 WHERE a.vec_id % 50 = 0")
def _(t: Tables) -> DataFrame:
    """F32, J20, AL: every fiftieth vector as a topic, against all."""
    e = t.raw("embeddings")
    found = vectors.matches(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("topic"), F.col("embedding").alias("vector")))
    return found.select("topic", "id", F.round("similarity", 4).alias("similarity"))


@query(
    "tc_topic_sections",
    """WITH c AS (SELECT c.*, s.date, s.title, lower(s.house) AS source FROM contribution c JOIN session s ON s.id = c.session_id WHERE s.date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'),
    d AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN url IS NULL THEN 'id ' || id ELSE concat_ws(' ', url, member_name) END ORDER BY id, member_name NULLS FIRST, date, title, source, word_count, relevance) AS n FROM c)
    SELECT date, title, source, count(*) AS speeches, coalesce(bool_or(lower(trim(member_name)) IN (SELECT 'member ' || id FROM member WHERE id % 5 = 0)), FALSE) AS has_minister, max(word_count) AS longest FROM d WHERE n = 1 GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    """TC, S14-S19, U05."""
    speeches = t.contribution.join(t.session.select(F.col("id").alias("session_id"), "date", "title", F.lower("house").alias("source")), "session_id").select("id", "url", F.col("member_name").alias("speaker"), "date", "title", "source", F.col("word_count").alias("words"), "relevance")
    ministers = t.member.where("id % 5 = 0").select(F.concat(F.lit("member "), "id").alias("key"), F.col("house").alias("role"))
    found = pipelines.topic_sections(speeches, ministers, "1996-01-01", "1999-12-31")
    return found.select("date", "title", "source", "speeches", F.when(F.col("has_minister"), True).otherwise(False).alias("has_minister"), "longest")


@query("ds_department_scan", "WITH g AS (SELECT CASE WHEN title LIKE '% - Second Reading' THEN split_part(title, ' - ', 1) ELSE title END AS title, date, count(*) AS n, min(id) AS id FROM session GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY date DESC, id) AS k FROM g), h AS (SELECT title, min(department) AS theme FROM session WHERE house = 'Lords' GROUP BY 1) SELECT CASE WHEN k > 120 THEN 'Older' ELSE coalesce(h.theme, 'General / Uncategorized') END AS theme, count(*) AS groups, CAST(sum(n) AS BIGINT) AS contributions FROM r LEFT JOIN h ON h.title = r.title GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """DS, S43."""
    themes = t.session.where("house = 'Lords'").select("title", F.col("department").alias("theme"))
    return pipelines.department_scan(t.session.select("title", "date", "id"), None, themes)


@query("ss_stakeholder_timeline", "WITH e AS (SELECT engagement_date AS date, source_type AS title, source_url AS url, 'engagement' AS source FROM engagement UNION ALL SELECT tabled_date, heading, uin, 'question' FROM question UNION ALL SELECT date, title, ext_id, 'session' FROM session) SELECT source, date, title, url FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY date DESC, url, title NULLS FIRST) AS n FROM e WHERE date BETWEEN DATE '1997-01-01' AND DATE '2000-12-31') WHERE n <= 8")
def _(t: Tables) -> DataFrame:
    """SS, S27-S30."""
    parts = {"engagement": t.engagement.select(F.col("engagement_date").alias("date"), F.col("source_type").alias("title"), F.col("source_url").alias("url")), "question": t.question.select(F.col("tabled_date").alias("date"), F.col("heading").alias("title"), F.col("uin").alias("url")), "session": t.session.select("date", "title", F.col("ext_id").alias("url"))}
    return pipelines.stakeholder_timeline(parts, "1997-01-01", "2000-12-31").select("source", "date", "title", "url")


@query(
    "mb_dp_member_brief",
    """WITH s AS (SELECT member_id, count(*) AS n, max(CAST(spoken_at AS DATE)) AS d FROM contribution WHERE member_id IS NOT NULL GROUP BY 1), p AS (SELECT member_id, heading, count(*) AS n FROM question WHERE member_id IS NOT NULL AND tabled_date >= DATE '1998-06-30' - 180 GROUP BY ALL),
    q AS (SELECT member_id, CAST(sum(n) AS BIGINT) AS n, arg_max(heading, {'n': n, 'h': coalesce(heading, '')}) AS h FROM p GROUP BY 1) SELECT m.id AS member_id, coalesce(s.n, 0) AS speeches, s.d AS last_speech, coalesce(q.n, 0) AS questions FROM member m LEFT JOIN s ON s.member_id = m.id LEFT JOIN q ON q.member_id = m.id""",
)
def _(t: Tables) -> DataFrame:
    """MB, DP, S22-S25, S44."""
    found = pipelines.member_brief(t.member, t.contribution.select("member_id", F.col("spoken_at").cast("date").alias("date")), t.question, F.lit("1998-06-30").cast("date"))
    return found.select("member_id", "speeches", "last_speech", "questions")


@query("br_retention", "WITH k AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'weekly' ELSE 'daily' END AS kind, tabled_date AS d, date_diff('day', tabled_date, DATE '1998-01-31') AS age FROM question WHERE tabled_date BETWEEN DATE '1997-10-01' AND DATE '1998-01-31') SELECT id, CASE WHEN kind = 'weekly' AND age <= 84 THEN 'keep' WHEN kind = 'weekly' THEN 'delete' WHEN age <= 30 THEN 'keep' WHEN isodow(d) = 1 THEN 'promote' ELSE 'delete' END AS action FROM k")
def _(t: Tables) -> DataFrame:
    today = F.lit("1998-01-31").cast("date")
    keys = t.question.where("tabled_date BETWEEN DATE '1997-10-01' AND DATE '1998-01-31'").select("id", F.when(F.col("id") % 4 == 0, "weekly").otherwise("daily").alias("kind"), F.col("tabled_date").alias("d"))
    return audit.retention(keys, "d", today).select("id", "action")


@query("m01_m07_audit", 'SELECT * FROM (SELECT \'dangling flags\' AS "check", (SELECT count(*) FROM flag WHERE organisation_id % 400 NOT IN (SELECT id FROM organisation WHERE id > 20)) AS issues UNION ALL SELECT \'unknown status\', (SELECT count(*) FROM organisation WHERE status NOT IN (\'active\')) UNION ALL SELECT \'negative dates\', 0 UNION ALL SELECT \'duplicate names\', (SELECT count(*) FROM (SELECT canonical_name FROM organisation GROUP BY 1 HAVING count(*) > 1)))')
def _(t: Tables) -> DataFrame:
    orgs = t.organisation
    flags = t.flag.select((F.col("organisation_id") % 400).alias("k"))
    return audit.report({
        "dangling flags": flags.join(orgs.where("id > 20").select(F.col("id").alias("k")), "k", "left_anti"), "unknown status": audit.violations(orgs, "status", ["active"]), "negative dates": t.session.where("date < DATE '1900-01-01'"),
        "duplicate names": orgs.groupBy("canonical_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
    })


@query("m08_reclassified", "WITH c AS (SELECT debate_type AS old, CASE WHEN house = 'Lords' THEN 'debate' ELSE debate_type END AS new FROM session) SELECT old, new, count(*) AS n FROM c WHERE old IS DISTINCT FROM new GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    """M05, M08."""
    return audit.reclassified(t.session.select(F.col("debate_type").alias("old"), F.when(F.col("house") == "Lords", "debate").otherwise(F.col("debate_type")).alias("new")), "old", "new")


@query("m06_t07_pruned", "SELECT id FROM run WHERE started_at >= TIMESTAMP '2024-04-20 00:00:00' - INTERVAL 90 DAY")
def _(t: Tables) -> DataFrame:
    return I.pruned(t.run, "started_at", F.lit("2024-04-20 00:00:00").cast("timestamp_ntz")).select("id")


@query("m12_m13_caps", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 60")
def _(t: Tables) -> DataFrame:
    return audit.over_cap(t.raw("events"), "user_id", 60)


# Streams: an extension beside the batch patterns T01-T10.


def event_stream(t: Tables) -> DataFrame:
    return I.stream(t.spark, f"{t.sf_dir}/events.parquet", "ts")


def plain(df: DataFrame, *times: str) -> DataFrame:
    """Times without a zone again, as in the tables."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


@query("t09_tumbling_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    """Counts and sums per day and type, as a stream."""
    return plain(I.finished(I.windowed(event_stream(t), "ts", [F.col("event_type")], "1 day").select(F.col("window.start").alias("start"), "event_type", "n", "value"), "tumbling", "complete"), "start")


@query("x02_sliding_windows", "SELECT s AS start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """An extension: two-day windows that begin each day."""
    return plain(I.finished(I.windowed(event_stream(t), "ts", [], "2 days", "1 day").select(F.col("window.start").alias("start"), "n"), "sliding", "complete"), "start")


@query("x03_session_windows", "WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def _(t: Tables) -> DataFrame:
    """An extension: runs of a user's events with gaps under six hours."""
    return plain(I.finished(I.sessions(event_stream(t), "ts", "user_id", "6 hours").select("user_id", F.col("session_window.start").alias("start"), "n"), "sessions", "complete"), "start")


@query("t02_stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def _(t: Tables) -> DataFrame:
    """Each user's first event of a type, with keys remembered for 40 days."""
    return I.finished(I.deduplicated(event_stream(t), "ts", ["user_id", "event_type"], "40 days").select("user_id", "event_type"), "dedup", "append")


@query("t04_late_updates", "SELECT user_id, event_type, max(ts) AS ts, arg_max(value, {'t': ts, 'e': event_id}) AS value FROM events GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    """A target kept at the latest row per key."""
    keys = ["user_id", "event_type"]
    rows = event_stream(t).select(*keys, "ts", "event_id", "value", I.bucket(keys).alias("bucket"))
    return I.upserts(rows, new_path(t.spark, "latest"), keys, ["ts", "event_id"], "latest-run", part="bucket").select(*keys, F.col("ts").cast("timestamp_ntz").alias("ts"), "value")


@query("t04_latest_state", "SELECT user_id, event_type, max(ts) AS ts, arg_max(value, {'t': ts, 'e': event_id}) AS value FROM events GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    """The same by keyed state, which holds the latest row of a key."""
    rows = event_stream(t).select("user_id", "event_type", "ts", "event_id", "value")
    return plain(state.latest(rows, ["user_id", "event_type"], ["ts", "event_id"], "latest-state"), "ts").select("user_id", "event_type", "ts", "value")


@query(
    "t06_staged_states",
    """WITH e AS (SELECT event_id // 10 AS id, list({'at': ts, 'to': CASE event_type WHEN 'purchase' THEN 'committed' WHEN 'error' THEN 'errored' WHEN 'signup' THEN 'rejected' ELSE 'pending' END, 's': NULL::VARCHAR, 'since': NULL::TIMESTAMP, 'n': 0::BIGINT} ORDER BY ts, event_id) AS l
        FROM events GROUP BY 1),
    f AS (SELECT id, list_reduce(list_prepend({'at': NULL::TIMESTAMP, 'to': NULL::VARCHAR, 's': NULL::VARCHAR, 'since': NULL::TIMESTAMP, 'n': 0::BIGINT}, l), lambda a, x:
        CASE WHEN (a.s IS NULL OR a.s = 'errored') AND x.to = 'pending' OR a.s = 'pending' AND x.to <> 'pending' THEN {'at': x.at, 'to': x.to, 's': x.to, 'since': x.at, 'n': a.n} ELSE {'at': x.at, 'to': x.to, 's': a.s, 'since': a.since, 'n': a.n + 1} END) AS r FROM e)
    SELECT id, r.s AS status, r.since AS since, r.n AS refused FROM f""",
)
def _(t: Tables) -> DataFrame:
    """Ten events each move a staged row between pending, committed, rejected and errored; what is not legal is refused and counted. None is pending for long enough to expire."""
    to = F.when(F.col("event_type") == "purchase", "committed").when(F.col("event_type") == "error", "errored").when(F.col("event_type") == "signup", "rejected").otherwise("pending")
    rows = event_stream(t).select(F.expr("event_id div 10").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("id"), to.alias("to"))
    found = state.staged_once(rows, "key", 3650)
    return plain(found, "since").select(F.col("key").alias("id"), "status", "since", "refused")


@query("t01_page_stream", "SELECT uin, max({'u': updated_at, 'i': id}).i AS id, max({'u': updated_at, 'i': id, 'h': heading}).h AS heading, max(updated_at) AS updated_at FROM question GROUP BY uin")
def _(t: Tables) -> DataFrame:
    """Questions landed as pages, a folder a year, and read by two runs of a stream, of which the second has only what came in between."""
    folder, target, run = (new_path(t.spark, x) for x in ("landed", "questions", "pages-run"))
    rows = t.question.select("uin", "id", "heading", "updated_at", F.trunc("tabled_date", "year").alias("day"))
    schema = "uin string, id long, heading string, updated_at timestamp_ntz, day date"
    for part in ("is_odd", "NOT is_odd"):
        own = rows.withColumn("is_odd", F.col("id") % 2 == 1).where(part).drop("is_odd")
        pages.land(own, "day", 500, folder)
        pages.ingest(t.spark, folder, target, run, schema, ["uin"], ["updated_at", "id"], 36_500)
    return sinks.current(t.spark, target).select("uin", "id", "heading", "updated_at")
