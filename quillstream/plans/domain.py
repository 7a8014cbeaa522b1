"""The domain's tables as projections of the driver's tables: sessions, contributions, themes, questions, organisations, engagements.

Each is a list of (column, expression) that Spark and DuckDB both read, so a query and its SQL start from the same rows.
Spark prunes the columns that a query doesn't use down to the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TITLES = [
    "Oral Answers to Questions", "Business of the House", "Draft Widgets (Amendment) Order", "Widgets Bill [Lords]", "Education", "Health: Urgent Question", "Statement on Floods",
    "Draft  Fisheries Regulations 2024", "Fisheries Regulations 2024", "Prime Minister: Engagements and Questions", "Children's Wellbeing and Schools Bill - Second Reading", "Royal Assent & Other: Matters/Notes",
    "Written Ministerial Statements - Department for Education: Skills",
]
TAGS = ["hs_8Question", "hs_2cStatement", "hs_2cBillTitle", "hs_3MainHdg", "hs_2cUrgentQuestion", "hs_8Petition", "hs_unknown"]


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cases(key: str, values: list[str]) -> str:
    """One of the values by key modulo their number; NULL is written as such."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v if v == 'NULL' else quoted(v)}" for i, v in enumerate(values)) + " END"


VIEWS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "session": ("orders", [
        ("id", "o_orderkey"), ("ext_id", "'S-' || CAST(o_orderkey AS STRING) || '-AbCd'"), ("title", cases("o_orderkey", TITLES)), ("date", "CAST(o_orderdate AS DATE)"),
        ("house", "CASE WHEN o_custkey % 3 = 0 THEN 'Lords' ELSE 'Commons' END"), ("debate_type", cases("o_custkey", ["oral_questions", "debate", "other", "statement", "NULL"])),
        ("location", cases("o_orderkey", ["Chamber", "Westminster Hall", "Grand Committee", "General Committee", "NULL"])), ("hrs_tag", cases("o_custkey", [*TAGS, "NULL"])), ("is_container", "o_orderstatus = 'P'"),
        ("department", cases("o_custkey", ["Department for Education", "HM Treasury", "Home Office", "NULL"])), ("parent_id", "CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey - o_orderkey % 10 END"), ("ingested_at", "o_orderdate"),
    ]),
    "contribution": ("lineitem", [
        ("id", "l_orderkey * 10000000 + l_partkey * 10 + l_linenumber"), ("session_id", "l_orderkey"), ("member_id", "CASE WHEN l_suppkey % 11 <> 0 THEN l_suppkey END"), ("member_name", "CASE WHEN l_suppkey % 11 <> 0 THEN 'Member ' || CAST(l_suppkey AS STRING) END"),
        ("party", cases("l_suppkey", ["Con", "Lab", "LD", "SNP", "NULL"])), ("speech_order", "l_linenumber"), ("word_count", "CAST(l_quantity * 20 AS INT)"), ("relevance", "l_extendedprice"),
        ("speech_text", "CASE WHEN l_linenumber = 1 AND l_suppkey % 4 = 0 THEN '  To ask His Majesty''s Government about ' ELSE 'Speech about ' END || " + cases("l_partkey", ["skills", "flooding and repayments", "the reform of schools", "student loans"])),
        ("url", "CASE WHEN l_partkey % 9 <> 0 THEN 'https://' || CASE WHEN l_partkey % 2 = 0 THEN 'a.example.org' ELSE 'b.example.org' END || '/debates/?id=' || CAST(l_orderkey AS STRING) || '.' || CAST(l_partkey % 3 AS STRING) END"),
        ("spoken_at", "l_shipdate"), ("stance", "l_returnflag"),
    ]),
    "theme": ("lineitem", [("session_id", "l_orderkey"), ("theme", "'theme ' || CAST(l_partkey % 40 AS STRING)"), ("theme_type", "CASE WHEN l_linenumber % 2 = 0 THEN 'policy_area' ELSE 'specific' END"), ("confidence", "l_discount")]),
    "question": ("orders", [
        ("id", "o_orderkey"), ("uin", "'HL' || CAST(o_orderkey % 9000 AS STRING)"), ("heading", cases("o_custkey", ["Schools: Repayments", "Floods - Wales", "NULL", "Student Loans", "Health Services"])),
        ("question_text", "'To ask about <b>' || " + cases("o_orderkey", ["student loan repayments", "flood defences &amp; rivers", "schools and teachers", "hospital waiting times"]) + " || '</b>  and  its effects'"),
        ("answer_text", "CASE WHEN o_orderstatus <> 'O' THEN " + cases("o_custkey", ["I will write to the noble Lord.", "The Government invests in growth and support.", "A short answer.", ""]) + " END"), ("member_id", "CASE WHEN o_custkey % 7 <> 0 THEN o_custkey % 100 END"),
        ("department", cases("o_custkey", ["Department for Education", "HM Treasury", "Home Office", "NULL"])), ("tabled_date", "CAST(o_orderdate AS DATE)"), ("is_withdrawn", "o_orderkey % 23 = 0"), ("is_named_day", "o_orderkey % 3 = 0"), ("house", "CASE WHEN o_custkey % 3 = 0 THEN 'Lords' ELSE 'Commons' END"),
        ("updated_at", "o_orderdate"),
    ]),
    "question_theme": ("lineitem", [("question_id", "l_orderkey"), ("theme", "'theme ' || CAST(l_partkey % 40 AS STRING)"), ("theme_type", "CASE WHEN l_linenumber % 2 = 0 THEN 'policy_area' ELSE 'specific' END")]),
    "organisation": ("customer", [
        ("id", "c_custkey"), ("canonical_name", "CASE WHEN c_custkey % 50 = 49 THEN 'Customer#000000048 ltd' ELSE c_name || " + cases("c_custkey", [" Ltd", "", " Trust", " (UK) plc"]) + " END"),
        ("url", "CASE WHEN c_custkey % 6 <> 0 THEN 'HTTPS://Www.Org' || CAST(c_custkey % 700 AS STRING) || '.example.org:80/about' END"), ("registration_number", "CASE WHEN c_custkey % 5 = 0 THEN 'R' || CAST(c_custkey % 90 AS STRING) END"),
        ("type", "lower(c_mktsegment)"), ("status", "CASE WHEN c_acctbal < 0 THEN 'provisional' ELSE 'active' END"), ("nation_id", "c_nationkey"),
    ]),
    "alias": ("supplier", [("organisation_id", "s_suppkey"), ("alias_name", "'The ' || s_name"), ("source", cases("s_suppkey", ["config", "register"]))]),
    "engagement": ("orders", [
        ("id", "o_orderkey"), ("organisation_id", "o_custkey"), ("source_type", "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'oral_evidence_committee' WHEN '2' THEN 'ministerial_meeting' WHEN '3' THEN 'written_evidence_committee' WHEN '4' THEN 'lobbying_register_client' ELSE 'consultation_response' END"),
        ("engagement_date", "CAST(o_orderdate AS DATE)"), ("cited_in_outcome", "o_orderstatus = 'F'"), ("policy_area", cases("o_orderkey", ["skills", "health", "NULL", "schools"])), ("department", cases("o_custkey", ["Department for Education", "HM Treasury", "Home Office", "NULL"])),
        ("inquiry_id", "CASE WHEN o_orderkey % 4 <> 0 THEN 'INQ' || CAST(o_orderkey % 300 AS STRING) END"), ("source_url", "'https://source.example.org/' || CAST(o_orderkey % 500 AS STRING)"),
    ]),
    "flag": ("events", [
        ("id", "event_id"), ("organisation_id", "user_id"), ("flag_type", "CASE event_type WHEN 'error' THEN 'possible_duplicate' WHEN 'click' THEN 'missing_url' ELSE event_type END"),
        ("detail", "'similarity ' || CAST(event_id % 7 AS STRING) || ' (org_id=' || CAST(event_id % 400 AS STRING) || ')'"), ("resolved", "event_id % 3 = 0"), ("raised_at", "ts"),
    ]),
    "run": ("events", [("id", "event_id"), ("service_name", "event_type"), ("started_at", "ts"), ("finished_at", "CASE WHEN event_id % 4 <> 0 THEN ts END"), ("status", "CASE event_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE 'ok' END"), ("ingested", "CAST(floor(value) AS BIGINT)")]),
    "member": ("supplier", [
        ("id", "s_suppkey"), ("name", cases("s_suppkey", ["The Rt Hon Baroness Smith ", "Mr John Jones ", "Lord Brown ", "Dame Ann "]).replace(" END", " END || CAST(s_suppkey AS STRING) || CASE WHEN s_suppkey % 2 = 0 THEN ' MP' ELSE ' OBE' END")),
        ("attribution", cases("s_suppkey", ["Mr Ann Smith (Ely) (Lab)", "Lord Sikka (Lab)", "The Secretary of State for Trade (Jo Doe)", "Baroness in Waiting/Government Whip (Baroness Blake of Leeds) (Lab)", "Ann Lee", "Tom Ray (Hove) (Maiden Speech)", "NULL"])), ("party", cases("s_suppkey", ["snp", " LD ", "Conservative", "NULL"])), ("house", "CASE WHEN s_nationkey % 3 = 0 THEN 'Lords' ELSE 'Commons' END"), ("nation_id", "s_nationkey"),
    ]),
    "speech": ("documents", [("id", "doc_id"), ("text", "text"), ("source", "source"), ("lang", "lang"), ("n_chars", "n_chars")]),
    "page": ("pages", [("id", "page_id"), ("url", "url"), ("html", "html")]),
    "turn": ("conversations", [("conv_id", "conv_id"), ("turn", "turn"), ("role", "role"), ("text", "text")]),
}


class Tables:
    """The domain's tables (attributes) and the driver's (by `raw`) of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        source, columns = VIEWS[name]
        return self.raw(source).select(*(F.expr(e).alias(c) for c, e in columns))


def SQL_VIEWS(sql: str) -> str:
    """sql with the domain's views that it names put before it."""
    used = [v for v in VIEWS if re.search(rf"\b(FROM|JOIN)\s+{v}\b", sql)]
    views = [f"{v} AS (SELECT {', '.join(f'{e} AS {chr(34)}{c}{chr(34)}' for c, e in VIEWS[v][1])} FROM {VIEWS[v][0]})" for v in used]
    sql = sql.strip()
    if not views:
        return sql
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(views)}, {sql[15:]}"
    return f"WITH {', '.join(views)}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {', '.join(views)} {sql}"
