"""Scans and landed rows over the domain's tables."""

from __future__ import annotations

import json
import os
from contextlib import closing

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import catalogue, database, landed
from ..storage import new_path
from .domain import Tables
from .registry import query


@query(
    "s14_s20_speech_rows",
    "SELECT c.url AS listurl, trim(speech_text) AS body_clean, CAST(len(string_split_regex(trim(speech_text), '\\s+')) AS INTEGER) AS body_word_count, trim(split_part(m.attribution, '(', 1)) AS speaker_name, lower(s.house) AS source, s.house AS source_label, s.date AS hdate FROM contribution c JOIN session s ON s.id = c.session_id JOIN member m ON m.id = c.member_id WHERE m.attribution NOT LIKE '%/%' AND m.attribution IS NOT NULL",
)
def _(t: Tables) -> DataFrame:
    """S14-S20, P03, S45."""
    rows = t.contribution.join(t.session.select(F.col("id").alias("session_id"), "title", "date", "house"), "session_id").join(t.member.where("attribution NOT LIKE '%/%'").select(F.col("id").alias("member_id"), "attribution"), "member_id")
    c = F.col
    found = landed.speech_rows(landed.without_errors(rows.withColumn("_error", F.lit(None).cast("string"))), c("url"), c("speech_text"), c("attribution"), c("date"), c("title"), F.lower("house"))
    return found.select("listurl", "body_clean", "body_word_count", "speaker_name", "source", "source_label", "hdate")


@query("s12_s33_ordered_union", "SELECT name, arg_min(role, p) AS role FROM (SELECT name, 'cabinet' AS role, 0 AS p FROM member WHERE id % 4 = 0 UNION ALL SELECT name, 'minister', 1 FROM member WHERE id % 6 = 0 UNION ALL SELECT name, 'whip', 2 FROM member WHERE id % 10 = 0) GROUP BY name")
def _(t: Tables) -> DataFrame:
    """Three lists in order, the first role wins."""
    part = lambda n, role: t.member.where(F.col("id") % n == 0).select("name", F.lit(role).alias("role"))
    return landed.prioritised([part(4, "cabinet"), part(6, "minister"), part(10, "whip")], "name")


@query("s07_s46_dimension", "SELECT i.id, coalesce(m.name, 'Committee ' || i.id) AS name FROM (SELECT unnest([3, 7, 99999]) AS id) i LEFT JOIN (SELECT * FROM member WHERE id % 7 > 0) m ON m.id = i.id")
def _(t: Tables) -> DataFrame:
    """S07, S46, S38."""
    ids = landed.id_list(t.spark, "3, 7,x, 99999,", t.member, "id")
    return landed.named_dimension(ids, t.member.where("id % 7 > 0").select("id", "name"), "id", "name", "Committee").select(F.col("id").cast("int").alias("id"), "name")


@query(["s39_full_answers", "s39_full_answers_all"], "SELECT q.id, CASE WHEN length(q.answer_text) < 20 THEN coalesce(f.full_text, q.answer_text) ELSE q.answer_text END AS answer_text FROM question q LEFT JOIN (SELECT o_orderkey AS id, o_orderpriority || ' in full' AS full_text FROM orders) f ON f.id = q.id")
def _(t: Tables) -> DataFrame:
    """S39 with the full texts of another table, for every question."""
    full = t.raw("orders").select(F.col("o_orderkey").alias("id"), F.concat("o_orderpriority", F.lit(" in full")).alias("answer_text"))
    return landed.completed(t.question.select("id", "answer_text"), full, "id", "answer_text", 20)


@query("s10_s11_s23_pruned_scans", "SELECT id, uin FROM question WHERE tabled_date BETWEEN DATE '1997-03-01' AND DATE '1997-03-31' AND department = 'HM Treasury' UNION ALL SELECT id, ext_id FROM session WHERE date BETWEEN DATE '1997-03-01' AND DATE '1997-03-31' AND title LIKE '%Bill%'")
def _(t: Tables) -> DataFrame:
    """A month's questions of a department and sections by title; the filters reach the scans."""
    of_month = lambda c: F.col(c).between(F.lit("1997-03-01").cast("date"), F.lit("1997-03-31").cast("date"))
    return t.question.where(of_month("tabled_date") & (F.col("department") == "HM Treasury")).select("id", "uin").union(t.session.where(of_month("date") & F.col("title").contains("Bill")).select("id", "ext_id"))


@query(["s32_first_feed", "s32_first_feed_all"], "SELECT site, arg_min(url, i) AS feed FROM (SELECT DISTINCT 'https://x' || (c_custkey % 40) || '.org' AS site, unnest(['/feed', '/rss', '/rss.xml']) AS p, unnest([0, 1, 2]) AS i FROM customer) s JOIN (SELECT DISTINCT 'https://x' || (c_custkey % 40) || '.org' || CASE WHEN c_custkey % 3 = 0 THEN '/rss' ELSE '/rss.xml' END AS url FROM customer) f ON f.url = s.site || s.p GROUP BY site")
def _(t: Tables) -> DataFrame:
    """S32 with the feeds of all customers."""
    site = F.concat(F.lit("https://x"), F.col("c_custkey") % 40, F.lit(".org"))
    c = t.raw("customer")
    feeds = c.select(F.concat(site, F.when(F.col("c_custkey") % 3 == 0, "/rss").otherwise("/rss.xml")).alias("url"))
    return landed.first_feed(c.select(site.alias("site")).distinct(), ["/feed", "/rss", "/rss.xml"], feeds)


@query("s34_s36_u10_catalogue", "SELECT * FROM (VALUES ('member', 'added', 'string')) v(name, \"column\", type)")
def _(t: Tables) -> DataFrame:
    """Expected columns that a table lacks."""
    expected = t.member.withColumn("added", F.lit("x"))
    return landed.columns_of({"member": expected}).subtract(landed.columns_of({"member": t.member}))


#: The driver's tables and their columns.
COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars", "embeddings": "vec_id embedding label", "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}


def sql_column(name: str, column: str) -> str:
    number = f"TRY_CAST(CASE WHEN typeof({column}) IN ('INTEGER', 'BIGINT') THEN {column}::VARCHAR END AS BIGINT)"
    return f"""SELECT '{name}' AS name, '{column}' AS "column", count(*) AS rows, count(*) - count({column}) AS nulls, min({number}) AS low, max({number}) AS high FROM {name}"""


@query(
    "s36_catalogue",
    f"""SELECT c.name, c."column", i.ordinal_position - 1 AS position, i.data_type AS type, c.rows, c.nulls, c.low, c.high FROM ({" UNION ALL ".join(sql_column(t, c) for t, cs in COLUMNS.items() for c in cs.split())}) c
    JOIN information_schema.columns i ON i.table_name = c.name AND i.column_name = c."column" """,
)
def _(t: Tables) -> DataFrame:
    """All tables' columns, types, row and null counts and ranges, from the files' footers."""
    return catalogue.catalogue(t.spark, {name: t.raw(name) for name in COLUMNS}).select("name", "column", "position", "type", "rows", "nulls", "low", "high")


@query(
    "m04_evolution",
    """WITH i AS (SELECT column_name, data_type FROM information_schema.columns WHERE table_name = 'orders'), e AS (SELECT column_name, CASE WHEN column_name = 'o_custkey' THEN 'VARCHAR' ELSE data_type END AS data_type FROM i WHERE column_name <> 'o_orderpriority' UNION ALL SELECT 'o_note', 'VARCHAR')
    SELECT 'orders' AS name, column_name AS "column", CASE WHEN i.data_type IS NULL THEN 'add' WHEN e.data_type IS NULL THEN 'extra' ELSE 'retype' END AS change, i.data_type AS found, e.data_type AS expected FROM i FULL JOIN e USING (column_name) WHERE i.data_type IS DISTINCT FROM e.data_type""",
)
def _(t: Tables) -> DataFrame:
    """The orders' files against a later schema, with a column more, one fewer and one of another type."""
    found = catalogue.catalogue(t.spark, {"orders": t.raw("orders")})
    later = found.where("column <> 'o_orderpriority'").select("name", "column", F.when(F.col("column") == "o_custkey", "VARCHAR").otherwise(F.col("type")).alias("type"))
    return catalogue.evolution(found, later.unionByName(t.spark.createDataFrame([("orders", "o_note", "VARCHAR")], "name string, column string, type string")))


@query("k16_bulk_load", "SELECT id, CASE WHEN status = 'provisional' THEN 'there before' ELSE canonical_name END AS name FROM organisation")
def _(t: Tables) -> DataFrame:
    """Organisations added in bulk to a database's table, which keeps the rows it has, and read back in ranges. The database is a file in the shared folder."""
    path = new_path(t.spark, "database").removeprefix("file://")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    arguments = {"database": path + ".db", "timeout": 600}
    with closing(database.connect({"arguments": json.dumps(arguments)})) as db:
        db.cursor().execute("CREATE TABLE organisation (id INTEGER, name TEXT)")
        db.commit()
    database.load(t.organisation.where("status = 'provisional'").select("id", F.lit("there before").alias("name")), "organisation", ["id"], arguments)
    database.load(t.organisation.select("id", F.col("canonical_name").alias("name")), "organisation", ["id"], arguments)
    return database.read_table(t.spark, "organisation", "id long, name string", "id", arguments)
