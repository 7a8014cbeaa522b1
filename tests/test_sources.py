import datetime
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillstream.sources import readers as R
from quillstream.sources import sinks as K

INTERNAL = ["HM Treasury", "Cabinet Office", "DfE"]


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return f"file://{path}"


HEAD = "Minister,Date of meeting,Organisation(s) met,Purpose of meeting\n"


def test_meetings(spark, tmp_path):
    text = HEAD + 'A Minister,8 January 2025,Acme Ltd,Schools\nA Minister,10-12 January 2025,"First; Second, and; ",Two\nA Minister,January 2025,hm treasury,Budget\nA Minister,9/1/2025,"a, b, c, d, e",List\nA Minister,soon,Late,x\nNil return,,,\nA Minister,2025-01-08,,\n'
    raw = R.read_csv(spark, write(tmp_path / "m.csv", text, "utf-8-sig"))
    assert raw.columns[0] == "Minister"
    rows = {r["raw_organisation_name"]: r for r in R.meetings(raw, "dfe", "http://s", INTERNAL).collect() if r["raw_organisation_name"]}
    assert rows["Acme Ltd"]["meeting_date"] == datetime.date(2025, 1, 8) and rows["Acme Ltd"]["processing_status"] == "pending"
    assert rows["First"]["meeting_date"] == datetime.date(2025, 1, 10) and "used start date" in rows["Second, and"]["processing_notes"]
    assert rows["hm treasury"]["processing_status"] == "rejected" and rows["hm treasury"]["meeting_date"] == datetime.date(2025, 1, 1)
    assert "list of organisations" in rows["a, b, c, d, e"]["processing_notes"] and rows["Late"]["processing_status"] == "errored"
    counts = {r["processing_status"]: r["count"] for r in R.meetings(raw, "dfe", "s", INTERNAL).groupBy("processing_status").count().collect()}
    assert counts == {"pending": 4, "rejected": 1, "errored": 1, "nil": 2}
    old = R.read_csv(spark, write(tmp_path / "old.csv", HEAD + "M,8 January 2025,Caf\xe9 \xa3,p\n", "cp1252"))
    assert old.first()[2] == "Café £"
    with pytest.raises(ValueError, match="organisation"):
        R.roles(["Minister", "Date"])
    (tmp_path / "mixed é").mkdir()
    write(tmp_path / "mixed é" / "a.csv", HEAD + "M,8 January 2025,Caf\xe9 \xa3 \u20ac,p\n", "cp1252")
    write(tmp_path / "mixed é" / "b.csv", HEAD + "M,9 January 2025,Caf\xe9 Ltd,p\n", "utf-8-sig")
    write(tmp_path / "mixed é" / "c.csv", HEAD + 'M,10 January 2025,"two\nlines \u65e5",p\n', "utf-8")
    mixed = R.read_csv(spark, f"file://{tmp_path}/mixed é")
    assert mixed.columns == HEAD.strip().split(",") and {r[2] for r in mixed.collect()} == {"Café £ €", "Café Ltd", "two\nlines 日"}


def xlsx(path, rows):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared = sorted({c for r in rows for c in r if c})
    cells = lambda r, n: "".join(f'<c r="{chr(65 + i)}{n}" t="s"><v>{shared.index(c)}</v></c>' for i, c in enumerate(r) if c)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{c}</t></si>" for c in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{n}">{cells(r, n)}</row>' for n, r in enumerate(rows, 1)) + "</sheetData></worksheet>")


def test_register(spark, tmp_path):
    xlsx(tmp_path / "r.xlsx", [("Title",), ("Note",), ("Firm", "Client"), ("F1", "C1"), (None, None), ("F2", "cabinet office"), ("F3", "N/A"), ("F4", None)])
    raw = R.read_register(spark, f"file://{tmp_path}/r.xlsx")
    assert [tuple(r) for r in raw.collect()] == [("F1", "C1"), ("F2", "cabinet office"), ("F3", "N/A"), ("F4", None)]
    got = R.register_entries(raw, "2022-Q4", "2022-10-01", "2022-12-31", INTERNAL).collect()
    assert sorted((r["firm_name"], r["record_type"], r["processing_status"]) for r in got) == [("F1", "client", "pending"), ("F1", "firm", "pending"), ("F2", "client", "rejected"), ("F2", "firm", "rejected")]
    csv = R.read_register(spark, write(tmp_path / "r.csv", "Registered organisation name,Client name\nF,C\n", "utf-8-sig"))
    assert R.register_entries(csv, "q", "2022-10-01", "2022-12-31", []).count() == 2


def test_pages_and_evidence(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    witness = lambda kind, *orgs: {"id": 1, "name": "Ann", "submitterType": kind, "organisations": [{"name": n, "role": r} for n, r in orgs]}
    pages = [{"totalResults": 3, "items": [{"id": 1, "publicationDate": "2024-05-01T00:00:00", "committeeBusinesses": [{"id": 9, "title": "Inquiry"}], "witnesses": [witness("Organisation", ("One; Two", "Chair"))]}, {"id": 2, "committeeBusiness": {"id": 8, "title": "Other"}, "witnesses": [witness("Individual", ("Uni", "Professor")), witness("Organisation", ("DfE", "x"))]}]}, {"totalResults": 3, "items": [{"id": 3, "witnesses": []}]}]
    for i, p in enumerate(pages):
        (folder / f"page-{i}.json").write_text(json.dumps(p))
    (folder / "page-9.json").write_text("{broken")
    R.register(spark)
    items = spark.read.format("json_pages").load(f"file://{folder}")
    assert items.count() == 3 and {r["totalResults"] if "totalResults" in r else r[1] for r in items.collect()} == {3}
    got = {r["raw_organisation_name"]: r for r in R.evidence(items, True, "Committee", INTERNAL).collect()}
    assert set(got) == {"One", "Two", "Uni"} and got["Uni"]["role"] == "Ann, Professor" and got["Uni"]["inquiry_id"] == 8 and got["One"]["inquiry_title"] == "Inquiry"
    assert got["One"]["publication_date"] == datetime.date(2024, 5, 1) and got["One"]["source_url"].endswith("/1/transcript")


def test_nested_debates(spark):
    item = lambda text, kind="Contribution", tag=None: {"ItemType": kind, "HRSTag": tag, "Value": text, "MemberId": 5, "AttributedTo": "Ann (Ely) (Lab)"}
    part = lambda ext, items, children=(): {"Overview": {"Title": ext, "Date": "2026-04-27T00:00:00", "House": "Commons", "ExtId": ext}, "Items": items, "ChildDebates": list(children)}
    doc = part("A", [item("<p>One</p><p>Two</p>"), item("", tag="hs_para"), item("x", "Timestamp"), item("m", tag="hs_TabledBy")], [part("B", [item("b1"), item("b2")], [part("C", [item("c1")])])])
    sections = R.debates(spark.createDataFrame([(json.dumps(doc),)], "doc string"), "doc")
    assert {(r["ext_id"], r["parent_ext_id"]) for r in sections.collect()} == {("A", None), ("B", "A"), ("C", "B")}
    got = {(r["ext_id"], r["speech_order"]): r for r in R.speeches(sections).collect()}
    assert set(got) == {("A", 0), ("B", 0), ("B", 1), ("C", 0)} and got["A", 0]["speech_text"] == "OneTwo".replace("OneTwo", "One\n\nTwo") and got["A", 0]["party"] == "Lab"


def test_feed_and_posts(spark, tmp_path):
    rss = write(tmp_path / "f.xml", "<rss><channel>" + "".join(f"<item><title>{t}</title><link>l{i}</link><description>d</description></item>" for i, t in enumerate(["School news", "Rivers", "Loans for schools"])) + "</channel></rss>")
    assert {r["title"] for r in R.feed(spark, rss, "school x").collect()} == {"School news", "Loans for schools"}
    rows = write(tmp_path / "p.json", "\n".join(json.dumps({"uri": str(i), "text": t, "createdAt": f"2024-01-0{i + 1}"}) for i, t in enumerate(["about rivers", "none", "rivers again"])))
    assert [r["uri"] for r in R.posts(spark, rows, "rivers").collect()] == ["2", "0"]
    page = spark.createDataFrame([("Member of Parliament for Ely, House of Commons",), ("A footballer",)], "t string")
    assert [r[0] for r in page.select(R.looks_parliamentary(F.col("t"), ["house of commons", "member of parliament"])).collect()] == [True, False]


def test_sinks(spark, tmp_path):
    target = f"file://{tmp_path}/t"
    frame = lambda rows: spark.createDataFrame(rows, "k string, d date, v int")
    day = datetime.date(2024, 1, 1)
    K.insert_new(frame([("a", day, 1), ("a", day, 1), ("b", None, 2)]), target, ["k", "d"])
    K.insert_new(frame([("a", day, 9), ("b", None, 9), ("c", None, 3)]), target, ["k", "d"])
    assert sorted(tuple(r)[::2] for r in K.current(spark, target).collect()) == [("a", 1), ("b", 2), ("c", 3)]
    assert [kind for _, kind in K._steps(spark, target)] == ["v", "d"]
    assert K.load(frame([("a", day, 9), ("c", None, 3), ("c", None, 3)]), target, ["k", "d"]) == {"keys": 2, "rows": 3}
    K.upsert(frame([("a", day, 5), ("z", day, 6)]), target, ["k"], columns=["v"])
    K.upsert(frame([("b", day, 7), ("c", day, 1)]), target, ["k"], only_if="o.v < 3")
    assert {r["k"]: (r["v"], r["d"]) for r in K.current(spark, target).collect()} == {"a": (5, day), "b": (7, day), "c": (3, None), "z": (6, day)}
    K.insert_new(frame([("y", day, 8)]).withColumn("more", F.lit("m")), target, ["k"])
    assert {r["k"]: r["more"] for r in K.current(spark, target).collect()} == {"a": None, "b": None, "c": None, "z": None, "y": "m"}
    K.delete(spark, target, F.col("v") > 5)
    assert {r["k"] for r in K.current(spark, target).collect()} == {"a", "c"}
    log = f"file://{tmp_path}/log"
    for _ in range(2):
        K.log_run(spark, log, "ingest", spark.createDataFrame([("ok", 3), ("failed", 1)], "outcome string, n long"))
    assert [r["counters"] for r in K.current(spark, log).collect()] == [{"ok": 3, "failed": 1}] * 2
    K.csv_report(frame([("a", day, 1), ('q"x', None, 2)]), f"file://{tmp_path}/csv", [("Report", "x")])
    lines = next((tmp_path / "csv").glob("part-*")).read_text(encoding="utf-8").splitlines()
    assert lines == ['﻿"Report","x"', "", '"k","d","v"', '"a","2024-01-01","1"', '"q""x","","2"']
    K.sitemap(spark.createDataFrame([("http://x", day)], "loc string, lastmod date"), f"file://{tmp_path}/xml")
    assert any("<loc>http://x</loc>" in p.read_text() for p in (tmp_path / "xml").glob("part-*"))


def test_debates_nested_to_any_depth(spark):
    doc = None
    for k in range(19, -1, -1):
        doc = {"Overview": {"ExtId": f"e{k}", "Title": f"level {k}", "Date": "2024-05-01"}, "Items": [{"ItemType": "Contribution", "Value": f"<p>speech {k}</p>", "AttributedTo": "A"}], "ChildDebates": [doc] if doc else []}
    sections = R.debates(spark.createDataFrame([(json.dumps(doc),), (json.dumps({"Overview": {"ExtId": "flat"}, "Items": []}),), (None,)], "doc string"), "doc").collect()
    got = {r["ext_id"]: r for r in sections if r["ext_id"]}
    assert sorted(got) == sorted([*(f"e{k}" for k in range(20)), "flat"])
    assert all(got[f"e{k}"]["parent_ext_id"] == (f"e{k - 1}" if k else None) and got[f"e{k}"]["root"] == "e0" and len(got[f"e{k}"]["path"]) == k and got[f"e{k}"]["item"]["Value"] == f"<p>speech {k}</p>" for k in range(20))


def test_a_batch_that_runs_again_writes_its_rows_once(spark, tmp_path, monkeypatch):
    from quillstream.streaming import incremental as I

    spark.range(10).write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    monkeypatch.setattr(I, "new_path", lambda spark, name: f"{tmp_path}/out")
    assert I.finished(rows, "x", "append").count() == 10
    monkeypatch.setattr(I, "new_path", lambda spark, name: f"{tmp_path}/out")
    (tmp_path / "out" / "state").rename(tmp_path / "lost")  # the state is lost, so the batch runs again
    assert I.finished(rows, "x", "append").count() == 10


def test_updates_touch_only_their_partitions(spark, tmp_path):
    target = f"file://{tmp_path}/p"
    days = [datetime.date(2024, 1, d) for d in (1, 2, 3)]
    frame = lambda rows: spark.createDataFrame(rows, "k int, d date, v int")
    K.upsert(frame([(i, days[i % 3] if i else None, i) for i in range(9)]), target, ["k"], part="d")
    K.upsert(frame([(1, days[1], 10), (9, days[1], 9), (0, None, 7)]), target, ["k"], newer_by="v", part="d")
    K.insert_new(frame([(1, days[1], 0), (10, days[2], 1)]), target, ["k"], part="d")
    K.upsert(frame([(10, days[2], 2), (2, days[2], 1), (11, datetime.date(2024, 2, 1), 3)]), target, ["k"], newer_by="v", part="d")
    want = {0: 7, 1: 10, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 2, 11: 3}
    for _ in range(2):
        found = K.current(spark, target)
        assert found.columns == ["k", "d", "v"] and sorted((r["k"], r["v"]) for r in found.collect()) == sorted(want.items())
        assert {r["k"]: r["d"] for r in found.collect()} == {i: (days[i % 3] if i else None) for i in range(9)} | {9: days[1], 10: days[2], 11: datetime.date(2024, 2, 1)}
        K.upsert(frame([(11, datetime.date(2024, 2, 1), 3)]), target, ["k"], part="d")
    assert [kind for _, kind in K._steps(spark, target)] == ["v", "p", "d", "p", "p", "p"]
    K.insert_new(frame([(12, days[0], 5)]), target, ["k"])
    K.upsert(frame([(12, days[0], 6)]), target, ["k"], part="d")
    assert {r["k"]: r["v"] for r in K.current(spark, target).collect()} == want | {12: 6} and K.current(spark, target).count() == 13
