import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.functions import classify as C
from quillstream.functions import dates as D
from quillstream.functions import scoring as S
from quillstream.functions import text as T
from quillstream.operators import audit, graph, joins, predicates, search, vectors, windows
from quillstream.sources import sinks
from quillstream.storage import new_path
from quillstream.streaming import incremental


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_text(spark):
    c = F.col("t")
    one = lambda f, *texts: [r[0] for r in values(spark, [(t,) for t in texts], "t string", f)]
    assert one(T.strip_html(c), "<b>A</b> &amp;  B &eacute;", None) == ["A & B é", ""]
    assert one(T.paragraphs(c), "<p>a<br>b</p>\r\n<p>c  d</p>") == ["a b\n\nc d"]
    assert one(T.title_slug(c), "The Café & Women’s Rights: 2024/25", "of the", "x" * 70, " ".join(["word"] * 20)) == ["cafe-womens-rights-2024-25", "session", "x" * 60, "-".join(["word"] * 12)]
    assert one(T.last_group_party(c), "Ann (Ely) (Lab)", "Lord Sikka (Lab)", "Ann (Ely) (Maiden Speech)") == ["Lab", None, None]
    assert one(T.person_key(c), "The Rt Hon Baroness Smith of Malvern", "Sir John Jones MP", "Mr Dr Who OBE") == ["smith of malvern", "john jones", "who"]
    assert one(T.display_name(c), "The Rt Hon Baroness Smith of Malvern", "The Rt Hon Josh MacAlister MP") == ["Baroness Smith of Malvern", "Josh MacAlister"]
    assert one(T.organisation_key(c), "Acme (UK) Ltd.", "Été Limited") == ["acme uk", "été"]
    assert one(T.word_root(c), "repayments", "schools", "ties", "planning") == ["repay", "school", "ties", "plann"]
    assert one(T.tolerant_json(c, "a int")["a"], '```json\n{"a": 1,}\n```', 'text {"a": 2} more', "none") == [1, 2, None]
    assert one(T.page_text(c), "<head>x</head><body><script>y</script>Hello <b>there</b></body>") == ["Hello there"]


def test_dates(spark):
    d = lambda t: D.noted_date(F.lit(t))
    got = values(spark, [(1,)], "x int", *(d(t)["date"] for t in ("2025-01-08", "8/1/2025", "10–15 January 2024", "8 January 2025", "January 2025", "", "31 February 2024")))[0]
    day = datetime.date
    assert got == (day(2025, 1, 8), day(2025, 1, 8), day(2024, 1, 10), day(2025, 1, 8), day(2025, 1, 1), None, None)
    assert values(spark, [(day(2026, 4, 27),)], "d date", D.url_date(F.col("d")), D.from_url_date(F.lit("27-april-2026")), D.from_url_date(F.lit("27-x-2026")), D.iso_week(F.col("d"))) == [("27-april-2026", day(2026, 4, 27), None, "2026-W18")]


def test_classifiers_and_scores(spark):
    kinds = [("Arrangement of Business", "Grand Committee", None), ("Engagements", "", "hs_8Question"), ("Finance (Amendment) Regulations 2024", None, None), ("Post Office: Motion", None, "x"), ("Lord X: Humble Address", None, "hs_2cStatement")]
    assert [r[0] for r in values(spark, kinds, "t string, l string, g string", C.session_type(F.col("t"), F.col("l"), F.col("g")))] == ["other", "pmqs", "statutory_instrument", "debate", "debate"]
    score = S.engagement_score(F.lit("ministerial_meeting"), F.lit("2020-01-01").cast("date"), F.lit(True), F.lit("a"), F.lit(None).cast("string"), F.lit("2025-01-01").cast("date"), "a", "d")
    assert values(spark, [(1,)], "x int", score)[0][0] == pytest.approx(3.0 * 0.5 ** (1827 / 1825) * 2.5 * 2.0)
    with pytest.raises(ValueError):
        S.weight(F.lit("x"), {"nothing": 1.0})


def test_predicates(spark):
    t = F.col("t")
    rows = [("student loan repayments",), ("student finance",), (None,)]
    assert [r[0] for r in values(spark, rows, "t string", predicates.stems_match(t, "student loans"))][:2] == [True, False]
    assert values(spark, [("met DfE team",), ("DfES",)], "t string", predicates.whole_word(t, ["x", "dfe"])) == [("dfe",), (None,)]
    assert [r[0] for r in values(spark, [("http://x.org/a",), ("ftp://x",), ("http://10.0.0.1/",), ("nothing",)], "u string", predicates.safe_url(F.col("u")))] == [True, False, False, False]
    df = spark.createDataFrame([(1, True, False), (2, False, True)], "id int, a boolean, b boolean")
    assert [r["id"] for r in predicates.cascade(df, F.col("a"), F.col("b")).collect()] == [1]
    assert [r["id"] for r in predicates.cascade(df.where("id = 2"), F.col("a"), F.col("b")).collect()] == [2]


def test_joins_and_windows(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 7), (None, 3)], "k int, at int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (2, 8, "c")], "k int, since int, v string")
    assert sorted((r["k"] or 0, r["at"], r["asof_v"]) for r in joins.as_of(left, right, "k", "at", "since", ["v"]).collect()) == [(0, 3, None), (1, 1, None), (1, 5, "b"), (2, 7, None)]
    far = spark.createDataFrame([(k, n) for k in (1, 2) for n in (0, 4, 17, 40, 90)], "k int, at int").withColumn("time", F.timestamp_seconds(F.col("at") * 20_000))
    seen = spark.createDataFrame([(1, 3, "a"), (1, 3, "c"), (1, 17, "b"), (1, 39, None), (2, 41, "d"), (None, 0, "n"), (2, None, "n")], "k int, since int, v string").withColumn("time", F.timestamp_seconds(F.col("since") * 20_000))
    plain = [(k, n, max(((s, v or "") for j, s, v in [(1, 3, "a"), (1, 3, "c"), (1, 17, "b"), (1, 39, None), (2, 41, "d")] if j == k and s <= n), default=(None, ""))) for k in (1, 2) for n in (0, 4, 17, 40, 90)]
    for width in (1, 5, 1000):
        got = joins.as_of(far.drop("time"), seen.drop("time"), "k", "at", "since", ["v"], width)
        assert sorted((r["k"], r["at"], (r["asof_at"], r["asof_v"] or "")) for r in got.collect()) == plain
        assert sorted((r["k"], r["at"], r["asof_v"] or "") for r in joins.as_of(far, seen.drop("since"), "k", "time", "time", ["v"], width).collect()) == [(k, n, v) for k, n, (_, v) in plain]
    s = spark.createDataFrame([(i, datetime.date(2020, 1, 1) + datetime.timedelta(days=d), k) for i, d, k in [(1, 0, "x"), (2, 364, "x"), (3, 365, "x"), (4, 731, "x"), (5, 0, "y")]], "id int, date date, k string")
    assert {(r["id"], r["other_id"]) for r in joins.related(s, F.col("k")).collect()} == {(1, 2), (2, 1), (1, 3), (3, 1), (2, 3), (3, 2)}
    more = s.union(spark.createDataFrame([(6, datetime.date(2020, 1, 1), "x"), (7, None, "x"), (8, datetime.date(2020, 1, 1), "x")], "id int, date date, k string"))
    best = {}
    for r in joins.related(more, F.col("k")).collect():
        best.setdefault(r["id"], []).append((abs(r["days"]), r["other_id"]))
    assert {r["id"]: (r["n"], r["days"], r["nearest_id"]) for r in joins.related_summary(more, F.col("k")).collect()} == {i: (len(x), *min(x)) for i, x in best.items()}
    rows = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "s string, x string")
    slug = windows.collision_free(rows, F.col("s"), F.concat("s", "x"), F.concat("s", F.lit("-"), "x"))
    assert sorted(r["slug"] for r in slug.collect()) == ["a1", "a2", "b"]


def test_search(spark):
    t = F.col("t")
    rows = [("Student loans and the repayment of loans",), ("Loan for a student",), ("nothing",), (None,)]
    index = search.build(spark.createDataFrame([(i, i, *r) for i, r in enumerate(rows)], "key long, owner long, text string"), new_path(spark, "search"))
    found = lambda q: {r["id"] for r in search.search(q, index, None).collect()}
    hits = lambda q: [i in found(q) for i in range(4)]
    assert hits("loans student") == [True, True, False, False] and hits('"student loans"') == [True, False, False, False] and hits("the") == [False] * 4
    assert values(spark, rows[:1], "t string", search.headline(t, search.inflections(index, "repayment"), 4, 1))[0][0] == "the <mark>repayment</mark> of loans"


def test_graph_and_vectors(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 5)], "a long, b long")
    node = lambda *n: spark.createDataFrame([(x,) for x in n], "node long")
    assert {(r["node"], r["depth"]) for r in graph.walk(node(1), edges, node(1, 2, 3)).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    rng = np.random.default_rng(0)
    data = rng.normal(size=(60, 8))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, vector array<double>")
    topics = items.where("id < 7").withColumnRenamed("id", "topic")
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    wanted = {(i, j) for i in range(7) for j in range(60) if unit[i] @ unit[j] >= 0.3}
    for block in (4096, 3):
        vectors.BLOCK = block
        assert {(r["topic"], r["id"]) for r in vectors.matches(items, topics, 0.3).collect()} == wanted
    vectors.BLOCK = 4096


def test_audit(spark):
    vocab = {"kind": ["a"], "empty": []}
    assert audit.checked_value("a", vocab, "kind") == "a"
    for args, error in ((("a", vocab, "none"), KeyError), (("a", vocab, "empty"), RuntimeError), (("b", vocab, "kind"), ValueError)):
        with pytest.raises(error):
            audit.checked_value(*args)
    keys = spark.createDataFrame([("daily", datetime.date(2020, 1, 1) + datetime.timedelta(days=i)) for i in range(100)], "kind string, d date")
    plan = audit.retention(keys, "d", F.lit("2020-12-31").cast("date"))
    with pytest.raises(RuntimeError):
        audit.guarded(plan)
    assert audit.guarded(plan, 100).count() == 100


def test_streams_restart_from_their_state(spark, tmp_path):
    """A late row updates its window; a row later than the watermark does not."""
    at = lambda d, h: datetime.datetime(2024, 1, d, h)
    folder = f"file://{tmp_path}/in"
    schema = "ts timestamp_ntz, user string, value double"
    spark.createDataFrame([(at(1, 1), "a", 1.0), (at(5, 1), "a", 1.0)], schema).write.parquet(folder)
    df = incremental.stream(spark, folder, "ts")
    one = incremental.finished(incremental.windowed(df, "ts", [], "1 day").select("n"), "w", "complete")
    assert sorted(r["n"] for r in one.collect()) == [1, 1]
    latest = incremental.upserts(df, f"file://{tmp_path}/t", ["user"], ["ts"], "u")
    assert [r["ts"].day for r in latest.collect()] == [5]
    row = spark.createDataFrame([("1990-01-01",)], "x string")
    assert row.select(incremental.since(spark.createDataFrame([(datetime.date(2024, 2, 1),)], "d date"), "d", 14, "1990-01-01")).first()[0] == datetime.date(2024, 1, 18)


def test_joined_text_is_cut_and_ordered_within_and_across_bins(spark):
    rows = [(1, o, i, f"speech {o} {i} " + "é" * (o % 30)) for o in range(400) for i in range(2)] + [(1, None, 900, "last"), (2, 1, 1, None), (2, 2, 2, ""), (3, 200, 1, "b"), (3, 3, 2, "a"), (3, None, 3, "c"), (4, 1, 1, "x" * 9000)]
    df = spark.createDataFrame(rows, "k long, o long, i long, t string").repartition(7)
    found = {r["k"]: r["text"] for r in windows.joined_text(df, "k", ["o", "i"], "t", 4000).collect()}
    whole = " ".join(t for k, _, _, t in rows if k == 1)
    assert found == {1: whole[:4000], 2: "", 3: "a b c", 4: "x" * 4000} and len(whole) > 4000


def test_csv_report_of_many_rows_is_in_several_ordered_files(spark, tmp_path):
    sizes = {"spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        sinks.csv_report(spark.range(20000, numPartitions=6).selectExpr("20000 - id AS n").orderBy("n"), f"file://{tmp_path}/csv", [("Report", "x")])
    finally:
        for k in sizes:
            spark.conf.unset(k)
    parts = sorted((tmp_path / "csv").glob("part-*"))
    lines = [x for p in parts for x in p.read_text(encoding="utf-8").splitlines()]
    assert len(parts) > 1 and lines[:3] == ['\ufeff"Report","x"', "", '"n"'] and lines[3:] == [f'"{n}"' for n in range(1, 20001)]


def test_interval_join_broadcasts_nothing_and_needs_few_rows(spark):
    """Cut spans are more than their table's size tells, so neither side may be broadcast; an event is a row for each level of its table's days alone."""
    rows = spark.range(3000).select("id", (F.col("id") % 7).alias("k"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("id") % 2000).cast("int")).alias("a"))
    found = joins.during(rows, rows.withColumn("b", F.lit(None).cast("date")), "k", "a", "a", "b")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert found.count() == sum(1 for i in range(3000) for j in range(i % 7, 3000, 7) if j % 2000 <= i % 2000)
    first, days, levels = joins._extent(rows, "a")
    assert (days, levels) == (2000, 6)
    for a, b in ((0, 2000), (3, 3), (5, 1021), (1999, 1999), (-40, 15), (16, 31)):
        span = spark.range(1).selectExpr(f"date_from_unix_date({first + a}) AS a", f"date_from_unix_date({first + b}) AS b")
        codes = [r["_range"] for r in joins.cut(span, "a", "b", first, days, levels).collect()]
        days_of = [d for c in codes for d in range((c >> 5) * 4 ** (c & 31), ((c >> 5) + 1) * 4 ** (c & 31))]
        assert sorted(days_of) == list(range(max(a, 0), min(b, days - 1) + 1)) and len(codes) <= 9 * levels


def test_spans_that_cover_a_day(spark):
    """Ranges against every pair, days long ago and far ahead, times within a day, and a key with very many spans."""
    rng = np.random.default_rng(7)
    day = lambda n: datetime.date(1970, 1, 1) + datetime.timedelta(days=int(n))
    spans = [(i, int(rng.integers(3)), day(a := rng.integers(-400, 400)), day(a + rng.integers(-3, 200)) if rng.random() < 0.8 else None) for i in range(150)]
    spans += [(900, 1, datetime.date(1, 1, 1), datetime.date(9999, 12, 31)), (901, None, day(0), None), (902, 1, None, day(5)), (903, 1, day(10), day(9))]
    events = [(i, int(rng.integers(3)), day(rng.integers(-500, 700))) for i in range(200)] + [(900, 1, datetime.date(1, 1, 1)), (901, 1, datetime.date(9999, 12, 31)), (902, None, day(1)), (903, 2, None)]
    s, e = spark.createDataFrame(spans, "id long, k int, a date, b date"), spark.createDataFrame(events, "id long, k int, at date")
    wanted = sorted((i, j) for i, k, at in events for j, own, a, b in spans if None not in (k, own, at, a) and k == own and a <= at and (b is None or at <= b))
    assert sorted(tuple(r) for r in joins.during(e, s, "k", "at", "a", "b").select("id", "span_id").collect()) == wanted
    counts = {i: sum(x == i for x, _ in wanted) for i, _, _ in events}
    assert {r["id"]: r["spans"] for r in joins.covers(e, s, "k", "at", "a", "b").collect()} == counts
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    hours, of = spark.createDataFrame([(1, 1, at(5)), (2, 1, at(9))], "id long, k int, at timestamp_ntz"), spark.createDataFrame([(7, 1, at(6), at(10))], "id long, k int, a timestamp_ntz, b timestamp_ntz")
    assert [(r["id"], r["span_id"]) for r in joins.during(hours, of, "k", "at", "a", "b").collect()] == [(2, 7)]
    hot = spark.range(100_000).select("id", F.lit(1).alias("k"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 1000).cast("int")).alias("a"))
    found = joins.covers(hot, hot.withColumn("b", F.lit(None).cast("date")), "k", "a", "a", "b").groupBy("a").agg(F.min("spans").alias("n"), F.max("spans").alias("m"))
    assert all(r["n"] == r["m"] == 100 * ((r["a"] - datetime.date(2020, 1, 1)).days + 1) for r in found.collect())


def test_similarities_are_held_in_bounded_memory():
    """As many topics as a block may have against a whole batch."""
    import tracemalloc

    rng = np.random.default_rng(0)
    own, wanted = rng.normal(size=(10_000, 8)), rng.normal(size=(vectors.BLOCK, 8))
    wanted /= np.linalg.norm(wanted, axis=1, keepdims=True)
    tracemalloc.start()
    found = [sum(len(i) for i, _, _ in vectors.near(own, wanted, 0.99))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6 and found[0] > 0
    i, j, score = (np.concatenate(x) for x in zip(*vectors.near(own[:700], wanted, 0.9), strict=True))
    whole = own[:700] @ wanted.T / np.linalg.norm(own[:700], axis=1, keepdims=True)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(a.tolist() for a in np.nonzero(whole >= 0.9)), strict=True)) and np.allclose(score, whole[i, j])


def test_links_of_a_walk_are_kept_as_they_are(spark, monkeypatch):
    """No task holds a table of distinct links; links that occur twice change nothing."""
    plans = {}

    def kept(df, name, own=graph.kept):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        return own(df, name)

    monkeypatch.setattr(graph, "kept", kept)
    nodes = lambda *ids: spark.createDataFrame([(i,) for i in ids], "node long")
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (2, 3)], "a long, b long")
    found = graph.walk(nodes(1, 1), edges, nodes(1, 2, 3))
    assert sorted(map(tuple, found.collect())) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert "Aggregate" not in plans["links"]


def test_joined_texts_are_dealt_out(spark):
    """Few bytes are many rows where texts compress well: they are not put into few tasks."""
    rows = spark.range(2000).selectExpr("id % 500 AS k", "id AS place", "concat('t', id) AS t")
    found = windows.joined_text(rows, "k", ["place"], "t", 9)
    assert found.where("k = 3").first()["text"] == "t3 t503 t"
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
