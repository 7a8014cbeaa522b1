"""The stored index: equal to looking at every text, the top k by bounds, phrases, headlines, and what a query reads."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillstream.operators import search
from quillstream.storage import new_path

# Words and their stems.
FORMS = {"schools": "school", "school": "school", "schooling": "school", "repayments": "repay", "repay": "repay", "reform": "reform", "reforms": "reform", "floods": "flood", "skills": "skill", "skill": "skill", "reforming": "reform", "flooding": "flood", "the": None, "of": None}


def made(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choice(list(FORMS)) if rng.random() < 0.3 else f"filler{rng.randint(0, 200)}" for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def sections(spark):
    titles = [(i, t) for i, t in enumerate(made(1, 150))]
    speeches = [(1000 + i, i * 7 % 200 if i % 3 else 5, t) for i, t in enumerate(made(2, 600))] + [(5000, 3, None), (5001, 3, "")]
    build = lambda rows, name: search.build(spark.createDataFrame(rows, "key long, owner long, text string"), new_path(spark, name), 8, 16)
    return titles, speeches, build([(i, i, t) for i, t in titles], "titles"), build(speeches, "speeches")


def plain(titles, speeches, query):
    phrase, text = search.query_mode(query)
    stem = lambda w: FORMS.get(w, w)
    wanted = [stem(w) for w in text.lower().split() if w not in search.STOP_WORDS]

    def rank(t):
        words = [stem(w) for w in (t or "").lower().split() if w not in search.STOP_WORDS]
        if not wanted or not set(wanted) <= set(words) or phrase and not any(words[k : k + len(wanted)] == wanted for k in range(len(words))):
            return None
        return sum(w in wanted for w in words) / (1 + math.log1p(len(words)))

    out = {}
    for i, t in titles:
        if (r := rank(t)) is not None:
            out[i] = (3 * r, None)
    best = {}
    for key, owner, t in speeches:
        if (r := rank(t)) is not None:
            best[owner] = max(best.get(owner, (0, 0)), (r, key))
    for owner, (r, key) in best.items():
        out[owner] = (out.get(owner, (0, None))[0] + r, key)
    return {i: (round(r, 6), k) for i, (r, k) in out.items()}


QUERIES = ["school", "repay schools", "the reforming of school", '"school repayments"', '"reforms of the schools"', '"school school school"', "nothing", "the", "", '""', "flooding skill reforms repay"]


@pytest.mark.parametrize("query", QUERIES)
def test_equal_to_every_text(sections, query):
    titles, speeches, a, b = sections
    wanted = plain(titles, speeches, query)
    assert {r["id"]: (r["rank"], r["speech_id"]) for r in search.search(query, a, b).collect()} == {i: (pytest.approx(r, abs=2e-6), k) for i, (r, k) in wanted.items()}
    assert {r["id"] for r in search.search(query, a, None).collect()} == set(plain(titles, [], query))
    assert search.count(query, a, b).first()["n"] == len(wanted)


@pytest.mark.parametrize("k", [1, 7, 1000])
@pytest.mark.parametrize("query", ["school", "reform schools", '"school repayments"', "nothing"])
def test_top_by_bounds(spark, sections, query, k):
    titles, speeches, a, b = sections
    few = spark.range(0, 200, 3)
    for allowed in (None, few):
        every = [tuple(r) for r in search.search(query, a, b, allowed).orderBy(F.desc("rank"), "id").limit(k).collect()]
        assert [tuple(r) for r in search.top(query, k, a, b, allowed, first=1).collect()] == every


def test_bounds_hold_and_leave_blocks_out(sections):
    titles, speeches, a, b = sections
    rows = b.rows(["school", "reform"])
    bound = {r["block"]: r["bound"] for r in search.bounds(rows, ["school", "reform"]).collect()}
    assert len(bound) > 10
    by_block = rows.select("block", F.explode("docs.key").alias("key")).distinct()
    for r in search.hits(rows, ["school", "reform"], False).join(by_block, "key").collect():
        assert r["rank"] <= bound[r["block"]] + 1e-9
    best = max(r["rank"] for r in search.hits(rows, ["school", "reform"], False).collect())
    assert 0 < sum(v >= best for v in bound.values()) < len(bound)


def test_a_query_reads_its_buckets_alone(spark, sections):
    _, _, _, b = sections
    plan = b.rows(["school"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(stem,school)" in plan
    assert len(b.rows(["school"]).inputFiles()) > len({r[0] for r in b.rows(["school"]).select(F.input_file_name()).distinct().collect()}) > 0
    assert "docs" not in search.bounds(b.rows(["school"]), ["school"])._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_stored_once_and_again_when_files_change(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = lambda: spark.read.schema("key long, owner long, text string").parquet(path)
    spark.createDataFrame([(1, 1, "schools reform")], "key long, owner long, text string").write.parquet(path)
    first = search.stored(rows(), "test")
    assert search.stored(rows(), "test").path == first.path and [r["owner"] for r in search.hits(first.rows(["school"]), ["school"], False).collect()] == [1]
    spark.createDataFrame([(2, 2, "a school")], "key long, owner long, text string").write.mode("append").parquet(path)
    second = search.stored(rows(), "test")
    assert second.path != first.path and search.count("school", second, None).first()["n"] == 2


def test_headline_and_filters(spark):
    rows = spark.createDataFrame([("Of one two three four (school-reform) six seven",), ("nothing here",)], "t string")
    assert [r[0] for r in rows.select(search.headline(F.col("t"), ["school", "schools"], 4, 2)).collect()] == ["three four <mark>(school-reform)</mark> six", "nothing here"]
    s = spark.createDataFrame([(1, "Lords", "debate", "Department for Education", False), (2, "Lords", "debate", None, False), (3, "Lords", "debate", "Education", True)], "id long, house string, debate_type string, department string, is_container boolean")
    assert [r["id"] for r in search.allowed(s, house="Lords", department="EDUCATION").collect()] == [1] and search.allowed(s, house="Commons").count() == 0
    empty = search.build(spark.createDataFrame([], "key long, owner long, text string"), new_path(spark, "empty"))
    assert search.search("school", empty, empty).count() == 0 == search.top("school", 3, empty, empty).count()


def test_an_index_shuffles_texts_and_lists_once(spark, tmp_path):
    """Words are not shuffled one by one: what goes through shuffles is a few times the texts, and the index has every word."""
    store = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)

    def shuffled():
        found, stages = 0, store().iterator()
        while stages.hasNext():
            found += stages.next().shuffleWriteBytes()
        return found

    rng = random.Random(3)
    texts = [(i, i, " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 3000)}" for _ in range(400))) for i in range(2000)]
    docs = spark.createDataFrame(texts, "key long, owner long, text string")
    before = shuffled()
    index = search.build(docs, new_path(spark, "once"))
    spread, size = shuffled() - before, sum(len(t) for _, _, t in texts)
    assert spread < 5 * size
    lists = spark.read.parquet(f"{index.path}/postings").select(F.explode("docs").alias("d")).agg(F.sum("d.n"), F.count_distinct("d.key")).first()
    assert tuple(lists) == (800_000, 2000)
