import random

import pytest

from quillstream.operators import resolve as R
from quillstream.operators import similarity as S


def sequential(staging, organisations, aliases, distinct=()):
    """Row after row: an exact name, else the closest known or earlier name, else a new organisation."""
    exact = {}
    for o, k in sorted(aliases):
        exact[k] = o
    for o, k in sorted(organisations):
        exact[k] = o
    known = [(k, -1, max(o for o, other in organisations if other == k)) for k in sorted({k for _, k in organisations})]
    out, new = {}, {}
    for i, k in sorted(staging):
        if k in exact:
            out[i] = (1, exact[k], None)
            continue
        if k in new:
            out[i] = new[k]
            continue
        best = max(((R.token_set_similarity(k, other), -since, -(o or 0), other) for other, since, o in known), default=(0, 0, 0, ""))
        close = best[0] >= R.CLOSE and tuple(sorted((k, best[3]))) not in distinct
        out[i] = new[k] = (3, None, best[3]) if close else (4, None, None)
        known.append((k, i, None))
    return out


def test_similarity_of_known_pairs():
    s = R.token_set_similarity
    assert s("national education trust", "national education union") == pytest.approx(0.857, abs=1e-3)
    assert s("ark schools", "lift schools") == pytest.approx(0.778, abs=1e-3)
    assert s("russell group", "the russell group of universities") == 1.0 == s("group russell", "russell group")
    assert s("russel group", "russell group") == pytest.approx(0.96, abs=1e-2) and s("", "x") == 0.0
    plain = lambda a, b: max((len(c) for c in subsequences(a) & subsequences(b)), default=0)
    for a, b in [("abcbdab", "bdcaba"), ("xyz", ""), ("aaa", "aa")]:
        assert R.common_length(a, b) == plain(a, b)


def subsequences(t):
    return {"".join(ch for i, ch in enumerate(t) if m >> i & 1) for m in range(1 << len(t))}


def near_names(n, seed):
    rng = random.Random(seed)
    words = ["russell", "group", "national", "union", "teachers", "education", "trust", "college", "royal", "nursing", "schools", "of", "the"]
    out = []
    for _ in range(n):
        name = " ".join(rng.sample(words, rng.randint(1, 5)))
        if rng.random() < 0.5:
            i = rng.randrange(len(name))
            name = name[:i] + rng.choice(["", "x", name[i] * 2]) + name[i + 1 :]
        out.append(" ".join(name.split()) or "x")
    return out


def test_candidates_lose_no_close_pair(spark):
    names = sorted(set(near_names(150, 1)))
    keys = spark.createDataFrame([(k,) for k in names], "key string")
    found = {(r["key"], r["other"]) for r in R.candidates(keys, keys).collect()}
    close = {(a, b) for a in names for b in names if a != b and R.token_set_similarity(a, b) >= R.CLOSE}
    assert close and close <= found


def test_resolution_equals_row_after_row(spark):
    orgs, staged = list(enumerate(near_names(40, 2))), [(100 + i, k) for i, k in enumerate(near_names(120, 3))]
    aliases = [(900, staged[0][1]), (901, orgs[3][1])]
    pairs = {tuple(sorted((staged[5][1], orgs[7][1])))}
    found = R.resolve(
        spark.createDataFrame(staged, "id long, key string"), spark.createDataFrame(orgs, "id long, key string"), spark.createDataFrame(aliases, "organisation_id long, key string"), spark.createDataFrame(list(pairs), "a string, b string"),
    )
    wanted = sequential(staged, orgs, aliases, pairs)
    assert {r["id"]: (r["tier"], r["match"], r["close_to"]) for r in found.collect()} == wanted
    assert {t for t, _, _ in wanted.values()} == {1, 3, 4}


def test_new_ids_are_dense_and_ordered(spark):
    rows = spark.createDataFrame([(f"n{i:03d}",) for i in random.Random(4).sample(range(200), 200)], "name string")
    got = sorted((r["new_id"], r["name"]) for r in R.new_ids(rows, "name", 1000).collect())
    assert [i for i, _ in got] == list(range(1001, 1201)) and [n for _, n in got] == sorted(n for _, n in got)


def test_rows_fail_alone_and_keep_other_statuses(spark):
    staging = spark.createDataFrame([(1, "russell group", "pending"), (2, "", "pending"), (3, None, "pending"), (4, "royal college", "rejected"), (5, "russel group", "pending")], "id long, key string, status string")
    orgs = spark.createDataFrame([(7, "russell group")], "id long, key string")
    aliases = spark.createDataFrame([], "organisation_id long, key string")
    got = {r["id"]: (r["status"], r["note"], r["tier"], r["match"]) for r in R.process(staging, orgs, aliases).collect()}
    assert got == {1: ("committed", None, 1, 7), 2: ("errored", "no name", None, None), 3: ("errored", "no name", None, None), 4: ("rejected", None, None, None), 5: ("committed", None, 3, None)}
    assert {tuple(r) for r in R.dry_run(staging).collect()} == {("committed", 2), ("errored", 2)}


def test_rows_fail_for_several_reasons(spark):
    rows = [(1, "russell group", "2024-01-05", "oral"), (2, " ", "2024-01-05", "oral"), (3, "royal college", "soon", "unheard"), (4, "royal college", "2024-01-05", "unheard"), (5, "royal college", "2024-01-05", None), (6, "royal college", "2024-02-30", "oral"), (7, "royal college", "2024-01-06", "written")]
    staging = spark.createDataFrame([(*r, "pending") for r in rows], "id long, key string, day string, source string, status string")
    checks = {"no date": R.is_date("day"), "unknown source": R.one_of("source", ["oral", "written"])}
    none = spark.createDataFrame([], "organisation_id long, key string")
    got = {r["id"]: (r["status"], r["note"], r["tier"]) for r in R.process(staging, spark.createDataFrame([(9, "russell group")], "id long, key string"), none, checks=checks).collect()}
    assert got == {1: ("committed", None, 1), 2: ("errored", "no name", None), 3: ("errored", "no date", None), 4: ("errored", "unknown source", None), 5: ("errored", "unknown source", None), 6: ("errored", "no date", None), 7: ("committed", None, 4)}
    assert {tuple(r) for r in R.dry_run(staging, checks).collect()} == {("committed", 2), ("errored", 5)}
    assert R.dry_run(staging, {"empty": R.one_of("source", [])}).collect()[0]["status"] == "errored"


def test_closest_names_against_all_pairs(spark):
    names = near_names(120, 5)
    orgs = spark.createDataFrame(list(enumerate(names)), "id long, name string").repartition(5)
    wanted = [*near_names(6, 9), "qqqq"]
    for block in (4096, 2):
        R.QUERIES, before = block, R.QUERIES
        got = {(r["name"], r["rank"]): (r["id"], r["other"], r["score"]) for r in R.closest(spark.createDataFrame([(x,) for x in wanted], "name string"), orgs).collect()}
        R.QUERIES = before
        expected = {}
        for name in set(wanted):
            best = sorted(((-100 * R.token_set_similarity(name, x), x, i) for i, x in enumerate(names)))[:3]
            expected |= {(name, k): (i, x, -score) for k, (score, x, i) in enumerate(best, 1) if -score >= 45}
        assert got == expected


@pytest.mark.parametrize("seed", [3, 4])
def test_candidates_where_one_name_goes_on(spark, seed):
    """Common words that are nine elevenths of one name, whatever else the other has."""
    names = sorted(set(near_names(60, seed)) | {f"{n} of the national union" for n in near_names(20, seed)} | {f"x {n}" for n in near_names(20, seed + 10)})
    df = spark.createDataFrame([(n,) for n in names], "key string")
    found = {(r["key"], r["other"]) for r in R.candidates(df, df).collect()}
    assert {(a, b) for a in names for b in names if a != b and R.token_set_similarity(a, b) >= R.CLOSE} <= found


def test_lanes_against_the_plain_version(spark):
    rng = random.Random(8)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    pairs = [(text(rng.randint(0, 90), "ab c"), text(rng.randint(0, 90), "abc d")) for _ in range(300)] + [("", ""), ("é日🙂", "日é🙂"), (text(300, "abcde"), text(700, "abcde")), (text(64, "ab"), text(65, "ab")), ("a" * 128, "a" * 127)]
    wanted = [R.common_length(a, b) for a, b in pairs]
    for cells in (S.CELLS, 50):
        S.CELLS, before = cells, S.CELLS
        assert S.common_lengths([a for a, _ in pairs], [b for _, b in pairs]).tolist() == wanted
        S.CELLS = before
    assert S.common_lengths([], []).tolist() == []
    names = near_names(80, 6)
    pairs = [(a, b) for a in names[:30] for b in names] + [("", "x"), ("x", ""), ("", ""), ("a", "a"), ("b a", "a b"), ("  a  b ", "a b c")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[2] for r in df.select("a", "b", R.similarity("a", "b")).collect()] == [R.token_set_similarity(a, b) for a, b in pairs]


@pytest.mark.parametrize("words", [["ab", "cd", "ef", "gh", "ij", "kl"], ["a", "b", "c", "d", "e", "f", "aa"], ["abcde", "abcdf", "abcdefghij", "xbcdefghij", "abcdefghi"]])
def test_candidates_of_short_words(spark, words):
    """Few bigrams a name, so that names meet by single ones too."""
    rng = random.Random(2)
    names = sorted({" ".join(rng.choice(words)[: rng.choice([9, 9, 9, 4, 1])] for _ in range(rng.randint(1, 7))) for _ in range(260)})
    df = spark.createDataFrame([(n,) for n in names], "key string")
    found = {(r["key"], r["other"]) for r in R.candidates(df, df).collect()}
    assert {(a, b) for a in names for b in names if a != b and R.token_set_similarity(a, b) >= R.CLOSE} <= found


def test_pairs_of_five_thousand_names(spark):
    """All pairs of 5,000 names at 0.9: the plain comparison is made for those that letters do not rule out."""
    rng = random.Random(11)
    pool = ["".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(2, 9))) for _ in range(700)]
    names = [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 4))) for _ in range(3500)]
    for n in rng.sample(names, 1500):
        k = rng.randrange(len(n))
        names.append((n[:k] + rng.choice(["", "x", n[k] * 2]) + n[k + 1 :]).strip() or "x")
    names = sorted({" ".join(n.split()) for n in names})
    counts = R._Counts(names)
    wanted = set()
    for i, a in enumerate(names):
        _, most = counts.bounds(counts.words[i], int(counts.sizes[i]), counts.letters[i])
        near = [k for k in (most >= R.CLOSE - 1e-9).nonzero()[0].tolist() if k != i]
        wanted |= {(a, names[k]) for k in near if R.token_set_similarity(a, names[k]) >= R.CLOSE}
    df = spark.createDataFrame([(n,) for n in names], "key string").repartition(8)
    found = R.candidates(df, df).where(R.similarity("key", "other") >= R.CLOSE)
    assert len(wanted) > 1000 and {tuple(r) for r in found.collect()} == wanted


def test_the_queries_against_row_after_row(spark, sf_dir):
    from quillstream.plans import composite
    from quillstream.plans.catalog import QUERIES
    from quillstream.plans.domain import Tables

    t = Tables(spark, sf_dir)
    staged = [(r["id"], r["key"]) for r in composite.names(t).where("source NOT RLIKE '[02468]$'").collect()]
    known = [(r["id"], r["key"]) for r in composite.registered(t).collect()]
    aliases = [(r["organisation_id"], r["key"]) for r in t.alias.select("organisation_id", composite.T.organisation_key(composite.F.col("alias_name")).alias("key")).collect()]
    wanted = sequential([x for x in staged if (x[1] or "").strip()], known, aliases)
    found = {r["id"]: r for r in QUERIES["er_resolve"](spark, sf_dir).collect()}
    assert set(found) == {i for i, _ in staged} and {r["status"] for r in found.values()} <= {"committed", "errored"}
    assert {i: (r["tier"], r["match"], r["close_to"]) for i, r in found.items() if r["status"] == "committed"} == wanted
    organisations = [(r["id"], r["canonical_name"].lower()) for r in t.organisation.collect()]
    got = sorted((r["name"], r["rank"], r["id"], r["other"], r["score"]) for r in QUERIES["o13_did_you_mean"](spark, sf_dir).collect())
    expected = []
    for name in ("custmer#000000042 trust", "customers 7", "zzz", "customer#00000001 plc"):
        best = sorted((-100 * R.token_set_similarity(name, x), x, i) for i, x in organisations)[:3]
        expected += [(name, k, i, x, -s) for k, (s, x, i) in enumerate(best, 1) if -s >= 45]
    assert got == sorted(expected) and got


def test_closest_names_are_dealt_out(spark, sf_dir):
    """A small file is one partition; its names are several tasks' work."""
    names = spark.range(3000).selectExpr("id", "concat('name ', id) AS name").coalesce(1)
    found = R.closest(spark.createDataFrame([("name 12",)], "name string"), names)
    assert "RoundRobinPartitioning(8)" in found._jdf.queryExecution().toString()
    assert [(r["rank"], r["id"], r["score"]) for r in found.collect() if r["rank"] == 1] == [(1, 12, 100.0)]
