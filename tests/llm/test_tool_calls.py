import json
import random

import duckdb

from quillstream.llm import tool_calls as T

CALLS = "conv_id long, turn long, index int, call_id string, name string, arguments string, depends_on array<string>, level string"
SCHEMA = {"find": {"required": ["q"], "additionalProperties": False, "properties": {"q": {"type": "string", "maxLength": 5}, "n": {"type": "integer", "minimum": 1, "maximum": 9}, "kind": {"enum": ["a", "b"]}, "f": {"type": "number"}, "list": {"type": "array"}, "flag": {"type": "boolean"}}}}


def linked(spark, calls, results=()):
    c = spark.createDataFrame([(*x, "clash") for x in calls], CALLS)
    r = spark.createDataFrame(list(results), "conv_id long, turn long, call_id string, content string")
    return {(x["conv_id"], x["call_id"]): x for x in T.link(c, r, SCHEMA).collect()}


def test_links_statuses_and_canonical_json(spark):
    got = linked(spark, [
        (1, 0, 0, "a", "find", ' {"q" : "é\\u0041", "n": 3, "f": 1.50, "list": [ {"z":1,"b":null} ]}', None), (1, 0, 1, "b", "find", '{"q":"x"}', ["a", None, "a"]), (1, 2, 0, "b", "find", '{"q":"later"}', []),
        (1, 3, 0, None, "find", '{"q":"x"}', []), (1, 4, 0, None, "find", '{"q":"y"}', []), (None, 0, 0, "a", "find", "not json", []), (2, 0, 0, "a", "other", "{}", ["gone"]), (2, 1, 0, "c", "find", "[1]", []), (2, 2, 0, "d", "find", None, None),
    ], [(1, 1, "a", "one"), (1, 5, "a", "two"), (None, 1, "a", "null conversation"), (3, 0, "zzz", "orphan"), (3, 1, None, None)])
    a = got[1, "a"]
    assert (a["status"], a["n_calls"], a["n_results"], a["errors"], a["level"]) == ("linked", 1, 2, [], 0)
    assert a["json"] == '{"arguments":{"f":1.5,"list":[{"b":null,"z":1}],"n":3,"q":"éA"},"call_id":"a","conv_id":1,"depends_on":[],"errors":[],"level":0,"name":"find","result":"one","status":"linked"}'
    assert (got[1, "b"]["status"], got[1, "b"]["n_calls"], json.loads(got[1, "b"]["json"])["arguments"]) == ("unanswered", 2, {"q": "x"})
    assert {k[1] for k in got if k[0] == 1} == {"a", "b", "unnamed:3:0", "unnamed:4:0"}
    assert got[None, "a"]["errors"] == ["arguments: not an object"] and got[None, "a"]["n_results"] == 1
    assert got[2, "a"]["errors"] == ["unknown tool: other", "unknown dependency: gone"]
    assert got[2, "c"]["status"] == got[2, "d"]["status"] == "invalid"
    assert got[3, "zzz"]["status"] == got[3, "unnamed result:1"]["status"] == "orphan" and len(got) == 10
    for x in got.values():
        assert json.dumps(json.loads(x["json"]), separators=(",", ":"), ensure_ascii=False, sort_keys=True) == x["json"]


def test_schema(spark):
    cases = {'{"q":"ok"}': [], '{"n":0}': ["n: minimum", "q: required"], '{"q":"toolong","n":10}': ["n: maximum", "q: maxLength"], '{"q":1,"f":"x","list":{},"flag":0}': ["f: not number", "flag: not boolean", "list: not array", "q: not string"], '{"q":"x","kind":"c","more":1}': ["kind: enum", "additional properties"], '{"q":"x","n":1.5,"kind":"a","f":2,"flag":true,"list":[]}': ["n: not integer"]}
    got = linked(spark, [(1, i, 0, str(i), "find", text, []) for i, text in enumerate(cases)])
    for i, (text, errors) in enumerate(cases.items()):
        assert got[1, str(i)]["errors"] == errors, text


def test_integers_and_numbers_in_one_form(spark):
    """However an integer is written it is one; equal numbers are written alike, and strings stay as they are."""
    big, text = "12345678901234567890123", r'1e5, 2.0,[3.0E7] \" :4e2,' + r"\n" * 20_000
    ok = {"3": "3", "3.0": "3", "3e0": "3", "0.5e1": "5", "5": "5"}
    got = linked(spark, [(1, i, 0, k, "find", f'{{"q":"x","n":{k}}}', []) for i, k in enumerate(ok)] + [(2, i, 0, k, "find", f'{{"q":"x","n":{k}}}', []) for i, k in enumerate(["3.5", "35e-1", "45e-1", '"3"'])])
    for k, want in ok.items():
        assert got[1, k]["errors"] == [] and got[1, k]["json"].startswith(f'{{"arguments":{{"n":{want},"q":"x"}},'), k
    assert all(got[2, k]["errors"] == ["n: not integer"] for k in ("3.5", "35e-1", "45e-1", '"3"'))
    many = {"1e2": "100", "1.50": "1.5", "-1.5E3": "-1500", "1e30": "1" + "0" * 30, "1" + "0" * 30: "1" + "0" * 30, "1.25e-3": "0.00125", "0.00125": "0.00125", "1e300": "1.0E300", big: big, "-0.0": "0", "0e0": "0", "1e21": "1" + "0" * 21}
    frame = spark.createDataFrame([(k, f'{{"a":[{k},{{"b":{k}}}],"s":"{text}"}}') for k in many], "k string, j string")
    from pyspark.sql import functions as F

    for r in frame.select("k", T.canonical(F.parse_json("j")).alias("c"), F.size(T.schema_errors(F.parse_json("k"), {"type": "integer"})).alias("e")).collect():
        assert r["c"] == f'{{"a":[{many[r["k"]]},{{"b":{many[r["k"]]}}}],"s":"{text}"}}', r["k"]
        assert (r["e"] == 0) == ("." not in many[r["k"]] or "E" in many[r["k"]])


def test_order_follows_dependencies_and_finds_cycles(spark):
    args = '{"q":"x"}'
    calls = [(1, t, 0, f"c{t}", "find", args, [f"c{t + 1}"] if t < 6 else []) for t in range(7)]  # each needs a later one
    calls += [(2, 0, 0, "x", "find", args, ["y"]), (2, 1, 0, "y", "find", args, ["x"]), (2, 2, 0, "z", "find", args, ["y"]), (2, 3, 0, "free", "find", args, []), (3, 0, 0, "s", "find", args, ["s"]), (4, 0, 0, "p", "find", args, []), (4, 1, 0, "q", "find", args, ["p"])]
    got = linked(spark, calls)
    order = sorted((x for x in got.values() if x["conv_id"] == 1), key=lambda x: (x["level"], x["turn"], x["index"]))
    assert [x["call_id"] for x in order] == [f"c{t}" for t in range(6, -1, -1)]
    assert all(got[2, k]["errors"] == ["cyclic"] and got[2, k]["level"] is None for k in "xyz") and got[2, "free"]["level"] == 0 and got[3, "s"]["errors"] == ["cyclic"]
    assert (got[4, "p"]["level"], got[4, "q"]["level"]) == (0, 1)


def test_levels_against_recursion(spark):
    """Random graphs with several dependencies, unknown ones and cycles, and a chain of 300 calls."""
    rng, graphs = random.Random(3), {}
    for conv in range(40):
        n = rng.randint(1, 12)
        graphs[conv] = {i: sorted({rng.randrange(n + 1) for _ in range(rng.randint(0, 3)) if rng.random() < 0.6} if conv % 4 == 0 else {rng.randrange(i) for _ in range(rng.randint(0, 3)) if i}) for i in range(n)}
    graphs[100] = {i: [i + 1] if i < 299 else [] for i in range(300)}
    rows = [(conv, str(i), [str(x) for x in needs]) for conv, graph in graphs.items() for i, needs in graph.items()]

    def level(graph, i, above=()):
        if i in above:
            return None
        below = [level(graph, x, (*above, i)) for x in graph[i] if x in graph]
        return None if None in below else max(below, default=-1) + 1

    rounds = []
    staged, T.staged = T.staged, lambda df, name: rounds.append(name) or staged(df, name)
    try:
        got = {(r["conv_id"], int(r["call_id"])): r["level"] for r in T.levels(spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>")).collect()}
    finally:
        T.staged = staged
    assert len(got) == len(rows) and rounds.count("levels") <= 14
    chain = {(100, i): 299 - i for i in range(300)}
    assert got == {(conv, i): level(graph, i) for conv, graph in graphs.items() for i in graph if conv < 100} | chain


def test_query_against_sql(spark, sf_dir):
    own = T.op1_tool_calls(spark, sf_dir)
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Python" not in plan and "Arrow" not in plan
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    found = duck.sql(T.OP1_SQL)
    rows = [tuple(r[c] for c in found.columns) for r in own.collect()]
    assert sorted(rows, key=repr) == sorted(found.fetchall(), key=repr) and max(r[3] or 0 for r in rows) > 1
    assert any(r[3] and "call-2" == r[1] for r in rows)  # it needs a later call


def test_nested_schema(spark):
    schema = {"type": "object", "required": ["who"], "properties": {
        "who": {"type": "object", "required": ["name"], "additionalProperties": False, "properties": {"name": {"type": ["string", "null"], "pattern": "^[a-z]+$"}, "age": {"type": "integer", "minimum": 0}}},
        "tags": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "object", "properties": {"k": {"enum": ["x", "y"]}}, "required": ["k"]}}, "it's": {"type": "boolean"},
    }}
    cases = {
        '{"who":{"name":"ann","age":3},"tags":[{"k":"x"},{"k":"y"}],"it\'s":true}': [], '{"who":{"name":null}}': [], "{}": ["who: required"], '{"who":[]}': ["who: not object"],
        '{"who":{"name":"Ann","age":-1,"more":1}}': ["who.age: minimum", "who.additional properties", "who.name: pattern"], '{"who":{"age":"x"}}': ["who.age: not integer", "who.name: required"],
        '{"who":{"name":"a"},"tags":[]}': ["tags: minItems"], '{"who":{"name":"a"},"tags":[{"k":"x"},{"k":"z"},{},1]}': ["tags: maxItems", "tags[1].k: enum", "tags[2].k: required", "tags[3]: not object"],
        '{"who":{"name":5},"it\'s":1}': ["it's: not boolean", "who.name: not string or null"],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    for r in df.select("t", T.schema_errors(T.F.try_parse_json("t"), schema).alias("e")).collect():
        assert sorted(r["e"]) == sorted(cases[r["t"]]), r["t"]


def test_empty_and_turns(spark, sf_dir):
    assert linked(spark, []) == {}
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "hello " * 500), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "tool", "x"), (5, 3, "assistant", "late"), (5, 3, "assistant", "late"), (6, 1, None, "nobody"), (6, None, "assistant", "no turn")], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["call_id"]): (r["status"], r["errors"], r["n_calls"]) for r in T.link(*T.from_turns(turns), {"reply": T.REPLY}).collect()}
    assert got[1, "call-1"] == ("invalid", ["words: maximum"], 1) and got[1, "call-3"] == ("invalid", ["text: minLength"], 1)
    assert got[5, "call-3"] == ("invalid", ["unknown dependency: call-1"], 2)
    assert got[6, "unnamed:0"][0] == "invalid"
