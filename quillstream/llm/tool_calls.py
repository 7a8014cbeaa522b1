"""Chat formatting, tool-call linking: calls and results are joined by identifier, ordered so that each call follows those it
depends on, validated against the tools' schemas, and written as canonical JSON. DataFrame functions alone.

Calls and results are each reduced to one row per (conversation, identifier) before the hash join, so repeated identifiers meet
pre-aggregated. JSON becomes canonical by way of the variant type, which keeps object keys in order and escapes in one form; numbers
of equal value get one form (`canonical`). A call's level is the length of its longest chain of dependencies. Levels come from rounds in which calls without
open dependencies settle and chains are halved (a dependency on a call that itself waits for one other becomes one on that
other), so a chain of n calls takes about log2(n) rounds; where calls wait for several others each, a round settles a level.

Defined cases: null ids of conversations are one conversation; a call or result without identifier is named after its place and links to nothing; the first of
repeated calls or results (by turn, then index, then text) counts and `n_calls`, `n_results` tell; arguments that are not a
JSON object (or exceed the variant's size) are invalid; an unknown tool, an unknown dependency and a cycle (or waiting for one)
are errors of the call; an unknown dependency adds nothing to a level, a cyclic call has none; results without a call have
status orphan; a schema's keywords that are not named in `schema_errors` are ignored; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import staged, table

#: JSON Schema types as the variant's types (Spark names them in capitals).
TYPES = {"string": "STRING", "integer": "BIGINT|DOUBLE|DECIMAL.*|FLOAT", "number": "BIGINT|DOUBLE|DECIMAL.*|FLOAT", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}


def _problem(bad: Column, name: Column, text: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.concat(name, F.lit(f": {text}")))


def _names(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else _none()


def _whole(value: Column, kind: Column) -> Column:
    """Whether a number is an integer, however it is written: 3, 3.0 and 3e0 are, and so are integers of any length."""
    return F.when(kind.rlike("^(DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double") % 1 == 0).otherwise(~F.contains(F.to_json(value), F.lit(".")))


#: A string in JSON (loops that never go back, so of any length), and a number as to_json writes it.
STRING, NUMBER = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', r"-?[0-9]+(?:\.[0-9]+)?(?:E-?[0-9]+)?"


def _one_form(number: Column) -> Column:
    """A number without an exponent and without zeros after its digits, if 38 digits can hold it exactly."""
    d = number.try_cast("double")
    exact = F.when(F.abs(d) < 1e8, number.try_cast("decimal(38,30)").cast("string")).when(F.abs(d) < 1e28, number.try_cast("decimal(38,10)").cast("string")).otherwise(number.try_cast("decimal(38,0)").cast("string"))
    plain = F.when(F.contains(exact, F.lit(".")), F.regexp_replace(exact, r"\.?0+$", "")).otherwise(exact)
    return F.when(~F.contains(number, F.lit("E")) & ~number.endswith(".0"), number).when(plain.try_cast("double") == d, plain).otherwise(number)


def _woven(between: Column, found: Column, each: Callable[[Column], Column]) -> Column:
    """The pieces between what was found, and each of what was found, in turn."""
    return F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(each(b), F.lit("")))), "")


def canonical(value: Column) -> Column:
    """A variant as JSON: keys in order, no spaces, and one form for equal numbers (1.0, 1e0 and 1 are 1). Only doubles need more than to_json; what it writes for them is mended outside of strings."""
    text = F.to_json(value)
    numbers = lambda piece: _woven(F.split(piece, NUMBER, -1), F.regexp_extract_all(piece, F.lit(NUMBER), F.lit(0)), _one_form)
    pieces = F.transform(F.split(text, STRING, -1), numbers)
    mended = _woven(pieces, F.regexp_extract_all(text, F.lit(STRING), F.lit(0)), lambda s: s)
    return F.when(text.rlike(r"[0-9]E-?[0-9]|[0-9]\.0(?![0-9])"), mended).otherwise(text)


def _none() -> Column:
    return F.array().cast("array<string>")


def schema_errors(value: Column, schema: dict, name: Column | None = None) -> Column:
    """Array of what is wrong with a variant, by a JSON Schema: type (or a list of them), enum, minimum, maximum, minLength, maxLength, pattern,
    properties, required, additionalProperties, items, minItems, maxItems; properties and items to any depth. A name is a path, such as a.b[2]."""
    at = (lambda part: F.concat(name, F.lit("."), F.lit(part))) if name is not None else (lambda part: F.lit(part))
    name, kind, out = name if name is not None else F.lit("value"), F.schema_of_variant(value), []
    deeper = []
    if "type" in schema:
        types = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
        fits = kind.rlike(f"^({'|'.join(TYPES[x] for x in types)})")
        if "integer" in types and "number" not in types:
            fits &= ~kind.rlike(f"^({TYPES['integer']})") | _whole(value, kind)
        out.append(_problem(value.isNotNull() & ~fits, name, f"not {' or '.join(types)}"))
    if "enum" in schema:
        out.append(_problem(~F.to_json(value).isin(*(F.to_json(F.parse_json(F.lit(json.dumps(x)))) for x in schema["enum"])), name, "enum"))
    number = F.when(kind.rlike(f"^({TYPES['number']})"), F.try_variant_get(value, "$", "double"))
    if "minimum" in schema:
        out.append(_problem(number < schema["minimum"], name, "minimum"))
    if "maximum" in schema:
        out.append(_problem(number > schema["maximum"], name, "maximum"))
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    if "minLength" in schema:
        out.append(_problem(F.length(text) < schema["minLength"], name, "minLength"))
    if "maxLength" in schema:
        out.append(_problem(F.length(text) > schema["maxLength"], name, "maxLength"))
    if "pattern" in schema:
        out.append(_problem(~text.rlike(schema["pattern"]), name, "pattern"))
    properties, is_object = schema.get("properties", {}), kind.startswith("OBJECT")
    for part in sorted(set(properties) | set(schema.get("required", []))):
        own = F.try_variant_get(value, "$[" + json.dumps(part) + "]" if "'" in part else f"$['{part}']", "variant")
        if part in schema.get("required", []):
            deeper.append(F.filter(F.array(_problem(is_object & own.isNull(), at(part), "required")), lambda x: x.isNotNull()))
        if part in properties:
            deeper.append(F.when(own.isNotNull(), schema_errors(own, properties[part], at(part))).otherwise(_none()))
    if schema.get("additionalProperties") is False:
        more = F.size(F.array_except(F.json_object_keys(F.to_json(value)), _names(sorted(properties)))) > 0
        deeper.append(F.when(is_object & more, F.array(at("additional properties"))).otherwise(_none()))
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))
    if "minItems" in schema:
        out.append(_problem(F.size(items) < schema["minItems"], name, "minItems"))
    if "maxItems" in schema:
        out.append(_problem(F.size(items) > schema["maxItems"], name, "maxItems"))
    if isinstance(schema.get("items"), dict):
        each = F.flatten(F.transform(items, lambda x, i: schema_errors(x, schema["items"], F.concat(name, F.lit("["), i.cast("string"), F.lit("]")))))
        deeper.append(F.coalesce(each, _none()))
    own = F.filter(F.array(*out), lambda x: x.isNotNull()) if out else _none()
    return F.concat(own, *deeper) if deeper else own


#: No chain is longer; distances around a cycle stay below.
_FAR = 1 << 40


def levels(calls: DataFrame) -> DataFrame:
    """calls: conv_id, call_id (a row each), depends_on. Returns conv_id, call_id, level (null: cyclic, or waiting for a cycle)."""
    node = F.struct("conv_id", "call_id")
    every = calls.select(node.alias("node"))
    edges = calls.select(node.alias("node"), "conv_id", F.explode("depends_on").alias("call_id")).select("node", node.alias("needs")).distinct()
    edges = staged(edges.join(every.withColumnRenamed("node", "needs").hint("shuffle_hash"), "needs", "left_semi").withColumn("distance", F.lit(1).cast("long")), "edges")
    open_ = every.withColumn("low", F.lit(0).cast("long"))  # the longest chain to calls that have settled
    done: list[DataFrame] = []
    while True:
        waits = edges.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("needs").alias("next"), F.min("distance").alias("step"))
        state = staged(open_.join(waits.hint("shuffle_hash"), "node", "left"), "levels")
        settled = state.where("n IS NULL").select("node", F.col("low").alias("level"))
        if settled.isEmpty():
            break
        done.append(settled)
        if len(done) == 50:  # one table again, so that plans stay small
            done = [staged(reduce(DataFrame.unionByName, done), "settled")]
        # A call that waits for one other alone hands that one on; then what has settled is taken in.
        chained = state.where("n = 1").select(F.col("node").alias("needs"), F.col("low").alias("_low"), "next", "step")
        far = lambda c: F.when(c > _FAR, F.lit(_FAR)).otherwise(c)  # noqa: E731 (least() would make _FAR of a null)
        moved = edges.join(chained.hint("shuffle_hash"), "needs", "left").select("node", F.coalesce("next", "needs").alias("needs"), far(F.col("_low") + F.col("distance")).alias("_low"), far(F.col("distance") + F.coalesce("step", F.lit(0))).alias("distance"))
        found = staged(moved.join(settled.withColumnRenamed("node", "needs").hint("shuffle_hash"), "needs", "left"), "edges")
        lows = found.groupBy("node").agg(F.max(far(F.greatest(F.col("_low"), F.col("level") + F.col("distance")))).alias("_more"))
        open_ = state.where("n IS NOT NULL").join(lows.hint("shuffle_hash"), "node", "left").select("node", F.greatest("low", "_more").alias("low"))
        edges = found.where("level IS NULL").groupBy("node", "needs").agg(F.max("distance").alias("distance"))
    cyclic = state.select("node", F.lit(None).cast("long").alias("level"))
    return reduce(DataFrame.unionByName, [*done, cyclic]).select("node.*", F.col("level").cast("int").alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls: conv_id, turn, index, call_id, name, arguments (JSON text), depends_on (array of identifiers). results: conv_id, turn, call_id, content.

    schemas: JSON Schema by tool; a registry of tools, not data. Returns one row per identifier: conv_id, call_id, turn, index, level, name, status,
    errors, n_calls, n_results and json. Sorted by level, turn and index the calls of a conversation follow their dependencies.
    """
    key = ["conv_id", "call_id"]
    calls = calls.withColumn("call_id", F.coalesce("call_id", F.concat_ws(":", F.lit("unnamed"), F.col("turn"), F.col("index"))))
    results = results.withColumn("call_id", F.coalesce("call_id", F.concat_ws(":", F.lit("unnamed result"), F.col("turn"))))
    first = F.min(F.struct("turn", "index", "name", "arguments", "depends_on"))
    one = calls.withColumn("depends_on", F.coalesce(F.array_sort(F.array_distinct(F.array_compact("depends_on"))), _none())).groupBy(*key).agg(first.alias("_"), F.count(F.lit(1)).alias("n_calls")).select(*key, "_.*", "n_calls")
    answered = results.groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("_"), F.count(F.lit(1)).alias("n_results")).select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call"), F.col("_.turn").alias("r_turn"), F.col("_.content").alias("result"), "n_results")
    joined = one.withColumn("_call", F.lit(True)).join(answered.hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("call_id") == F.col("r_call")), "full")
    ranks = levels(one.select(*key, "depends_on")).select(F.col("conv_id").alias("l_conv"), F.col("call_id").alias("l_call"), F.col("level").alias("_level"))
    parsed = F.try_parse_json("arguments")
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    by_tool = F.array(F.concat(F.lit("unknown tool: "), F.coalesce("name", F.lit("null"))))
    for tool, schema in sorted(schemas.items()):
        by_tool = F.when(F.col("name") == tool, schema_errors(parsed, schema)).otherwise(by_tool)
    errors = F.when(F.col("_call").isNull(), _none()).when(~is_object, F.array(F.lit("arguments: not an object"))).otherwise(by_tool)
    missing = _unknown(one)
    whole = (
        joined.join(ranks.hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("l_conv")) & (F.col("call_id") == F.col("l_call")), "left")
        .join(missing.hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("m_conv")) & (F.col("call_id") == F.col("m_call")), "left")
        .withColumn("errors", F.concat(errors, F.coalesce(F.transform("unknown", lambda x: F.concat(F.lit("unknown dependency: "), x)), _none()), F.when(F.col("_call") & F.col("_level").isNull(), F.array(F.lit("cyclic"))).otherwise(_none())))
        .withColumnRenamed("_level", "level")
    )
    status = F.when(F.col("_call").isNull(), "orphan").when(F.size("errors") > 0, "invalid").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    rest = F.to_json(F.struct(
        F.coalesce("call_id", "r_call").alias("call_id"), F.coalesce("conv_id", "r_conv").alias("conv_id"), "depends_on", "errors", "level", "name", "result", "status",
    ), {"ignoreNullFields": "false"})
    # "arguments" is the first key.
    written = F.concat(F.lit('{"arguments":'), F.coalesce(F.when(is_object, canonical(parsed)), F.lit("null")), F.lit(","), F.substr(rest, F.lit(2)))
    return whole.withColumn("status", status).withColumn("json", written).select(
        F.coalesce("conv_id", "r_conv").alias("conv_id"), F.coalesce("call_id", "r_call").alias("call_id"), F.coalesce("turn", "r_turn").alias("turn"), "index", "level", "name", "status", "errors",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), "json",
    )


def _unknown(calls: DataFrame) -> DataFrame:
    """The dependencies of each call that its conversation doesn't have."""
    needs = calls.select("conv_id", "call_id", F.explode("depends_on").alias("needs"))
    there = calls.select(F.col("conv_id").alias("c"), F.col("call_id").alias("id"))
    lost = needs.join(there, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("needs") == F.col("id")), "left_anti")
    return lost.groupBy(F.col("conv_id").alias("m_conv"), F.col("call_id").alias("m_call")).agg(F.array_sort(F.collect_set("needs")).alias("unknown"))


#: The schema that op1 gives the calls it reads out of conversations.
REPLY = {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "words": {"type": "integer", "maximum": 400}}}


def from_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: an assistant's turn calls the tool `reply` with its text; another role's turn is the result of the call one turn before.

    A call in an odd turn needs the call two turns before; one in an even turn (after a system's turn) needs the one two turns later, unless it is its conversation's last.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    name = lambda t: F.concat(F.lit("call-"), t.cast("string"))
    arguments = F.to_json(F.struct("turn", "text", F.size(F.split("text", " ")).alias("words")))
    assistant = F.col("role") == "assistant"
    even = F.col("turn") % 2 == 0
    last = rows.where(assistant & even).groupBy(F.col("conv_id").alias("l_conv")).agg(F.max("turn").alias("last"))
    asked = rows.where(assistant).join(last.hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("l_conv")), "left")
    needs = F.when(even & (F.col("turn") < F.col("last")), F.array(name(F.col("turn") + 2))).when(~even & (F.col("turn") > 2), F.array(name(F.col("turn") - 2))).otherwise(_none())
    calls = asked.select("conv_id", "turn", F.lit(0).alias("index"), name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), needs.alias("depends_on"))
    results = rows.where(~assistant & (F.col("turn") > 0)).select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = from_turns(table(spark, sf_dir, "conversations"))
    found = link(calls, results, {"reply": REPLY})
    return found.select("conv_id", "call_id", "turn", "level", "name", "status", F.array_join("errors", "; ").alias("errors"), "n_calls", "n_results", "json")


#: op1's rows by SQL.
OP1_SQL = """
WITH RECURSIVE
     c AS (SELECT conv_id, turn, 'call-' || turn AS call_id, text, CASE WHEN turn % 2 = 0 AND turn < max(CASE WHEN turn % 2 = 0 THEN turn END) OVER (PARTITION BY conv_id) THEN 'call-' || (turn + 2) WHEN turn % 2 = 1 AND turn > 2 THEN 'call-' || (turn - 2) END AS needs,
                  CAST(length(text) - length(replace(text, ' ', '')) + 1 AS BIGINT) AS words FROM conversations WHERE role = 'assistant'),
     c1 AS (SELECT conv_id, call_id, min({'turn': turn, 'text': text, 'words': words, 'needs': needs}) AS s, count(*) AS n_calls FROM c GROUP BY ALL),
     e1 AS (SELECT a.conv_id, a.call_id, a.s.needs AS needs FROM c1 a JOIN c1 b ON b.conv_id = a.conv_id AND b.call_id = a.s.needs),
     l AS (SELECT conv_id, call_id, 0 AS level FROM c1 WHERE NOT EXISTS (SELECT 1 FROM e1 WHERE e1.conv_id = c1.conv_id AND e1.call_id = c1.call_id)
           UNION ALL SELECT e1.conv_id, e1.call_id, l.level + 1 FROM l JOIN e1 ON e1.conv_id = l.conv_id AND e1.needs = l.call_id),
     r AS (SELECT conv_id, 'call-' || (turn - 1) AS call_id, min({'turn': turn, 'content': text}) AS s, count(*) AS n_results
           FROM conversations WHERE role <> 'assistant' AND turn > 0 GROUP BY ALL),
     j AS (SELECT coalesce(c1.conv_id, r.conv_id) AS conv_id, coalesce(c1.call_id, r.call_id) AS call_id, c1.s AS s, r.s AS r,
                  coalesce(c1.n_calls, 0) AS n_calls, coalesce(r.n_results, 0) AS n_results,
                  c1.s.needs IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c1 d WHERE d.conv_id = c1.conv_id AND d.call_id = c1.s.needs) AS lost
           FROM c1 FULL JOIN r ON c1.conv_id = r.conv_id AND c1.call_id = r.call_id),
     e AS (SELECT j.*, l.level, CASE WHEN s IS NULL THEN CAST([] AS VARCHAR[]) ELSE list_filter([
                  CASE WHEN s.text IS NULL THEN 'text: required' END, CASE WHEN s.text = '' THEN 'text: minLength' END,
                  CASE WHEN s.turn < 0 THEN 'turn: minimum' END, CASE WHEN s.words > 400 THEN 'words: maximum' END,
                  CASE WHEN lost THEN 'unknown dependency: ' || s.needs END], lambda x: x IS NOT NULL) END AS errors FROM j LEFT JOIN l ON l.conv_id = j.conv_id AND l.call_id = j.call_id),
     t AS (SELECT *, CASE WHEN s IS NULL THEN 'orphan' WHEN len(errors) > 0 THEN 'invalid' WHEN n_results = 0 THEN 'unanswered' ELSE 'linked' END AS status FROM e)
SELECT conv_id, call_id, coalesce(s.turn, r.turn) AS turn, CAST(level AS INTEGER) AS level,
       CASE WHEN s IS NOT NULL THEN 'reply' END AS name, status, array_to_string(errors, '; ') AS errors, n_calls, n_results,
       '{"arguments":' || CASE WHEN s IS NULL THEN 'null' ELSE '{"text":' || to_json(s.text) || ',"turn":' || s.turn || ',"words":' || s.words || '}' END
           || ',"call_id":"' || call_id || '","conv_id":' || conv_id || ',"depends_on":' || CASE WHEN s IS NULL THEN 'null' WHEN s.needs IS NULL THEN '[]' ELSE '["' || s.needs || '"]' END
           || ',"errors":' || to_json(errors) || ',"level":' || coalesce(CAST(level AS VARCHAR), 'null') || ',"name":' || CASE WHEN s IS NULL THEN 'null' ELSE '"reply"' END
           || ',"result":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || ',"status":"' || status || '"}' AS json
FROM t
"""
