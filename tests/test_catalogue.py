"""Footers against DuckDB's reading of them, schema evolution, and vocabularies from files."""

import datetime
import json

import duckdb
import pytest

from quillstream.sources import catalogue as C


def test_footers_against_duckdb(spark, tmp_path):
    rows = [(i, f"t{i % 5}" if i % 7 else None, float(i), datetime.date(2024, 1, 1 + i % 20), [1.0, 2.0] * (i % 3), i % 2 == 0) for i in range(5000)]
    path = str(tmp_path / "t é")
    spark.createDataFrame(rows, "k long, s string, d double, day date, v array<double>, flag boolean").repartition(3).write.option("parquet.block.size", 20_000).parquet(path)
    found = C.footers(spark, {"t": spark.read.parquet(path)}).collect()
    c = duckdb.connect()
    wanted = c.sql(f"SELECT file_name, row_group_id, split_part(path_in_schema, ',', 1), row_group_num_rows, total_compressed_size, total_uncompressed_size, compression, stats_null_count FROM parquet_metadata('{path}/*.parquet')").fetchall()
    name = lambda f: f.rsplit("/", 1)[1]
    assert len({r[0] for r in wanted}) == 3 and len(found) == len(wanted)
    assert sorted((name(r["file"]), r["row_group"], r["column"], r["rows"], r["compressed"], r["uncompressed"], r["codec"], r["nulls"]) for r in found) == sorted((name(r[0]), r[1], r[2].strip(), *r[3:]) for r in wanted)
    types = {r["column"]: r["type"] for r in found}
    assert types == {"k": "BIGINT", "s": "VARCHAR", "d": "DOUBLE", "day": "DATE", "v": "DOUBLE[]", "flag": "BOOLEAN"}
    one = {r["column"]: r for r in C.catalogue(spark, {"t": spark.read.parquet(path)}).collect()}
    assert (one["k"]["rows"], one["k"]["low"], one["k"]["high"], one["k"]["files"]) == (5000, 0, 4999, 3)
    assert one["s"]["nulls"] == sum(r[1] is None for r in rows) and [one[x]["position"] for x in ("k", "s", "d", "day", "v", "flag")] == list(range(6))


def test_types_of_the_given_tables(spark, sf_dir):
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("events", "embeddings", "orders")}
    c = duckdb.connect()
    for r in C.catalogue(spark, tables).collect():
        kinds = dict(x[:2] for x in c.sql(f"DESCRIBE SELECT * FROM '{sf_dir}/{r['name']}.parquet'").fetchall())
        assert r["type"] == kinds[r["column"]]


def test_evolution(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "x")], "id long, a string").write.parquet(path)
    df = spark.read.parquet(path)
    found = C.catalogue(spark, {"t": df})
    expected = lambda *rows: spark.createDataFrame([("t", *r) for r in rows], "name string, column string, type string")
    more = C.evolution(found, expected(("id", "BIGINT"), ("a", "VARCHAR"), ("b", "BIGINT"), ("c", "DATE")))
    assert sorted(map(tuple, more.collect())) == [("t", "b", "add", None, "BIGINT"), ("t", "c", "add", None, "DATE")]
    assert C.evolved(df, more, "t").schema.simpleString() == "struct<id:bigint,a:string,b:bigint,c:date>"
    assert C.evolution(found, expected(("id", "BIGINT"), ("a", "VARCHAR"))).count() == 0
    with pytest.raises(ValueError, match="a would change"):
        C.evolved(df, C.evolution(found, expected(("id", "BIGINT"), ("a", "BIGINT"))), "t")
    assert {r["change"] for r in C.evolution(found, expected(("id", "BIGINT"))).collect()} == {"extra"}


def test_vocabulary_files(spark, tmp_path):
    data = {"types": ["charity", "trade body"], "weights": {"oral": 4, "written": 1.5}, "areas": {"edu": {"name": "Éducation", "scope": "national"}, "empty": {}}, "none": None}
    (tmp_path / "v.json").write_text(json.dumps(data, ensure_ascii=False), "utf-8")
    read = lambda section, file="v.json": [tuple(r) for r in C.vocabulary_file(spark, f"file://{tmp_path}/{file}", section).orderBy("position").collect()]
    assert read("types") == [(0, "charity", None, None), (1, "trade body", None, None)]
    assert read("weights") == [(0, "oral", 4.0, None), (1, "written", 1.5, None)]
    assert read("areas") == [(0, "edu", None, '{"name": "Éducation", "scope": "national"}'), (1, "empty", None, "{}")]
    assert read("none") == read("absent") == []
    pytest.importorskip("yaml")
    (tmp_path / "v.yaml").write_text("# a comment\ntypes:\n  - charity\n  - 'trade body'\nweights:\n  oral: 4.0\n  written: 1.5\nareas: {}\n")
    assert read("types", "v.yaml") == read("types") and read("weights", "v.yaml") == read("weights") and read("areas", "v.yaml") == []
