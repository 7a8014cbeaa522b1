"""Bulk load into a database and reading it back: tasks that fail half way, keys that are there, ranges and filters."""

import sqlite3

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from quillstream.sources import database as D


@pytest.fixture
def file(tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id INTEGER, name TEXT, n REAL)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, "old", None) for i in range(0, 100, 10)])
    return {"database": path, "timeout": 60}


TABLES = "SELECT name FROM sqlite_master WHERE type = 'table'"


def rows(file, sql="SELECT id, name, n FROM t ORDER BY id, name"):
    with sqlite3.connect(file["database"]) as db:
        return db.execute(sql).fetchall()


def test_new_keys_are_added_once(spark, file):
    df = spark.range(3000).select("id", F.concat(F.lit("é"), "id").alias("name"), (F.col("id") / 2).alias("n")).repartition(6)
    again = df.union(df.where("id < 50"))  # equal keys in the source too
    assert D.load(again, "t", ["id"], file) == {"before": 10, "added": 2990, "after": 3000, "there": 3000}
    assert rows(file) == [(i, "old", None) if i < 100 and i % 10 == 0 else (i, f"é{i}", i / 2) for i in range(3000)]
    assert D.load(again, "t", ["id"], file)["added"] == 0 and rows(file, TABLES) == [("t",)]
    assert D.load(df.limit(0), "t", ["id"], file)["added"] == 0


def test_a_task_that_fails_half_way_leaves_nothing(spark, file):
    def fails(frames):
        for frame in frames:
            yield frame
            if TaskContext.get().partitionId() == 1:
                raise RuntimeError("half way")

    df = spark.range(4000).select("id", F.lit("x").alias("name"), F.lit(1.0).alias("n")).repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "600")
    try:
        with pytest.raises(Exception, match="half way"):
            D.load(df.mapInPandas(fails, "id long, name string, n double"), "t", ["id"], file)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows(file)) == 10 and rows(file, TABLES) == [("t",)]
    assert D.load(df, "t", ["id"], file)["after"] == 4000 and len({r[0] for r in rows(file)}) == 4000


def test_attempts_that_do_not_count_add_nothing(file):
    """An attempt that wrote its rows and was then lost: another attempt's message is the one that comes."""
    from pyspark.sql.types import _parse_datatype_string

    options = {"table": "t", "keys": '["id"]', "arguments": __import__("json").dumps(file), "staging": "s"}
    with sqlite3.connect(file["database"]) as db:
        db.execute("CREATE TABLE s AS SELECT *, '' AS quillstream_label FROM t WHERE 0")
        db.executemany("INSERT INTO s VALUES (?, ?, ?, ?)", [(1, "lost", 1.0, "0-a"), (1, "counts", 1.0, "0-b"), (2, "lost too", 1.0, "0-c")])
    D.TableWriter(options, _parse_datatype_string("id long, name string, n double")).commit([D.Loaded("0-b", 1), None])
    assert (1, "counts", 1.0) in rows(file) and len(rows(file)) == 11 and rows(file, TABLES) == [("t",)]


def test_read_in_ranges_with_filters(spark, file):
    with sqlite3.connect(file["database"]) as db:
        db.execute("INSERT INTO t VALUES (NULL, 'no key', 2.5)")
    df = D.read_table(spark, "t", "id long, name string, n double", "id", file, partitions=3)
    assert df.rdd.getNumPartitions() == 3 and sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, rows(file)))
    assert {r["id"] for r in df.where("id > 40 AND name = 'old'").collect()} == {50, 60, 70, 80, 90}
    with sqlite3.connect(file["database"]) as db:
        db.execute("DELETE FROM t")
    assert df.count() == 0


def test_steps_of_a_commit_grow_with_the_rows(tmp_path, monkeypatch):
    """A table without an index on its keys isn't read once for each new row."""
    import json

    from pyspark.sql.types import _parse_datatype_string

    file, steps = {"database": str(tmp_path / "y.db")}, []
    with sqlite3.connect(file["database"]) as db:
        db.execute("CREATE TABLE t (id INTEGER, name TEXT)")
        db.execute("CREATE TABLE s (id INTEGER, name TEXT, quillstream_label TEXT)")
        db.executemany("INSERT INTO t VALUES (?, 'old')", [(i,) for i in range(5000)])
        db.executemany("INSERT INTO s VALUES (?, 'new', ?)", [(i, f"l{i % 600}") for i in range(10_000)])

    def connect(options):
        found = sqlite3.connect(file["database"])
        found.set_progress_handler(lambda: steps.append(1), 10_000)
        return found

    monkeypatch.setattr(D, "connect", connect)
    options = {"table": "t", "keys": '["id"]', "arguments": json.dumps(file), "staging": "s"}
    D.TableWriter(options, _parse_datatype_string("id long, name string")).commit([D.Loaded(f"l{k}", 17) for k in range(599)])
    assert len(steps) * 10_000 < 500 * 10_000
    lost = [(i, "new") for i in range(5000, 10_000) if i % 600 < 599]
    assert rows(file, "SELECT id, name FROM t ORDER BY id") == [(i, "old") for i in range(5000)] + lost
