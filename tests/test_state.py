"""Keyed state: the same result for one, two and ten micro-batches, ties included."""

import datetime
import random

import pytest

from quillstream.sources import sinks
from quillstream.streaming import incremental, state


def at(hours):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)


def in_files(spark, folder, rows, schema, n):
    """rows, in that order, as a folder of n files that a stream reads one at a time."""
    for k in range(n):
        part = rows[k * len(rows) // n : (k + 1) * len(rows) // n]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


@pytest.mark.parametrize("how", ["state", "table"])
def test_latest_whatever_the_batches(spark, tmp_path, how):
    rng = random.Random(3)
    rows = [(rng.randint(1, 6), at(rng.randint(0, 4)), rng.choice([None, 1, 2, 3]), rng.choice([None, 5, 9]), rng.choice([None, "x", "y"])) for _ in range(60)]
    schema = "k long, ts timestamp_ntz, id long, e long, s string"
    key = lambda r: tuple((v is not None, v) for v in r[1:])
    wanted = {k: max((r for r in rows if r[0] == k), key=key)[1:] for k in {r[0] for r in rows}}
    for n in (1, 2, 10):
        folder = in_files(spark, f"file://{tmp_path}/{how}{n}", rows, schema, n)
        events = incremental.stream(spark, folder, "ts", 1)
        if how == "state":
            found = state.latest(events, ["k"], ["ts", "id"], "latest")
        else:
            found = incremental.upserts(events.withColumn("bucket", incremental.bucket(["k"], 3)), f"file://{tmp_path}/t{n}", ["k"], ["ts", "id"], "u", part="bucket")
        got = {r["k"]: (r["ts"].replace(tzinfo=None), r["id"], r["e"], r["s"]) for r in found.collect()}
        assert got == wanted, n


def test_latest_keeps_values_as_they_are(spark, tmp_path):
    """Long numbers beside nulls, and values that are no numbers, are the row's own."""
    long, nan = (1 << 53) + 1, float("nan")
    rows = [("a", at(0), None, 1.0), ("a", at(1), long, nan), ("b", at(1), long, None), ("b", at(0), None, 2.0)]
    for n in (1, 2):
        folder = in_files(spark, f"file://{tmp_path}/v{n}", rows, "k string, ts timestamp_ntz, id long, value double", n)
        got = {r["k"]: (r["id"], str(r["value"])) for r in state.latest(incremental.stream(spark, folder, "ts", 1), ["k"], ["ts", "id"], "values").collect()}
        assert got == {"a": (long, "nan"), "b": (long, "None")}, n


def fold(events, ttl, end):
    out = (None, None, None, 0)
    for t, _, to in sorted(events):
        out = state.step(out, t, to, ttl)
    return state.expired(out, end, ttl)


def test_staged_states_whatever_the_batches(spark, tmp_path):
    rng = random.Random(5)
    names = ["pending", "pending", "committed", "rejected", "errored", "unheard"]
    rows = [(rng.randint(1, 25), at(24 * rng.randint(0, 3) + rng.randint(0, 20)), i, rng.choice(names)) for i in range(160)]
    rows += [(30, at(0), 1000, "pending"), (31, at(0), 1001, "pending"), (31, at(24 * 6), 1002, "committed"), (32, at(2), 1003, "committed"), (33, at(3), 1004, "pending"), (33, at(3), 1005, "errored"), (33, at(3), 1006, "pending"), (33, at(3), 1007, "rejected")]
    rng.shuffle(rows)
    rows.sort(key=lambda r: r[1] > at(24 * 4))  # nothing is later than the watermark allows
    ttl, end = datetime.timedelta(days=4), at(24 * 6) - datetime.timedelta(days=5)
    wanted = {k: fold([r[1:] for r in rows if r[0] == k], ttl, end) for k in {r[0] for r in rows}}
    assert {w[0] for w in wanted.values()} >= {"pending", "committed", "rejected", "errored"}
    for n in (1, 2, 10):
        folder = in_files(spark, f"file://{tmp_path}/in{n}", rows, "k long, at timestamp_ntz, id long, to string", n)
        found = state.staged_states(incremental.stream(spark, folder, "at", 1), "k", f"file://{tmp_path}/t{n}", f"s{n}", 4, "5 days")
        got = {r["k"]: (r["status"], r["since"] and r["since"].replace(tzinfo=None), r["note"], r["refused"]) for r in found.collect()}
        assert got == wanted, n


def test_pending_rows_expire(spark, tmp_path):
    """Row 1 is pending too long; row 2 comes back after that and its commit is refused, since it had expired before."""
    rows = [(1, at(0), 1, "pending"), (2, at(0), 2, "pending"), (3, at(24 * 20), 3, "pending"), (2, at(24 * 10), 4, "committed"), (4, at(24 * 19), 5, "pending"), (4, at(24 * 20), 6, "committed")]
    for n in (1, 3):
        folder = in_files(spark, f"file://{tmp_path}/in{n}", rows, "k long, at timestamp_ntz, id long, to string", n)
        found = state.staged_states(incremental.stream(spark, folder, "at", 1), "k", f"file://{tmp_path}/t{n}", f"e{n}", 2, "15 days")
        got = {r["k"]: (r["status"], r["note"], r["refused"]) for r in found.collect()}
        assert got == {1: ("errored", "expired", 0), 2: ("errored", "expired", 1), 3: ("pending", None, 0), 4: ("committed", None, 0)}, n


@pytest.mark.parametrize("zone", ["Pacific/Auckland", "America/Lima"])
def test_rows_expire_in_any_time_zone(spark, tmp_path, zone):
    """Watermark 54 hours (America/Lima: 46), two days to expire."""
    last = 78 if zone == "Pacific/Auckland" else 70
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [(1, at(0), 1, "pending"), (2, at(last), 2, "pending"), (3, at(1), 3, None)]
        folder = in_files(spark, f"file://{tmp_path}/in", rows, "k long, at timestamp_ntz, id long, to string", 1)
        found = state.staged_states(incremental.stream(spark, folder, "at", 1), "k", f"file://{tmp_path}/t", "z", 2, "1 day")
        got = {r["k"]: (r["status"], r["note"], r["refused"]) for r in found.collect()}
        assert got == {1: ("errored", "expired", 0) if last == 78 else ("pending", None, 0), 2: ("pending", None, 0), 3: (None, None, 1)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_equal_times_in_a_table(spark, tmp_path):
    rows = [("a", 1, 9), ("a", 1, 5), ("b", None, 3), ("b", 2, 1), ("c", None, None)]
    frame = lambda r: spark.createDataFrame(r, "k string, v long, e long")
    for order in (rows, rows[::-1]):
        target = f"file://{tmp_path}/t{order[0][0]}"
        for r in order:
            sinks.upsert(frame([r]), target, ["k"], newer_by="v")
        assert sorted(map(tuple, sinks.current(spark, target).collect())) == [("a", 1, 9), ("b", 2, 1), ("c", None, None)]
