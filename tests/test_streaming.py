"""Streams with state: order, restarts, late rows."""

import random
import uuid
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marlstone.sources.workspace import shared_folder
from marlstone.streaming import stateful as S

START = datetime(2024, 1, 1, tzinfo=UTC)
SCHEMA = "id long, user string, ts timestamp, kind string, value double"
END = (-1, "end", START + timedelta(days=3650), "end", None)


def at(minutes):
    return START + timedelta(minutes=minutes)


def made(n, seed=1):
    r = random.Random(seed)
    return [(i, None if r.random() < 0.03 else r.choice("aaab"), None if r.random() < 0.03 else at(3 * i + r.randint(-20, 20)), r.choice("xxy"), None if r.random() < 0.1 else float(r.randint(1, 9))) for i in range(n)]


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def runs_of(rows, gap):
    out, now = [], {}
    for _, user, ts, kind, value in sorted((r for r in rows if r[1] and r[2] and r[3]), key=lambda r: (r[1], r[2], r[3], r[4] or 0)):
        run = now.get(user)
        if run and run[1] == kind and (ts - run[3]).total_seconds() <= gap:
            run[3], run[4], run[5] = ts, run[4] + 1, run[5] + (value or 0)
        else:
            now[user] = run = [user, kind, ts, ts, 1, value or 0.0]
            out.append(run)
    return sorted(tuple(r) for r in out)


def collected(df):
    utc = lambda t: t.astimezone(UTC)
    return sorted((r["user"], r["kind"], utc(r["run_start"]), utc(r["run_end"]), r["n"], r["total"]) for r in df.where("kind <> 'end'").collect())


@pytest.fixture
def folder(spark):
    return shared_folder(spark, "streams")


def test_runs_over_files_out_of_order_and_a_restart(spark, folder):
    rows = made(90)
    session = S.stream_session(spark, 2)

    def drain():
        stream = S.read_files(session, f"{folder}/in", SCHEMA)
        return S.drain(S.runs(stream, "user", "ts", "kind", "value", 600, "1 hour"), f"{folder}/out", f"{folder}/checkpoint")

    for i in range(0, 50, 25):
        put(spark, folder, rows[i : i + 25])
    first = collected(drain())
    put(spark, folder, rows[50:])
    put(spark, folder, [END])
    whole = collected(drain())
    assert whole == runs_of(rows, 600)
    assert 0 < len(first) < len(whole) and set(first) <= set(whole)
    assert collected(drain()) == whole  # nothing new


def test_late_rows_are_dropped(spark, folder):
    session = S.stream_session(spark, 2)
    put(spark, folder, [(0, "a", at(0), "x", 1.0)])
    put(spark, folder, [(1, "a", at(500), "x", 1.0)])
    put(spark, folder, [(2, "a", at(1000), "x", 1.0)])
    put(spark, folder, [(3, "a", at(1), "x", 100.0), (4, "a", at(990), "y", 7.0)])  # over an hour late, and ten minutes late
    put(spark, folder, [END])
    stream = S.read_files(session, f"{folder}/in", SCHEMA)
    out = collected(S.drain(S.runs(stream, "user", "ts", "kind", "value", 60, "1 hour"), f"{folder}/out", f"{folder}/checkpoint"))
    assert [(r[2], r[5]) for r in out] == [(at(0), 1.0), (at(500), 1.0), (at(1000), 1.0), (at(990), 7.0)]


def test_runs_of_many_keys_share_a_buckets_state(spark, folder):
    rows = [(i, f"u{i % 40}", at(7 * i), "xy"[i // 90 % 2], 1.0) for i in range(400)]
    session = S.stream_session(spark, 2)
    for i in range(0, 400, 200):
        put(spark, folder, rows[i : i + 200])
    put(spark, folder, [END])
    stream = S.read_files(session, f"{folder}/in", SCHEMA)
    out = S.drain(S.runs(stream, "user", "ts", "kind", "value", 6 * 3600, "1 hour", buckets=3), f"{folder}/out", f"{folder}/checkpoint")
    assert collected(out) == runs_of(rows, 6 * 3600)


def test_join_of_two_streams(spark, folder):
    rows = made(120, 4)
    session = S.stream_session(spark, 2)
    for i in range(0, 120, 40):
        put(spark, folder, rows[i : i + 40])
    put(spark, folder, [END])
    stream = S.read_files(session, f"{folder}/in", SCHEMA)
    x = stream.where("kind <> 'y'").select("user", F.col("id").alias("x"), F.col("ts").alias("xt"))
    y = stream.where("kind <> 'x'").select("user", F.col("id").alias("y"), F.col("ts").alias("yt"))
    got = sorted((r["x"], r["y"]) for r in S.drain(S.joined_within(x, y, "user", "xt", "yt", "30 MINUTES", "2 hours"), f"{folder}/out", f"{folder}/checkpoint").where("x >= 0").collect())
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[1] and a[1] == b[1] and a[3] == "x" and b[3] == "y" and a[2] and b[2] and a[2] <= b[2] <= a[2] + timedelta(minutes=30))
    assert got == want and want


def test_first_seen_and_turns(spark, folder):
    rows = [r for r in made(60, 6) if r[2]]
    again = [(i, u, t + timedelta(minutes=5), k, v) for i, u, t, k, v in rows[::3]]
    S.write_in_turns(spark.createDataFrame(rows + again, SCHEMA), f"{folder}/in", "ts", 3, 2)
    stream = S.read_files(S.stream_session(spark, 2), f"{folder}/in", SCHEMA, 2)
    out = S.drain(S.first_seen(stream, ["id"], "ts", "2 hours"), f"{folder}/out", f"{folder}/checkpoint").collect()
    assert sorted(r["id"] for r in out) == sorted(r[0] for r in rows)


def test_turns_of_nothing(spark):
    path = shared_folder(spark, f"empty-{uuid.uuid4().hex}")
    S.write_in_turns(spark.createDataFrame([], SCHEMA), path, "ts", 3)
    assert spark.read.schema(SCHEMA).parquet(path).count() == 0
