"""Interval, as-of and edit-distance joins against brute force, with small limits so that heavy keys are cut."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlstone.operators import fuzzy as Z
from marlstone.operators import temporal_joins as J


def rows(n, seed, least=-500, most=500):
    r = random.Random(seed)
    key = lambda: None if r.random() < 0.03 else 0 if r.random() < 0.4 else r.randint(1, 5)
    return [(i, key(), None if r.random() < 0.05 else r.randint(least, most)) for i in range(n)]


@pytest.mark.parametrize("heavy", [10_000, 20])
@pytest.mark.parametrize("keyed", [True, False])
def test_points_in_intervals(spark, heavy, keyed):
    r = random.Random(3)
    points = rows(200, 1)
    spans = [(i, k, s, None if r.random() < 0.05 else (s or 0) + r.choice([0, -3, 1, 2, 7, 64, 65, 900])) for i, k, s in rows(150, 2)]
    p = spark.createDataFrame(points, "p long, k int, at long")
    i = spark.createDataFrame(spans, "i long, k int, s long, e long")
    if not keyed:
        i = i.drop("k")
    on = ["k"] if keyed else []
    got = Counter((x["p"], x["i"]) for x in J.points_in_intervals(p, i, "at", "s", "e", on, unit=8, heavy_rows=heavy).collect())
    want = Counter((a, b) for a, k, t in points for b, m, s, e in spans if t is not None and s is not None and e is not None and s <= t < e and (not keyed or (k is not None and k == m)))
    assert got == want and want


@pytest.mark.parametrize("keyed", [True, False])
def test_sums_in_intervals(spark, keyed):
    r = random.Random(12)
    points = [(i, k, t, float(i)) for i, k, t in rows(300, 10, 0, 20)]
    spans = [(i, k, s, (s or 0) + r.choice([0, 1, 4])) for i, k, s in rows(300, 11, 0, 20)]
    p, i = spark.createDataFrame(points, "p long, k int, at long, v double"), spark.createDataFrame(spans, "i long, k int, s long, e long")
    got = J.sums_in_intervals(p, i if keyed else i.drop("k"), "at", "s", "e", {"v": "total"}, "n", ["k"] if keyed else [], unit=8)
    want = {}
    for b, m, s, e in spans:
        held = [v for _, k, t, v in points if t is not None and s is not None and s <= t < e and (not keyed or (k is not None and k == m))]
        if held:
            want[b] = (len(held), sum(held))
    assert {x["i"]: (x["n"], x["total"]) for x in got.collect()} == want and got.count() == len(want)


def test_no_nested_loop(spark):
    p, i = spark.range(100).selectExpr("id as at"), spark.range(100).selectExpr("id as s", "id + 3 as e")
    plan = J.points_in_intervals(p, i, "at", "s", "e", unit=4)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("heavy", [10_000, 15])
def test_overlapping_intervals(spark, heavy):
    r = random.Random(5)
    a = [(i, k, s or 0, (s or 0) + r.choice([0, 1, 5, 40, 300])) for i, k, s in rows(120, 6)]
    b = [(i, k, s or 0, (s or 0) + r.choice([-1, 1, 5, 40, 300])) for i, k, s in rows(120, 7)]
    x = spark.createDataFrame(a, "a long, k int, s long, e long")
    y = spark.createDataFrame(b, "b long, k int, u long, v long")
    got = Counter((z["a"], z["b"]) for z in J.overlapping_intervals(x, y, "s", "e", "u", "v", ["k"], unit=4, heavy_rows=heavy).collect())
    assert got == Counter((i, j) for i, k, s, e in a for j, m, u, v in b if k is not None and k == m and s < e and u < v and s < v and u < e)


@pytest.mark.parametrize("heavy", [10_000, 25, 3])
@pytest.mark.parametrize("tolerance", [None, 30])
def test_as_of(spark, heavy, tolerance):
    left, right = rows(300, 8), rows(250, 9)
    right += [(1000 + i, 0, 77) for i in range(4)]  # ties at one time: the greatest value wins
    df = spark.createDataFrame(left, "l long, k int, at long")
    other = spark.createDataFrame(right, "r long, k int, rt long")
    got = {x["l"]: (x["rt"], x["r"]) for x in J.as_of(df, other, "at", "rt", ["k"], ["r"], tolerance, heavy).collect()}
    assert len(got) == len(left)
    for i, k, at in left:
        found = [(t, v) for v, m, t in right if k is not None and m == k and t is not None and at is not None and t <= at]
        best = max(found, default=(None, None))
        if tolerance is not None and best[0] is not None and at - best[0] > tolerance:
            best = (None, None)
        assert got[i] == best, (i, k, at)
    assert J.as_of(df.limit(0), other, "at", "rt", ["k"], ["r"]).collect() == []
    assert {x["r"] for x in J.as_of(df, other.limit(0), "at", "rt", ["k"], ["r"]).collect()} == {None}


def distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        line, last = [i], line
        for j, y in enumerate(b, 1):
            line.append(min(last[j] + 1, line[-1] + 1, last[j - 1] + (x != y)))
    return line[-1]


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_similar_texts(spark, k):
    r = random.Random(k)
    texts = {"".join(r.choice("abü😀") for _ in range(r.randint(0, 9))) for _ in range(120)} | {"", "a", "abcdefghij", "abcdefghiJ", "xabcdefghij"}
    df = spark.createDataFrame([(x,) for x in texts] * 2 + [(None,)], "text string")
    got = {(x[0], x[1]): x[2] for x in Z.similar_pairs(df, k, heavy_rows=50).collect()}
    order = lambda t: t.encode()
    assert got == {(a, b): distance(a, b) for a in texts for b in texts if order(a) < order(b) and distance(a, b) <= k}
    assert Z.similar_texts(df, df.limit(0), k).collect() == []


def test_salted_join_keeps_all_pairs(spark):
    a = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("x"))
    b = spark.range(7).select((F.col("id") % 4).alias("k"), F.col("id").alias("y"))
    assert J.salted_join(a, b, ["k"], 50).count() == a.join(b, "k").count()
