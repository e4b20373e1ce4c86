"""Boosted rankers on planted data that no linear score ranks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import models as L
from marlstone.operators import rankers as K


@pytest.fixture(scope="module")
def planted(spark):
    r = np.random.default_rng(5)
    rows = []
    for g in range(60):
        for i in range(1500 if g == 0 else 25):
            a, b, c = (float(v) for v in r.normal(size=3))
            rows.append((g, g * 10_000 + i, int(r.random() < (0.85 if a * b > 0.2 else 0.1)), a, b, c, g % 3))
    return spark.createDataFrame(rows, "g long, item long, label int, a double, b double, c double, fold int").repartition(4).cache()


def test_beats_a_linear_ranker(spark, planted):
    train, test = planted.where("fold <> 0"), planted.where("fold = 0")
    ranker = K.tree_ranker(train, "g", "label", ["a", "b", "c"], K.Settings(depth=3), rounds=8)
    trees = K.ndcg(ranker.score(test), "g", "label", "rank_score", "item")
    linear = L.rank_scores(test, ["a", "b", "c"], L.pairwise_ranker(train, "g", "label", "item", ["a", "b", "c"]))
    linear = test.join(linear.select("item", "rank_score"), "item")
    assert trees > K.ndcg(linear, "g", "label", "rank_score", "item") + 0.1


def test_gradients_are_those_of_all_pairs(spark):
    rows = [(1, 1, 0.3), (1, 0, 0.5), (1, 1, -0.2), (1, 0, 0.0), (1, 0, 1.0), (2, 1, 0.1), (None, 1, 0.0)]
    df = spark.createDataFrame(rows, "g long, label int, s double")
    got = {(r["label"], r["s"]): r["_weight"] * r["_sign"] for r in K.pairwise_gradients(df, "g", "label", "s").collect()}
    own = rows[:5]
    pairs = [(p, n) for p in own for n in own if p[1] > n[1]]
    for row in own:
        total = sum((row is p) * np.exp(n[2] - p[2]) - (row is n) * np.exp(n[2] - p[2]) for p, n in pairs) / len(pairs)
        assert got[(row[1], row[2])] == pytest.approx(total)
    assert len(got) == 5


def test_successive_halving_keeps_the_better(spark, planted):
    small = planted.where("g > 0")
    best, trials = K.successive_halving(small, "g", "label", "item", ["a", "b", "c"], [K.Settings(depth=1), K.Settings(depth=3)], "fold", 1, rounds=2)
    assert best.settings.depth == 3
    assert [(t.settings.depth, t.rounds) for t in trials] == [(1, 2), (3, 2), (3, 6)]


def test_without_pairs(spark, planted):
    none = K.tree_ranker(planted.where("label = 1"), "g", "label", ["a"], rounds=2)
    assert none.trees == [] and none.score(planted.limit(3)).agg(F.max("rank_score")).first()[0] == 0
    assert K.ndcg(planted.where("label = 0"), "g", "label", "a", "item") is None
