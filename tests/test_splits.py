"""Balanced folds by classes of load against the greedy assignment one by one."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlstone.operators import splits as V


def greedy(loads, folds):
    totals, out = [0] * folds, []
    for load in sorted(loads, reverse=True):
        f = min(range(folds), key=lambda i: (totals[i], i))
        out.append((load, f))
        totals[f] += load
    return out


@pytest.mark.parametrize("folds", [1, 2, 3, 5, 8])
def test_classes_are_dealt_as_one_by_one(folds):
    r = random.Random(folds)
    for _ in range(300):
        loads = [r.choice([0, 1, 1, 2, 3, 7, 50, r.randint(0, 400)]) for _ in range(r.randint(0, 60))]
        counts, got = Counter(loads), {}
        for load, first, order in V.deal_classes(list(counts.items()), folds):
            got.setdefault(load, []).append((first, order))
        made = []
        for load in sorted(counts, reverse=True):
            for n in range(counts[load]):
                first, order = [p for p in got[load] if p[0] <= n][-1]
                made.append((load, order[(n - first) % len(order)]))
        assert made == greedy(loads, folds), loads
        assert all(len(p) <= folds for p in got.values())


def test_ten_million_groups_take_a_few_phases():
    phases = V.deal_classes([(1, 10_000_000), (5, 300_000), (1000, 7)], 5)
    assert len(phases) < 15


def test_over_a_table(spark):
    r = random.Random(1)
    rows = [(f"g{i}", int(r.paretovariate(0.7)) % 100_000) for i in range(3000)] + [(None, 4), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, load long").repartition(3)
    out = V.balanced_folds(df, "g", "load", 4, "s").collect()
    assert len(out) == len(rows)
    totals = Counter()
    for x in out:
        totals[x["fold"]] += x["load"] or 0
    assert max(totals.values()) - min(totals.values()) <= max(x["load"] or 0 for x in out)
    assert V.balanced_folds(df.limit(0), "g", "load", 4, "s").collect() == []
    exact = df.where("load < 4096")
    hashed = {x["g"]: x["h"] for x in exact.select("g", V.keyed_hash("s", F.col("g")).alias("h")).collect()}
    order = sorted(((x["g"], x["load"]) for x in exact.collect()), key=lambda x: (-x[1], hashed[x[0]] or 0, x[0] or ""))
    want = dict(zip([g for g, _ in order], [f for _, f in greedy([n for _, n in order], 4)], strict=True))
    got = {x["g"]: x["fold"] for x in V.balanced_folds(exact.where("g is not null"), "g", "load", 4, "s").collect()}
    order = [(g, n) for g, n in order if g is not None]
    want = dict(zip([g for g, _ in order], [f for _, f in greedy([n for _, n in order], 4)], strict=True))
    assert got == want


def test_fold_scope_brings_each_held_key_once(spark, monkeypatch):
    from marlstone.operators import splits as V

    rows = {}
    monkeypatch.setattr(V, "stored", lambda df, name: rows.__setitem__(name, df.count()) or df, raising=False)
    pairs = spark.createDataFrame([(i % 3, i % 4, i % 2) for i in range(240)], "fold int, item int, family int").where("fold > 0 or item < 3 and family = 0")
    counts = {p: V.fold_scope(pairs, 0, "item", "family", p).agg({"*": "count", "leaks": "sum"}).first() for p in ("audit", "purge_item", "purge_family")}
    assert {p: (r["count(1)"], r["sum(leaks)"]) for p, r in counts.items()} == {"audit": (160, 80), "purge_item": (80, 0), "purge_family": (80, 0)}
    assert rows["held-keys"] == 1  # the last one's family, of 40 rows
