"""Fitted models, functions of one's own and artifacts against plain computations."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import models as L
from marlstone.operators import user_functions as U
from marlstone.plans import model_queries as Q
from marlstone.sources import artifacts as A


def test_svd_equals_numpy(spark):
    x = np.random.default_rng(3).normal(size=(60, 8)) @ np.diag([9, 7, 5, 3, 1, 0.5, 0.2, 0.1])
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)] + [(60, None), (61, [0.0] * 8)], "id int, v array<double>").repartition(5)
    got = {r["id"]: r["reduced"] for r in L.truncated_svd(df, "v", 3).collect()}
    assert got.pop(60) is None and got.pop(61) == [0.0] * 3
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    want = u[:, :3] * s[:3]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    ours = np.array([got[i] for i in range(60)])
    assert np.allclose(ours @ ours.T, want @ want.T, atol=1e-8)


def test_svd_of_nothing_and_of_low_rank(spark):
    assert L.truncated_svd(spark.createDataFrame([], "id int, v array<double>"), "v", 3).count() == 0
    low = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0])], "id int, v array<double>")
    assert [len(r["reduced"]) for r in L.truncated_svd(low, "v", 2).collect()] == [1, 1]


def test_size_regressor_beats_the_median(spark):
    rng = np.random.default_rng(5)
    rows = [(int(t), int(rng.random() < (t % 10) / 10), (t % 10) / 10 + 0.05 * rng.random(), "a b") for t in range(150) for _ in range(20)]
    df = spark.createDataFrame(rows, "term int, label int, score double, text string")
    report = L.size_report(L.size_regressor(L.group_size_features(df, "term", "label", "score", F.col("text")), "term", trees=10)).first()
    assert report["val_groups"] > 10 and report["val_mae"] < 0.6 * report["median_mae"]


def test_ranker_learns_the_order_inside_groups(spark, monkeypatch):
    monkeypatch.setattr(L, "PAIR_BUCKET", 15)
    rng = np.random.default_rng(7)
    rows = []
    for i in range(1200):
        g, a, b = i % 30, rng.normal(), rng.normal()
        rows.append((i, g, int(a - 2 * b + 0.3 * rng.normal() > 0), a + 100 * g, b))
    df = spark.createDataFrame(rows, "id int, g int, y int, a double, b double")
    pairs = L.preference_pairs(df, "g", "y", "id", ["a", "b"])
    assert pairs.count() < 3 * len(rows) and pairs.where("abs(a) > 50").isEmpty()
    w = L.pairwise_ranker(df, "g", "y", "id", ["a", "b"])
    assert w[0] > 0 and -3 < w[1] / w[0] < -1.4
    assert L.pairwise_ranker(df.where("y = 1"), "g", "y", "id", ["a", "b"]).tolist() == [0, 0]


def test_preference_pairs_are_dealt_by_the_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(L, "PAIR_BUCKET", 15)
    df = spark.createDataFrame([(i, None if i % 50 == 49 else i % 7 if i % 3 else 7, i % 2, float(i)) for i in range(400)], "id int, g int, y int, a double")
    one = sorted(tuple(r) for r in L.preference_pairs(df, "g", "y", "id", ["a"]).collect())
    monkeypatch.setattr(L, "PAIR_PART", 40, raising=False)
    many = L.preference_pairs(df, "g", "y", "id", ["a"])
    assert many.rdd.getNumPartitions() == 3 * 10
    assert sorted(tuple(r) for r in many.collect()) == one and len(one) > 300


def test_adversarial_auc_reads_texts_once(spark, monkeypatch):
    from marlstone.operators import scoring

    tables = {}
    monkeypatch.setattr(scoring, "stored", lambda df, name, f=getattr(scoring, "stored", None): tables.setdefault(name, f(df, name)), raising=False)
    rows = [(f"lamp chair {i} {'zinc' if i % 2 else 'mug'}", i % 2) for i in range(100)] + [(None, 0)]
    found = scoring.adversarial_auc(spark.createDataFrame(rows, "text string, y int"), "text", "y", 64).first()
    assert found["auc"] > 0.95 and 0 < found["rows"] < 50
    assert tables["term-counts"].columns == ["y", "_fold", "tf"] and tables["term-counts"].count() == 101


def test_adversarial_validation_finds_what_differs(spark):
    rng = np.random.default_rng(9)
    words = "lamp chair table mug plate spoon".split()
    rows = [(i, " ".join([*rng.choice(words, 5), *(["zinc"] if y and rng.random() < 0.9 else [])]), y) for i, y in enumerate([0, 1] * 60)] + [(900, None, 0)]
    scores, aucs, top = L.adversarial_validation(spark.createDataFrame(rows, "id int, text string, y int"), "id", "text", "y", folds=3)
    assert scores.select("id").distinct().count() == len(rows) == scores.count()
    assert all(r["auc"] > 0.85 for r in aucs.collect()) and aucs.count() == 4
    best = top.orderBy(F.desc("coefficient")).limit(15).collect()
    assert any("zinc" in r["feature"] for r in best) and top.count() <= 200


def test_aggregate_has_nulls_hot_keys_and_any_partitioning(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", None if i % 11 == 0 else float(i)) for i in range(3000)] + [(None, 2.0), ("none", None)]
    want = {}
    for k, v in rows:
        want.setdefault(k, []).extend([] if v is None else [v])
    for parts in (1, 9):
        got = {r["key"]: r["result"] for r in U.aggregate(spark.createDataFrame(rows, "key string, v double").repartition(parts), "key", "v", Q._sums, Q._merge_sums, Q._root_mean_square).collect()}
        assert got.keys() == want.keys() and got.pop("none") is None
        assert all(v == pytest.approx(np.sqrt(np.mean(np.square(want[k])))) for k, v in got.items())


def test_aggregate_counts_equal_states(spark):
    count = lambda state, values: struct.pack("<q", len(values))
    merge = lambda states: struct.pack("<q", sum(struct.unpack("<q", s)[0] for s in states))
    df = spark.range(80).select(F.lit("a").alias("k"), "id").repartition(8)
    assert U.aggregate(df, "k", "id", count, merge, lambda s: float(struct.unpack("<q", s)[0])).first()["result"] == 80


def test_text_windows(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, None), (3, " ")], "id int, text string")
    assert [(r["id"], r["start"], r["window"]) for r in U.text_windows(df, "text", 3, 2).orderBy("start").collect()] == [(1, 0, "a b c"), (1, 2, "c d e"), (1, 4, "e")]


def test_view_is_built_once_for_each_content(spark, tmp_path):
    built = []

    def build(items):
        built.append(1)
        return items.select("id", F.upper("title").alias("product_text"))

    items = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id int, title string")
    folder = str(tmp_path / "views")
    for same in (items, items.repartition(3), items.orderBy(F.desc("id"))):
        assert A.cached_view(same, build, "plain", folder).count() == 3
    assert len(built) == 1
    A.cached_view(items.union(items.limit(1)), build, "plain", folder)
    A.cached_view(items.fillna(""), build, "plain", folder)
    A.cached_view(items, build, "other", folder)
    assert len(built) == 4
    for p in (tmp_path / "views" / "other").rglob("_SUCCESS"):
        p.unlink()
    A.cached_view(items, build, "other", folder)
    assert len(built) == 5
    with pytest.raises(ValueError):
        A.cached_view(items, build, "../out", folder)


def test_bundle_and_config(tmp_path):
    root = tmp_path / "stage"
    A.write_config({"seed": 7}, "run-1", root)
    (root / "votes").mkdir()
    (root / "votes" / "part-0").write_bytes(b"x" * 3000)
    manifest = A.write_bundle(root, tmp_path / "b.zip")
    first = (tmp_path / "b.zip").read_bytes()
    assert set(manifest) == {"run-1/config.json", "votes/part-0"}
    A.write_bundle(root, tmp_path / "b.zip")
    assert (tmp_path / "b.zip").read_bytes() == first
    A.verify_bundle(tmp_path / "b.zip")
    import zipfile

    with zipfile.ZipFile(tmp_path / "b.zip", "a") as z:
        z.writestr("extra", "1")
    with pytest.raises(ValueError, match="extra"):
        A.verify_bundle(tmp_path / "b.zip")
    with pytest.raises(ValueError):
        A.write_config({}, "..", root)


def test_state_audit_of_wrong_tables(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "term int, item int")
    twice = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 2)], "item int, prediction int")
    rows = {r["name"]: r for r in A.state_audit(pairs, {"twice": twice, "empty": twice.limit(0), "gone": None}, size=2).collect()}
    assert not rows["twice"]["same_keys"] and not rows["twice"]["is_binary"] and rows["twice"]["exact_terms"] == 1
    assert rows["empty"]["rows"] == 0 and rows["empty"]["positives"] == 0 and not rows["empty"]["same_keys"]
    assert rows["gone"]["status"] == "missing" and rows["gone"]["terms"] == 2


def test_adversarial_validation_deals_a_small_file(spark, monkeypatch):
    monkeypatch.setattr(L, "PART_TEXTS", 20)
    rows = [(i, ("red apple " if i % 2 else "blue stone ") + f"w{i % 5}", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string, y int").coalesce(1)
    assert L.adversarial_validation(df, "id", "text", "y", folds=2)[0].rdd.getNumPartitions() >= 3  # one file would give one part for each fold
