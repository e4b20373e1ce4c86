"""Sparse truncated SVD against NumPy's."""

import numpy as np

from marlstone.operators import sparse_svd as V


def table(spark, a):
    rows = [(i, [int(j) for j in np.flatnonzero(r)], [float(x) for x in r[np.flatnonzero(r)]]) for i, r in enumerate(a)]
    return spark.createDataFrame(rows, "k long, ids array<int>, values array<double>")


def test_against_numpy(spark):
    r = np.random.default_rng(3)
    a = np.where(r.random((300, 120)) < 0.08, r.normal(size=(300, 120)), 0) * np.linspace(3, 0.3, 120)
    a[7] = 0
    df = table(spark, a)
    basis = V.sparse_svd(df, 120, 6, steps=30, tolerance=1e-7)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.abs(basis.values - s[:6]).max() < 1e-6
    assert np.linalg.norm(basis.vectors - vt[:6].T @ (vt[:6] @ basis.vectors), 2) < 1e-3
    y = np.array([x["reduced"] for x in V.project(df, basis, scaled=False).orderBy("k").collect()])
    assert np.abs(y - a @ basis.vectors).max() < 1e-9
    z = np.array([x["reduced"] for x in V.project(df, basis).orderBy("k").collect()])
    assert (z[7] == 0).all() and np.abs(np.linalg.norm(np.delete(z, 7, 0), axis=1) - 1).max() < 1e-9


def test_low_rank_and_empty(spark):
    a = np.outer(np.arange(1, 9), [1, 0, 2, 0, 1.0])
    basis = V.sparse_svd(table(spark, a), 5, 3)
    assert len(basis.values) == 1 and abs(basis.values[0] - np.linalg.norm(a)) < 1e-9
    empty = table(spark, a).limit(0)
    assert len(V.sparse_svd(empty, 5, 3).values) == 0 and V.project(empty, basis).collect() == []


def test_from_texts(spark):
    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "b", 1), (3, "c", 1)], "d long, g string, tf long")
    w = V.unit_weights(V.most_frequent(counts, "g", 2), "d", "g", 3)
    rows, columns = V.sparse_rows(w, "d", "g", "w")
    assert {x["g"]: x["id"] for x in columns.collect()} == {"a": 0, "b": 1}
    got = {x["d"]: dict(zip(x["ids"], x["values"], strict=True)) for x in rows.collect()}
    assert set(got) == {1, 2} and got[2] == {1: 1.0}
    assert abs(sum(v * v for v in got[1].values()) - 1) < 1e-12


def test_rows_of_texts_equal_those_of_counts_without_shuffling_them(spark):
    from marlstone.operators import retrieval as R

    texts = [(i, " ".join(f"w{(i * j) % 11}" for j in range(1, 3 + i % 7))) for i in range(40)] + [(40, None), (41, "alone once")]
    df = spark.createDataFrame(texts, "d long, t string")
    for most in (15, 1000):
        counts = V.most_frequent(R.term_counts(df, "d", R.word_grams(df["t"])), "gram", most)
        rows, _ = V.sparse_rows(V.unit_weights(counts, "d", "gram", 42), "d", "gram", "w")
        want = {x["d"]: sorted(round(v, 9) for v in x["values"]) for x in rows.collect()}
        found, width = V.frequent_rows(df, "d", "t", R.word_grams, most)
        got = {x["d"]: sorted(round(v, 9) for v in x["values"]) for x in found.collect()}
        assert got == want and width == counts.select("gram").distinct().count()


def test_dense_blocks_equal_cells_one_by_one(spark, monkeypatch):
    a = np.where(np.random.default_rng(5).random((200, 30)) < 0.3, 1.5, 0.0)
    q = np.random.default_rng(6).normal(size=(30, 4))
    assert V._dense(*np.nonzero(a), a[np.nonzero(a)], 200) is not None
    assert np.abs(V.gram_times(table(spark, a), q) - a.T @ (a @ q)).max() < 1e-9
    monkeypatch.setattr(V, "_dense", lambda *_: None)
    assert np.abs(V.gram_times(table(spark, a), q) - a.T @ (a @ q)).max() < 1e-9
