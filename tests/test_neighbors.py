"""Exact and approximate neighbour search, and running sums over ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import neighbors as V
from marlstone.operators import windows as W


def planted(n=3000, d=16, seed=1):
    """Vectors around 20 centres, a third of all around one of them; some repeated, some of zeros."""
    r = np.random.default_rng(seed)
    centers = r.normal(size=(20, d))
    x = centers[np.where(r.random(n) < 1 / 3, 0, r.integers(20, size=n))] + 0.4 * r.normal(size=(n, d))
    x[5], x[6] = x[7], 0
    return x


def brute(x, keys, k):
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = u[keys] @ u.T
    return {q: [int(i) for i in np.lexsort((np.arange(len(x)), -row))[:k]] for q, row in zip(keys, s, strict=True)}


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row], "extra") for i, row in enumerate(x)] + [(len(x), None, "none")], "vec_id long, embedding array<float>, score string")


def test_scores_are_held_in_slabs():
    """A full block has 80 million scores; a task holds SLAB_CELLS of them, and cells are ranked alike in slabs."""
    for rows, width in ((V.QUERY_ROWS, V.ITEM_ROWS), (10_000, V.MOST_CELLS), (3, 10 * V.SLAB_CELLS), (0, 5), (7, 0)):
        cuts = V._slabs(rows, width)
        assert [i for c in cuts for i in range(rows)[c]] == list(range(rows))
        assert all((c.stop - c.start) * width <= V.SLAB_CELLS or c.stop - c.start == 1 for c in cuts)
    scores = np.random.default_rng(2).integers(0, 4, size=(50, 9)).astype(float)
    assert (V._nearest(scores, 1) == V._nearest(scores, 9)[:, :1]).all()


def test_exact_in_blocks(spark):
    x = planted(400).astype(np.float32).astype(float)
    df = table(spark, x)
    q = df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    want = brute(x, list(range(0, 400, 20)), 7)
    for item_rows, query_rows in ((10_000, 10_000), (50, 3)):
        got = {}
        for r in V.exact_top_k(q, df, 7, "query_id", "vec_id", item_rows=item_rows, query_rows=query_rows).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert {k: v for k, v in got.items() if k != 400} == want
    assert V.exact_top_k(q.limit(0), df, 7, "query_id", "vec_id").collect() == []
    with pytest.raises(ValueError):
        V.exact_top_k(q, df, 0, "query_id", "vec_id")


def test_cells_find_most_neighbours_and_split_skewed_cells(spark):
    x = planted().astype(np.float32).astype(float)
    df = table(spark, x)
    index = V.tuned(V.build_cells(df, "vec_id", cells=20, item_rows=100, sample_rows=1000), 5, 0.95)
    assert 1 <= index.probes < 20
    rows = index.rows(spark)
    assert rows.count() == len(x)
    assert rows.groupBy("cell", "part").count().agg(F.max("count")).first()[0] < 200 < rows.groupBy("cell").count().agg(F.max("count")).first()[0]
    q = df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    found = V.search_cells(index, q, 5, "query_id", query_rows=20)
    recall = V.recall_at_k(found, V.exact_top_k(q, df, 5, "query_id", "vec_id"), "query_id", "vec_id")
    assert recall.agg(F.avg("recall")).first()[0] >= 0.9
    everywhere = V.search_cells(index, q, 5, "query_id", probes=len(index.centroids))
    want = brute(x, list(range(0, len(x), 20)), 5)
    got = {}
    for r in everywhere.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == want


def test_cells_of_an_empty_table(spark):
    df = table(spark, planted(10)).limit(0)
    index = V.tuned(V.build_cells(df, "vec_id"), 5, 0.9)
    assert V.search_cells(index, df.withColumnRenamed("vec_id", "query_id"), 5, "query_id").collect() == []


def numbered(spark, df, order):
    return [r["n"] for r in W.number_rows(df, order, "n").orderBy(*order).collect()]


def test_ranges_over_frames_of_any_origin(spark):
    made = spark.range(5000).select(F.concat(F.lit("item-"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("k"))
    plain = [f"item-{i:08}" for i in range(5000)]
    rdd = spark.createDataFrame(spark.sparkContext.parallelize([(k,) for k in random.Random(1).sample(plain, 5000)]), "k string")
    cached = made.cache()
    for df in (made, rdd, cached, spark.range(5000).withColumnRenamed("id", "k"), spark.range(5000).select((F.col("id") / 7).alias("k"))):
        assert numbered(spark, df, ["k"]) == list(range(5000))
    cached.unpersist()
    assert numbered(spark, made.limit(0), ["k"]) == []
    odd = spark.createDataFrame([(None,), ("",), ("ü",), ("z",)], "k string")
    assert [r["k"] for r in W.number_rows(odd, ["k"], "n").orderBy("n").collect()] == [None, "", "z", "ü"]


def test_text_keys_of_one_prefix_spread(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(200_000).select(F.concat(F.lit("item-"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("k"))
        sizes = df.groupBy(W._range_of(df, "k", 16).alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(sizes) == 16 and max(r["count"] for r in sizes) < 20_000
