"""Sketches merged in any order stay within their stated errors."""

import random
from collections import Counter

from pyspark.sql import functions as F

from marlstone.operators import sketches as K


def rows(n=60_000):
    r = random.Random(4)
    return [(r.choice("ab"), r.randint(0, 9), 0 if r.random() < 1 / 3 else int(r.paretovariate(0.8)) % 20_000, None if r.random() < 0.01 else r.gauss(5, 2)) for _ in range(n)]


def test_merged_sketches(spark):
    data = rows()
    df = spark.createDataFrame(data, "g string, day int, item long, value double").repartition(5).cache()
    daily = K.sketched(df, ["g", "day"], distinct="item", quantiles="value", frequent="item", sets="item")
    once = K.merged(daily, ["g"])
    twice = K.merged(K.merged(daily.withColumn("half", F.col("day") % 2), ["g", "half"]), ["g"])
    direct = K.sketched(df, ["g"], distinct="item", quantiles="value", frequent="item", sets="item")
    for table in (once, twice, direct):
        out = table.select("g", "n", K.distinct_count().alias("d"), *[K.quantile(q).alias(f"q{int(100 * q)}") for q in (0.1, 0.5, 0.99)], K.frequent_items(5).alias("top")).collect()
        assert {x["g"] for x in out} == {"a", "b"}
        for x in out:
            own = [y for y in data if y[0] == x["g"]]
            items, values = Counter(y[2] for y in own), sorted(y[3] for y in own if y[3] is not None)
            assert x["n"] == len(own)
            assert abs(x["d"] - len(items)) <= K.DISTINCT_ERROR * len(items)
            for q in (0.1, 0.5, 0.99):
                rank = sum(v <= x[f"q{int(100 * q)}"] for v in values) / len(values)
                assert abs(rank - q) <= K.QUANTILE_ERROR
            assert [t["count"] for t in x["top"]] == [c for _, c in items.most_common(5)]
    df.unpersist()


def test_shared_values(spark):
    df = spark.range(20_000).select(F.explode(F.array(F.struct(F.lit("a").alias("g"), F.col("id").alias("v")), F.struct(F.lit("b").alias("g"), (F.col("id") + 5000).alias("v")))).alias("x")).select("x.*")
    t = K.sketched(df, ["g"], sets="v")
    a, b = t.where("g = 'a'").select(F.col("set_sketch").alias("a")), t.where("g = 'b'").select(F.col("set_sketch").alias("b"))
    assert abs(a.crossJoin(b).select(K.shared_count("a", "b")).first()[0] - 15_000) < 15_000 * 0.05


def test_nothing(spark):
    df = spark.createDataFrame([], "g string, item long, value double")
    assert K.merged(K.sketched(df, ["g"], distinct="item", quantiles="value"), ["g"]).collect() == []
    nulls = spark.createDataFrame([("a", None, None)], "g string, item long, value double")
    assert K.sketched(nulls, ["g"], distinct="item").select("n", K.distinct_count().alias("d")).first() == (1, 0)


def test_top_count_beyond_what_a_sketch_tracks(spark):
    r = random.Random(8)
    data = [("wide", r.randint(0, 4000)) for _ in range(20_000)] + [("narrow", r.randint(0, 5)) for _ in range(500)] + [("empty", None)]
    df = spark.createDataFrame(data, "g string, item long").repartition(3)
    made = K.merged(K.sketched(df.withColumn("day", F.col("item") % 3), ["g", "day"], frequent="item", sets="item", tracked=200), ["g"], tracked=200)
    got = {x["g"]: x["top"] for x in K.top_count(df, made, ["g"], "item", "top", F.theta_sketch_estimate("set_sketch"), tracked=200).collect()}
    most = lambda g: Counter(y for x, y in data if x == g).most_common(1)[0][1]
    assert got["wide"] == most("wide") and got["narrow"] == most("narrow") and got["empty"] == 1
