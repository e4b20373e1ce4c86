"""Approximate aggregates as sketches that are stored in columns and merged later, across days or shards.

A table of sketches has a row for each group; its sketches merge in any order and any grouping (hash joins, unions and further groupings
keep them plain binary columns).  Sizes are fixed, so a group with a third of all rows costs no more than another, and Spark combines
sketches on the map side.  Stated errors, at about three standard deviations: DISTINCT_ERROR of the count, QUANTILE_ERROR of the rank.
Frequent items are exact while a group has no more than `tracked` distinct ones; beyond that counts are estimates, and top_count is the exact way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_DISTINCT, K_QUANTILE, TRACKED = 14, 400, 10_000
DISTINCT_ERROR = 3 * 1.04 / (1 << LG_DISTINCT) ** 0.5
QUANTILE_ERROR = 0.02


def sketched(df: DataFrame, by: list[str], distinct: str | None = None, quantiles: str | None = None, frequent: str | None = None, sets: str | None = None, tracked: int = TRACKED) -> DataFrame:
    """by, n and a sketch for each column asked for: distinct_sketch, quantile_sketch, frequent_sketch, set_sketch.  Nulls count for nothing."""
    made = [F.count(F.lit(1)).alias("n")]
    if distinct:
        made.append(F.hll_sketch_agg(distinct, LG_DISTINCT).alias("distinct_sketch"))
    if quantiles:
        made.append(F.kll_sketch_agg_double(F.col(quantiles).cast("double"), F.lit(K_QUANTILE)).alias("quantile_sketch"))
    if frequent:
        made.append(F.call_function("approx_top_k_accumulate", F.col(frequent), F.lit(tracked)).alias("frequent_sketch"))
    if sets:
        made.append(F.theta_sketch_agg(sets, LG_DISTINCT).alias("set_sketch"))
    return df.groupBy(*by).agg(*made)


def merged(sketches: DataFrame, by: list[str], tracked: int = TRACKED) -> DataFrame:
    """The sketches of coarser groups."""
    made = [F.sum("n").alias("n")]
    if "distinct_sketch" in sketches.columns:
        made.append(F.hll_union_agg("distinct_sketch").alias("distinct_sketch"))
    if "quantile_sketch" in sketches.columns:
        made.append(F.kll_merge_agg_double("quantile_sketch", F.lit(K_QUANTILE)).alias("quantile_sketch"))
    if "frequent_sketch" in sketches.columns:
        made.append(F.call_function("approx_top_k_combine", F.col("frequent_sketch"), F.lit(tracked)).alias("frequent_sketch"))
    if "set_sketch" in sketches.columns:
        made.append(F.theta_union_agg("set_sketch", LG_DISTINCT).alias("set_sketch"))
    return sketches.groupBy(*by).agg(*made)


def distinct_count(sketch: str = "distinct_sketch") -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile(q: float, sketch: str = "quantile_sketch") -> Column:
    return F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(q))


def frequent_items(k: int, sketch: str = "frequent_sketch") -> Column:
    """item and count of the k most frequent."""
    return F.call_function("approx_top_k_estimate", F.col(sketch), F.lit(k))


def top_count(rows: DataFrame, sketches: DataFrame, by: list[str], item: str, into: str, distinct: Column, tracked: int = TRACKED) -> DataFrame:
    """sketches with the exact count of each group's most frequent item.

    From the sketch where it is exact, which is while `distinct`, an estimate of the group's distinct items, is safely below what it
    tracks; rows of all other groups are counted by item, in partial sums, and only each group's largest count goes on.  Nulls are an item too.
    """
    held = sketches.withColumn("_sure", F.coalesce(distinct * (1 + DISTINCT_ERROR) < tracked / 2, F.lit(False)))
    wide = rows.join(held.where("not _sure").select(*by), by, "left_semi")
    counted = wide.groupBy(*by, item).agg(F.count(F.lit(1)).alias("_c")).groupBy(*by).agg(F.max("_c").alias("_c"))
    return held.join(counted, by, "left").withColumn(into, F.when(F.col("_sure"), F.get(frequent_items(1), F.lit(0))["count"]).otherwise(F.col("_c"))).drop("_sure", "_c")


def shared_count(a: str, b: str) -> Column:
    """Distinct values that two set sketches share."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))
