"""Selections of the best rows: over all rows, by ratio, and within groups under counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import ordinal_rank, score_positions


def global_top_k(df: DataFrame, k: int, score: str, *ties: str, into: str = "selected") -> DataFrame:
    """Marks exactly k rows: those over the cut score, and at it the first by their tie keys.  Only distinct scores are ordered."""
    if k <= 0:
        return df.withColumn(into, F.lit(0))
    places = score_positions(df, score, descending=True)
    cut = places.where((F.col("before") < k) & (F.col("before") + F.col("n") >= k)).select("score", "before").first()
    if cut is None:
        return df.withColumn(into, F.lit(1))
    at = F.row_number().over(Window.partitionBy(score).orderBy(*[F.asc(t) for t in ties]))
    value = F.lit(cut["score"])
    edge = df.where(F.col(score) == value).withColumn(into, (at <= k - cut["before"]).cast("int"))
    rest = df.where((F.col(score) != value) | F.col(score).isNull())
    return rest.withColumn(into, F.coalesce((F.col(score) > value).cast("int"), F.lit(0))).unionByName(edge)


def ratio_count(rows: int, ratio: float) -> int:
    """Rows at a ratio, halves to even."""
    return round(rows * ratio)


def global_ratio(df: DataFrame, ratio: float, score: str, tie: str, into: str = "prediction") -> DataFrame:
    return global_top_k(df, ratio_count(df.count(), ratio), score, tie, into=into)


def count_preserving(df: DataFrame, group: str, score: str, anchor: str, tie: str) -> DataFrame:
    """selected: as many best rows of a group as it has anchor positives; boundary: between the last taken and the first left."""
    w = Window.partitionBy(group)
    df = df.withColumns({"rank": ordinal_rank(group, score, tie), "k": F.sum(anchor).over(w), "n": F.count(F.lit(1)).over(w)})
    inner, outer = F.max(F.when(F.col("rank") == F.col("k"), F.col(score))).over(w), F.max(F.when(F.col("rank") == F.col("k") + 1, F.col(score))).over(w)
    df = df.withColumns({"_in": inner, "_out": outer})
    edge = F.when(F.col("k") == 0, F.col("_out") + 1e-6).when(F.col("k") == F.col("n"), F.col("_in") - 1e-6).otherwise((F.col("_in") + F.col("_out")) / 2)
    return df.withColumns({"selected": (F.col("rank") <= F.col("k")).cast("int"), "boundary": edge}).drop("_in", "_out")


def priority_pool(df: DataFrame, priority: str, tie: str, most: int) -> DataFrame:
    """The most rows of highest priority: sorted parts, merged, never one sort of all rows."""
    return df.orderBy(F.desc(priority), F.asc(tie)).limit(most)


def pick(df: DataFrame, group: str, order: list[Column], limit: Column) -> DataFrame:
    """The first limit rows of each group under a composite order."""
    return df.withColumn("pick_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("pick_rank") <= limit)


def keep_first(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row for each key, by explicit priority."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") == 1).drop("_n")


def hash_order(df: DataFrame, hashed: Column, n: int, tie: str) -> DataFrame:
    return df.withColumn("_hash", hashed).orderBy("_hash", tie).limit(n).drop("_hash")
