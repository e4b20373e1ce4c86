"""Data contracts: each rule is one row, its name and how many rows break it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rule(df: DataFrame, name: str, violations: Column) -> DataFrame:
    return df.agg(F.coalesce(violations, F.lit(0)).cast("long").alias("violations")).select(F.lit(name).alias("rule"), "violations")


def failing(df: DataFrame, holds: Column, name: str) -> DataFrame:
    """Rows for which the condition is false or null."""
    return _rule(df, name, F.sum((~F.coalesce(holds, F.lit(False))).cast("long")))


def unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows beyond the first of their key; counted by key, so no distinct over all rows is expanded."""
    return _rule(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), name, F.sum(F.col("n") - 1))


def foreign_key(df: DataFrame, parent: DataFrame, keys: list[str], name: str) -> DataFrame:
    return _rule(df.join(parent.select(*keys), keys, "left_anti"), name, F.count(F.lit(1)))


def both_classes(df: DataFrame, group: str, label: str, name: str) -> DataFrame:
    """Groups that lack a positive or a negative."""
    per = df.groupBy(group).agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
    return _rule(per, name, F.sum((F.col("lo") == F.col("hi")).cast("long")))


def same_order(a: DataFrame, b: DataFrame, key: str, index: str, name: str) -> DataFrame:
    """Rows whose key differs at the same row index, or that one side lacks."""
    both = a.select(index, F.col(key).alias("_a")).join(b.select(index, F.col(key).alias("_b")), index, "full")
    return failing(both, F.col("_a").eqNullSafe(F.col("_b")), name)


def probability_frame(df: DataFrame, key: str = "id", probability: str = "probability") -> list[DataFrame]:
    p = F.col(probability)
    return [unique(df, [key], "id_unique"), failing(df, p.between(0, 1) & ~F.isnan(p), "probability_range")]


def training_frame(df: DataFrame, term: str = "term_id", item: str = "item_id") -> list[DataFrame]:
    return [unique(df, [term, item], "pair_unique"), both_classes(df, term, "label", "both_classes"), failing(df, F.col("label").isin(0, 1), "label_domain")]


def mined_negatives(df: DataFrame, positives: DataFrame, held_items: DataFrame, term: str = "term_id", item: str = "item_id") -> list[DataFrame]:
    weight = F.col("weight")
    return [
        unique(df, [term, item], "pair_unique"),
        failing(df, F.col("label") == 0, "label_zero"),
        failing(df, (weight > 0) & ~F.isnan(weight) & (weight < float("inf")), "weight_positive"),
        _rule(df.join(positives.select(term, item), [term, item], "left_semi"), "positive_collision", F.count(F.lit(1))),
        _rule(df.join(held_items.select(item), item, "left_semi"), "purged_item", F.count(F.lit(1))),
    ]


def vote_part(df: DataFrame, signature: str) -> list[DataFrame]:
    return [unique(df, ["id"], "id_unique"), failing(df, F.col("label").isin(0, 1), "label_domain"), failing(df, F.col("confidence").between(0, 1), "confidence_range"), failing(df, F.col("run_signature") == signature, "run_signature")]


def require(rules: list[DataFrame]) -> None:
    """Raises with the names and counts of all broken rules."""
    broken = [(r["rule"], r["violations"]) for d in rules for r in d.where("violations > 0").collect()]
    if broken:
        raise ValueError("broken contracts: " + ", ".join(f"{n} ({v})" for n, v in broken))
