"""Joins with the cardinality they promise, membership flags, and alignment of score tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The table with a broadcast hint if Catalyst's estimate of its size is within most bytes, else as it is."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= most else df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: list[str], name: str = "table") -> None:
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"{name}: {', '.join(keys)} is not unique")


def assert_subset(left: DataFrame, right: DataFrame, keys: list[str], name: str = "table") -> None:
    if not left.join(right.select(*keys), keys, "left_anti").isEmpty():
        raise ValueError(f"{name}: some {', '.join(keys)} are missing on the right")


def merge_validated(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """A join that first checks how often keys occur: one_to_one, many_to_one, one_to_many."""
    if validate.startswith("one_to"):
        assert_unique(left, keys, "left")
    if validate.endswith("to_one"):
        assert_unique(right, keys, "right")
    return left.join(right, keys, how)


def enrich_pairs(pairs: DataFrame, terms: DataFrame, items: DataFrame, term_key: str = "term_id", item_key: str = "item_id", strict: bool = True) -> DataFrame:
    """Pairs with their term's and item's columns.  Both sides have unique keys; strict: a pair without either is an error."""
    if strict:
        assert_unique(terms, [term_key], "terms")
        assert_unique(items, [item_key], "items")
        assert_subset(pairs, terms, [term_key], "pairs")
        assert_subset(pairs, items, [item_key], "pairs")
    return pairs.join(small_side(terms), term_key, "left").join(items, item_key, "left")


def outer_merge(left: DataFrame, right: DataFrame, keys: list[str], score: str = "score", left_name: str = "left", right_name: str = "right") -> DataFrame:
    """Two retrieval channels: missing scores 0, score the larger one, source where it was found."""
    a = left.select(*keys, F.col(score).alias("_a"))
    b = right.select(*keys, F.col(score).alias("_b"))
    source = F.when(F.col("_b").isNull(), left_name).when(F.col("_a").isNull(), right_name).otherwise(f"{left_name}+{right_name}")
    return a.join(b, keys, "full").withColumn("source", source).withColumns({f"{left_name}_score": F.coalesce("_a", F.lit(0.0)), f"{right_name}_score": F.coalesce("_b", F.lit(0.0))}).withColumn("score", F.greatest(f"{left_name}_score", f"{right_name}_score")).drop("_a", "_b")


def flag_members(df: DataFrame, members: DataFrame, keys: list[str], into: str = "is_member") -> DataFrame:
    """1 where the keys occur among members, else 0; rows are neither lost nor repeated."""
    return df.join(members.select(*keys).distinct().withColumn(into, F.lit(1)), keys, "left").withColumn(into, F.coalesce(into, F.lit(0)))


def without(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(known.select(*keys), keys, "left_anti")


def only(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(known.select(*keys), keys, "left_semi")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    return df.join(small_side(table.select(key, value)), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def align_scores(tables: dict[str, DataFrame], key: str, metadata: list[str], score: str = "score", check: bool = True) -> DataFrame:
    """One row for each key with every model's score; keys and metadata must be the same in all tables."""
    names = list(tables)
    if check:
        first = tables[names[0]].select(key, *metadata)
        assert_unique(first, [key], names[0])
        for name in names[1:]:
            if not same_rows(first, tables[name].select(key, *metadata)):
                raise ValueError(f"{name}: keys or metadata differ from {names[0]}")
    base = tables[names[0]].select(key, *metadata, F.col(score).alias(names[0]))
    return reduce(lambda out, name: out.join(tables[name].select(key, F.col(score).alias(name)), key), names[1:], base)


def set_overlap(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Distinct values on each side, in both, and their Jaccard similarity, as one row."""
    a, b = left.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_a", F.lit(1)), right.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_b", F.lit(1))
    sums = a.join(b, column, "full").agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(n) for x, n in (("_a", "left_values"), ("_b", "right_values"), (F.col("_a") * F.col("_b"), "shared_values"))))
    return sums.withColumn("jaccard", F.coalesce(F.try_divide(F.col("shared_values"), F.col("left_values") + F.col("right_values") - F.col("shared_values")), F.lit(0.0)))
