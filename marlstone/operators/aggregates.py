"""Aggregations and table profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(df: DataFrame, column: Column, *group: str) -> DataFrame:
    """Count, mean, population deviation, extremes and five percentiles of the values that are numbers."""
    v = F.expr("try_cast(_v as double)")
    at = F.percentile("_d", F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    rows = df.select(*group, column.alias("_v")).select(*group, v.alias("_d")).where("_d is not null")
    out = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("count"), F.avg("_d").alias("mean"), F.stddev_pop("_d").alias("std"), F.min("_d").alias("min"), at.alias("_p"), F.max("_d").alias("max"))
    return out.select(*group, "count", "mean", "std", "min", *[F.col("_p")[i].alias(n) for i, n in enumerate(("p05", "p25", "median", "p75", "p95"))], "max")


def table_audit(df: DataFrame, key: str, missing: list[str]) -> DataFrame:
    """metric, column_name, value: rows, repeated rows and keys, and for each column its nulls and missing values."""
    text = {c: F.lower(F.trim(F.col(c).cast("string"))) for c in df.columns}
    sums = [F.count(F.lit(1)).alias("rows"), (F.count(key) - F.count_distinct(key)).alias("duplicate_ids"), *[F.sum(F.col(c).isNull().cast("long")).alias(f"nulls|{c}") for c in df.columns], *[F.sum(F.coalesce(text[c].isin(*missing), F.lit(True)).cast("long")).alias(f"missing|{c}") for c in df.columns]]
    one = df.agg(*sums)
    pairs = [("rows", "", F.col("rows")), ("duplicate_ids", "", F.col("duplicate_ids")), *[(m, c, F.col(f"`{m}|{c}`")) for m in ("nulls", "missing") for c in df.columns]]
    long = one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(c).alias("column_name"), v.cast("long").alias("value")) for m, c, v in pairs])).alias("x")).select("x.*")
    repeated = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("value")).select(F.lit("duplicate_rows").alias("metric"), F.lit("").alias("column_name"), "value")
    return long.unionByName(repeated)


def value_rates(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    rates = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).withColumn("rate", F.col("n") / F.col("_all")).drop("_all")
    return rates.orderBy(F.desc("n"), F.asc(column)).limit(most) if most else rates


def duplicate_groups(df: DataFrame, key: Column, into: str = "group_key") -> DataFrame:
    """All rows of groups of two or more, with the group's size."""
    return df.withColumn(into, key).withColumn("group_rows", F.count(F.lit(1)).over(Window.partitionBy(into))).where("group_rows > 1")


def top_tokens(df: DataFrame, tokens: Column, most: int = 50) -> DataFrame:
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(most)


def deterministic_mode(df: DataFrame, group: str, value: str) -> DataFrame:
    """Most frequent value of each group; of equally frequent ones the smallest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("m")).select(group, F.col("m.v").alias("mode"), (-F.col("m.n")).alias("n"))


def aggregate_votes(votes: DataFrame, key: str, label: str = "label", confidence: str = "confidence") -> DataFrame:
    """Unanimous keys with their label, votes, mean confidence and teacher weight."""
    sums = votes.groupBy(key).agg(F.count(F.lit(1)).alias("votes"), F.sum(label).alias("positive"), F.avg(confidence).alias("mean_confidence")).where("positive = 0 or positive = votes")
    weight = F.least(F.greatest("mean_confidence", F.lit(0.5)), F.lit(1.0)) * (1 + 0.25 * (F.col("votes") - 1))
    return sums.select(key, "votes", (F.col("positive") > 0).cast("int").alias("label"), "mean_confidence", weight.alias("weight"))


def weight_multiplier(df: DataFrame, label: str, weight: str, ratio: float) -> DataFrame:
    """Negative weights rescaled to ratio times the positives' total; base_weight keeps the old ones."""
    sums = df.agg(F.sum(F.when(F.col(label) == 1, F.col(weight))).alias("_p"), F.sum(F.when(F.col(label) == 0, F.col(weight))).alias("_n"))
    factor = ratio * F.coalesce("_p", F.lit(0.0)) / F.greatest(F.coalesce("_n", F.lit(0.0)), F.lit(1e-12))
    return df.withColumn("base_weight", F.col(weight)).crossJoin(F.broadcast(sums)).withColumn(weight, F.when(F.col(label) == 0, F.col(weight) * factor).otherwise(F.col(weight))).drop("_p", "_n")


def spearman_matrix(df: DataFrame, columns: list[str], percentile) -> DataFrame:
    """model_a, model_b, rho for every ordered pair of score columns; percentile(df, column, into) adds average ranks."""
    ranked = reduce(lambda d, c: percentile(d, c, f"_{c}"), columns, df)
    one = ranked.agg(*[F.corr(f"_{a}", f"_{b}").alias(f"{a}|{b}") for a in columns for b in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"`{a}|{b}`").alias("rho")) for a in columns for b in columns])).alias("x")).select("x.*")


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values that are not finite replaced by the median of the finite ones, and flagged in missing_<column>."""
    finite = {c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)) for c in columns}
    medians = df.agg(*[F.percentile(finite[c], 0.5).alias(f"_m_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(medians))
    return out.withColumns({f"missing_{c}": finite[c].isNull().cast("int") for c in columns} | {c: F.coalesce(finite[c], F.col(f"_m_{c}"), F.lit(0.0)) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def numeric_features(df: DataFrame, exclude: set[str]) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() in {"byte", "short", "integer", "long", "float", "double"} and f.name not in exclude]
