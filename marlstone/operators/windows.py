"""Window features of candidates within their group.  Ties are always broken by an explicit key, so ranks are repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(group: str | list[str], score: Column, *ties: Column):
    return Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(score, *ties)


def ordinal_rank(group: str | list[str], score: str, *ties: str) -> Column:
    """1, 2, 3 by descending score; equal scores by the tie keys."""
    return F.row_number().over(ranked(group, F.desc(score), *[F.asc(t) for t in ties]))


def position(group: str, *order: str) -> Column:
    return F.row_number().over(Window.partitionBy(group).orderBy(*order))


def group_size(*group: str) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(*group))


def average_percentile(score: str, *group: str) -> Column:
    """Average rank of equal scores, divided by the group's size (all rows without a group)."""
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    same = Window.partitionBy(*group, score)
    return (F.rank().over(w.orderBy(score)) + (F.count(F.lit(1)).over(same) - 1) / 2) / F.count(F.lit(1)).over(w)


RANGES, BOUND_ROWS = 256, 10_000


def _range_of(rows: DataFrame, first: str, parts: int) -> Column:
    """The range of a row by its first column, of about equally many rows.

    Numbers go by approximate quantiles; texts by those of the BOUND_ROWS texts with the smallest hashes, a bounded sample that only
    tells how even the ranges are.  The bounds are literals by the time rows are dealt, so every part of a plan deals alike.
    """
    kind = rows.schema[first].dataType
    if parts < 2:
        return F.lit(0)
    if kind.typeName() == "string":
        sample = sorted(r[0] for r in rows.where(F.col(first).isNotNull()).select(first).orderBy(F.xxhash64(first), first).limit(BOUND_ROWS).collect())
        bounds, place = [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else [], F.col(first)
    else:
        place = F.col(first).cast("double")
        bounds = rows.agg(F.percentile_approx(place, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    if not bounds:
        return F.lit(0)
    below = F.filter(F.array(*[F.lit(x) for x in sorted(set(bounds))]), lambda x: x < place)
    return F.when(place.isNull(), 0).otherwise(F.size(below))


def range_sums(rows: DataFrame, order: list[str], values: dict[str, str], before: bool = False) -> DataFrame:
    """rows with running sums over all of them: values gives the new column's name for each summed one; before leaves the row itself out.

    order names columns, a leading minus for descending order, and must tell all rows apart.  Rows are dealt to ranges of the first and
    summed range by range, so no task orders all rows; those equal in the first column stay together.  The driver gets the bounds and a
    sum for each of at most RANGES ranges, which go back as literals.  The rows are read three times (bounds, sums, result), so a costly
    plan should be stored first.
    """
    named = [(c.lstrip("-"), c.startswith("-")) for c in order]
    first, falling = named[0]
    at = _range_of(rows, first, min(RANGES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = rows.withColumn("_part", -at if falling else at)
    sums = dealt.groupBy("_part").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    kinds, totals = {f.name: f.dataType for f in sums.schema.fields}, sorted(sums.collect(), key=lambda r: r["_part"])
    lowest = totals[0]["_part"] if totals else 0

    def ahead(v: str) -> Column:
        """The sum over all ranges ahead of a row's."""
        out, so_far = [], 0
        by_part = {r["_part"]: r[f"_{v}"] or 0 for r in totals}
        for part in range(lowest, (totals[-1]["_part"] if totals else 0) + 1):
            out.append(F.lit(so_far).cast(kinds[f"_{v}"]))
            so_far = so_far + by_part.get(part, 0)
        return F.element_at(F.array(*out), F.col("_part") - lowest + 1)

    inside = Window.partitionBy("_part").orderBy(*[F.desc(c) if down else F.asc(c) for c, down in named]).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return dealt.withColumns({name: ahead(v) + F.coalesce(F.sum(v).over(inside), F.lit(0)) for v, name in values.items()}).drop("_part")


def number_rows(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """0, 1, 2 in an order that tells all rows apart."""
    return range_sums(df.withColumn("_one", F.lit(1)), order, {"_one": into}, before=True).drop("_one")


def score_positions(df: DataFrame, score: str, descending: bool = False) -> DataFrame:
    """score, n and before (rows ahead of it) for each distinct score, and all (all rows).

    Distinct scores are counted, dealt to ranges and summed range by range; no task orders all of them.
    """
    counts = df.groupBy(F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    placed = range_sums(counts, ["-score" if descending else "score"], {"n": "before"}, before=True)
    return placed.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("score", "n", "before", "all")


def global_average_percentile(df: DataFrame, score: str, into: str) -> DataFrame:
    """average_percentile over all rows."""
    places = score_positions(df, score).select(F.col("score").alias("_score"), ((F.col("before") + 1 + (F.col("n") - 1) / 2) / F.col("all")).alias(into))
    return df.join(places, df[score].eqNullSafe(places["_score"])).drop("_score")


def group_features(df: DataFrame, group: str, score: str, *ties: str) -> DataFrame:
    """rank, group_size, top, mean, gap_to_top, minus_mean, zscore, percentile_a (over n) and percentile_b (over n - 1)."""
    w = Window.partitionBy(group)
    std = F.greatest(F.coalesce(F.stddev_samp(score).over(w), F.lit(0.0)), F.lit(1e-6))
    df = df.withColumns({"rank": ordinal_rank(group, score, *ties), "group_size": group_size(group), "top": F.max(score).over(w), "mean": F.avg(score).over(w), "std": std})
    r, n = F.col("rank"), F.col("group_size")
    return df.withColumns(
        {
            "gap_to_top": F.col("top") - F.col(score),
            "minus_mean": F.col(score) - F.col("mean"),
            "zscore": (F.col(score) - F.col("mean")) / F.col("std"),
            "percentile_a": 1 - (r - 1) / n,
            "percentile_b": 1 - (r - 1) / F.greatest(n - 1, F.lit(1)),
        }
    )


def category_frequency(group: str, category: str) -> Column:
    return group_size(group, category) / group_size(group)


def top_k(df: DataFrame, group: str | list[str], k: int | Column, score: str, *ties: str) -> DataFrame:
    return df.withColumn("rank", ordinal_rank(group, score, *ties)).where(F.col("rank") <= k)


def boundary(group: str, score: str, rank: str, k: int) -> Column:
    """The k-th best score of the group, null in smaller groups."""
    return F.max(F.when(F.col(rank) == k, F.col(score))).over(Window.partitionBy(group))


def structural_residual(df: DataFrame, group: str, engine: str, others: list[str], tie: str, limit: int = 100) -> DataFrame:
    """Rank of each channel, is_residual (beyond the limit in a larger group), agreement of channels, margin and confidence."""
    channels = [engine, *others]
    df = df.withColumns({f"{c}_rank": ordinal_rank(group, c, tie) for c in channels} | {"group_size": group_size(group)})
    big = F.col("group_size") > limit
    std = F.greatest(F.coalesce(F.stddev_samp(engine).over(Window.partitionBy(group)), F.lit(0.0)), F.lit(1e-6))
    df = df.withColumns({"is_residual": (big & (F.col(f"{engine}_rank") > limit)).cast("int"), "agreement": sum((F.when(big & (F.col(f"{c}_rank") > limit), 1).otherwise(0) for c in channels), F.lit(0)), "boundary": boundary(group, engine, f"{engine}_rank", limit), "std": std})
    df = df.withColumn("margin", F.when(F.col("boundary").isNotNull(), F.greatest((F.col("boundary") - F.col(engine)) / F.col("std"), F.lit(0.0))))
    return df.withColumn("confidence", F.col("margin") + 0.30 * F.greatest(F.col("agreement") - 1, F.lit(0)))


def fast_retrieval_score(overlap: Column, jaccard: Column, overlap_category: Column, brand_in_query: Column) -> Column:
    taxonomy = ((overlap_category > 0) | (brand_in_query > 0)).cast("double")
    return overlap + 0.35 * jaccard + 0.5 * (overlap >= 1).cast("double") + 0.2 * taxonomy


def ablation(df: DataFrame, step: str, metric: str, seconds: str) -> DataFrame:
    """Previous step's metric, delta, and low_roi: little gain for over half as much time again."""
    w = Window.partitionBy(F.lit(0)).orderBy(step)
    df = df.withColumns({"previous": F.lag(metric).over(w), "previous_seconds": F.lag(seconds).over(w)}).withColumn("delta", F.col(metric) - F.col("previous"))
    slow = F.col(seconds) > 1.5 * F.col("previous_seconds")
    return df.withColumn("low_roi", F.coalesce((F.col("delta").between(0, 0.002) & slow).cast("int"), F.lit(0)))


def bands(df: DataFrame, n: int, *order: str) -> DataFrame:
    """band 1 to n of a row in the order of all rows, as even as they can be, the larger ones first."""
    total = df.count()
    small, larger = divmod(total, n)
    at = F.col("_at")
    rows = number_rows(df, list(order), "_at")
    in_larger = at < larger * (small + 1)
    return rows.withColumn("band", F.when(in_larger, F.floor(at / (small + 1))).otherwise(larger + F.floor((at - larger * (small + 1)) / max(small, 1))).cast("int") + 1).drop("_at")


def round_robin(stratum: str, *shuffled: Column) -> Column:
    """Turn of a row within its stratum, from 0; ordering by it takes the strata in turn."""
    return F.row_number().over(Window.partitionBy(stratum).orderBy(*shuffled)) - 1


def score_elbow(df: DataFrame, group: str, score: str, tie: str, least: int, most: int) -> DataFrame:
    """k of each group: the rank before the largest relative drop among the best most + 5, within [least, min(most, n)]."""
    w = ranked(group, F.desc(score), F.asc(tie))
    df = df.withColumns({"rank": F.row_number().over(w), "n": group_size(group)}).where(F.col("rank") <= most + 5)
    df = df.withColumn("next", F.lead(score).over(w)).withColumn("drop", (F.col(score) - F.col("next")) / (F.col(score) + 1e-6))
    found = df.groupBy(group).agg(F.max("n").alias("n"), F.min_by("rank", F.when(F.col("drop").isNotNull(), F.struct((-F.col("drop")).alias("d"), F.col("rank")))).alias("k"))
    return found.select(group, "n", F.greatest(F.least(F.coalesce("k", F.lit(1)), F.lit(most), F.col("n")), F.lit(least)).alias("k"))


def score_profile(df: DataFrame, group: str, score: str, extra: list[Column] | None = None) -> DataFrame:
    at_least = lambda t: F.sum(F.when(F.col(score) >= t, 1).otherwise(0))
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.max(score).alias("top"), F.percentile(score, 0.9).alias("p90"), at_least(0.35).alias("n35"), at_least(0.5).alias("n50"), at_least(0.7).alias("n70"), *(extra or []))
