"""Decision policies: turning scores and evidence into binary predictions under per-group rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import ordinal_rank


def at_least_per_group(df: DataFrame, group: str, prediction: str, score: str, tie: str, least: int) -> DataFrame:
    """Predictions raised for a group's best negatives until it has least positives."""
    w = Window.partitionBy(group)
    zero_rank = F.row_number().over(Window.partitionBy(group, prediction).orderBy(F.desc(score), F.asc(tie)))
    need = F.greatest(F.lit(least) - F.sum(prediction).over(w), F.lit(0))
    return df.withColumns({"_r": zero_rank, "_need": need}).withColumn(prediction, F.when((F.col(prediction) == 0) & (F.col("_r") <= F.col("_need")), 1).otherwise(F.col(prediction))).drop("_r", "_need")


def postprocess(df: DataFrame, group: str, probability: str, tie: str, threshold: float, penalty: float = 0.0, top_k: int = 0, ensure_one: bool = True) -> DataFrame:
    """Contradicted rows lose penalty; then the threshold, the group's best top_k (ties, to nine digits, by the tie key), and at least one row."""
    value = F.greatest(F.col(probability) - penalty * F.col("contradiction"), F.lit(0.0)) if "contradiction" in df.columns else F.col(probability)
    df = df.withColumn("adjusted", value).withColumn("_s", F.round("adjusted", 9)).withColumn("_rank", ordinal_rank(group, "_s", tie)).drop("_s")
    df = df.withColumn("prediction", ((F.col("adjusted") >= threshold) | (F.col("_rank") <= top_k)).cast("int"))
    if ensure_one:
        empty = F.sum("prediction").over(Window.partitionBy(group)) == 0
        df = df.withColumn("prediction", F.when(empty & (F.col("_rank") == 1), 1).otherwise(F.col("prediction")))
    return df.drop("_rank")


def swaps(df: DataFrame, group: str, anchor: str, order: list[Column]) -> DataFrame:
    """Candidate flips in equal number of additions and removals: for each group the best of either."""
    w = Window.partitionBy(group)
    adds, drops = (F.sum(F.when(F.col(anchor) == v, 1).otherwise(0)).over(w) for v in (0, 1))
    rank = F.row_number().over(Window.partitionBy(group, anchor).orderBy(*order))
    return df.withColumns({"_r": rank, "_n": F.least(adds, drops)}).where("_r <= _n").drop("_r", "_n")


def apply_flips(anchor: DataFrame, flips: DataFrame, key: str, prediction: str = "prediction") -> DataFrame:
    """The anchor with flipped rows turned over."""
    marked = anchor.join(flips.select(key).distinct().withColumn("_flip", F.lit(1)), key, "left")
    return marked.withColumn(prediction, F.when(F.col("_flip") == 1, 1 - F.col(prediction)).otherwise(F.col(prediction))).withColumn("flipped", F.coalesce("_flip", F.lit(0))).drop("_flip")


def raise_only(anchor: DataFrame, chosen: DataFrame, key: str, prediction: str = "prediction") -> DataFrame:
    marked = anchor.join(chosen.select(key).distinct().withColumn("_up", F.lit(1)), key, "left")
    return marked.withColumn(prediction, F.greatest(F.col(prediction), F.coalesce("_up", F.lit(0)))).drop("_up")


def floor_deficit(df: DataFrame, group: str, anchor: str, order: list[Column], free: int, least_certainty: float) -> DataFrame:
    """Rows to raise so that a group has at least n - free positives: the best negatives, where these are a large enough share."""
    w = Window.partitionBy(group)
    n, ones = F.count(F.lit(1)).over(w), F.sum(anchor).over(w)
    df = df.withColumns({"deficit": F.greatest(F.greatest(n - free, F.lit(0)) - ones, F.lit(0)), "zeros": n - ones})
    df = df.withColumn("certainty", F.coalesce(F.try_divide(F.col("deficit"), F.col("zeros")), F.lit(0.0)))
    zeros = df.where((F.col(anchor) == 0) & (F.col("deficit") > 0) & (F.col("certainty") >= least_certainty))
    return zeros.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_r <= deficit").drop("_r")


def target_counts(mode: str) -> Column:
    """Target positives of a group with k, n50 and n70."""
    conservative = F.greatest(F.col("k"), F.lit(1))
    medium = F.when((F.col("k") <= 2) & (F.col("n70") >= 5), F.least(F.col("n70"), F.col("k") + 8)).otherwise(conservative)
    if mode == "conservative":
        return conservative
    if mode == "medium":
        return medium
    if mode == "aggressive":
        return F.when(F.col("k") > F.col("n50") + 15, F.greatest(F.col("n50"), F.lit(1))).otherwise(medium)
    raise ValueError(f"unknown mode {mode!r}")


def nudge_to_target(df: DataFrame, group: str, anchor: str, score: str, tie: str, target: str, trim: bool) -> DataFrame:
    """Adds the best negatives up to the group's target; trim: takes away the worst positives beyond it."""
    w = Window.partitionBy(group)
    gap = F.col(target) - F.sum(anchor).over(w)
    best_zero = F.row_number().over(Window.partitionBy(group, anchor).orderBy(F.desc(score), F.asc(tie)))
    worst_one = F.row_number().over(Window.partitionBy(group, anchor).orderBy(F.asc(score), F.desc(tie)))
    df = df.withColumns({"_gap": gap, "_z": best_zero, "_o": worst_one})
    up = (F.col(anchor) == 0) & (F.col("_z") <= F.col("_gap"))
    down = (F.col(anchor) == 1) & (F.col("_o") <= -F.col("_gap")) if trim else F.lit(False)
    return df.withColumn("prediction", F.when(up, 1).when(down, 0).otherwise(F.col(anchor))).drop("_gap", "_z", "_o")


def capped_flips(df: DataFrame, group: str, anchor: str, probability: str, tie: str, high: float, low: float) -> DataFrame:
    """Flips by student probability under a cap of a tenth of the group (three at least); locked rows stay and no group is emptied."""
    w = Window.partitionBy(group)
    free = F.coalesce(F.col("locked"), F.lit(0)) == 0
    df = df.withColumns({"_up": (free & (F.col(anchor) == 0) & (F.col(probability) >= high)).cast("int"), "_down": (free & (F.col(anchor) == 1) & (F.col(probability) <= low)).cast("int"), "_cap": F.greatest(F.lit(3), F.ceil(0.10 * F.count(F.lit(1)).over(w)).cast("int")), "_k": F.sum(anchor).over(w)})
    up_rank = F.row_number().over(Window.partitionBy(group, "_up").orderBy(F.desc(probability), F.asc(tie)))
    down_rank = F.row_number().over(Window.partitionBy(group, "_down").orderBy(F.asc(probability), F.asc(tie)))
    df = df.withColumns({"_ur": up_rank, "_dr": down_rank, "_adds": F.least(F.sum("_up").over(w), F.col("_cap"))})
    room = F.least(F.col("_cap"), F.greatest(F.lit(0), F.col("_k") + F.col("_adds") - 1))
    flip_up, flip_down = (F.col("_up") == 1) & (F.col("_ur") <= F.col("_cap")), (F.col("_down") == 1) & (F.col("_dr") <= room)
    return df.withColumn("prediction", F.when(flip_up, 1).when(flip_down, 0).otherwise(F.col(anchor))).drop("_up", "_down", "_cap", "_k", "_ur", "_dr", "_adds")


def cascade(pool: DataFrame, votes: list[DataFrame], key: str, least: list[float]) -> DataFrame:
    """Rows the next judge sees: every earlier judge chose the alternative with enough confidence."""
    return reduce(lambda rows, v: rows.join(v[0].select(key, F.col("label").alias("_l"), F.col("confidence").alias("_c")), key).where((F.col("_l") == F.col("alternative")) & (F.col("_c") >= v[1])).drop("_l", "_c"), zip(votes, least, strict=True), pool)


def consensus(pool: DataFrame, votes: list[DataFrame], key: str, tiers: dict[str, float]) -> DataFrame:
    """Rows all judges would flip, with joint confidence (the least) and the strictest tier it reaches."""
    joined = reduce(lambda rows, v: rows.join(v[1].select(key, F.col("label").alias(f"_l{v[0]}"), F.col("confidence").alias(f"_c{v[0]}")), key), enumerate(votes), pool)
    agree = reduce(lambda a, b: a & b, (F.col(f"_l{i}") == F.col("alternative") for i in range(len(votes))))
    confidences = [F.col(f"_c{i}") for i in range(len(votes))]
    joint = F.least(*confidences) if len(confidences) > 1 else confidences[0]
    tier = reduce(lambda c, t: c.when(F.col("joint") >= t[1], t[0]), sorted(tiers.items(), key=lambda t: -t[1]), F.when(F.lit(False), ""))
    return joined.where(agree).withColumn("joint", joint).withColumn("tier", tier).where("tier is not null").drop(*[f"_{x}{i}" for x in "lc" for i in range(len(votes))])


def layered(base: DataFrame, layers: list[DataFrame], negative_votes: DataFrame, key: str) -> DataFrame:
    """The base raised by each layer in turn, without rows any judge called negative; layer: which one raised a row (0: none)."""
    safe = [layer.select(key).distinct().join(negative_votes.select(key), key, "left_anti").withColumn("_layer", F.lit(i + 1)) for i, layer in enumerate(layers)]
    first = reduce(DataFrame.unionByName, safe).groupBy(key).agg(F.min("_layer").alias("_layer"))
    out = base.join(first, key, "left")
    raised = (F.col("prediction") == 0) & F.col("_layer").isNotNull()
    return out.withColumns({"layer": F.when(raised, F.col("_layer")).otherwise(0), "prediction": F.when(raised, 1).otherwise(F.col("prediction"))}).drop("_layer")


def veto_audit(two: DataFrame, third: DataFrame, key: str) -> DataFrame:
    """How the third judge sees the rows two judges agree to flip: seen, confirmed, vetoed, and collapsed (it gives one answer only)."""
    both = two.join(third.select(key, F.col("label").alias("_l")), key, "left")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count("_l").alias("seen"), F.sum((F.col("_l") == F.col("alternative")).cast("long")).alias("confirmed"), F.sum((F.col("_l") != F.col("alternative")).cast("long")).alias("vetoed"), (F.count_distinct("_l") <= 1).cast("int").alias("collapsed"))
