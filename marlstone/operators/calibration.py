"""Calibration, priors, thresholds by bucket, ensembles and experiment records."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import EPSILON, bins, clip, logit, sigmoid
from .joins import small_side
from .metrics import best_threshold, confusion, f1_columns
from .windows import range_sums

RANK_EDGES, RANK_LABELS = [1, 3, 5, 10, 20, 50, 100], ["1", "2-3", "4-5", "6-10", "11-20", "21-50", "51-100", ">100"]


def temperatures(spark) -> DataFrame:
    """exp(-4) to exp(4) in 161 even steps of the logarithm."""
    return spark.range(161).select(F.exp(-4 + F.col("id") * 0.05).alias("temperature"), F.col("id").alias("step"))


def cross_fit_temperature(df: DataFrame, label: str, raw_logit: str, fold: str) -> DataFrame:
    """The temperature of least log loss on the other folds, for each fold.

    Rows are counted by fold, label and logit first; losses are summed once for each fold and temperature, and the other folds' loss is
    the total less the own.
    """
    t = temperatures(df.sparkSession)
    p = clip(sigmoid(F.col(raw_logit) / F.col("temperature")), 1e-15, 1 - 1e-15)
    y = F.col(label)
    cells = df.groupBy(fold, label, raw_logit).agg(F.count(F.lit(1)).alias("_n"))
    losses = cells.crossJoin(F.broadcast(t)).groupBy(fold, "step", "temperature").agg(F.sum(-(y * F.ln(p) + (1 - y) * F.ln(1 - p)) * F.col("_n")).alias("loss"), F.sum("_n").alias("n"))
    w = Window.partitionBy("step")
    others = losses.withColumns({"loss": F.sum("loss").over(w) - F.col("loss"), "n": F.sum("n").over(w) - F.col("n")}).where("n > 0").withColumn("mean", F.round(F.col("loss") / F.col("n"), 9))
    return others.groupBy(fold).agg(F.min(F.struct("mean", "step", "temperature")).alias("_b")).select(fold, F.col("_b.temperature").alias("temperature"), F.col("_b.mean").alias("loss"))


def logistic(df: DataFrame, features: list[str], label: str, weight: str | None = None, strength: float = 0.0):
    """An MLlib logistic regression over columns; returns the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    lr = LogisticRegression(labelCol=label, regParam=strength, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), lr]).fit(df)


def calibrate(train: DataFrame, apply: DataFrame, label: str, probability: str, method: str) -> DataFrame:
    """apply with calibrated: platt (logit), beta (ln p and ln(1 - p)), isotonic, identity."""
    from pyspark.ml.regression import IsotonicRegression

    p = clip(F.col(probability), EPSILON, 1 - EPSILON)
    if method == "identity":
        return apply.withColumn("calibrated", F.col(probability))
    if method == "isotonic":
        model = IsotonicRegression(labelCol=label, featuresCol=probability).fit(train)
        return model.transform(apply).withColumn("calibrated", clip(F.col("prediction"), EPSILON, 1 - EPSILON)).drop("prediction")
    columns = {"platt": {"_f0": logit(F.col(probability))}, "beta": {"_f0": F.ln(p), "_f1": F.ln(1 - p)}}[method]
    fitted = logistic(train.withColumns(columns), list(columns), label, strength=1e-6)
    lr = fitted.stages[-1]
    raw = reduce(lambda x, y: x + y, (F.lit(float(w)) * columns[c] for w, c in zip(lr.coefficients, columns, strict=True)), F.lit(float(lr.intercept)))
    return apply.withColumn("calibrated", sigmoid(raw))


def rank_log_odds(df: DataFrame, rank: str, label: str, smoothing: float = 20.0) -> DataFrame:
    """bin, log_odds of a rank bin against all rows."""
    total = df.agg(F.avg(label).alias("_g"))
    per = df.groupBy(bins(F.col(rank), RANK_EDGES, RANK_LABELS).alias("bin")).agg(F.sum(label).alias("pos"), F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total))
    g = clip(F.col("_g"), EPSILON, 1 - EPSILON)
    rate = clip((F.col("pos") + smoothing * g) / (F.col("n") + smoothing), EPSILON, 1 - EPSILON)
    return per.select("bin", "pos", "n", (F.ln(rate / (1 - rate)) - F.ln(g / (1 - g))).alias("log_odds"))


def rank_adjusted(df: DataFrame, priors: DataFrame, rank: str, probability: str, strength: float = 1.0) -> DataFrame:
    """adjusted: the logit moved by the bin's log odds; beyond rank 100 certain."""
    out = df.withColumn("bin", bins(F.col(rank), RANK_EDGES, RANK_LABELS)).join(F.broadcast(priors.select("bin", "log_odds")), "bin", "left")
    moved = sigmoid(logit(F.col(probability)) + strength * F.coalesce("log_odds", F.lit(0.0)))
    return out.withColumn("adjusted", F.when(F.col(rank) > 100, 1.0).otherwise(moved))


def precision_thresholds(df: DataFrame, label: str, probability: str, precision: float, support: int) -> DataFrame:
    """high: smallest threshold from which on positives reach the precision; low: largest up to which negatives do; both with enough rows."""
    by = df.groupBy(F.col(probability).alias("p")).agg(F.sum(label).alias("pos"), F.count(F.lit(1)).alias("n"))
    totals = by.agg(F.sum("pos").alias("_pos"), F.sum("n").alias("_n"))
    down = range_sums(by, ["-p"], {"pos": "hp", "n": "hn"}).crossJoin(F.broadcast(totals))
    both = down.withColumns({"lp": F.col("_pos") - F.col("hp") + F.col("pos"), "ln": F.col("_n") - F.col("hn") + F.col("n")})
    return both.agg(F.min(F.when((F.col("hn") >= support) & (F.col("hp") / F.col("hn") >= precision), F.col("p"))).alias("high"), F.max(F.when((F.col("ln") >= support) & (1 - F.col("lp") / F.col("ln") >= precision), F.col("p"))).alias("low"))


def bucket_thresholds(df: DataFrame, bucket: str, label: str, probability: str, group: str, thresholds: DataFrame, min_rows: int = 2000, min_terms: int = 50, shrink: float = 5000.0) -> DataFrame:
    """bucket, threshold: the bucket's best one drawn towards the overall best by its rows; buckets with little support take the overall one."""
    cells = df.groupBy(bucket, label, probability).agg(F.count(F.lit(1)).alias("_n"))
    counted = cells.crossJoin(F.broadcast(thresholds)).withColumn("_hit", (F.col(probability) >= F.col("threshold")).cast("int"))
    times = lambda a, b: F.sum(F.when((F.col(label) == a) & (F.col("_hit") == b), F.col("_n")).otherwise(0))
    sums = counted.groupBy(bucket, "threshold").agg(times(0, 0).alias("tn"), times(0, 1).alias("fp"), times(1, 0).alias("fn"), times(1, 1).alias("tp"))
    overall = best_threshold(sums.groupBy("threshold").agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")]).withColumns(f1_columns())).select(F.col("threshold").alias("_overall"))
    own = best_threshold(sums.withColumns(f1_columns()), bucket).select(bucket, F.col("threshold").alias("_own"))
    support = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(group).alias("terms"))
    out = support.join(own, bucket).crossJoin(F.broadcast(overall))
    share = F.col("rows") / (F.col("rows") + shrink)
    enough = (F.col("rows") >= min_rows) & (F.col("terms") >= min_terms)
    return out.select(bucket, "rows", "terms", F.when(enough, share * F.col("_own") + (1 - share) * F.col("_overall")).otherwise(F.col("_overall")).alias("threshold"))


def apply_bucket_thresholds(df: DataFrame, thresholds: DataFrame, bucket: str, probability: str, default: float) -> DataFrame:
    out = df.join(small_side(thresholds.select(bucket, "threshold")), bucket, "left")
    return out.withColumn("prediction", (F.col(probability) >= F.coalesce("threshold", F.lit(default))).cast("int"))


def cross_fit_predictions(df: DataFrame, label: str, raw_logit: str, fold: str, steps: int = 100) -> DataFrame:
    """df with calibrated, threshold and prediction, all fitted on the other folds.

    A fold's rows take the temperature of least loss on the other folds and the threshold i / steps of best macro F1 on the other folds' rows
    at that temperature (the lowest of equals).  Those rows are counted by threshold bin, so what is ordered is steps bins a fold.
    """
    fits = cross_fit_temperature(df, label, raw_logit, fold).select(F.col(fold).alias("_fit"), F.col("temperature").alias("_t"))
    cells = df.groupBy(fold, label, raw_logit).agg(F.count(F.lit(1)).alias("_c"))
    # a fold's fit is one row, so this gives each cell to the other folds, not to other rows
    others = cells.join(F.broadcast(fits), F.col(fold) != F.col("_fit"))
    p = F.round(sigmoid(F.col(raw_logit) / F.col("_t")), 9)
    counted = others.groupBy("_fit", F.floor(p * steps).cast("int").alias("_bin")).agg(F.sum(F.col("_c") * F.col(label)).alias("pos"), F.sum(F.col("_c") * (1 - F.col(label))).alias("neg"))
    marks = fits.select("_fit", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("_bin"))
    w = Window.partitionBy("_fit").orderBy(F.desc("_bin"))
    all_of = Window.partitionBy("_fit")
    sums = marks.join(counted, ["_fit", "_bin"], "left").fillna(0, ["pos", "neg"]).withColumns({"tp": F.sum("pos").over(w), "fp": F.sum("neg").over(w)})
    sums = sums.withColumns({"fn": F.sum("pos").over(all_of) - F.col("tp"), "tn": F.sum("neg").over(all_of) - F.col("fp"), "threshold": F.col("_bin") / steps}).where("_bin between 1 and %d" % (steps - 1))
    cuts = best_threshold(sums.withColumns(f1_columns()), "_fit").select("_fit", "threshold")
    out = df.join(F.broadcast(fits.join(cuts, "_fit")), F.col(fold) == F.col("_fit"))
    out = out.withColumn("calibrated", F.round(sigmoid(F.col(raw_logit) / F.col("_t")), 9))
    return out.withColumn("prediction", (F.col("calibrated") >= F.col("threshold")).cast("int")).drop("_fit", "_t")


# ---- ensembles -------------------------------------------------------------------------------------------------------


def average(models: list[str], weights: list[float] | None = None) -> Column:
    weights = weights or [1 / len(models)] * len(models)
    return reduce(lambda a, b: a + b, (F.col(m) * w for m, w in zip(models, weights, strict=True)))


def geometric(models: list[str]) -> Column:
    return F.exp(reduce(lambda a, b: a + b, (F.ln(clip(F.col(m), EPSILON, 1 - EPSILON)) for m in models)) / len(models))


def simplex_weights(df: DataFrame, models: list[str], label: str, steps: int = 200, rate: float = 0.5) -> list[float]:
    """Weights of least log loss of the weighted mean, none negative, with sum one.

    Exponentiated gradient steps with halving: each needs one grouped pass, which returns a loss and a sum for each model.
    """
    cells = df.groupBy(label, *models).agg(F.count(F.lit(1)).alias("_n")).persist()
    try:
        total = cells.agg(F.sum("_n")).first()[0]

        def measured(w: list[float]) -> tuple[float, list[float]]:
            p = clip(average(models, w), EPSILON, 1 - EPSILON)
            slope = F.when(F.col(label) == 1, -1 / p).otherwise(1 / (1 - p)) * F.col("_n")
            loss = F.sum(-F.when(F.col(label) == 1, F.ln(p)).otherwise(F.ln(1 - p)) * F.col("_n"))
            row = cells.agg(loss, *[F.sum(slope * F.col(m)) for m in models]).first()
            return row[0] / total, [x / total for x in row[1:]]

        weights = [1 / len(models)] * len(models)
        loss, slopes = measured(weights)
        for _ in range(steps):
            tried = [w * math.exp(-rate * (g - min(slopes))) for w, g in zip(weights, slopes, strict=True)]
            tried = [x / sum(tried) for x in tried]
            next_loss, next_slopes = measured(tried)
            if next_loss < loss:
                gained, weights, loss, slopes = loss - next_loss, tried, next_loss, next_slopes
                rate *= 1.5
                if gained < 1e-9:
                    break
            else:
                rate /= 4
                if rate < 1e-4:
                    break
        return weights
    finally:
        cells.unpersist()


def cross_fit_ensemble(df: DataFrame, models: list[str], label: str, fold: str) -> DataFrame:
    """blend: each fold's rows by the simplex weights fitted on the other folds.  A fit for each fold, so folds are few."""
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    blend = F.lit(None).cast("double")
    for f in folds:
        blend = F.when(F.col(fold) == f, average(models, simplex_weights(df.where(F.col(fold) != f), models, label))).otherwise(blend)
    return df.withColumn("blend", blend)


def weight_search(df: DataFrame, a: str, b: str, label: str, weights: DataFrame, thresholds: DataFrame) -> DataFrame:
    """weight (of a), threshold and macro F1 of the best blend; ties to the lower weight, then threshold.  Rows are counted by pair of scores first."""
    cells = df.groupBy(a, b, label).agg(F.count(F.lit(1)).alias("_n"))
    tried = cells.crossJoin(F.broadcast(weights)).crossJoin(F.broadcast(thresholds)).withColumn("_p", F.round(F.col("weight") * F.col(a) + (1 - F.col("weight")) * F.col(b), 9))
    hit = (F.col("_p") >= F.col("threshold")).cast("int")
    times = lambda y, h: F.sum(F.when((F.col(label) == y) & (hit == h), F.col("_n")).otherwise(0))
    sums = tried.groupBy("weight", "threshold").agg(times(0, 0).alias("tn"), times(0, 1).alias("fp"), times(1, 0).alias("fn"), times(1, 1).alias("tp")).withColumns(f1_columns())
    best = sums.agg(F.min(F.struct((-F.round("macro_f1", 9)).alias("m"), "weight", "threshold")).alias("_b"))
    return best.select(F.col("_b.weight").alias("weight"), F.col("_b.threshold").alias("threshold"), (-F.col("_b.m")).alias("macro_f1"))


def upsert_experiments(log: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest record of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order))
    both = log.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def compare_false_negative_filter(df: DataFrame, label: str, before: str, after: str) -> DataFrame:
    """Confusion and macro F1 of two predictions of the same rows, and the change."""
    both = df.select(label, F.explode(F.array(F.struct(F.lit("before").alias("variant"), F.col(before).alias("p")), F.struct(F.lit("after").alias("variant"), F.col(after).alias("p")))).alias("x"))
    sums = both.groupBy("x.variant").agg(*[v.alias(k) for k, v in confusion(F.col(label), F.col("x.p")).items()])
    return sums.withColumns(f1_columns())
