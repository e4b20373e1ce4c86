"""Evaluation: reports, calibration error, threshold sweeps, rank metrics, error analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.math import clip
from .windows import range_sums, score_positions


def confusion(label: Column, prediction: Column) -> dict[str, Column]:
    hit = lambda a, b: F.sum(F.when((label == a) & (prediction == b), 1).otherwise(0))
    return {"tn": hit(0, 0), "fp": hit(0, 1), "fn": hit(1, 0), "tp": hit(1, 1)}


def _safe(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1_columns() -> dict[str, Column]:
    """f1_pos, f1_neg and macro_f1 from tn, fp, fn, tp; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    pos, neg = _safe(2 * tp, 2 * tp + fp + fn), _safe(2 * tn, 2 * tn + fp + fn)
    return {"f1_pos": pos, "f1_neg": neg, "macro_f1": (pos + neg) / 2}


def binary_report(df: DataFrame, label: str, prediction: str, probability: str, *group: str) -> DataFrame:
    """Counts, precision, recall and F1 of each class, macro averages, accuracy, rate of positives, log loss and Brier score."""
    p = clip(F.col(probability), 1e-15, 1 - 1e-15)
    y = F.col(label)
    sums = df.groupBy(*group).agg(*[v.alias(k) for k, v in confusion(y, F.col(prediction)).items()], F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"), F.avg((F.col(probability) - y) * (F.col(probability) - y)).alias("brier"))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    out = sums.withColumns({"precision_pos": _safe(tp, tp + fp), "recall_pos": _safe(tp, tp + fn), "precision_neg": _safe(tn, tn + fn), "recall_neg": _safe(tn, tn + fp), "accuracy": _safe(tp + tn, n), "positive_rate": _safe(tp + fp, n)} | f1_columns())
    return out.withColumns({"macro_precision": (F.col("precision_pos") + F.col("precision_neg")) / 2, "macro_recall": (F.col("recall_pos") + F.col("recall_neg")) / 2})


def calibration_error(df: DataFrame, label: str, probability: str, bins: int = 15) -> DataFrame:
    """Expected calibration error over equal bins closed on the right."""
    bin_ = F.least(F.greatest(F.ceil(F.col(probability) * bins) - 1, F.lit(0)), F.lit(bins - 1))
    per = df.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("y"), F.avg(probability).alias("p"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("y") - F.col("p"))) / F.sum("n")).alias("ece"))


def threshold_sweep(df: DataFrame, label: str, probability: str, thresholds: DataFrame) -> DataFrame:
    """threshold, tn, fp, fn, tp, macro_f1 of predicting probability >= threshold.

    Scores are counted by value first; a threshold's counts are a prefix sum over the distinct scores, never a pass over all rows for each.
    """
    scored = df.groupBy(F.col(probability).alias("score")).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"), F.lit(0).alias("is_threshold"))
    marks = thresholds.select(F.col("threshold").cast("double").alias("score"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"), F.lit(1).alias("is_threshold")).distinct()
    cumulative = range_sums(scored.unionByName(marks), ["-score", "is_threshold"], {"pos": "tp", "neg": "fp"}).where("is_threshold = 1")
    totals = df.agg(F.sum(label).alias("_p"), F.sum(1 - F.col(label)).alias("_n"))
    out = cumulative.crossJoin(F.broadcast(totals)).select(F.col("score").alias("threshold"), (F.col("_n") - F.col("fp")).alias("tn"), "fp", (F.col("_p") - F.col("tp")).alias("fn"), "tp")
    return out.withColumns(f1_columns())


def grid(spark, first: int, last: int, scale: int, step: int = 1) -> DataFrame:
    """Thresholds i / scale."""
    return spark.range(first, last + 1, step).select((F.col("id") / scale).alias("threshold"))


def best_threshold(sweep: DataFrame, *group: str) -> DataFrame:
    """The threshold of highest macro F1 (to nine digits); the lowest of equals."""
    rank = F.struct((-F.round("macro_f1", 9)).alias("m"), F.col("threshold"))
    return sweep.groupBy(*group).agg(F.min(rank).alias("_b")).select(*group, F.col("_b.threshold").alias("threshold"), (-F.col("_b.m")).alias("macro_f1"))


def auc_ap(df: DataFrame, label: str, score: str) -> DataFrame:
    """ROC AUC by rank sums with average ranks, and average precision over distinct scores."""
    by = df.groupBy(F.col(score).alias("value")).agg(F.sum(label).cast("double").alias("pos"))
    up = score_positions(df, score).join(by, F.col("score").eqNullSafe(F.col("value")))
    pos, n = F.sum("pos"), F.max("all")
    auc = up.agg(pos.alias("p"), (n - pos).alias("q"), F.sum(F.col("pos") * (F.col("before") + (F.col("n") + 1) / 2)).alias("r"))
    counted = df.groupBy(F.col(score).alias("value")).agg(F.sum(label).cast("double").alias("pos"), F.count(F.lit(1)).alias("n"))
    down = range_sums(counted, ["-value"], {"pos": "tp", "n": "upto"}).agg(F.sum(F.col("pos") * F.col("tp") / F.col("upto")).alias("s"))
    return auc.crossJoin(down).select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"), F.try_divide("s", "p").alias("average_precision"))


def slice_rates(df: DataFrame, group: str, label: str, prediction: str, least: int = 10) -> DataFrame:
    """F1 of each slice with enough rows and both classes."""
    sums = df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(label).alias("_c"), *[v.alias(k) for k, v in confusion(F.col(label), F.col(prediction)).items()])
    return sums.where((F.col("rows") >= least) & (F.col("_c") == 2)).withColumns(f1_columns()).drop("_c")


def error_groups(df: DataFrame, label: str, prediction: str, causes: list[tuple[str, Column]]) -> DataFrame:
    """error (fp, fn), cause (the first that holds), rows."""
    kind = F.when((F.col(label) == 0) & (F.col(prediction) == 1), "fp").when((F.col(label) == 1) & (F.col(prediction) == 0), "fn")
    cause = F.coalesce(*[F.when(c, F.lit(n)) for n, c in causes], F.lit("other"))
    return df.select(kind.alias("error"), cause.alias("cause")).where("error is not null").groupBy("error", "cause").agg(F.count(F.lit(1)).alias("rows"))
