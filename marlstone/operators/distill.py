"""Distillation: features of a student, labels and weights of its teachers, and the features of a pair ranker."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_fold
from ..functions.math import EPSILON, clip, logit, sigmoid
from .windows import average_percentile, global_average_percentile, group_size

SOURCES = ("title", "item_text", "forced_positive", "char", "word")


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def mean_global_percentile(df: DataFrame, scores: list[str], into: str) -> DataFrame:
    """The mean, over score sources, of a row's percentile among all rows; equal scores share theirs."""
    out = df
    for i, s in enumerate(scores):
        out = global_average_percentile(out, s, f"_pct{i}")
    names = [f"_pct{i}" for i in range(len(scores))]
    return out.withColumn(into, _sum([F.col(n) for n in names]) / len(names)).drop(*names)


def student_features(df: DataFrame, group: str, scores: list[str], ranked: list[str]) -> DataFrame:
    """Adds mean, deviation and range of the scores, the ranked ones' percentiles in the group and among all rows, and the log of the group's size."""
    out = df
    for r in ranked:
        out = global_average_percentile(out, r, f"global_rank_{r}")
    every = [F.col(s).cast("double") for s in scores]
    mean = _sum(every) / len(every)
    deviation = F.sqrt(F.greatest(_sum([x * x for x in every]) / len(every) - mean * mean, F.lit(0.0)))
    spread = F.greatest(*every) - F.least(*every) if len(every) > 1 else F.lit(0.0)
    return out.withColumns({**{f"term_rank_{r}": average_percentile(r, group) for r in ranked}, "model_mean": mean, "model_std": deviation, "model_range": spread, "term_size_log": F.log1p(group_size(group).cast("double"))})


def teacher(first: Column, second: Column) -> dict[str, Column]:
    """teacher_prob, teacher_label and weight of two judges' probabilities, of which the second may be null.

    Two judges count by the mean of their log odds.  Confident labels weigh more; a second judge's agreement adds, its disagreement takes.
    """
    p = F.when(second.isNull(), first).otherwise(sigmoid((logit(clip(first, EPSILON, 1 - EPSILON)) + logit(clip(second, EPSILON, 1 - EPSILON))) / 2))
    agree = (first >= 0.5) == (second >= 0.5)
    factor = F.when(second.isNull(), 1.0).when(agree, 1.35).otherwise(0.55)
    return {"teacher_prob": p, "teacher_label": (p >= 0.5).cast("int"), "weight": (0.35 + 0.65 * 2 * F.abs(p - 0.5)) * factor}


def student(df: DataFrame, group: str, features: list[str], seed: str = "student", trees: int = 20) -> DataFrame:
    """df (with teacher_label and weight) with held_out, a fifth of the groups by hash, and the probability of boosted trees fitted on the others."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ready = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip").transform(df.withColumn("held_out", hash_fold(seed, F.col(group), 5) == 0))
    model = GBTClassifier(featuresCol="_features", labelCol="teacher_label", weightCol="weight", maxIter=trees, maxDepth=4, seed=7).fit(ready.where("not held_out"))
    return model.transform(ready).withColumn("student_prob", vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "prediction")


def ranker_pair_features(df: DataFrame, group: str) -> dict[str, Column]:
    """Features of a retrieved pair beside the lexical ones: rank and its reciprocal, lengths, candidates of its categories, where it came from.

    df has retrieval_rank, retrieval_score, query, title, attributes, top_category, leaf_category and retrieval_source; nulls count as 0 or "".
    For a text, df may have its length (text_length) instead, so that pairs are sorted without texts.
    """
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    size = lambda c: F.coalesce(F.col(f"{c}_length") if f"{c}_length" in df.columns else F.length(c), F.lit(0)).cast("double")
    rank = number("retrieval_rank")
    return {
        "retrieval_rank": rank, "retrieval_rank_pct": F.when(rank > 0, 1 / rank).otherwise(0.0), "retrieval_score": number("retrieval_score"), "query_char_count": size("query"), "title_char_count": size("title"), "attribute_char_count": size("attributes"),
        "top_category_candidate_count": group_size(group, "top_category").cast("double"), "leaf_category_candidate_count": group_size(group, "leaf_category").cast("double"), **{f"source_{s}": F.coalesce(F.col("retrieval_source") == s, F.lit(False)).cast("double") for s in SOURCES},
    }
