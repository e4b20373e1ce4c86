"""Fitted models beside the classifiers of scoring.py: truncated SVD, a regressor, a pairwise ranker, adversarial validation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import keyed_hash
from ..functions.text import normalize, split_tokens
from ..sources.workspace import stored
from .joins import small_side
from .metrics import auc_ap
from .retrieval import char_grams, word_grams

PART_TEXTS = 20_000
PAIR_BUCKET, PAIR_PART = 10_000, 250_000


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.drop_null()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def gram_matrix(df: DataFrame, vector: str) -> np.ndarray:
    """X'X of a column of equally long vectors: a partial product for each task, added up row by row; null vectors count for nothing.

    The driver gets width x width numbers, so the width has to be bounded; the number of rows does not.
    """

    def partial(batches):
        total = None
        for b in batches:
            x = _matrix(b[vector])
            if len(x):
                total = x.T @ x + (0 if total is None else total)
        for i, row in enumerate([] if total is None else total):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), i, np.int32)), pa.array(np.arange(len(row), dtype=np.int32)), pa.array(row)], names=["i", "j", "v"])

    cells = df.select(F.col(vector).cast("array<double>").alias(vector)).mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    width = int(cells["i"].max()) + 1 if len(cells) else 0
    out = np.zeros((width, width))
    out[cells["i"], cells["j"]] = cells["v"]
    return out


def truncated_svd(df: DataFrame, vector: str, size: int, into: str = "reduced") -> DataFrame:
    """The column replaced by its coordinates on the leading `size` right singular vectors, scaled to length one.

    Fewer coordinates where the width or the rank is smaller.  A null vector stays null, and one of zeros stays zeros.
    """
    values, vectors = np.linalg.eigh(gram_matrix(df, vector)) if size > 0 else (np.zeros(0), np.zeros((0, 0)))
    keep = np.argsort(values)[::-1][:size]
    keep = keep[values[keep] > 1e-12 * max(values.max(initial=0.0), 1e-300)]
    basis = vectors[:, keep] * np.where(vectors[np.abs(vectors[:, keep]).argmax(axis=0), keep] < 0, -1.0, 1.0) if len(keep) else np.zeros((len(values), 0))
    names = [c for c in df.columns if c != vector]

    def project(batches):
        for b in batches:
            x = _matrix(b[vector])
            y = x @ basis if len(x) else np.zeros((0, basis.shape[1]))
            y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
            rows = iter(y.tolist())
            reduced = pa.array([None if null else next(rows) for null in b[vector].is_null().to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), reduced], names=[*names, into])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields if f.name != vector)
    return df.withColumn(vector, F.col(vector).cast("array<double>")).mapInArrow(project, f"{schema}`{into}` array<double>")


def group_size_features(df: DataFrame, group: str, label: str, score: str, text: Column) -> DataFrame:
    """One row for each group: k (positives), its size, mean, greatest and deviation of the scores, characters and words of its text; missing: 0."""
    rows = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_candidates"), F.sum(label).alias("k"), F.avg(score).alias("score_mean"), F.max(score).alias("score_max"), F.stddev_samp(score).alias("score_std"), F.min(text).alias("_text"))
    sized = rows.withColumns({"query_chars": F.length("_text"), "query_tokens": F.size(F.filter(F.split("_text", r"\s+"), lambda w: w != ""))}).drop("_text")
    return sized.fillna(0)


SIZE_FEATURES = ["n_candidates", "score_mean", "score_max", "score_std", "query_chars", "query_tokens"]


def size_regressor(features: DataFrame, group: str, trees: int = 20, seed: int = 13) -> DataFrame:
    """The features with `held_out` (a fifth of the groups, by keyed hash) and a prediction of k by boosted trees fitted on the others."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = features.withColumn("held_out", keyed_hash(f"size{seed}", F.col(group)) % 5 == 0)
    ready = VectorAssembler(inputCols=SIZE_FEATURES, outputCol="_features").transform(rows)
    model = GBTRegressor(featuresCol="_features", labelCol="k", lossType="absolute", maxIter=trees, maxDepth=4, stepSize=0.1, seed=seed).fit(ready.where("not held_out"))
    return model.transform(ready).drop("_features")


def size_report(predicted: DataFrame) -> DataFrame:
    """val_mae of held-out groups, median and mean k of the fitted ones, beside the error of always saying that median."""
    fitted = predicted.where("not held_out").agg(F.percentile("k", F.lit(0.5)).alias("train_k_median"), F.avg("k").alias("train_k_mean"))
    held = predicted.where("held_out").crossJoin(fitted)  # one row
    return held.groupBy("train_k_median", "train_k_mean").agg(F.avg(F.abs(F.col("prediction") - F.col("k"))).alias("val_mae"), F.avg(F.abs(F.col("train_k_median") - F.col("k"))).alias("median_mae"), F.count(F.lit(1)).alias("val_groups"))


def preference_pairs(df: DataFrame, group: str, label: str, key: str, features: list[str], seed: str = "pairs", rounds: int = 3) -> DataFrame:
    """Differences of features between a positive and a negative of one group, no more than `rounds` for each row.

    Rows of a group lie in the order of a keyed hash, another one each round, and each is held against the next one.  Groups of over
    PAIR_BUCKET rows are cut into parts of about that many by the same hash, so no task gets a whole group, however large it is.
    Rows are dealt in tasks of about PAIR_PART, a number given outright that is not merged again, so what a task sorts does not grow with them.
    """
    tasks = max(1, -(-df.count() // PAIR_PART))
    sizes = df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / PAIR_BUCKET).alias("_parts"))
    large = small_side(stored(sizes.where("_parts > 1"), "large-groups"))
    values = F.struct(*[F.col(f).cast("double").alias(f) for f in features])
    rows = df.where(F.col(group).isNotNull()).join(large, group, "left").select(group, F.col(label).alias("_y"), values.alias("_x"), F.col(key).alias("_key"), F.coalesce("_parts", F.lit(1)).alias("_parts"))
    parts = []
    for r in range(rounds):
        drawn = rows.withColumn("_h", keyed_hash(f"{seed}{r}", F.col("_key"))).withColumn("_part", F.col("_h") % F.col("_parts")).repartition(tasks, group, "_part")
        w = Window.partitionBy(group, "_part").orderBy("_h", "_key")
        near = drawn.withColumns({"_next": F.lead("_x").over(w), "_next_y": F.lead("_y").over(w)}).where("_y <> _next_y")
        sign = F.when(F.col("_y") > F.col("_next_y"), 1.0).otherwise(-1.0)
        parts.append(near.select(group, *[(sign * (F.col(f"_x.`{f}`") - F.col(f"_next.`{f}`"))).alias(f) for f in features]))
    return reduce(DataFrame.unionByName, parts)


def pairwise_ranker(df: DataFrame, group: str, label: str, key: str, features: list[str]) -> np.ndarray:
    """Weights of a linear ranker: logistic regression, without a constant, on preference pairs and their mirror images."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    pairs = stored(preference_pairs(df, group, label, key, features).select(*features), "preference-pairs")
    if pairs.isEmpty():
        return np.zeros(len(features))
    both = pairs.withColumn("_sign", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    mirrored = both.select(*[(F.col("_sign") * F.col(f)).alias(f) for f in features], (F.col("_sign") > 0).cast("int").alias("_y"))
    ready = VectorAssembler(inputCols=features, outputCol="_features").transform(mirrored)
    return LogisticRegression(featuresCol="_features", labelCol="_y", fitIntercept=False, regParam=0.001, maxIter=50).fit(ready).coefficients.toArray()


def rank_scores(df: DataFrame, features: list[str], weights: np.ndarray, into: str = "rank_score") -> DataFrame:
    return df.withColumn(into, reduce(lambda a, b: a + b, [F.col(f).cast("double") * float(w) for f, w in zip(features, weights, strict=True)]))


def text_counts(text: Column) -> dict[str, Column]:
    """Six numbers of a normalised text: characters, words, digits, Turkish letters, units, and other characters."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return {"length_chars": F.length(text), "length_tokens": F.size(split_tokens(text)), "digit_count": count(r"\d"), "turkish_char_count": count("[çğıöşü]"), "unit_count": count(r"\b(?:gb|tb|ml|kg|cm|mm|mah)\b"), "punctuation_count": count("[^a-zçğıöşü0-9 ]")}


def adversarial_validation(df: DataFrame, key: str, text: str, label: str, folds: int = 5, vocabulary: int = 40_000, least: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """How well texts of two sources (label 0, 1) can be told apart: out-of-fold scores, AUC of each fold and over all, the 200 largest coefficients.

    Logistic regression, both labels of equal weight, on TF-IDF of words and word pairs, TF-IDF of character n-grams inside words, and
    six standardised counts.  Folds are dealt in each label by a keyed hash.  The driver holds two vocabularies of bounded size; terms
    that fewer than `least` texts hold are left out.  Term frequencies are plain counts.  Grams are made once and features once: both
    stay cached (in memory, then on disk), the features as long as the scores are in use.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    share = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in share)
    weight = F.create_map(*[F.lit(x) for r in share for x in (r[label], total / (len(share) * r["n"]))])
    clean = F.coalesce(F.col(text), F.lit(""))
    # a small file of texts is one task, and its grams are many times as large; a number given outright is not merged again
    dealt = df.repartition(max(1, -(-total // PART_TEXTS)), key)
    rows = dealt.select(key, label, normalize(clean).alias("_norm"), word_grams(clean).alias("_words"), char_grams(clean).alias("_chars"), (keyed_hash("adversarial", F.col(label), F.col(key)) % folds).alias("fold"), weight[F.col(label)].alias("_weight"))
    counts = text_counts(F.col("_norm"))
    rows = rows.withColumns({n: c.cast("double") for n, c in counts.items()}).drop("_norm").persist()
    stages = []
    for c in ("_words", "_chars"):
        stages += [CountVectorizer(inputCol=c, outputCol=f"{c}_tf", vocabSize=vocabulary, minDF=least), IDF(inputCol=f"{c}_tf", outputCol=f"{c}_idf"), Normalizer(inputCol=f"{c}_idf", outputCol=f"{c}_x")]
    stages += [VectorAssembler(inputCols=list(counts), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_counts", withMean=True), VectorAssembler(inputCols=["_words_x", "_chars_x", "_counts"], outputCol="_features")]
    prepared = Pipeline(stages=stages).fit(rows)
    ready = prepared.transform(rows).select(key, label, "fold", "_weight", "_features").persist()
    ready.count()
    rows.unpersist()
    fit = lambda part: LogisticRegression(featuresCol="_features", labelCol=label, weightCol="_weight", regParam=0.01, maxIter=100, standardization=False).fit(part)
    scored = [fit(ready.where(F.col("fold") != f)).transform(ready.where(F.col("fold") == f)) for f in range(folds)]
    scores = reduce(DataFrame.unionByName, scored).select(key, label, "fold", vector_to_array("probability")[1].alias("score"))
    by_fold = [auc_ap(scores.where(F.col("fold") == f), label, "score").select(F.lit(f).alias("fold"), "auc") for f in range(folds)]
    aucs = reduce(DataFrame.unionByName, [*by_fold, auc_ap(scores, label, "score").select(F.lit(-1).alias("fold"), "auc")])
    names = [f"word:{w}" for w in prepared.stages[0].vocabulary] + [f"char:{w}" for w in prepared.stages[3].vocabulary] + [f"numeric:{n}" for n in counts]
    weights = fit(ready).coefficients.toArray()
    top = np.argsort(-np.abs(weights), kind="stable")[:200]
    features = df.sparkSession.createDataFrame([(names[i], float(weights[i]), int(weights[i] > 0)) for i in top], "feature string, coefficient double, direction int")
    return scores, aucs, features
