"""Scoring with injected models, and MLlib models.  Training of neural models is outside this library; their scoring interface is not."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import stored

Scorer = Callable[[list[str]], list[tuple[float, float]]]
Encoder = Callable[[list[str]], np.ndarray]


def judge(df: DataFrame, prompt: str, scorer: Scorer, batch: int = 256) -> DataFrame:
    """label, p_relevant and confidence from a scorer's log-probabilities of 0 and 1.  A batch that runs out of memory is halved and tried again."""
    names = [c for c in df.columns if c != prompt]

    def scored(texts: list[str]) -> list[tuple[float, float]]:
        try:
            return scorer(texts)
        except MemoryError:
            if len(texts) == 1:
                raise
            half = len(texts) // 2
            return scored(texts[:half]) + scored(texts[half:])

    def run(batches):
        for b in batches:
            texts = [x or "" for x in b[prompt].to_pylist()]
            out = [s for i in range(0, len(texts), batch) for s in scored(texts[i : i + batch])]
            p = [1 / (1 + math.exp(max(-700.0, min(700.0, a - z)))) for a, z in out]
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array(p, pa.float64()), pa.array([max(x, 1 - x) for x in p], pa.float64())], names=[*names, "label", "p_relevant", "confidence"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != prompt)
    return df.mapInArrow(run, f"{schema}, label int, p_relevant double, confidence double")


def hashing_encoder(size: int) -> Encoder:
    """Word counts hashed to size signed places, of length one: an encoder without a model, for tests."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % size] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def embed(df: DataFrame, text: str, encoder: Encoder, size: int) -> DataFrame:
    """embedding (array of float) by an injected encoder, a batch at a time."""
    names = [c for c in df.columns if c != text]

    def run(batches):
        for b in batches:
            m = np.asarray(encoder([x or "" for x in b[text].to_pylist()]), np.float32).reshape(-1, size)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, size, dtype=np.int32)), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), vectors], names=[*names, "embedding"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text)
    return df.mapInArrow(run, f"{schema}, embedding array<float>")


def refresh_embeddings(texts: DataFrame, cache: DataFrame, key: str, text: str, encoder: Encoder, size: int, model: str) -> DataFrame:
    """The cache with only new or changed texts encoded; a row is valid for its key, text hash and model."""
    wanted = texts.select(key, text, F.sha2(F.col(text), 256).alias("text_hash"), F.lit(model).alias("model"))
    keys = [key, "text_hash", "model"]
    fresh = embed(wanted.join(cache.select(*keys), keys, "left_anti"), text, encoder, size)
    return cache.join(wanted.select(*keys), keys, "left_semi").unionByName(fresh)


def estimated_hours(pairs: int, folds: int, rows_per_second: float) -> float:
    return pairs * folds / rows_per_second / 3600 * 1.15


def out_of_fold_gbt(df: DataFrame, features: list[str], label: str, fold: str, trees: int = 10) -> DataFrame:
    """Each fold predicted by boosted trees fitted on the others."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.classification import GBTClassifier

    ready = VectorAssembler(inputCols=features, outputCol="features").transform(df)
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    parts = []
    for f in folds:
        model = GBTClassifier(labelCol=label, maxIter=trees, maxDepth=4, seed=7).fit(ready.where(F.col(fold) != f))
        parts.append(model.transform(ready.where(F.col(fold) == f)).withColumn("prediction", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability"))
    return reduce(DataFrame.unionByName, parts)


def adversarial_auc(df: DataFrame, text: str, label: str, features: int = 1 << 12) -> DataFrame:
    """How well a linear model tells two sources of texts apart: AUC on a held-out fifth.  Texts are read once; all passes of the fit go over their term counts."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF
    from pyspark.ml.functions import vector_to_array

    from ..functions.hashing import keyed_hash
    from ..functions.text import normalize, split_tokens
    from .metrics import auc_ap

    tokens = df.select(label, split_tokens(normalize(F.col(text))).alias("tokens"), (keyed_hash("adv", F.md5(text)) % 5).alias("_fold"))
    rows = stored(HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features).transform(tokens).drop("tokens"), "term-counts")
    model = Pipeline(stages=[IDF(inputCol="tf", outputCol="features"), LogisticRegression(labelCol=label, regParam=0.01, maxIter=30)]).fit(rows.where("_fold <> 0"))
    scored = model.transform(rows.where("_fold = 0")).select(label, vector_to_array("probability")[1].alias("p"))
    return auc_ap(scored, label, "p").select("auc").crossJoin(scored.agg(F.count(F.lit(1)).alias("rows")))
