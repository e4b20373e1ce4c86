"""Ensembles chosen and fitted by nested cross-fitting: average, geometric, rank, weighted (a simplex) and logistic (a stack).

All fits run together.  A pass over the rows returns, for every fit that still moves, loss, gradient and second derivatives of its
training folds; a Newton step for each follows on the driver, from a few numbers a fit.  Each pair of folds is left out once, so the
method of a fold's rows can be chosen on predictions for the other folds that neither fold's labels have touched.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.math import EPSILON, clip, logit, sigmoid
from .calibration import average, geometric
from .windows import average_percentile

METHODS = ("average", "geometric", "rank", "weighted", "logistic")
RIDGE = 1.0


@dataclass(frozen=True)
class Fitted:
    """Parameters of the fits that leave out some folds: weights on the simplex, coefficients of the stack with the intercept last."""

    models: list[str]
    weights: dict[frozenset, np.ndarray]
    stack: dict[frozenset, np.ndarray]

    def blend(self, method: str, left_out: frozenset) -> Column:
        """The probability by a method; rank needs the columns _rank_<model> of with_ranks()."""
        if method == "average":
            return average(self.models)
        if method == "geometric":
            return geometric(self.models)
        if method == "rank":
            return average([f"_rank_{m}" for m in self.models])
        if method == "weighted":
            return average(self.models, [float(w) for w in self.weights[left_out]])
        *slopes, intercept = (float(c) for c in self.stack[left_out])
        return sigmoid(reduce(lambda a, b: a + b, (F.lit(s) * logit(F.col(m)) for s, m in zip(slopes, self.models, strict=True)), F.lit(intercept)))


def with_ranks(df: DataFrame, models: list[str], group: str) -> DataFrame:
    """_rank_<model>: the percentile of a score within its group, equal ones sharing theirs."""
    return df.withColumns({f"_rank_{m}": average_percentile(m, group) for m in models})


def _passes(df: DataFrame, models: list[str], label: str, fold: str, fits: list[tuple[str, frozenset, np.ndarray]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Loss, gradient and second derivatives of each (kind, folds left out, parameters) over its training rows, in one pass."""
    width = max(len(p) for _, _, p in fits)
    size = 1 + width + width * width

    def run(batches):
        sums = np.zeros((len(fits), size))
        for b in batches:
            x = np.clip(np.stack([b[m].to_numpy(zero_copy_only=False).astype(float) for m in models], 1), EPSILON, 1 - EPSILON)
            y, where = b["_label"].to_numpy(zero_copy_only=False).astype(float), b["_fold"].to_numpy(zero_copy_only=False)
            z = np.concatenate([np.log(x / (1 - x)), np.ones((len(x), 1))], 1)
            likely = np.where(y[:, None] > 0, x, 1 - x)
            for i, (kind, out, p) in enumerate(fits):
                mine = ~np.isin(where, list(out))
                if kind == "weighted":
                    a = likely[mine] / (likely[mine] @ p)[:, None]
                    loss, g, h = -np.log(likely[mine] @ p).sum(), -a.sum(0), a.T @ a
                else:
                    t = z[mine] @ p
                    q = 1 / (1 + np.exp(-np.clip(t, -700, 700)))
                    loss, g, h = (np.logaddexp(0, t) - y[mine] * t).sum(), z[mine].T @ (q - y[mine]), (z[mine] * (q * (1 - q))[:, None]).T @ z[mine]
                k = len(p)
                sums[i, 0] += loss
                sums[i, 1 : k + 1] += g
                sums[i, 1 + width : 1 + width + k * k] += h.ravel()
        at, place = np.repeat(np.arange(len(fits), dtype=np.int32), size), np.tile(np.arange(size, dtype=np.int32), len(fits))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(place), pa.array(sums.ravel())], names=["fit", "place", "v"])

    rows = df.select(*[F.col(m).cast("double").alias(m) for m in models], F.col(label).cast("int").alias("_label"), F.col(fold).cast("long").alias("_fold"))
    out = np.zeros((len(fits), size))
    for i, j, v in rows.mapInArrow(run, "fit int, place int, v double").groupBy("fit", "place").agg(F.sum("v")).collect():
        out[i, j] = v
    return [(row[0], row[1 : len(p) + 1], row[1 + width : 1 + width + len(p) ** 2].reshape(len(p), len(p))) for row, (_, _, p) in zip(out, fits, strict=True)]


def _onto_simplex(v: np.ndarray) -> np.ndarray:
    u = np.sort(v)[::-1]
    over = np.cumsum(u) - 1
    k = np.flatnonzero(u - over / np.arange(1, len(u) + 1) > 0)[-1]
    return np.maximum(v - over[k] / (k + 1), 0)


def _simplex_step(w: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The least of the quadratic model over the simplex, by accelerated projected gradients: a few numbers, no rows."""
    scale = max(np.linalg.eigvalsh(h).max(), 1e-12)
    x = y = w
    t = 1.0
    for _ in range(5000):
        new = _onto_simplex(y - (g + h @ (y - w)) / scale)
        if np.abs(new - x).max() < 1e-15:
            break
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def fit_all(df: DataFrame, models: list[str], label: str, fold: str, left_out: list[frozenset], steps: int = 40, tolerance: float = 1e-8) -> Fitted:
    """The weighted and the logistic fit for each set of folds left out.  Null scores and labels have to be dropped before."""
    m = len(models)
    at = {("weighted", s): np.full(m, 1 / m) for s in left_out} | {("logistic", s): np.zeros(m + 1) for s in left_out}
    ridge = np.array([RIDGE] * m + [0.0])
    moving, best, tried = dict.fromkeys(at), {}, dict(at)
    for _ in range(steps):
        if not moving:
            break
        keys = list(moving)
        for key, (loss, g, h) in zip(keys, _passes(df, models, label, fold, [(*k, tried[k]) for k in keys]), strict=True):
            p = tried[key]
            if key[0] == "logistic":
                loss, g, h = loss + (ridge * p * p).sum() / 2, g + ridge * p, h + np.diag(ridge)
            if key in best and loss > best[key] + 1e-9 * abs(best[key]):  # too far: halfway back
                tried[key] = (at[key] + p) / 2
                if np.abs(tried[key] - at[key]).max() < tolerance:
                    del moving[key]
                continue
            at[key], best[key] = p, loss
            new = _simplex_step(p, g, h) if key[0] == "weighted" else p - np.linalg.solve(h + 1e-9 * np.eye(len(p)), g)
            if np.abs(new - p).max() < tolerance:
                del moving[key]
            tried[key] = new
    return Fitted(models, {s: at[("weighted", s)] for s in left_out}, {s: at[("logistic", s)] for s in left_out})


def _loss(label: str, p: Column) -> Column:
    q = clip(p, EPSILON, 1 - EPSILON)
    return -F.when(F.col(label) > 0, F.ln(q)).otherwise(F.ln(1 - q))


def _by_fold(folds: list[int], fold: str, of) -> Column:
    return reduce(lambda out, f: F.when(F.col(fold) == f, of(f)).otherwise(out), folds, F.lit(None).cast("double"))


def nested_ensemble(df: DataFrame, models: list[str], label: str, fold: str, group: str, methods: tuple[str, ...] = METHODS) -> tuple[DataFrame, DataFrame, Fitted]:
    """(rows, report, fitted).

    rows: df with a column for each method, fitted on the other folds, and method and blend, the one chosen on the other folds by log loss
    (the first of equals).  report: method, n and log_loss over all rows of each method and of the choice ("chosen").  fitted also holds the
    fits that leave out nothing.  Two folds at least, and as few as a fit for each pair of them allows.
    """
    folds = [r[0] for r in df.select(F.col(fold).cast("long").alias("f")).distinct().orderBy("f").collect()]
    if len(folds) < 2:
        raise ValueError("two folds at least")
    none, ones, pairs = frozenset(), [frozenset([f]) for f in folds], [frozenset(p) for p in combinations(folds, 2)]
    fitted = fit_all(df, models, label, fold, [none, *ones, *pairs])
    ranked = with_ranks(df, models, group) if "rank" in methods else df
    inner = ranked.agg(*[F.sum(F.when(F.col(fold) != f, _loss(label, _by_fold([g for g in folds if g != f], fold, lambda g, f=f, m=m: fitted.blend(m, frozenset([f, g])))))).alias(f"l{i}_{j}") for i, f in enumerate(folds) for j, m in enumerate(methods)]).first()
    chosen = {f: methods[int(np.argmin([inner[f"l{i}_{j}"] for j in range(len(methods))]))] for i, f in enumerate(folds)}
    out = ranked.withColumns({m: _by_fold(folds, fold, lambda f, m=m: fitted.blend(m, frozenset([f]))) for m in methods}).drop(*[f"_rank_{m}" for m in models])
    out = out.withColumns({"method": reduce(lambda c, f: F.when(F.col(fold) == f, chosen[f]).otherwise(c), folds, F.lit(None).cast("string")), "blend": _by_fold(folds, fold, lambda f: F.col(chosen[f]))})
    every = {**{m: F.col(m) for m in methods}, "chosen": F.col("blend")}
    sums = out.agg(F.count(F.lit(1)).alias("n"), *[F.avg(_loss(label, c)).alias(m) for m, c in every.items()])
    report = sums.select(F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col("n"), F.col(m).alias("log_loss")) for m in every])).alias("r")).select("r.*")
    return out, report, fitted


def predict_full(df: DataFrame, fitted: Fitted, method: str, group: str, into: str = "blend") -> DataFrame:
    """New rows by the fit on all folds."""
    ranked = with_ranks(df, fitted.models, group) if method == "rank" else df
    return ranked.withColumn(into, fitted.blend(method, frozenset())).drop(*[f"_rank_{m}" for m in fitted.models])
