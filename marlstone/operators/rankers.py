"""A ranker of boosted regression trees on pairwise gradients, and model search by successive halving.

The loss of a group is the mean of exp(score of a negative - score of a positive) over all its pairs.  It factors into two sums, one over
the positives and one over the negatives, so the exact gradient of every row needs those two sums of its group and no pairs: they are
combined on the map side, and a group with a third of all rows is two numbers like any other.  A round fits one tree to the signs with the
gradients as weights (its leaves are the Newton steps of this loss) with MLlib's histogram trees, so rows never leave their executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import stored
from .windows import ordinal_rank

STORE_EVERY = 5


@dataclass(frozen=True)
class Settings:
    depth: int = 3
    rate: float = 0.3
    bins: int = 64
    least_rows: int = 5


@dataclass
class TreeRanker:
    features: list[str]
    settings: Settings
    trees: list[DecisionTreeRegressionModel] = field(default_factory=list)

    def score(self, df: DataFrame, into: str = "rank_score") -> DataFrame:
        """df with the sum of the trees' steps; a null feature counts as 0."""
        out = _assembled(df, self.features).withColumn(into, F.lit(0.0))
        for tree in self.trees:
            out = _added(out, tree, self.settings.rate, into)
        return out.drop("_features")


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    plain = df.withColumns({f"_f{i}": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for i, f in enumerate(features)})
    names = [f"_f{i}" for i in range(len(features))]
    return VectorAssembler(inputCols=names, outputCol="_features").transform(plain).drop(*names)


def _added(df: DataFrame, tree: DecisionTreeRegressionModel, rate: float, score: str) -> DataFrame:
    return tree.transform(df).withColumn(score, F.col(score) + rate * F.col("_step")).drop("_step")


def pairwise_gradients(df: DataFrame, group: str, label: str, score: str) -> DataFrame:
    """df with _weight (size of the row's gradient) and _sign (1 for positives); groups of one class have no pairs and are left out."""
    positive = F.col(label) > 0
    up, down = F.exp(-F.col(score)), F.exp(score)
    sums = df.groupBy(group).agg(F.sum(F.when(positive, up)).alias("_p"), F.sum(F.when(~positive, down)).alias("_n"), F.count(F.when(positive, 1)).alias("_np"), F.count(F.when(~positive, 1)).alias("_nn")).where("_np > 0 and _nn > 0")
    joined = df.join(sums, group)
    weight = F.when(positive, up * F.col("_n")).otherwise(down * F.col("_p")) / (F.col("_np") * F.col("_nn"))
    return joined.withColumns({"_weight": weight, "_sign": F.when(positive, 1.0).otherwise(-1.0)}).drop("_p", "_n", "_np", "_nn")


class Fit:
    """A ranker being fitted: more rounds can follow, and held-out rows are scored along."""

    def __init__(self, train: DataFrame, group: str, label: str, features: list[str], settings: Settings):
        self.ranker, self.group, self.label = TreeRanker(features, settings), group, label
        rows = train.where(F.col(group).isNotNull() & F.col(label).isNotNull())
        self.rows = stored(_assembled(rows, features).select(group, label, "_features", F.lit(0.0).alias("_score")), "ranker")

    def run(self, rounds: int) -> TreeRanker:
        s = self.ranker.settings
        learner = DecisionTreeRegressor(featuresCol="_features", labelCol="_sign", weightCol="_weight", predictionCol="_step", maxDepth=s.depth, maxBins=s.bins, minInstancesPerNode=s.least_rows, seed=7)
        for _ in range(rounds):
            pairs = pairwise_gradients(self.rows, self.group, self.label, "_score")
            if not self.ranker.trees and pairs.isEmpty():
                break
            tree = learner.fit(pairs.select("_features", "_sign", "_weight"))
            self.ranker.trees.append(tree)
            self.rows = _added(self.rows, tree, s.rate, "_score")
            if len(self.ranker.trees) % STORE_EVERY == 0:
                self.rows = stored(self.rows, "ranker")
        return self.ranker


def tree_ranker(train: DataFrame, group: str, label: str, features: list[str], settings: Settings | None = None, rounds: int = 20) -> TreeRanker:
    """A ranker fitted on rows of group, label (0 or 1) and features.  Without a group of both classes it scores all rows 0."""
    return Fit(train, group, label, features, settings or Settings()).run(rounds)


def ndcg(df: DataFrame, group: str, label: str, score: str, item: str, k: int = 10) -> float | None:
    """Mean NDCG at k over groups with a positive, equal scores by item; None without such a group."""
    gain = F.when(F.col("_r") <= k, F.col(label) / F.log2(F.col("_r") + 1))
    rows = df.select(group, F.col(label).cast("double").alias(label), score, item).withColumn("_r", ordinal_rank(group, score, item))
    per = rows.groupBy(group).agg(F.sum(gain).alias("dcg"), F.sum(label).cast("int").alias("n")).where("n > 0")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return per.agg(F.avg(F.col("dcg") / ideal)).first()[0]


@dataclass(frozen=True)
class Trial:
    settings: Settings
    rounds: int
    ndcg: float


def successive_halving(df: DataFrame, group: str, label: str, item: str, features: list[str], candidates: list[Settings], fold: str, held: int, rounds: int = 4) -> tuple[TreeRanker, list[Trial]]:
    """The best of the candidates on the groups of one fold, and all trials.

    All start with `rounds` trees; the better half goes on with as many again as it has, until one is left.  No tree is fitted twice.
    """
    train, test = stored(df.where(F.col(fold) != held), "search-train"), stored(df.where(F.col(fold) == held), "search-test")
    fits, trials = [Fit(train, group, label, features, s) for s in candidates], []
    while True:
        rated = []
        for n, fit in enumerate(fits):
            ranker = fit.run(rounds)
            value = ndcg(ranker.score(test, "_s"), group, label, "_s", item) or 0.0
            trials.append(Trial(ranker.settings, len(ranker.trees), value))
            rated.append((-value, n))
        fits = [fits[n] for _, n in sorted(rated)[: max(1, len(rated) // 2)]]
        if len(rated) <= 1:
            return fits[0].ranker, trials
        rounds *= 2
