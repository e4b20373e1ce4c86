"""Leakage-safe splits: by hash, holdout, balanced groups, clusters; manifests and overlap audits."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_fold, keyed_hash
from ..sources.workspace import stored
from .joins import small_side
from .windows import number_rows, range_sums

LOAD_BITS = 12
HASH_PARTS, HASH_BITS = 256, 60


def hash_folds(df: DataFrame, key: str, folds: int, seed: str) -> DataFrame:
    return df.withColumn("fold", hash_fold(seed, F.col(key), folds))


def group_holdout(df: DataFrame, group: str, fraction: float, seed: str) -> DataFrame:
    """split: the first fraction of groups in hash order is valid, the rest train; all rows of a group go together."""
    groups = df.select(group).distinct()
    n = groups.count()
    order = number_rows(groups.withColumn("_hash", keyed_hash(seed, F.col(group))), ["_hash", group], "_n")
    return df.join(order.select(group, F.when(F.col("_n") < max(1, int(n * fraction)), "valid").otherwise("train").alias("split")), group)


def assign_balanced(loads: list[tuple[str, int]], folds: int) -> dict[str, int]:
    """Greedy: groups from the heaviest, each to the lightest fold (the lowest of equals).  loads are ordered for ties."""
    heap = [(0, f) for f in range(folds)]
    out = {}
    for key, load in sorted(loads, key=lambda x: -x[1]):
        total, fold = heapq.heappop(heap)
        out[key] = fold
        heapq.heappush(heap, (total + load, fold))
    return out


def deal_classes(classes: list[tuple[int, int]], folds: int) -> list[tuple[int, int, list[int]]]:
    """The greedy assignment of (load, count) classes from the heaviest, without a step for each group: (load, first, order) phases.

    Equal loads go to the n-th least of all (total of a fold + k * load, fold).  Folds whose next totals lie within one load of the least
    take turns in a fixed order, until the next fold comes within reach: so a class has at most `folds` phases, and from number `first` on
    its members go to order[(number - first) % len(order)].
    """
    totals, out = [0] * folds, []
    for load, count in sorted(classes, reverse=True):
        if load <= 0:  # adds nothing: all to the lightest
            out.append((load, 0, [min(range(folds), key=lambda f: (totals[f], f))]))
            continue
        first = 0
        while first < count:
            least = min(totals)
            order = sorted((f for f in range(folds) if totals[f] < least + load), key=lambda f: (totals[f], f))
            others = [totals[f] for f in range(folds) if totals[f] >= least + load]
            left = count - first
            rounds = min((min(others) - least) // load, -(-left // len(order))) if others else -(-left // len(order))
            out.append((load, first, order))
            for place, f in enumerate(order):
                totals[f] += load * min(rounds, max(0, -(-(left - place) // len(order))))
            first += rounds * len(order)
    return out


def load_class(load: Column) -> Column:
    """The load with all but its LOAD_BITS leading bits zero: loads below 2 ** LOAD_BITS are classes of their own."""
    spare = F.greatest(F.length(F.bin(load)) - LOAD_BITS, F.lit(0))
    width = F.call_function("shiftleft", F.lit(1).cast("long"), spare)
    return F.when(load <= 0, F.lit(0).cast("long")).otherwise(load - F.pmod(load, width))


def balanced_folds(df: DataFrame, group: str, load: str, folds: int, seed: str) -> DataFrame:
    """group, load and fold: greedily, groups from the heaviest (equal ones by hash) to the lightest fold (the lowest of equals).

    Groups of one load are one class; the driver runs over classes, their number by the loads' leading bits, never over groups, and a
    group finds its fold by its number in its class.  Numbers come from counts of hash ranges, so a class of all groups is not one task.
    Loads are whole numbers, at least 0; a load of more than LOAD_BITS bits counts as its class.
    """
    loads = df.groupBy(group).agg(F.sum(load).cast("long").alias("load")).withColumns({"_hash": keyed_hash(seed, F.col(group))}).withColumn("_class", load_class(F.coalesce("load", F.lit(0))))
    loads = loads.withColumn("_part", F.shiftright("_hash", HASH_BITS - 8).cast("int"))
    counts = loads.groupBy("_class", "_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(Window.partitionBy("_class").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    phases = deal_classes([(r[0], r[1]) for r in counts.groupBy("_class").agg(F.sum("_n")).collect()], folds)
    schema = "_class long, _phases array<struct<first:long,order:array<int>>>"
    by_class: dict[int, list] = {}
    for at, first, order in phases:
        by_class.setdefault(at, []).append((first, order))
    table = df.sparkSession.createDataFrame(list(by_class.items()), schema)
    inside = F.row_number().over(Window.partitionBy("_class", "_part").orderBy("_hash", group)) - 1
    numbered = loads.withColumn("_at", inside).join(ahead, ["_class", "_part"]).withColumn("_at", F.col("_at") + F.col("_ahead")).join(table, "_class")
    phase = F.element_at(F.filter("_phases", lambda p: p["first"] <= F.col("_at")), -1)
    return numbered.withColumn("_p", phase).select(group, "load", F.get("_p.order", F.pmod(F.col("_at") - F.col("_p.first"), F.size("_p.order")).cast("int")).alias("fold"))


def cluster_folds(vectors: DataFrame, key: str, vector: str, clusters: int, folds: int, seed: int = 7) -> DataFrame:
    """k-means clusters of vectors; a cluster never crosses folds."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=clusters, seed=seed, maxIter=20).fit(ready)
    placed = model.transform(ready).select(key, F.col("prediction").alias("cluster"))
    sizes = [(str(r[0]), r[1]) for r in placed.groupBy("cluster").count().orderBy("cluster").collect()]
    fold = assign_balanced(sizes, folds)
    table = vectors.sparkSession.createDataFrame([(int(c), f) for c, f in fold.items()], "cluster int, fold int")
    return placed.join(F.broadcast(table), "cluster").select(key, "cluster", "fold")


def test_like(df: DataFrame, group: str, share: float) -> DataFrame:
    """Groups of highest mean domain score until their positives reach a share of all; fold 0, the others -1."""
    groups = df.groupBy(group).agg(F.round(F.avg("domain_score"), 12).alias("domain"), F.sum("label").alias("positives"))
    total = groups.agg(F.sum("positives").alias("_all"))
    return range_sums(groups, ["-domain", "-positives", group], {"positives": "_before"}, before=True).crossJoin(F.broadcast(total)).withColumn("fold", F.when(F.col("_before") < share * F.col("_all"), 0).otherwise(-1)).drop("_before", "_all")


def validate_manifest(manifest: DataFrame, group: str, fold: str = "fold") -> None:
    if not manifest.groupBy(group).agg(F.count_distinct(fold).alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"a {group} crosses folds")


def overlap_audit(df: DataFrame, item: str, fold: str = "fold") -> DataFrame:
    """For each fold: distinct items in it, those also elsewhere, and their share."""
    per = df.select(item, fold).distinct()
    spread = per.withColumn("_folds", F.count(F.lit(1)).over(Window.partitionBy(item)))
    return spread.groupBy(fold).agg(F.count(F.lit(1)).alias("items"), F.sum((F.col("_folds") > 1).cast("long")).alias("shared")).withColumn("shared_rate", F.col("shared") / F.col("items"))


HELD_BYTES = 8 << 20


def fold_scope(pairs: DataFrame, fold: int, item: str, family: str, policy: str) -> DataFrame:
    """Training pairs of other folds, without the items (purge_item) or families (purge_family) of the held-out fold; audit keeps all and flags them."""
    if policy not in {"audit", "purge_item", "purge_family"}:
        raise ValueError(f"unknown policy {policy!r}")
    key = family if policy == "purge_family" else item
    # each key once: few families would else bring all their rows to a few tasks
    held = small_side(stored(pairs.where(F.col("fold") == fold).select(key).distinct(), "held-keys"), HELD_BYTES)
    train = pairs.where(F.col("fold") != fold)
    if policy == "audit":
        return train.join(held.withColumn("leaks", F.lit(1)), item, "left").fillna(0, ["leaks"])
    return train.join(held, key, "left_anti").withColumn("leaks", F.lit(0))


def size_profile(df: DataFrame, group: str) -> DataFrame:
    """The sorted group sizes as one array, for drawing sizes by hash."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("times")).agg(F.array_sort(F.collect_list(F.struct("n", "times"))).alias("profile"))
