"""Nearest neighbours by cosine: exact search in blocks, and an inverted file of cells for approximate search.

Both run on one join of blocks: queries and items meet by key in groups of bounded size, a task multiplies two matrices and keeps the k
best of each query.  No query goes through the driver, no block depends on how the rows are skewed, and equal scores go by item key.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import shared_folder
from .windows import ordinal_rank

ITEM_ROWS, QUERY_ROWS = 20_000, 4_000
SLAB_CELLS = 1 << 21  # scores that a task holds at once, some 16 MB
SAMPLE_ROWS, TUNING_QUERIES, MOST_CELLS = 20_000, 256, 4096


def _parts(count: Column | int, rows: int) -> Column:
    return F.greatest(F.ceil(F.lit(count) / rows), F.lit(1)).cast("int")


def _part_of(key: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(key), parts).cast("int")


def unit(column: pa.Array) -> np.ndarray:
    m = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _slabs(rows: int, width: int) -> list[slice]:
    """Runs of rows that have SLAB_CELLS scores at most, or one row."""
    step = max(1, SLAB_CELLS // max(width, 1))
    return [slice(a, a + step) for a in range(0, rows, step)]


def _best(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (scores, keys) of each row, equal scores by key."""
    if scores.shape[1] > 4 * k:  # what cannot be among the best goes first; what equals the k-th score stays
        least = np.partition(scores, -k, axis=1)[:, -k]
        keep = (scores >= least[:, None]).any(0)
        scores, keys = scores[:, keep], keys[keep]
    order = np.lexsort((np.broadcast_to(keys, scores.shape), -scores))[:, :k]
    return np.take_along_axis(scores, order, 1), keys[order]


def block_top_k(queries: DataFrame, items: DataFrame, on: list[str], k: int, query_key: str, item_key: str, vector: str) -> DataFrame:
    """The k best items of each query over all groups in which they meet.  Both sides have the columns `on`, whose groups must be bounded."""
    if k <= 0:
        raise ValueError("k must be positive")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        q, i = left.combine_chunks(), right.combine_chunks()
        ids, keys = i[item_key].to_numpy(), q[query_key].to_numpy()
        if not len(ids) or not len(keys):
            return pa.table({query_key: pa.array([], pa.int64()), item_key: pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        left_units, right_units = unit(q[vector].chunk(0)), unit(i[vector].chunk(0)).T
        found = [_best(left_units[cut] @ right_units, ids, k) for cut in _slabs(len(keys), len(ids))]
        scores, best = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        return pa.table({query_key: np.repeat(keys, scores.shape[1]), item_key: best.ravel(), "score": scores.ravel()})

    pick = lambda df, key: df.select(*on, F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector)).where(F.col(vector).isNotNull())
    found = pick(queries, query_key).groupBy(*on).cogroup(pick(items, item_key).groupBy(*on)).applyInArrow(search, f"{query_key} long, {item_key} long, score double")
    return found.withColumn("rank", ordinal_rank(query_key, "score", item_key)).where(F.col("rank") <= k)


def exact_top_k(queries: DataFrame, items: DataFrame, k: int, query_key: str, item_key: str, vector: str = "embedding", item_rows: int = ITEM_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Every query against every item, in blocks of about query_rows by item_rows.

    query_key and item_key are longs and differ in name; rows without a vector are left out, vectors of zeros score 0.
    """
    n, m = queries.count(), items.count()
    query_parts, item_parts = max(1, -(-n // query_rows)), max(1, -(-m // item_rows))
    q = queries.select(query_key, vector, _part_of(query_key, F.lit(query_parts)).alias("_q"), F.explode(F.sequence(F.lit(0), F.lit(item_parts - 1))).alias("_i"))
    i = items.select(item_key, vector, _part_of(item_key, F.lit(item_parts)).alias("_i"), F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))).alias("_q"))
    return block_top_k(q, i, ["_q", "_i"], k, query_key, item_key, vector)


@dataclass(frozen=True)
class CellIndex:
    """An inverted file: rows in the table at `path` by cell and part, the cells' centroids, and how many cells to probe."""

    path: str
    centroids: np.ndarray
    item_key: str
    vector: str
    probes: int = 1

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"`{self.item_key}` long, `{self.vector}` array<double>, part int, parts int, cell int").parquet(self.path)


def _nearest(scores: np.ndarray, n: int) -> np.ndarray:
    """The n best columns of each row, equal ones by number."""
    return (scores.argmax(1)[:, None] if n == 1 else np.argsort(-scores, axis=1, kind="stable")[:, :n]).astype(np.int32)


def _nearest_cells(df: DataFrame, vector: str, centroids: np.ndarray, n: int, into: str) -> DataFrame:
    """df with its n nearest cells, nearest first; vectors without length are in cell 0."""
    n = min(n, len(centroids))

    def cells(v: pa.Array) -> pa.Array:
        units = unit(v)
        order = np.concatenate([_nearest(units[cut] @ centroids.T, n) for cut in _slabs(len(units), len(centroids))]) if len(units) else np.zeros((0, n), np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1) * n, pa.int32()), pa.array(order.ravel(), pa.int32()))

    return df.withColumn(into, F.arrow_udf(cells, "array<int>")(F.col(vector).cast("array<double>")))


def fit_cells(items: DataFrame, item_key: str, vector: str, cells: int, sample_rows: int = SAMPLE_ROWS, steps: int = 12) -> np.ndarray:
    """Unit centroids from the sample_rows rows with the smallest key hashes: a bounded sample, whatever the table's size."""
    sample = items.orderBy(F.xxhash64(item_key), item_key).limit(sample_rows).select(F.col(vector).cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    units = sample.where(norm > 0).select(array_to_vector(F.transform("v", lambda x: x / norm)).alias("features"))
    if units.isEmpty():
        return np.zeros((1, 1))
    model = KMeans(k=max(2, cells), maxIter=steps, seed=7, distanceMeasure="euclidean").fit(units)
    c = np.array(model.clusterCenters())
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)


def build_cells(items: DataFrame, item_key: str, vector: str = "embedding", cells: int | None = None, item_rows: int = ITEM_ROWS, sample_rows: int = SAMPLE_ROWS, path: str | None = None) -> CellIndex:
    """Every row assigned to its nearest cell and written by cell; a cell of more than item_rows rows is cut into parts by key hash."""
    spark = items.sparkSession
    rows = items.select(F.col(item_key).cast("long").alias(item_key), F.col(vector).cast("array<double>").alias(vector)).where(F.col(vector).isNotNull())
    n = rows.count()
    centroids = fit_cells(rows, item_key, vector, cells or min(MOST_CELLS, max(1, int(n**0.5))), sample_rows)
    path = path or shared_folder(spark, "cells")
    if centroids.shape[1] == 1:
        placed = rows.withColumn("cell", F.lit(0))
    else:
        placed = _nearest_cells(rows, vector, centroids, 1, "_c").withColumn("cell", F.get("_c", F.lit(0))).drop("_c")
    # A row's part is by the cell's share of all rows, told from counts; at most MOST_CELLS of them.
    sizes = {r[0]: r[1] for r in placed.groupBy("cell").count().collect()}
    parts = F.get(F.array(*[F.lit(-(-sizes.get(c, 0) // item_rows) or 1) for c in range(len(centroids))]), F.col("cell"))
    placed.withColumn("part", _part_of(item_key, parts)).withColumn("parts", parts).repartition("cell", "part").sortWithinPartitions("cell", "part").write.partitionBy("cell").parquet(path)
    return CellIndex(path, centroids, item_key, vector)


def search_cells(index: CellIndex, queries: DataFrame, k: int, query_key: str, probes: int | None = None, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k best items of each query among those in its nearest cells, by their exact cosine."""
    items = index.rows(queries.sparkSession)
    q = queries.where(F.col(index.vector).isNotNull()).select(query_key, F.col(index.vector).cast("array<double>").alias(index.vector))
    if index.centroids.shape[1] == 1:
        q = q.withColumn("cell", F.lit(0))
    else:
        q = _nearest_cells(q, index.vector, index.centroids, probes or index.probes, "_c").withColumn("cell", F.explode("_c")).drop("_c")
    item_parts = items.groupBy("cell").agg(F.max("parts").alias("parts"))
    query_parts = q.groupBy("cell").agg(_parts(F.count(F.lit(1)), query_rows).alias("_n"))
    # At most MOST_CELLS rows on either side.
    q = q.join(F.broadcast(item_parts), "cell").join(F.broadcast(query_parts), "cell").withColumn("_q", _part_of(query_key, F.col("_n")))
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    i = items.join(F.broadcast(query_parts), "cell").withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return block_top_k(q, i, ["cell", "part", "_q"], k, query_key, index.item_key, index.vector)


def tuned(index: CellIndex, k: int, recall: float, most_queries: int = TUNING_QUERIES) -> CellIndex:
    """The index with the least number of probes that finds `recall` of the true k neighbours of most_queries of its own rows."""
    items = index.rows(SparkSession.active())
    sample = items.orderBy(F.xxhash64(index.item_key, F.lit(1)), index.item_key).limit(most_queries).select(F.col(index.item_key).alias("_query"), index.vector)
    true = exact_top_k(sample, items, k, "_query", index.item_key, index.vector).select("_query", index.item_key)
    if index.centroids.shape[1] == 1:
        return index
    ranked = _nearest_cells(sample, index.vector, index.centroids, len(index.centroids), "_cells").select("_query", "_cells")
    depth = true.join(items.select(index.item_key, "cell"), index.item_key).join(ranked, "_query").select(F.array_position("_cells", F.col("cell")).alias("depth"))
    hits = sorted(r[0] for r in depth.collect())  # most_queries * k numbers at most
    probes = int(hits[min(len(hits) - 1, int(np.ceil(recall * len(hits))) - 1)]) if hits else 1
    return CellIndex(index.path, index.centroids, index.item_key, index.vector, max(1, probes))


def recall_at_k(found: DataFrame, true: DataFrame, query_key: str, item_key: str) -> DataFrame:
    """query_key, k (true neighbours), hits and recall."""
    both = true.select(query_key, item_key).join(found.select(query_key, item_key, F.lit(1).alias("_hit")), [query_key, item_key], "left")
    return both.groupBy(query_key).agg(F.count(F.lit(1)).alias("k"), F.count("_hit").alias("hits")).withColumn("recall", F.col("hits") / F.col("k"))
