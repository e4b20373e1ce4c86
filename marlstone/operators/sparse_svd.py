"""Truncated SVD of a wide sparse table by randomised subspace iteration.

A row is a list of column numbers and one of values.  A step multiplies A'A with the current width x k basis in one pass: tasks hold
that basis and the rows of their batch, and send k partial sums for the columns they saw, in blocks of columns that are added up by block.  The driver
holds width x k numbers (BASIS_CELLS at most), never a width x width matrix; the number of rows has no bound.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import stored
from .joins import small_side
from .windows import number_rows

BASIS_CELLS = 1 << 25
DENSE_CELLS, DENSE_FOR_ONE = 1 << 23, 256  # a dense block of 64 MB at most; products of cells one by one cost as much as some 256 dense ones
SLAB_ROWS, BLOCK = 2048, 64  # a block's sums of 10,000 tasks are some 400 MB at 74 vectors


@dataclass(frozen=True)
class SparseBasis:
    """Right singular vectors (width x size) and singular values, the largest first."""

    vectors: np.ndarray
    values: np.ndarray


def sparse_rows(weights: DataFrame, key: str, gram: str, weight: str) -> tuple[DataFrame, DataFrame]:
    """(rows, columns): key, ids and values of each key's weights, and each gram's column number.  A row is no longer than the columns."""
    columns = number_rows(weights.select(gram).distinct(), [gram], "id").withColumn("id", F.col("id").cast("int"))
    cells = weights.join(columns, gram).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", F.col(weight).cast("double").alias("v")))).alias("_c"))
    return cells.select(key, F.col("_c.id").alias("ids"), F.col("_c.v").alias("values")), columns


def frequent_rows(df: DataFrame, key: str, text: str, grams, most: int) -> tuple[DataFrame, int]:
    """(rows, width): key, ids and values of each key's unit_weights over its most_frequent grams, without a row for each of all grams of all keys.

    Grams are 64-bit hashes, kept as one list for each key; only their counts are shuffled.  Equal counts at the boundary go by name, so
    names are made again for those alone.  The driver and the tasks hold `most` hashes; lists are cut down and weighed where they lie.
    """
    hashed = lambda x: F.transform(grams(x), lambda g: F.xxhash64(g))
    lists = stored(df.groupBy(key).agg(F.collect_list(text).alias("_texts")).select(key, F.flatten(F.transform("_texts", hashed)).alias("grams")), "gram-lists")
    n = lists.count()
    held = stored(lists.select(F.explode(F.array_distinct("grams")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")), "gram-counts")
    top = [tuple(r) for r in held.orderBy(F.desc("n"), "h").limit(most).collect()]
    if len(top) == most and held.where(F.col("n") >= top[-1][1]).count() > most:
        last = top[-1][1]
        top = [r for r in top if r[1] > last]
        tied = small_side(stored(held.where(F.col("n") == last).select("h"), "tied-grams"))
        named = df.select(F.explode(grams(F.col(text))).alias("gram")).withColumn("h", F.xxhash64("gram")).join(tied, "h", "left_semi").distinct()
        top += [(r["h"], last) for r in named.orderBy("gram").limit(most - len(top)).collect()]
    top.sort()
    keys, counts = np.array([r[0] for r in top], np.int64), np.array([r[1] for r in top], np.float64)
    sent = df.sparkSession.sparkContext.broadcast((keys, np.log((1 + n) / (1 + counts)) + 1))

    def weigh(batches):
        keys, idf = sent.value
        for b in batches:
            for at in range(0, b.num_rows, SLAB_ROWS):
                part = b.slice(at, SLAB_ROWS)
                rows, found = np.repeat(np.arange(part.num_rows), part["grams"].value_lengths().fill_null(0).to_numpy()), part["grams"].flatten().to_numpy()
                ids = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                known = keys[ids] == found
                cells, tf = np.unique(rows[known] * len(keys) + ids[known], return_counts=True)
                rows, ids = cells // len(keys), cells % len(keys)
                w = (1 + np.log(tf)) * idf[ids]
                w /= np.sqrt(np.bincount(rows, w * w, part.num_rows))[rows]
                sizes = np.bincount(rows, minlength=part.num_rows)
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                out = pa.RecordBatch.from_arrays([part[key], pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(w))], names=[key, "ids", "values"])
                yield out.filter(pa.array(sizes > 0))

    schema = f"`{key}` {lists.schema[key].dataType.simpleString()}, ids array<int>, values array<double>"
    return (lists.mapInArrow(weigh, schema) if top else df.sparkSession.createDataFrame([], schema)), len(top)


def _triples(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of each cell of a batch."""
    sizes = b["ids"].value_lengths().fill_null(0).to_numpy()
    return np.repeat(np.arange(b.num_rows), sizes), b["ids"].flatten().to_numpy(), b["values"].flatten().to_numpy()


def _times(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, basis: np.ndarray, n: int) -> np.ndarray:
    """The rows' products with the basis."""
    out = np.zeros((n, basis.shape[1]))
    for a in range(0, len(values), 1 << 18):
        cut = slice(a, a + (1 << 18))
        part = values[cut, None] * basis[columns[cut]]
        starts = np.flatnonzero(np.diff(rows[cut], prepend=-1))
        np.add.at(out, rows[cut][starts], np.add.reduceat(part, starts, axis=0))
    return out


def _dense(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The columns that occur, and the cells as a dense block of them, where that costs less than going cell by cell."""
    seen, at = np.unique(columns, return_inverse=True)
    if n * len(seen) > min(DENSE_CELLS, DENSE_FOR_ONE * len(values)):
        return None
    return seen, np.bincount(rows * len(seen) + at, values, n * len(seen)).reshape(n, len(seen))


def gram_times(table: DataFrame, basis: np.ndarray) -> np.ndarray:
    """A'A times the basis."""
    sent = table.sparkSession.sparkContext.broadcast(basis)
    width, k = basis.shape

    def partial(batches):
        q, total, seen = sent.value, np.zeros((width, k)), np.zeros(width, bool)
        slab_rows = max(64, min(SLAB_ROWS, DENSE_CELLS // width))
        for b in batches:
            for at in range(0, b.num_rows, slab_rows):
                slab = b.slice(at, slab_rows)
                rows, columns, values = _triples(slab)
                if len(values) and (block := _dense(rows, columns, values, slab.num_rows)):
                    own, a = block
                    total[own] += a.T @ (a @ q[own])
                    seen[own] = True
                elif len(values):
                    y = _times(rows, columns, values, q, slab.num_rows)
                    order = np.argsort(columns, kind="stable")
                    c = columns[order]
                    starts = np.flatnonzero(np.diff(c, prepend=-1))
                    for a in range(0, len(starts), 4096):
                        own = starts[a : a + 4096]
                        end = starts[a + 4096] if a + 4096 < len(starts) else len(c)
                        part = values[order[own[0] : end], None] * y[rows[order[own[0] : end]]]
                        total[c[own]] += np.add.reduceat(part, own - own[0], axis=0)
                    seen[c[starts]] = True
        blocks = np.unique(np.flatnonzero(seen) // BLOCK)
        for some in np.array_split(blocks, max(1, len(blocks) // 64)):
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([total[x * BLOCK : (x + 1) * BLOCK].tobytes() for x in some], pa.binary())], names=["block", "z"])

    def add(group: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(z.as_buffer()) for z in group["z"]), np.zeros(1))
        return pa.table({"block": group["block"][:1].cast(pa.int32()), "z": pa.array([total.tobytes()], pa.binary())})

    sums = table.select("ids", "values").mapInArrow(partial, "block int, z binary").groupBy("block").applyInArrow(add, "block int, z binary")
    out = np.zeros((width, k))
    for block, z in sums.collect():  # width x k numbers
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(z).reshape(-1, k)
    sent.unpersist()
    return out


def sparse_svd(table: DataFrame, width: int, size: int, steps: int = 12, extra: int = 10, tolerance: float = 1e-5, seed: int = 7) -> SparseBasis:
    """The leading `size` singular vectors of rows with ids < width.  Stops before `steps` once the leading subspace turns by less than tolerance.

    Fewer vectors where the rank is smaller; an empty table gives none.
    """
    k = min(width, size + extra)
    if width * max(k, 1) > BASIS_CELLS:
        raise ValueError(f"{width} columns by {k} vectors are more than {BASIS_CELLS} numbers")
    if size <= 0 or width == 0:
        return SparseBasis(np.zeros((width, 0)), np.zeros(0))
    # a task sends up to width x k sums, so it should hold as many cells at least, and 16 times as many once all cores have work
    cells = table.agg(F.coalesce(F.sum(F.size("ids").cast("long")), F.lit(0))).first()[0]
    most = 2 * table.sparkSession.sparkContext.defaultParallelism
    table = table.coalesce(max(1, min(cells // (width * k), most), cells // (16 * width * k)))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, k)))[0]
    lead = None
    for _ in range(steps):
        z = gram_times(table, q)
        values, turned = np.linalg.eigh(q.T @ z)  # the products of the rows with q, squared
        order = np.argsort(values)[::-1]
        values, found = values[order], q @ turned[:, order]
        before, lead = lead, found[:, :size]
        if before is not None and 1 - np.linalg.svd(before.T @ lead, compute_uv=False).min() ** 2 < tolerance**2:
            break
        q = np.linalg.qr(z)[0]
    keep = np.flatnonzero(values[:size] > 1e-12 * max(values.max(initial=0.0), 1e-300))
    vectors = found[:, keep]
    signs = np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(keep))] < 0, -1.0, 1.0) if len(keep) else np.ones(0)
    return SparseBasis(vectors * signs, np.sqrt(values[keep]))


def project(table: DataFrame, basis: SparseBasis, into: str = "reduced", scaled: bool = True) -> DataFrame:
    """table without its cells and with its rows' coordinates on the basis, scaled to length one where asked (zeros stay zeros)."""
    sent = table.sparkSession.sparkContext.broadcast(basis.vectors)

    def of(ids: pa.Array, values: pa.Array) -> pa.Array:
        b = pa.RecordBatch.from_arrays([ids, values], names=["ids", "values"])
        rows, columns, cells = _triples(b)
        y = _times(rows, columns, cells, sent.value, b.num_rows) if len(cells) else np.zeros((b.num_rows, sent.value.shape[1]))
        if scaled:
            y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))

    return table.withColumn(into, F.arrow_udf(of, "array<double>")(F.col("ids"), F.col("values"))).drop("ids", "values")


def most_frequent(counts: DataFrame, gram: str, most: int) -> DataFrame:
    """Counts of the `most` grams that occur in the most rows, equal ones by name."""
    held = counts.groupBy(gram).agg(F.count(F.lit(1)).alias("_n"))
    return counts.join(held.orderBy(F.desc("_n"), gram).limit(most).select(gram), gram, "left_semi")


def unit_weights(counts: DataFrame, key: str, gram: str, n: int) -> DataFrame:
    """key, gram and w: (1 + ln tf) * idf, each key's weights of length one."""
    idf = counts.groupBy(gram).agg((F.ln((1 + F.lit(n)) / (1 + F.count(F.lit(1)))) + 1).alias("_idf"))
    raw = counts.join(idf, gram).select(key, gram, ((1 + F.ln("tf")) * F.col("_idf")).alias("w"))
    return raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key))))
