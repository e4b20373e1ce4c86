"""Shared pieces of the training-data operators: sizing, shared folders, words, hashes, packed blobs and the batched exchange.

The exchange lets a batch of documents ask a question about every distinct key it holds (a word, a shingle, a window) and
get the corpus-wide answer back.  A batch sends each key once however often it holds it, so a key that occurs in a third of
all rows costs one entry for each batch and no task ever receives all rows of a key.  Keys travel as sorted, delta coded
byte planes, one blob for each (batch, bucket); answers come back without keys, in the order the keys were sent.

A batch cuts its keys into at most FAN buckets.  With more batches than that, those of FAN batches are first merged bucket by
bucket and cut again, level by level, so the number of blobs grows with the number of batches, not with its square, and a
bucket of the last level stays as small as a batch.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20
LEAST_BATCHES = 16
FAN_BITS = 8
HEAVY_KEYS = 20_000
U64 = np.uint64
SLAB = 1 << 18


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which the driver and all executors see."""
    ensure_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoints(spark: SparkSession) -> None:
    """Set the checkpoint folder from spark.checkpoint.dir.  Without that setting only a local session gets one of its own: executors share no other folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(folder)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Written to and read from the shared folder: computed once, and not lost with an executor."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate (file sizes for a scan), or None where it has none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else None


def n_batches(df: DataFrame, batch_bytes: int = BATCH_BYTES) -> int:
    """As many as the input's bytes ask for, and some for small inputs, so that all cores have work."""
    least = min(LEAST_BATCHES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    return max(least, -(-(input_bytes(df) or 0) // batch_bytes))


def batch_of(n: int, *keys: str) -> Column:
    """The batch of a row, by a hash of its key and text: neither equal keys nor null ones fill one batch."""
    return F.pmod(F.xxhash64(*keys), F.lit(n)).alias("batch")


def with_batches(df: DataFrame, key: str, columns: list[str], n: int | None = None) -> tuple[DataFrame, int]:
    """Rows dealt to n batches by key and text; batch is a column, and a partition holds whole batches.  texts_of() reads the zipped texts."""
    n = n or n_batches(df)
    rows = df.select(batch_of(n, key, "text"), *[F.col(c) for c in columns], "text")

    def zipped(batches):
        codec = zstandard.ZstdCompressor(level=1)
        for b in batches:
            texts = [codec.compress(t) for t in texts_of(b["text"])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.binary())], names=b.schema.names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(zipped, f"{fields}, text binary").repartition(n, "batch"), n


HELD: list[dict] = []  # what operators keep in a worker from task to task, and others may drop


def release_memory() -> None:
    """What earlier operators keep in this worker is dropped, and free memory that Python's and Arrow's allocators hold goes back to the system, where the C library can do that."""
    for held in HELD:
        held.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(f: Callable) -> Callable:
    """f of one or two Arrow tables, giving its free memory back after each group, so a worker is as large as one group and not as all before it."""

    def of_one(a):
        try:
            return f(a)
        finally:
            release_memory()

    def of_two(a, b):
        try:
            return f(a, b)
        finally:
            release_memory()

    return of_one if f.__code__.co_argcount == 1 else of_two


def split_join(many: DataFrame, one: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """many joined with one on key, where one has a row for each key and counts the key's rows in many.

    The keys with more than a HEAVY_KEYS-th of all rows, so at most HEAVY_KEYS keys, are broadcast and their rows dealt over
    parts by a hash of the row, so a task that runs again deals alike.
    """
    least = max(1024, total // HEAVY_KEYS)
    parts = F.ceil(F.col(count) / least).cast("int")
    heavy = one.where(F.col(count) > least).select(key, parts.alias("_parts"))
    dealt = many.join(F.broadcast(heavy), key, "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*[F.col(c) for c in many.columns]), F.col("_parts")).cast("int"))).drop("_parts")
    spread = one.withColumn("_part", F.explode(F.when(F.col(count) > least, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))))
    return dealt.join(spread, [key, "_part"]).drop("_part")


# ---- words and hashes ------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


WORD_BASE = 0x9FB21C651E98DF25
VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_LOWER_VALUES = VALUES.copy()
_LOWER_VALUES[65:91] = VALUES[97:123]
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2**64, n of them or more."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 2 * SLAB), base, U64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        _POWERS[base] = known
    return known


def texts_of(column) -> list[bytes]:
    """UTF-8 texts of an Arrow column of strings, or of texts zipped by with_batches(); null is empty."""
    if pa.types.is_binary(column.type):
        codec = zstandard.ZstdDecompressor()
        return [codec.decompress(x) for x in column.to_pylist()]
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def hash_texts(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin (one entry more than texts).

    A word is a run of bytes other than 0x20 and 0x09-0x0D, and its hash a polynomial over its bytes (A-Z lower-cased) and its length, so
    all words of a slab of text are hashed by a few array operations; slabs end after white space.
    """
    values = _LOWER_VALUES if lower else VALUES
    out, bounds = [], [0]
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            _, hashes, _, ends = hash_words(held, values)
            out.append(hashes)
            bounds.extend((ends[1:] + bounds[-1]).tolist())
            held.clear()
            size = 0

    for t in texts:
        held.append(t)
        size += len(t)
        if size >= SLAB:
            flush()
    flush()
    return np.concatenate([np.empty(0, U64), *out]), np.array(bounds, np.int64)


def hash_words(texts: list[bytes], values: np.ndarray = VALUES) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one, the hashes of its words, where in it they begin, and where each text's words begin (one entry more than texts)."""
    text = b" ".join(texts) + b" "
    hashes, starts = _hash_slabs(np.frombuffer(text, np.uint8), values)
    return text, hashes, starts, np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))


def _blank(raw: np.ndarray) -> np.ndarray:
    return (raw == 0x20) | (raw - np.uint8(0x09) < 5)


def _hash_slabs(raw: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word; raw ends with white space."""
    hashes, places, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + SLAB)
        step = 256
        while not len(gap := np.flatnonzero(_blank(raw[at:end][-step:]))):  # a word longer than a slab
            if step >= end - at:
                end = min(len(raw), end + SLAB)
            step *= 2
        end -= min(step, end - at) - int(gap[-1]) - 1
        slab = raw[at:end]
        blank = np.empty(len(slab) + 1, bool)
        blank[0], blank[1:] = True, _blank(slab)
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        starts, stops = edges[::2], edges[1::2]
        sums = np.zeros(len(slab) + 1, U64)
        terms = values.take(slab)
        terms *= powers(WORD_BASE, len(slab))[: len(slab)]
        np.cumsum(terms, out=sums[1:])
        found = (sums[stops] - sums[starts]) * powers(pow(WORD_BASE, -1, 1 << 64), len(slab))[starts]
        hashes.append(mix(found ^ ((stops - starts).astype(U64) * U64(0xA24BAED4963EE407))))
        places.append(starts + at)
        at = end
    return np.concatenate([np.empty(0, U64), *hashes]), np.concatenate([np.empty(0, np.int64), *places])


ROLL = 0x5851F42D4C957F2D


def prefix_sums(h: np.ndarray, base: int = ROLL) -> np.ndarray:
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(h * powers(base, len(h))[: len(h)], out=total[1:])
    return total


def windows_at(total: np.ndarray, q: np.ndarray, n: int, base: int = ROLL) -> np.ndarray:
    """Hashes of the windows of n that begin at q, from prefix_sums()."""
    return mix((total[q + n] - total[q]) * powers(pow(base, -1, 1 << 64), len(total))[q])


def rolling(h: np.ndarray, n: int, base: int = ROLL) -> np.ndarray:
    """A hash of each n neighbours in h, as a polynomial over 2**64 whose base is odd and so has an inverse."""
    if len(h) < n:
        return np.empty(0, U64)
    total = prefix_sums(h, base)
    return mix((total[n:] - total[:-n]) * powers(pow(base, -1, 1 << 64), len(h))[: len(h) - n + 1])


def starts_within(ends: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask over window starts 0..total-n: the window lies in one text."""
    ok = np.ones(max(0, total - n + 1), bool)
    for e in ends[1:-1]:
        ok[max(0, e - n + 1) : e] = False
    return ok


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys."""
    keys = np.sort(keys)
    return keys[first_of_equal(keys)]


def first_of_equal(ordered: np.ndarray) -> np.ndarray:
    """Mask of the first of each group of equal neighbours."""
    return np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]])


def shingle_sets(h: np.ndarray, ends: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of n-word shingles for each text; a shorter text is one shingle of all its words, none if it has no words."""
    grams = rolling(h, n)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(distinct(grams[a : b - n + 1]))
        elif b > a:
            out.append(rolling(h[a:b], b - a) ^ U64(b - a))
        else:
            out.append(np.empty(0, U64))
    return out


# ---- packed blobs ----------------------------------------------------------------------------------------------------


def planes(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as zipped byte planes, which costs little more than the entropy of small numbers."""
    n = len(arrays[0])
    return n.to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(n, a.dtype.itemsize).T).tobytes() for a in arrays))


def from_planes(blob: bytes, *dtypes) -> list[np.ndarray]:
    n, at, out = int.from_bytes(blob[:4], "little"), 0, []
    blob = zstandard.ZstdDecompressor().decompress(blob[4:])
    for dtype in dtypes:
        width = np.dtype(dtype).itemsize
        raw = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(raw.T).view(dtype).reshape(n))
        at += n * width
    return out


def pack(keys: np.ndarray, *payloads: np.ndarray) -> bytes:
    """Sorted keys, delta coded, and their payloads."""
    return planes(np.diff(keys.astype(U64), prepend=U64(0)), *payloads)


def unpack(blob: bytes, *dtypes) -> list[np.ndarray]:
    out = from_planes(blob, U64, *dtypes)
    out[0] = np.cumsum(out[0], dtype=U64)
    return out


def sort_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts keys, and the sorted keys.

    Sorting values is several times faster than sorting places: the place goes into a key's low bits, and the few keys that
    differ only there are put right afterwards, by a sort that is quick on sorted data.
    """
    mask = U64((1 << max(1, (len(keys) - 1).bit_length())) - 1) if len(keys) else U64(1)
    order = np.sort((keys & ~mask) | np.arange(len(keys), dtype=U64))
    order &= mask
    order = order.view(np.int64)
    ordered = keys[order]
    if (ordered[1:] < ordered[:-1]).any():
        again = np.argsort(ordered, kind="stable")
        order, ordered = order[again], ordered[again]
    return order, ordered


def grouped(keys: np.ndarray, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts keys, and where each group of equal keys begins in it; with check, groups are of equal (key, check)."""
    order, ks = sort_order(keys)
    new = first_of_equal(ks)
    if check is not None:
        cs = check[order]
        if (~new[1:] & (cs[1:] != cs[:-1])).any():  # one key, two checks: sort by both
            order = np.lexsort((check, keys))
            ks, cs = keys[order], check[order]
            new = first_of_equal(ks) | first_of_equal(cs)
    return order, np.flatnonzero(new)


def spread(order: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Each group's value at each of its members, in the members' own order."""
    out = np.empty(len(order), values.dtype)
    out[order] = np.repeat(values, np.diff(np.append(at, len(order))))
    return out


# ---- the exchange ----------------------------------------------------------------------------------------------------

BLOBS = "bucket long, batch long, blob binary"
BLOBS_ARROW = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("blob", pa.binary())])


def OTHERS(totals: np.ndarray) -> np.ndarray:  # noqa: N802
    return totals


@dataclass(frozen=True)
class Question:
    """What an exchange asks of the entries (key, payloads) of all batches.

    merge(payloads, starts) gives each group of equal keys the total of its payloads, of the same types; totals of totals are totals.
    With checked the first payload belongs to the key and is no part of the answer.  finish(total) for each payload makes the answer of its total;
    where it is OTHERS the answer is the sum without the batch's own part, mostly zeros, which travel at no cost.
    """

    merge: Callable
    dtypes: tuple
    checked: bool = False
    finish: tuple = ()

    @property
    def answers(self) -> tuple:
        own = self.dtypes[1:] if self.checked else self.dtypes
        return tuple(np.dtype(f(np.empty(0, d)).dtype) if f else d for d, f in zip(own, self.finish, strict=True)) if self.finish else own

    def totals(self, keys: np.ndarray, payloads: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The order by key, groups' starts in it, and their totals."""
        order, at = grouped(keys, payloads[0] if self.checked else None)
        own = payloads[1:] if self.checked else payloads
        return order, at, list(self.merge([p[order] for p in own], at)) if len(at) else [p[:0] for p in own]


def summed(*dtypes, finish: tuple = ()) -> Question:
    """Sums of all payloads; sums beyond a type's range stay at its end."""

    def merge(payloads, at):
        for p in payloads:
            total = np.add.reduceat(p.astype(np.int64), at)
            yield np.clip(total, np.iinfo(p.dtype).min, np.iinfo(p.dtype).max).astype(p.dtype)

    return Question(merge, dtypes, finish=finish)


def n_buckets(n: int, fan_bits: int = FAN_BITS) -> int:
    return n if n <= 1 << fan_bits else 1 << fan_bits


def blob_table(batch: int, bounds: np.ndarray, first: int, keys: np.ndarray, *payloads: np.ndarray) -> pa.Table:
    """Sorted keys cut at bounds; a row for each part that has keys, their buckets numbered from first."""
    cuts = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
    some = np.flatnonzero(np.diff(cuts))
    blobs = [pack(*(x[i:j] for x in (keys, *payloads))) for i, j in zip(cuts[some].tolist(), cuts[some + 1].tolist(), strict=True)]
    return pa.table([pa.array(some + first, pa.int64()), pa.array(np.full(len(some), batch), pa.int64()), pa.array(blobs, pa.binary())], schema=BLOBS_ARROW)


def requests_table(batch: int, n: int, keys: np.ndarray, *payloads: np.ndarray, fan_bits: int = FAN_BITS) -> pa.Table:
    """What one of n batches asks: sorted distinct keys cut into buckets by range."""
    b = n_buckets(n, fan_bits)
    return blob_table(batch, np.array([(i << 64) // b for i in range(1, b)], U64), 0, keys, *payloads)


def _entries(table: pa.Table, dtypes: tuple) -> tuple[list[int], np.ndarray, list[np.ndarray]]:
    """Sizes of the blobs of a table, and all their entries."""
    parts = [unpack(b, *dtypes) for b in table["blob"].to_pylist()]
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, d) for i, d in enumerate((U64, *dtypes))]
    return [len(p[0]) for p in parts], columns[0], columns[1:]


def _replies(table: pa.Table, q: Question, sizes: list[int], own: list[np.ndarray], answers: list[np.ndarray]) -> pa.Table:
    """For each blob of a table its entries' answers, in their order, under the blob's bucket and batch."""
    if q.finish:
        answers = [a - o if f is OTHERS else a for a, o, f in zip(answers, own, q.finish, strict=True)]
    cuts = np.cumsum([0, *sizes]).tolist()
    blobs = [planes(*(a[i:j] for a in answers)) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table([table["bucket"].combine_chunks(), table["batch"].combine_chunks(), pa.array(blobs, pa.binary())], schema=BLOBS_ARROW)


def _up(requests: DataFrame, q: Question, buckets: int, fan_bits: int) -> tuple[DataFrame, DataFrame]:
    """Requests with their team, and one request for each team of 2**fan_bits batches in a bucket, cut into as many parts."""
    fan = 1 << fan_bits
    teams = requests.withColumn("team", F.shiftright("batch", fan_bits))

    def merged(table: pa.Table) -> pa.Table:
        _, keys, own = _entries(table, q.dtypes)
        order, at, totals = q.totals(keys, own)
        check = [own[0][order][at]] if q.checked else []
        first = table["bucket"][0].as_py() * fan
        bounds = np.array([((first + i) << 64) // (buckets * fan) for i in range(1, fan)], U64)
        return blob_table(table["team"][0].as_py(), bounds, first, keys[order][at], *check, *totals)

    return teams, teams.groupBy("bucket", "team").applyInArrow(trimmed(merged), BLOBS)


def exchange(requests: DataFrame, q: Question, n: int, fan_bits: int = FAN_BITS, buckets: int | None = None) -> DataFrame:
    """Answers (bucket, batch, blob) to the requests of n batches: an answer for each entry of a request's blob."""
    buckets = buckets or n_buckets(n, fan_bits)
    if n <= 1 << fan_bits:

        def answer(table: pa.Table) -> pa.Table:
            sizes, keys, own = _entries(table, q.dtypes)
            order, at, totals = q.totals(keys, own)
            return _replies(table, q, sizes, own, [spread(order, at, f(t) if f else t) for t, f in zip(totals, q.finish or [None] * len(totals), strict=True)])

        return requests.groupBy("bucket").applyInArrow(trimmed(answer), BLOBS)

    teams, up = _up(requests, q, buckets, fan_bits)
    down = exchange(up, q, -(-n >> fan_bits), fan_bits, buckets << fan_bits)

    def share(asked: pa.Table, told: pa.Table) -> pa.Table:
        """What the team was told, to each of its batches."""
        if not asked.num_rows:
            return BLOBS_ARROW.empty_table()
        sizes, keys, own = _entries(asked, q.dtypes)
        order, at, team = q.totals(keys, own)
        totals = joined(told, *q.answers)
        if q.finish:
            totals = [a + b if f is OTHERS else a for a, b, f in zip(totals, team, q.finish, strict=True)]
        return _replies(asked, q, sizes, own, [spread(order, at, t) for t in totals])

    told = down.select(F.shiftright("bucket", fan_bits).alias("over"), F.col("batch").alias("team"), "bucket", "blob")
    return teams.groupBy("bucket", "team").cogroup(told.groupBy("over", "team")).applyInArrow(trimmed(share), BLOBS)


def tally(requests: DataFrame, q: Question, n: int, finish: Callable, schema: str, fan_bits: int = FAN_BITS) -> DataFrame:
    """finish(keys, totals) of each last bucket; nothing is sent back."""
    buckets = n_buckets(n, fan_bits)
    while n > 1 << fan_bits:
        _, requests = _up(requests, q, buckets, fan_bits)
        n, buckets = -(-n >> fan_bits), buckets << fan_bits

    def run(table: pa.Table) -> pa.Table:
        _, keys, own = _entries(table, q.dtypes)
        order, at, totals = q.totals(keys, own)
        return finish(keys[order][at], totals)

    return requests.groupBy("bucket").applyInArrow(run, schema)


def joined(told: pa.Table, *dtypes) -> list[np.ndarray]:
    """The answers a batch got, in the order of its sorted keys (buckets are key ranges)."""
    parts = [from_planes(b, *dtypes) for _, b in sorted(zip(told["bucket"].to_pylist(), told["blob"].to_pylist(), strict=True))]
    return [np.concatenate([np.empty(0, d), *(p[i] for p in parts)]).astype(d, copy=False) for i, d in enumerate(dtypes)]


def lookup(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are in sorted_keys, and where (0 for the others)."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == keys, at
