"""Streams with state: sessions, runs closed by event-time timers, joins of two streams, and duplicates dropped within the watermark.

Every transformation takes and returns a DataFrame, streaming or not.  `late` is how late rows may come: what is later is dropped, and a
result is final, and its state gone, once the watermark has passed it; so state is bounded by the rows of that time.  drain() runs a stream
over all files that are there, into a table that a later run with the same checkpoint goes on with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession, state_partitions: int = 8) -> SparkSession:
    """A session for streams: state in RocksDB, so beyond memory, in so many partitions, a number that a stream keeps all its life."""
    s = spark.newSession()
    for key, value in (("spark.sql.shuffle.partitions", str(state_partitions)), ("spark.sql.streaming.stateStore.providerClass", STATE_STORE), ("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))):
        s.conf.set(key, value)
    return s


def read_files(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def drain(stream: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """Runs the stream over what is there and returns all rows written so far.  Only rows of committed batches count."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(table).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(table)


def write_in_turns(rows: DataFrame, folder: str, time: str, turns: int, files: int = 1) -> None:
    """rows as `turns` times `files` files, by equal spans of time, the earlier first: a feed to stream from."""
    low, high = rows.agg(F.min(F.unix_micros(F.col(time))), F.max(F.unix_micros(F.col(time)))).first()
    if low is None:
        rows.limit(0).write.mode("append").parquet(folder)
        return
    width = (high - low) // turns + 1
    for i in range(turns):
        part = rows.where(F.unix_micros(F.col(time)).between(low + i * width, low + (i + 1) * width - 1))
        part.repartition(files).write.mode("append").parquet(folder)


def first_seen(rows: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """One row for each key that comes again within `late`."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def joined_within(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, late: str) -> DataFrame:
    """Pairs of one key where right comes no earlier than left and at most `within` later; each side keeps only what may still meet."""
    a, b = left.withWatermark(left_time, late), right.withWatermark(right_time, late).withColumnRenamed(key, "_key")
    near = (F.col(key) == F.col("_key")) & (F.col(right_time) >= F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + F.expr(f"INTERVAL {within}"))
    return a.join(b, near).drop("_key")


RUN_BUCKETS = 256
_STATE = "waiting binary, open binary"
_RUN = ["key", "kind", "start", "last", "n", "total"]

_NO_RUNS = pd.DataFrame({"key": [], "kind": [], "start": np.zeros(0, np.int64), "last": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "total": np.zeros(0)})


def _together(*rows: pd.DataFrame) -> pd.DataFrame:
    some = [r for r in rows if len(r)]
    return pd.concat(some, ignore_index=True) if some else _NO_RUNS


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(data)).read_all().to_pandas()


def _runs_of(rows: pd.DataFrame, gap: int) -> tuple[pd.DataFrame, np.ndarray]:
    """Runs of rows, each itself a run of one kind (of one row or more), by key and time; and which of them is the last of its key."""
    keys, kinds = pd.factorize(rows["key"])[0], np.unique(rows["kind"].to_numpy(object), return_inverse=True)[1]
    order = np.lexsort((rows["total"], kinds, rows["start"], keys))
    rows, keys, kinds = rows.iloc[order], keys[order], kinds[order]
    start, last = rows["start"].to_numpy(), rows["last"].to_numpy()
    other = np.r_[True, keys[1:] != keys[:-1]]
    first = np.flatnonzero(other | np.r_[True, (kinds[1:] != kinds[:-1]) | (start[1:] - last[:-1] > gap)])
    ends = np.append(first[1:], len(rows)) - 1
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
    n, total = (np.bincount(of, rows[c]) for c in ("n", "total"))
    made = pd.DataFrame({"key": rows["key"].to_numpy()[first], "kind": rows["kind"].to_numpy()[first], "start": start[first], "last": last[ends], "n": n.astype(np.int64), "total": total})
    return made, np.append(other[1:], True)[ends]


def runs(rows: DataFrame, key: str, time: str, kind: str, amount: str, gap_seconds: int, late: str, buckets: int = RUN_BUCKETS) -> DataFrame:
    """Runs of rows of one kind of a key: key, kind, run_start, run_end, n, total.

    A run ends with a row of another kind or after gap_seconds without a row.  Rows wait in the state until the watermark is past them,
    so they count in the order of their times (then kind and amount) however they come; a timer on event time closes runs that go silent.
    Rows with a null key, time or kind are left out; null amounts count 0.

    Keys are dealt to buckets by hash, a number that a stream keeps all its life.  A bucket's keys share a state, two tables (rows that
    wait, and runs that are open), and a timer, so a batch calls Python once for each bucket and not for each key.
    """
    gap = gap_seconds * 1_000_000
    key_type = rows.schema[key].dataType.simpleString()
    whole = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(kind).isNotNull())
    timed = whole.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.col(key).alias("key"), F.col(time).alias("time"), F.unix_micros(time).alias("micros"), F.col(kind).alias("kind"), F.coalesce(F.col(amount).cast("double"), F.lit(0.0)).alias("amount")).withWatermark("time", late)

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, open_ = (_unpacked(b) for b in state.get) if state.exists else (_NO_RUNS, _NO_RUNS)
        new = [pd.DataFrame({"key": f["key"], "kind": f["kind"], "start": f["micros"], "last": f["micros"], "n": np.int64(1), "total": f["amount"]}) for f in frames]
        waiting, passed = _together(waiting, *new), state.getCurrentWatermarkMs() * 1000
        ready = waiting["start"] <= passed
        found, waiting = _together(open_, waiting[ready]), waiting[~ready]
        found, latest = _runs_of(found, gap) if len(found) else (found, np.zeros(0, bool))
        stays = latest & (found["last"].to_numpy() + gap >= passed)
        done, open_ = found[~stays], found[stays]
        if len(waiting) or len(open_):
            state.update((_packed(waiting), _packed(open_)))
            next_ = min([*waiting["start"].nsmallest(1), *(open_["last"].nsmallest(1) + gap)])
            state.setTimeoutTimestamp(max(int(next_) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if len(done):
            yield done[_RUN]

    found = timed.groupBy("bucket").applyInPandasWithState(step, f"key {key_type}, kind string, start long, last long, n long, total double", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("key").alias(key), "kind", F.timestamp_micros("start").alias("run_start"), F.timestamp_micros("last").alias("run_end"), "n", "total")
