"""Structured Streaming over events, fed as several files; each result equals the batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.workspace import shared_folder
from ..streaming import stateful as S
from ..streaming import windows as W
from .registry import query

TURNS = 4
FILE_ROWS, STATE_ROWS = 1_000_000, 2_000_000
END_ID = -1  # a last row, ten years on, moves the watermark past all others


def _feed(t, rows=None):
    """A stream over events in TURNS batches of files, and where it may write.  Files of a batch, and parts of the state, are as many as the rows ask for."""
    events = (rows if rows is not None else t("events")).withColumn("ts", F.col("ts").cast("timestamp"))
    folder = shared_folder(t.spark, "stream")
    n = events.count()
    files = max(1, -(-n // (TURNS * FILE_ROWS)))
    S.write_in_turns(events, f"{folder}/in", "ts", TURNS, files)
    last = events.agg(F.max("ts").alias("ts")).where("ts is not null")
    nothing = [F.lit(END_ID).cast(events.schema[c].dataType).alias(c) if c in ("user_id", "event_id") else (F.col("ts") + F.expr("INTERVAL 10 YEAR")).alias("ts") if c == "ts" else F.lit("end" if c == "event_type" else None).cast(events.schema[c].dataType).alias(c) for c in events.columns]
    last.select(*nothing).write.mode("append").parquet(f"{folder}/in")
    session = S.stream_session(t.spark, max(8, -(-n // STATE_ROWS)))
    return S.read_files(session, f"{folder}/in", events.schema, files), folder


def _drained(t, stream, folder):
    S.drain(stream, f"{folder}/out", f"{folder}/checkpoint")
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _second(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("stream_windows", "window_start:s event_type:s n:l total:d", "SELECT strftime(time_bucket(INTERVAL 1 day, ts), '%Y-%m-%d') AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def stream_windows(t):
    stream, folder = _feed(t)
    out = _drained(t, W.tumbling(stream, "1 day", late="1 hour"), folder)
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query("stream_sessions", "user_id:l session_start:s session_end:s n:l total:d", """WITH e AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 hour THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS run FROM e)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 6 hour, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n, sum(value) AS total FROM s GROUP BY user_id, run""")
def stream_sessions(t):
    stream, folder = _feed(t)
    return _drained(t, W.sessions(stream, "6 hours", late="1 hour"), folder).withColumns({"session_start": _second("session_start"), "session_end": _second("session_end")})


@query("stream_runs", "user_id:l kind:s run_start:s run_end:s n:l total:d", """WITH e AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w AND ts - lag(ts) OVER w <= INTERVAL 12 hour THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type, value)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_type, value ROWS UNBOUNDED PRECEDING) AS run FROM e)
    SELECT user_id, min(event_type) AS kind, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS run_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS run_end, count(*) AS n, sum(value) AS total FROM s GROUP BY user_id, run""")
def stream_runs(t):
    stream, folder = _feed(t)
    out = _drained(t, S.runs(stream, "user_id", "ts", "event_type", "value", 12 * 3600, "1 hour"), folder)
    return out.where(F.col("user_id") != END_ID).withColumns({"run_start": _second("run_start"), "run_end": _second("run_end")})


@query("stream_click_to_purchase", "click_id:l purchase_id:l", "SELECT c.event_id AS click_id, p.event_id AS purchase_id FROM events AS c JOIN events AS p ON c.user_id = p.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 6 hour WHERE c.event_type = 'click' AND p.event_type = 'purchase'")
def stream_click_to_purchase(t):
    stream, folder = _feed(t)
    clicks = stream.where("event_type in ('click', 'end')").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    bought = stream.where("event_type in ('purchase', 'end')").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("purchase_ts"))
    return _drained(t, S.joined_within(clicks, bought, "user_id", "click_ts", "purchase_ts", "6 HOURS", "1 hour"), folder).where(F.col("click_id") != END_ID)


@query("stream_first_seen", "event_id:l user_id:l event_type:s", "SELECT event_id, user_id, event_type FROM events")
def stream_first_seen(t):
    """Every tenth event is sent again up to half an hour later; each counts once."""
    events = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    again = events.where("event_id % 10 = 0").withColumn("ts", F.col("ts") + F.make_interval(mins=F.col("event_id").cast("int") % 30))
    stream, folder = _feed(t, events.unionByName(again))
    return _drained(t, S.first_seen(stream, ["event_id"], "ts", "1 hour"), folder).where(F.col("event_id") != END_ID)
