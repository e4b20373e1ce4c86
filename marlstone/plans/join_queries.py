"""Joins by time and by edit distance, and scalar functions over dates, intervals and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fuzzy as Z
from ..operators import temporal_joins as J
from .registry import query


@query("as_of_click", "event_id:l click_id:l click_value:d", """SELECT l.event_id, r.event_id AS click_id, r.value AS click_value FROM (SELECT * FROM events WHERE event_type <> 'click') AS l
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') AS r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def as_of_click(t):
    e = t("events").select("event_id", "user_id", "ts", "event_type", "value")
    clicks = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    return J.as_of(e.where("event_type <> 'click'").drop("value"), clicks, "ts", "click_ts", ["user_id"], ["click_id", "click_value"])


@query("as_of_error_within_hour", "event_id:l error_id:l", """SELECT l.event_id, CASE WHEN l.ts - r.ts <= INTERVAL 1 hour THEN r.event_id END AS error_id FROM (SELECT * FROM events WHERE event_type <> 'error') AS l
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') AS r ON l.ts >= r.ts""")
def as_of_error_within_hour(t):
    """One key for all rows: a single heavy key, cut into ranges of time."""
    e = t("events").select("event_id", "ts", "event_type", F.lit(0).alias("everyone"))
    errors = e.where("event_type = 'error'").select("everyone", F.col("ts").alias("error_ts"), F.col("event_id").alias("error_id"))
    return J.as_of(e.where("event_type <> 'error'"), errors, "ts", "error_ts", ["everyone"], ["error_id"], tolerance=3_600_000_000)


@query("orders_in_sales", "sale:l orders:l total:d", """SELECT p_partkey AS sale, count(*) AS orders, sum(o_totalprice) AS total FROM orders JOIN part
    ON o_orderdate >= TIMESTAMP '1995-01-01' + to_days(CAST(p_partkey % 2000 AS INTEGER)) AND o_orderdate < TIMESTAMP '1995-01-01' + to_days(CAST(p_partkey % 2000 + p_size AS INTEGER)) GROUP BY p_partkey""")
def orders_in_sales(t):
    day = lambda n: F.timestamp_micros(F.lit(788918400_000_000) + n.cast("long") * 86_400_000_000)
    sales = t("part").select("p_partkey", day(F.col("p_partkey") % 2000).alias("opens"), day(F.col("p_partkey") % 2000 + F.col("p_size")).alias("closes"))
    met = J.sums_in_intervals(t("orders").select("o_orderdate", "o_totalprice"), sales, "o_orderdate", "opens", "closes", {"o_totalprice": "total"}, "orders", unit=86_400_000_000)
    return met.groupBy(F.col("p_partkey").alias("sale")).agg(F.sum("orders").alias("orders"), F.sum("total").alias("total"))


@query("overlapping_visits", "error_id:l purchase_id:l", """WITH s AS (SELECT event_id, user_id, event_type, ts AS a, ts + to_seconds(CAST(floor(value * 600) AS BIGINT)) AS z FROM events)
    SELECT l.event_id AS error_id, r.event_id AS purchase_id FROM s AS l JOIN s AS r ON l.user_id = r.user_id AND l.a < r.z AND r.a < l.z AND l.a < l.z AND r.a < r.z WHERE l.event_type = 'error' AND r.event_type = 'purchase'""")
def overlapping_visits(t):
    e = t("events").withColumn("z", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 600) * 1_000_000))
    errors = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("ts").cast("timestamp").alias("error_start"), F.col("z").alias("error_end"))
    bought = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").cast("timestamp").alias("bought_start"), F.col("z").alias("bought_end"))
    return J.overlapping_intervals(errors, bought, "error_start", "error_end", "bought_start", "bought_end", ["user_id"])


@query("similar_names", "left_text:s right_text:s distance:l", """WITH n AS (SELECT DISTINCT p_name || ' ' || p_type AS t FROM part) SELECT a.t AS left_text, b.t AS right_text, levenshtein(a.t, b.t) AS distance FROM n AS a JOIN n AS b ON a.t < b.t WHERE levenshtein(a.t, b.t) <= 2""")
def similar_names(t):
    return Z.similar_pairs(t("part").select(F.concat_ws(" ", "p_name", "p_type").alias("text")), 2)


@query("similar_words", "left_text:s right_text:s distance:l", r"""WITH b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM benchmark), d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM documents)
    SELECT b.t AS left_text, d.t AS right_text, levenshtein(b.t, d.t) AS distance FROM b JOIN d ON abs(length(b.t) - length(d.t)) <= 2 WHERE levenshtein(b.t, d.t) <= 2""")
def similar_words(t):
    words = lambda name: t(name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("text"))
    return Z.similar_texts(words("benchmark"), words("documents"), 2)


@query("date_parts", "o_orderkey:l quarter:l iso_week:l day_of_year:l last_day:s month_start:s next_monday:s months_between:l", """SELECT o_orderkey, quarter(o_orderdate) AS quarter, week(o_orderdate) AS iso_week, dayofyear(o_orderdate) AS day_of_year, strftime(last_day(o_orderdate), '%Y-%m-%d') AS last_day, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start,
    strftime(o_orderdate + to_days(CAST(8 - isodow(o_orderdate) AS INTEGER)), '%Y-%m-%d') AS next_monday, date_diff('month', date_trunc('month', o_orderdate), TIMESTAMP '2003-01-01') AS months_between FROM orders""")
def date_parts(t):
    d = F.col("o_orderdate")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return t("orders").select("o_orderkey", F.quarter(d).alias("quarter"), F.weekofyear(d).alias("iso_week"), F.dayofyear(d).alias("day_of_year"), day(F.last_day(d)).alias("last_day"), day(F.date_trunc("month", d)).alias("month_start"), day(F.next_day(d, "MON")).alias("next_monday"), F.months_between(F.lit("2003-01-01").cast("date"), F.date_trunc("month", d)).cast("long").alias("months_between"))


@query("shipping_intervals", "l_orderkey:l l_linenumber:l days:l due:s late:l", """SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate, l_shipdate) AS days, strftime(o_orderdate + INTERVAL 1 month + INTERVAL 10 day, '%Y-%m-%d') AS due, CAST(l_shipdate > o_orderdate + INTERVAL 1 month + INTERVAL 10 day AS INTEGER) AS late FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def shipping_intervals(t):
    due = F.col("o_orderdate") + F.make_interval(months=F.lit(1)) + F.make_interval(days=F.lit(10))
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return rows.select("l_orderkey", "l_linenumber", F.datediff("l_shipdate", "o_orderdate").alias("days"), F.date_format(due, "yyyy-MM-dd").alias("due"), (F.col("l_shipdate") > due).cast("int").alias("late"))


@query("json_properties", "event_type:s n:l k_sum:l k_most:l with_k:l", """SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_sum, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_most, count(json_extract_string(props, '$.k')) AS with_k FROM events GROUP BY event_type""")
def json_properties(t):
    """Properties parsed once as a variant; malformed ones are null."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return t("events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k_sum"), F.max("k").alias("k_most"), F.count("k").alias("with_k"))
