"""Derived inputs the queries share: candidates of a term, scored and labelled pairs, a catalog, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import keyed_hash
from .registry import Tables, h

SCORED_SQL = f"""scored AS (
    SELECT *, round(0.6 * u + 0.4 * label, 6) AS p, round(0.5 * v + 0.5 * label, 6) AS q FROM (
        SELECT user_id AS term, event_id AS item, event_type, ts, value,
               CASE WHEN {h("label", "event_id")} % 10 < 3 THEN 1 ELSE 0 END AS label,
               ({h("u", "event_id")} % 1000) / 1000.0::DOUBLE AS u, ({h("v", "event_id")} % 1000) / 1000.0::DOUBLE AS v,
               CASE WHEN {h("anchor", "event_id")} % 10 < 4 THEN 1 ELSE 0 END AS anchor,
               {h("fold", "user_id")} % 3 AS fold FROM events) AS x)"""


def scored(t: Tables) -> DataFrame:
    """term, item, event_type, ts, value, label, two model scores p and q, anchor and fold, from events."""
    e = t("events")
    key = F.col("event_id")
    below = lambda seed, n: F.when(keyed_hash(seed, key) % 10 < n, 1).otherwise(0)
    part = lambda seed: (keyed_hash(seed, key) % 1000) / F.lit(1000.0)
    rows = e.select(F.col("user_id").alias("term"), key.alias("item"), "event_type", "ts", "value", below("label", 3).alias("label"), part("u").alias("u"), part("v").alias("v"), below("anchor", 4).alias("anchor"), (keyed_hash("fold", F.col("user_id")) % 3).alias("fold"))
    return rows.withColumns({"p": F.round(0.6 * F.col("u") + 0.4 * F.col("label"), 6), "q": F.round(0.5 * F.col("v") + 0.5 * F.col("label"), 6)})


CATALOG_SQL = """catalog AS (
    SELECT p_partkey AS item, p_name AS title, p_type || '/' || split_part(p_name, ' ', 1) || '/' || p_brand AS category, p_brand AS brand,
           'size: ' || p_size || ', brand: ' || p_brand || ', size: ' || (p_size + 1) AS attributes, p_type, p_size, p_retailprice FROM part)"""


def catalog(t: Tables) -> DataFrame:
    return t("part").select(
        F.col("p_partkey").alias("item"), F.col("p_name").alias("title"), F.concat_ws("/", "p_type", F.split_part("p_name", F.lit(" "), F.lit(1)), "p_brand").alias("category"), F.col("p_brand").alias("brand"),
        F.concat(F.lit("size: "), F.col("p_size"), F.lit(", brand: "), F.col("p_brand"), F.lit(", size: "), F.col("p_size") + 1).alias("attributes"), "p_type", "p_size", "p_retailprice",
    )


ORDER_PAIRS_SQL = "order_pairs AS (SELECT DISTINCT min(l_partkey) OVER (PARTITION BY l_orderkey) AS query_id, l_partkey AS item FROM lineitem)"


PAIR_ROWS = 250_000


def pair_parts(t: Tables) -> int:
    """Parts of about PAIR_ROWS order pairs."""
    return max(1, -(-t("lineitem").count() // PAIR_ROWS))


def order_pairs(t: Tables) -> DataFrame:
    """query_id, item: every part that was ordered, with the first part of its order as the query.

    Rows are dealt in numbers given outright, which are not merged by their few bytes, so what a task holds does not grow with them.
    """
    parts = pair_parts(t)
    rows = t("lineitem").select("l_orderkey", "l_partkey").repartition(parts, "l_orderkey")
    first = rows.groupBy("l_orderkey").agg(F.min("l_partkey").alias("query_id"))
    return rows.join(first, "l_orderkey").select("query_id", F.col("l_partkey").alias("item")).repartition(parts, "query_id", "item").distinct()


NORM = "trim(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def norm_sql(c: str) -> str:
    return NORM.format(c)


def tokens_sql(c: str) -> str:
    """Distinct tokens of normalised and folded text without stop words, sorted."""
    n = norm_sql(c)
    return f"list_sort(list_distinct(list_filter(list_concat(string_split({n}, ' '), string_split(translate({n}, 'çğıöşü', 'cgiosu'), ' ')), lambda x: x <> '' AND x NOT IN ('ve', 'ile', 'icin', 'için', 'bir', 'the', 'of', 'adet', 'urun', 'ürün'))))"
