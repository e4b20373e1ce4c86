"""Joins, set operations, aggregations, profiles and contract queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import math as M
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import windows as W
from ..operators import topk
from ..sources import contracts as Q
from ..sources import shards as S
from .frames import CATALOG_SQL, SCORED_SQL, catalog, norm_sql, scored
from .registry import h, query

# ---- joins -------------------------------------------------------------------------------------------------------


@query("pair_enrichment", "l_orderkey:l l_partkey:l l_linenumber:l p_brand:s o_orderpriority:s", "SELECT l_orderkey, l_partkey, l_linenumber, p_brand, o_orderpriority FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN orders ON l_orderkey = o_orderkey")
def pair_enrichment(t):
    pairs = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"), "l_linenumber")
    out = J.enrich_pairs(pairs, t("part").select("p_partkey", "p_brand"), t("orders").select("o_orderkey", "o_orderpriority"), "p_partkey", "o_orderkey", strict=False)
    return out.withColumnsRenamed({"o_orderkey": "l_orderkey", "p_partkey": "l_partkey"})


CHANNELS = f"""a AS (SELECT term, item, max(p) AS s FROM scored WHERE p >= 0.5 GROUP BY term, item), b AS (SELECT term, item, max(q) AS s FROM scored WHERE q >= 0.4 GROUP BY term, item)"""


@query("channel_outer_merge", "term:l item:l source:s word_score:d char_score:d score:d", f"""WITH {SCORED_SQL}, {CHANNELS} SELECT term, item, CASE WHEN b.s IS NULL THEN 'word' WHEN a.s IS NULL THEN 'char' ELSE 'word+char' END AS source,
    coalesce(a.s, 0) AS word_score, coalesce(b.s, 0) AS char_score, greatest(coalesce(a.s, 0), coalesce(b.s, 0)) AS score FROM a FULL JOIN b USING (term, item)""")
def channel_outer_merge(t):
    s = scored(t)
    return J.outer_merge(s.where("p >= 0.5").select("term", "item", F.col("p").alias("score")), s.where("q >= 0.4").select("term", "item", F.col("q").alias("score")), ["term", "item"], left_name="word", right_name="char")


@query("known_positive_antijoin", "kind:s n:l", f"""WITH {SCORED_SQL}, k AS (SELECT term, item FROM scored WHERE label = 1), c AS (SELECT term, item FROM scored WHERE p >= 0.3), n AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.term = c.term AND k.item = c.item))
    SELECT 'semi' AS kind, count(*) AS n FROM c WHERE EXISTS (SELECT 1 FROM k WHERE k.term = c.term AND k.item = c.item) UNION ALL SELECT 'anti', count(*) FROM n UNION ALL SELECT 'collisions', count(*) FROM n JOIN k USING (term, item)""")
def known_positive_antijoin(t):
    s = scored(t)
    known, candidates = s.where("label = 1").select("term", "item"), s.where("p >= 0.3").select("term", "item")
    fresh = J.without(candidates, known, ["term", "item"])
    rows = [("semi", J.only(candidates, known, ["term", "item"])), ("anti", fresh), ("collisions", J.only(fresh, known, ["term", "item"]))]
    return reduce(DataFrame.unionByName, [d.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(k)) for k, d in rows])


@query("score_alignment", "item:l label:l model_p:d model_q:d", f"WITH {SCORED_SQL} SELECT item, label, p AS model_p, q AS model_q FROM scored")
def score_alignment(t):
    s = scored(t)
    return J.align_scores({"model_p": s.withColumnRenamed("p", "score"), "model_q": s.withColumnRenamed("q", "score")}, "item", ["term", "label", "fold"])


@query("membership_flag", "p_partkey:l ordered:l brand_label:s", """SELECT p_partkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49) THEN 1 ELSE 0 END AS ordered, coalesce(b.label, 'other') AS brand_label
    FROM part LEFT JOIN (SELECT p_brand, min(p_type) AS label FROM part WHERE p_size > 45 GROUP BY p_brand) AS b USING (p_brand)""")
def membership_flag(t):
    part = t("part")
    flagged = J.flag_members(part, t("lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"], "ordered")
    labels = part.where("p_size > 45").groupBy("p_brand").agg(F.min("p_type").alias("brand_label"))
    return J.lookup(flagged, labels, "p_brand", "brand_label", "other")


@query("channel_intersection", "term:l item:l", f"WITH {SCORED_SQL}, {CHANNELS} SELECT term, item FROM a JOIN b USING (term, item)")
def channel_intersection(t):
    s = scored(t)
    return s.where("p >= 0.5").select("term", "item").distinct().join(s.where("q >= 0.4").select("term", "item").distinct(), ["term", "item"])


# ---- sets --------------------------------------------------------------------------------------------------------


@query("priority_dedup", "l_orderkey:l l_partkey:l l_linenumber:l origin:s", """SELECT l_orderkey, l_partkey, l_linenumber, origin FROM (SELECT *, 'returned' AS origin, 0 AS pr FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT *, 'all' AS origin, 1 AS pr FROM lineitem) AS x
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY pr, l_linenumber) = 1""")
def priority_dedup(t):
    rows = t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    both = rows.where("l_returnflag = 'R'").withColumn("origin", F.lit("returned")).unionByName(rows.withColumn("pr", F.lit(1)).withColumn("origin", F.lit("all")), allowMissingColumns=True)
    return topk.keep_first(both, ["l_orderkey", "l_partkey"], F.coalesce("pr", F.lit(0)), F.col("l_linenumber"))


@query("forced_membership_diff", "term:l item:l", f"WITH {SCORED_SQL} SELECT term, item FROM scored WHERE anchor = 1 EXCEPT SELECT term, item FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY p DESC, item) AS r FROM scored) AS x WHERE r <= 20")
def forced_membership_diff(t):
    s = scored(t)
    return s.where("anchor = 1").select("term", "item").subtract(W.top_k(s, "term", 20, "p", "item").select("term", "item"))


@query("evidence_variants", "variant:s n:l", f"""WITH {SCORED_SQL}, a AS (SELECT item FROM scored WHERE p >= 0.6), b AS (SELECT item FROM scored WHERE q >= 0.6) SELECT 'union' AS variant, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) AS x
    UNION ALL SELECT 'both', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) AS x UNION ALL SELECT 'first_only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) AS x""")
def evidence_variants(t):
    s = scored(t)
    a, b = s.where("p >= 0.6").select("item"), s.where("q >= 0.6").select("item")
    variants = {"union": a.unionByName(b).distinct(), "both": a.intersect(b), "first_only": a.subtract(b)}
    return reduce(DataFrame.unionByName, [d.agg(F.count(F.lit(1)).alias("n")).withColumn("variant", F.lit(k)) for k, d in variants.items()])


@query("set_overlap_jaccard", "column_name:s left_values:l right_values:l shared_values:l jaccard:d", """SELECT *, shared_values::DOUBLE / (left_values + right_values - shared_values) AS jaccard FROM (
    SELECT 'part' AS column_name, count(DISTINCT a) AS left_values, count(DISTINCT b) AS right_values, count(DISTINCT a) FILTER (WHERE b IS NOT NULL) AS shared_values FROM (SELECT DISTINCT l_partkey AS a FROM lineitem WHERE l_returnflag = 'R') AS x FULL JOIN (SELECT DISTINCT l_partkey AS b FROM lineitem WHERE l_returnflag = 'A') AS y ON a = b
    UNION ALL SELECT 'supplier', count(DISTINCT a), count(DISTINCT b), count(DISTINCT a) FILTER (WHERE b IS NOT NULL) FROM (SELECT DISTINCT l_suppkey AS a FROM lineitem WHERE l_returnflag = 'R') AS x FULL JOIN (SELECT DISTINCT l_suppkey AS b FROM lineitem WHERE l_returnflag = 'A') AS y ON a = b) AS z""")
def set_overlap_jaccard(t):
    li = t("lineitem")
    r, a = li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'A'")
    return J.set_overlap(r, a, "l_partkey").withColumn("column_name", F.lit("part")).unionByName(J.set_overlap(r, a, "l_suppkey").withColumn("column_name", F.lit("supplier")))


# ---- aggregations ------------------------------------------------------------------------------------------------


@query("group_counts_rates", "o_orderpriority:s orders:l customers:l rate:d", "SELECT o_orderpriority, count(*) AS orders, count(DISTINCT o_custkey) AS customers, count(*)::DOUBLE / sum(count(*)) OVER () AS rate FROM orders GROUP BY o_orderpriority HAVING count(*) >= 10")
def group_counts_rates(t):
    o = t("orders")
    counts = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("o_custkey").alias("customers")).where("orders >= 10")
    return counts.join(A.value_rates(o, "o_orderpriority").select("o_orderpriority", "rate"), "o_orderpriority")


@query("collect_group_sets", "user_id:l types:s sequence:s", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS sequence FROM events WHERE value > 40 GROUP BY user_id")
def collect_group_sets(t):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda s: s["event_id"].cast("string"))
    return t("events").where("value > 40").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("types"), F.array_join(ordered, ",").alias("sequence"))


@query("null_group_stats", "kind:s tier:s n:l mean_value:d", "SELECT CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS kind, CASE WHEN value > 20 THEN 'high' END AS tier, count(*) AS n, avg(value) AS mean_value FROM events GROUP BY 1, 2")
def null_group_stats(t):
    kind, tier = F.when(F.col("event_type") != "click", F.col("event_type")), F.when(F.col("value") > 20, "high")
    return t("events").groupBy(kind.alias("kind"), tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))


@query("distribution_profile", "event_type:s count:l mean:d std:d min:d p05:d p25:d median:d p75:d p95:d max:d", "SELECT event_type, count(*) AS count, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95, max(value) AS max FROM events GROUP BY event_type")
def distribution_profile(t):
    return A.distribution(t("events"), F.col("value"), "event_type")


_AUDIT = ["event_id", "user_id", "event_type", "props"]


@query("table_audit", "metric:s column_name:s value:l", "SELECT 'rows' AS metric, '' AS column_name, count(*) AS value FROM events UNION ALL SELECT 'duplicate_ids', '', count(event_id) - count(DISTINCT event_id) FROM events UNION ALL SELECT 'duplicate_rows', '', 0 " + " ".join(f"UNION ALL SELECT 'nulls', '{c}', count(*) FILTER (WHERE {c} IS NULL) FROM events UNION ALL SELECT 'missing', '{c}', count(*) FILTER (WHERE {c} IS NULL OR lower(trim({c}::VARCHAR)) IN ('', 'unknown', 'bilinmiyor', 'none', 'nan', 'null', '-')) FROM events" for c in _AUDIT))
def table_audit(t):
    return A.table_audit(t("events").select(*_AUDIT), "event_id", T.UNKNOWN)


@query("dataset_audit", "table_name:s column_name:s metric:s value:d", "SELECT 'documents' AS table_name, 'n_chars' AS column_name, 'mean' AS metric, avg(n_chars) AS value FROM documents UNION ALL SELECT 'documents', 'text', 'blank_rate', avg(CASE WHEN trim(coalesce(text, '')) = '' THEN 1.0 ELSE 0.0 END) FROM documents UNION ALL SELECT 'part', 'p_brand', 'distinct', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'labels', 'doc_id', 'unmatched', count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM documents)) FROM labels UNION ALL SELECT 'orders', 'o_custkey', 'max_rows', max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) AS x")
def dataset_audit(t):
    d, labels = t("documents"), t("labels")
    one = lambda df, table, column, metric, value: df.agg(value.cast("double").alias("value")).select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), F.lit(metric).alias("metric"), "value")
    blank = F.avg((F.trim(F.coalesce("text", F.lit(""))) == "").cast("double"))
    return reduce(DataFrame.unionByName, [one(d, "documents", "n_chars", "mean", F.avg("n_chars")), one(d, "documents", "text", "blank_rate", blank), one(t("part"), "part", "p_brand", "distinct", F.count_distinct("p_brand")), one(J.without(labels, d, ["doc_id"]), "labels", "doc_id", "unmatched", F.count(F.lit(1))), one(t("orders").groupBy("o_custkey").count(), "orders", "o_custkey", "max_rows", F.max("count"))])


@query("duplicate_groups", "item:l group_key:s group_rows:l", f"WITH {CATALOG_SQL} SELECT item, md5(brand || '|' || split_part(title, ' ', 1)) AS group_key, count(*) OVER (PARTITION BY brand, split_part(title, ' ', 1)) AS group_rows FROM catalog QUALIFY group_rows > 1")
def duplicate_groups(t):
    return A.duplicate_groups(catalog(t), F.md5(F.concat_ws("|", "brand", F.split_part("title", F.lit(" "), F.lit(1)))))


@query("token_top50", "token:s n:l", f"SELECT token, count(*) AS n FROM (SELECT unnest(string_split({norm_sql('text')}, ' ')) AS token FROM documents) AS x WHERE token <> '' GROUP BY token ORDER BY n DESC, token LIMIT 50")
def token_top50(t):
    return A.top_tokens(t("documents"), T.split_tokens(T.normalize(F.col("text"))), 50)


@query("deterministic_mode", "user_id:l mode:s n:l", "SELECT user_id, event_type AS mode, count(*) AS n FROM events GROUP BY user_id, event_type QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def deterministic_mode(t):
    return A.deterministic_mode(t("events"), "user_id", "event_type")


VOTES_SQL = f"votes AS (SELECT item, j, CASE WHEN {h('vote', 'item', 'j')} % 10 < 3 THEN 1 - label ELSE label END AS label, 0.5 + ({h('conf', 'item', 'j')} % 50) / 100.0::DOUBLE AS confidence FROM scored, (SELECT unnest([1, 2, 3]) AS j) AS js)"


def votes(t):
    s = scored(t).select("item", "label", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("j"))
    key = (F.col("item"), F.col("j"))
    return s.select("item", "j", F.when(H.keyed_hash("vote", *key) % 10 < 3, 1 - F.col("label")).otherwise(F.col("label")).alias("label"), (0.5 + (H.keyed_hash("conf", *key) % 50) / F.lit(100.0)).alias("confidence"))


@query("vote_aggregation", "item:l votes:l label:l mean_confidence:d weight:d", f"WITH {SCORED_SQL}, {VOTES_SQL} SELECT item, count(*) AS votes, max(label) AS label, avg(confidence) AS mean_confidence, least(greatest(avg(confidence), 0.5), 1.0) * (1 + 0.25 * (count(*) - 1)) AS weight FROM votes GROUP BY item HAVING sum(label) IN (0, count(*))")
def vote_aggregation(t):
    return A.aggregate_votes(votes(t), "item")


@query("lineage_hash", "fold:l fingerprint:s", f"WITH {SCORED_SQL} SELECT fold, sha256(string_agg(DISTINCT term::VARCHAR, chr(10) ORDER BY term::VARCHAR)) AS fingerprint FROM scored GROUP BY fold")
def lineage_hash(t):
    return scored(t).select("fold", "term").distinct().groupBy("fold").agg(H.lineage_hash(F.col("term")).alias("fingerprint"))


@query("order_free_lineage", "fold:l fingerprint:s", f"WITH {SCORED_SQL} SELECT fold, count(*) || '_' || sum(CAST('0x' || substr(md5(term::VARCHAR), 1, 15) AS HUGEINT)) || '_' || sum(CAST('0x' || substr(md5(term::VARCHAR), 16, 15) AS HUGEINT)) AS fingerprint FROM (SELECT DISTINCT fold, term FROM scored) AS x GROUP BY fold")
def order_free_lineage(t):
    return scored(t).select("fold", "term").distinct().groupBy("fold").agg(H.order_free_hash(F.col("term")).alias("fingerprint"))


AVG = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0)"


@query("spearman_matrix", "model_a:s model_b:s rho:d", f"WITH {SCORED_SQL}, r AS (SELECT {AVG.format('p')} AS p, {AVG.format('q')} AS q, {AVG.format('value')} AS value FROM scored) " + " UNION ALL ".join(f"SELECT '{a}' AS model_a, '{b}' AS model_b, corr({a}, {b}) AS rho FROM r" for a in ("p", "q", "value") for b in ("p", "q", "value")))
def spearman_matrix(t):
    return A.spearman_matrix(scored(t).select("p", "q", "value"), ["p", "q", "value"], W.global_average_percentile)


@query("weight_rebalance", "item:l base_weight:d weight:d", f"WITH {SCORED_SQL}, w AS (SELECT item, label, 0.1 + u AS weight FROM scored) SELECT item, weight AS base_weight, CASE WHEN label = 0 THEN weight * 3.0 * (SELECT sum(weight) FROM w WHERE label = 1) / greatest((SELECT sum(weight) FROM w WHERE label = 0), 1e-12) ELSE weight END AS weight FROM w")
def weight_rebalance(t):
    return A.weight_multiplier(scored(t).select("item", "label", (0.1 + F.col("u")).alias("weight")), "label", "weight", 3.0)


@query("impute_median", "item:l u:d v:d missing_u:l missing_v:l", f"WITH {SCORED_SQL}, m AS (SELECT item, CASE WHEN item % 7 <> 0 THEN u END AS u, CASE WHEN item % 5 <> 0 THEN v END AS v FROM scored) SELECT item, coalesce(u, (SELECT median(u) FROM m)) AS u, coalesce(v, (SELECT median(v) FROM m)) AS v, (u IS NULL)::INT AS missing_u, (v IS NULL)::INT AS missing_v FROM m")
def impute_median(t):
    s = scored(t).select("item", F.when(F.col("item") % 7 != 0, F.col("u")).otherwise(F.lit(float("inf"))).alias("u"), F.when(F.col("item") % 5 != 0, F.col("v")).otherwise(F.lit(float("nan"))).alias("v"))
    return A.impute_median(s, ["u", "v"])


@query("filters_clip_sanitize", "event_id:l known:l between:l clipped:d finite:d", "SELECT event_id, CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END AS known, CASE WHEN value BETWEEN 10 AND 20 THEN 1 ELSE 0 END AS between, least(greatest(value, 1.0), 30.0) AS clipped, CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE value END AS finite FROM events")
def filters_clip_sanitize(t):
    name = F.when(F.col("event_type") == "view", " Unknown ").otherwise(F.col("event_type"))
    broken = F.when(F.col("event_id") % 22 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    return t("events").select("event_id", T.known_value(name).cast("int").alias("known"), F.col("value").between(10, 20).cast("int").alias("between"), M.clip(F.col("value"), 1.0, 30.0).alias("clipped"), M.finite_or_zero(broken).alias("finite"))


@query("cube_rollup_frames", "l_returnflag:s l_linestatus:s level:l n:l quantity:d", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS level, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_rollup_frames(t):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("sliding_frames", "event_id:l recent_mean:d recent_hours:l place:l first_type:s", """SELECT event_id, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS recent_mean, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS recent_hours,
    dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS place, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_type FROM events""")
def sliding_frames(t):
    rows, seconds = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).rangeBetween(-86400, 0)
    return t("events").withColumns({"recent_mean": F.avg("value").over(rows.rowsBetween(-4, 0)), "recent_hours": F.count(F.lit(1)).over(seconds), "place": F.dense_rank().over(Window.partitionBy("user_id").orderBy("event_type")), "first_type": F.first("event_type").over(rows)})


# ---- contracts ---------------------------------------------------------------------------------------------------


@query("contract_violations", "rule:s violations:l", f"""WITH {SCORED_SQL} SELECT 'id_unique' AS rule, count(*) - count(DISTINCT item) AS violations FROM scored UNION ALL SELECT 'pair_unique', count(*) - count(DISTINCT (l_orderkey, l_partkey)) FROM lineitem UNION ALL SELECT 'label_domain', 0 FROM (SELECT 1) AS x
    UNION ALL SELECT 'probability_range', count(*) FILTER (WHERE p NOT BETWEEN 0 AND 1) FROM scored UNION ALL SELECT 'foreign_key', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'both_classes', count(*) FROM (SELECT term FROM scored GROUP BY term HAVING min(label) = max(label)) AS y UNION ALL SELECT 'weight_positive', count(*) FROM scored WHERE u <= 0""")
def contract_violations(t):
    s = scored(t)
    rules = [Q.unique(s, ["item"], "id_unique"), Q.unique(t("lineitem"), ["l_orderkey", "l_partkey"], "pair_unique"), Q.failing(s, F.col("label").isin(0, 1), "label_domain"), Q.failing(s, F.col("p").between(0, 1) & ~F.isnan("p"), "probability_range"), Q.foreign_key(t("labels"), t("documents"), ["doc_id"], "foreign_key"), Q.both_classes(s, "term", "label", "both_classes"), Q.failing(s, F.col("u") > 0, "weight_positive")]
    return reduce(DataFrame.unionByName, rules)


@query("id_normalise", "event_id:l id_text:s cleaned:s", "SELECT event_id, CASE WHEN event_id % 3 <> 1 THEN event_id::VARCHAR END AS id_text, CASE WHEN event_id % 4 = 0 THEN ' ' ELSE event_type END AS cleaned FROM events")
def id_normalise(t):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("event_id"), F.lit(".0"))).when(F.col("event_id") % 3 == 1, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("event_id")))
    text = F.when(F.col("event_id") % 4 == 0, F.lit("  ")).otherwise(F.col("event_type"))
    return t("events").select("event_id", T.id_text(raw).alias("id_text"), T.clean_text(text).alias("cleaned"))


@query("shard_partition", "shard:l rows:l first_row:l last_row:l fingerprint:s", "SELECT row_idx // 1000 AS shard, count(*) AS rows, min(row_idx) AS first_row, max(row_idx) AS last_row, sha256(string_agg(event_id::VARCHAR, chr(10) ORDER BY event_id::VARCHAR)) AS fingerprint FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_idx FROM events) AS x GROUP BY 1")
def shard_partition(t):
    return S.shard_summary(S.with_row_index(t("events").select("event_id"), "event_id"), "event_id", 1000)


@query("pair_uid", "item:l uid:s", f"WITH {SCORED_SQL} SELECT item, md5(concat_ws('|', 'group', fold, 0, term, item)) AS uid FROM scored")
def pair_uid(t):
    return scored(t).select("item", H.pair_uid(F.lit("group"), F.col("fold"), F.lit(0), F.col("term"), F.col("item")).alias("uid"))


@query("hash_folds", "user_id:l fold:l", f"SELECT DISTINCT user_id, {h('s1', 'user_id')} % 5 AS fold FROM events")
def hash_folds(t):
    return t("events").select("user_id").distinct().withColumn("fold", H.hash_fold("s1", F.col("user_id"), 5))


@query("sha1_split", "user_id:l bucket:l is_valid:l", "SELECT user_id, bucket, CASE WHEN bucket < 10 THEN 1 ELSE 0 END AS is_valid FROM (SELECT DISTINCT user_id, CAST('0x' || substr(sha1(user_id::VARCHAR), 1, 8) AS BIGINT) % 100 AS bucket FROM events) AS x")
def sha1_split(t):
    return t("events").select("user_id").distinct().withColumn("bucket", H.sha1_percent(F.col("user_id"))).withColumn("is_valid", (F.col("bucket") < 10).cast("int"))
