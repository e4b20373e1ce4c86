"""Window, ranking and top-k queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import math as M
from ..functions.hashing import keyed_hash
from ..operators import mining, topk
from ..operators import windows as W
from .frames import SCORED_SQL, scored
from .registry import h, query

FEATURES = """SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, count(*) OVER g AS group_size, max(value) OVER g AS top,
    avg(value) OVER g AS mean, greatest(coalesce(stddev_samp(value) OVER g, 0), 1e-6) AS std FROM events WINDOW g AS (PARTITION BY user_id)"""


def _features(t):
    return W.group_features(t("events").select("user_id", "event_id", "value"), "user_id", "value", "event_id")


@query("term_topk_gap", "user_id:l event_id:l rank:l group_size:l gap_to_top:d minus_mean:d percentile_a:d", f"SELECT *, top - value AS gap_to_top, value - mean AS minus_mean, 1 - (rank - 1) / group_size::DOUBLE AS percentile_a FROM ({FEATURES}) AS x WHERE rank <= 3")
def term_topk_gap(t):
    return _features(t).where("rank <= 3")


@query("percentile_b_zscore", "user_id:l event_id:l zscore:d percentile_b:d", f"SELECT *, (value - mean) / std AS zscore, 1 - (rank - 1) / greatest(group_size - 1, 1)::DOUBLE AS percentile_b FROM ({FEATURES}) AS x")
def percentile_b_zscore(t):
    return _features(t)


AVG_RANK = "(rank() OVER ({0} ORDER BY {1}) + (count(*) OVER (PARTITION BY {2}{1}) - 1) / 2.0) / count(*) OVER ({0})"


@query("avg_rank_pct", "event_id:l term_pct:d global_pct:d", f"SELECT event_id, {AVG_RANK.format('PARTITION BY user_id', 'v', 'user_id, ')} AS term_pct, {AVG_RANK.format('', 'v', '')} AS global_pct FROM (SELECT *, round(value) AS v FROM events) AS x")
def avg_rank_pct(t):
    rows = t("events").select("user_id", "event_id", F.round("value").alias("v")).withColumn("term_pct", W.average_percentile("v", "user_id"))
    return W.global_average_percentile(rows, "v", "global_pct")


@query("candidate_position_excess", "user_id:l event_id:l pos:l n:l exact:l boundary:d", """SELECT *, max(CASE WHEN rank = 20 THEN value END) OVER (PARTITION BY user_id) AS boundary, CASE WHEN n = 66 THEN 1 ELSE 0 END AS exact FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) AS x WHERE n > 20 QUALIFY pos > 20""")
def candidate_position_excess(t):
    rows = t("events").withColumns({"pos": W.position("user_id", "ts", "event_id"), "n": W.group_size("user_id"), "rank": W.ordinal_rank("user_id", "value", "event_id")}).where("n > 20")
    return rows.withColumns({"boundary": W.boundary("user_id", "value", "rank", 20), "exact": (F.col("n") == 66).cast("int")}).where("pos > 20")


@query("structural_residual", "term:l item:l is_residual:l agreement:l margin:d confidence:d", f"""WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY p DESC, item) AS r1, row_number() OVER (PARTITION BY term ORDER BY q DESC, item) AS r2,
    row_number() OVER (PARTITION BY term ORDER BY value DESC, item) AS r3, count(*) OVER (PARTITION BY term) AS n, greatest(coalesce(stddev_samp(p) OVER (PARTITION BY term), 0), 1e-6) AS std FROM scored),
    b AS (SELECT *, max(CASE WHEN r1 = 30 THEN p END) OVER (PARTITION BY term) AS boundary, CASE WHEN n > 30 AND r1 > 30 THEN 1 ELSE 0 END AS is_residual,
    CASE WHEN n > 30 THEN (r1 > 30)::INT + (r2 > 30)::INT + (r3 > 30)::INT ELSE 0 END AS agreement FROM r),
    m AS (SELECT *, CASE WHEN boundary IS NOT NULL THEN greatest((boundary - p) / std, 0) END AS margin FROM b) SELECT *, margin + 0.3 * greatest(agreement - 1, 0) AS confidence FROM m""")
def structural_residual(t):
    return W.structural_residual(scored(t), "term", "p", ["q", "value"], "item", 30)


@query("fast_retrieval_residual", "term:l item:l fast_score:d rank:l pos:l is_residual:l margin:d", f"""WITH {SCORED_SQL}, f AS (SELECT *, u + 0.35 * v + 0.5 * (CASE WHEN u >= 1 THEN 1 ELSE 0 END) + 0.2 * (CASE WHEN label > 0 OR anchor > 0 THEN 1 ELSE 0 END) AS fast_score,
    row_number() OVER (PARTITION BY term ORDER BY ts, item) AS pos, count(*) OVER (PARTITION BY term) AS n FROM scored),
    r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY round(fast_score, 9) DESC, item) AS rank, greatest(coalesce(stddev_samp(fast_score) OVER (PARTITION BY term), 0), 1e-6) AS std FROM f)
    SELECT *, CASE WHEN n > 30 AND rank > 30 THEN 1 ELSE 0 END AS is_residual, greatest((max(CASE WHEN rank = 30 THEN fast_score END) OVER (PARTITION BY term) - fast_score) / std, 0) AS margin FROM r WHERE n >= 30""")
def fast_retrieval_residual(t):
    c = F.col
    rows = scored(t).withColumns({"fast_score": W.fast_retrieval_score(c("u"), c("v"), c("label"), c("anchor")), "pos": W.position("term", "ts", "item"), "n": W.group_size("term")}).withColumn("_key", F.round("fast_score", 9))
    rows = rows.withColumns({"rank": W.ordinal_rank("term", "_key", "item"), "std": F.greatest(F.coalesce(F.stddev_samp("fast_score").over(Window.partitionBy("term")), F.lit(0.0)), F.lit(1e-6))}).where("n >= 30")
    return rows.withColumns({"is_residual": ((c("n") > 30) & (c("rank") > 30)).cast("int"), "margin": F.greatest((W.boundary("term", "fast_score", "rank", 30) - c("fast_score")) / c("std"), F.lit(0.0))})


@query("category_frequency", "event_id:l frequency:d", "SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type)::DOUBLE / count(*) OVER (PARTITION BY user_id) AS frequency FROM events")
def category_frequency(t):
    return t("events").withColumn("frequency", W.category_frequency("user_id", "event_type"))


@query("score_elbow", "user_id:l n:l k:l", """WITH r AS (SELECT user_id, value, row_number() OVER w AS rank, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id)),
    d AS (SELECT *, (value - lead(value) OVER (PARTITION BY user_id ORDER BY rank)) / (value + 1e-6) AS gap FROM r WHERE rank <= 15),
    k AS (SELECT user_id, max(n) AS n, coalesce(arg_min(rank, (-gap, rank)) FILTER (WHERE gap IS NOT NULL), 1) AS k FROM d GROUP BY user_id) SELECT user_id, n, greatest(least(k, 10, n), 2) AS k FROM k""")
def score_elbow(t):
    return W.score_elbow(t("events"), "user_id", "value", "event_id", 2, 10)


@query("query_score_profile", "term:l n:l mean:d std:d top:d p90:d n35:l n50:l n70:l anchor_k:l", f"""WITH {SCORED_SQL} SELECT term, count(*) AS n, avg(p) AS mean, stddev_pop(p) AS std, max(p) AS top, quantile_cont(p, 0.9) AS p90,
    count(*) FILTER (WHERE p >= 0.35) AS n35, count(*) FILTER (WHERE p >= 0.5) AS n50, count(*) FILTER (WHERE p >= 0.7) AS n70, sum(anchor) AS anchor_k FROM scored GROUP BY term""")
def query_score_profile(t):
    return W.score_profile(scored(t), "term", "p", [F.sum("anchor").alias("anchor_k")])


@query("running_total_prefix", "user_id:l rows_before:l", f"""SELECT user_id, coalesce(sum(n) OVER (ORDER BY hash, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rows_before FROM (SELECT user_id, count(*) AS n, {h("prefix", "user_id")} AS hash FROM events GROUP BY user_id) AS x QUALIFY rows_before < 2000""")
def running_total_prefix(t):
    sizes = t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("hash", keyed_hash("prefix", F.col("user_id")))
    return W.range_sums(sizes, ["hash", "user_id"], {"n": "rows_before"}, before=True).where("rows_before < 2000")


@query("ablation_lag", "step:s metric:d previous:d delta:d low_roi:l", """SELECT *, CASE WHEN delta BETWEEN 0 AND 0.002 AND seconds > 1.5 * previous_seconds THEN 1 ELSE 0 END AS low_roi FROM (SELECT *, metric - previous AS delta FROM (
    SELECT *, lag(metric) OVER (ORDER BY step) AS previous, lag(seconds) OVER (ORDER BY step) AS previous_seconds FROM (
    SELECT strftime(o_orderdate, '%Y-%m') AS step, round(avg(o_totalprice) / 100000, 4) AS metric, count(*)::DOUBLE AS seconds FROM orders GROUP BY 1) AS a) AS b) AS c""")
def ablation_lag(t):
    months = t("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("step")).agg(F.round(F.avg("o_totalprice") / 100000, 4).alias("metric"), F.count(F.lit(1)).cast("double").alias("seconds"))
    return W.ablation(months, "step", "metric", "seconds")


@query("stratified_roundrobin", "event_id:l band:l turn:l half:l", f"""WITH {SCORED_SQL}, b AS (SELECT item, event_type, ntile(5) OVER (ORDER BY p, item) AS band FROM scored),
    r AS (SELECT item AS event_id, event_type, band, row_number() OVER (PARTITION BY band, event_type ORDER BY {h("rr", "item")}, item) - 1 AS turn FROM b),
    s AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY turn, event_type, event_id) AS n FROM r)
    SELECT event_id, band, turn, CASE WHEN n - 1 >= 20 THEN 1 ELSE 0 END AS half FROM s WHERE n <= 40""")
def stratified_roundrobin(t):
    banded = W.bands(scored(t), 5, "p", "item").withColumn("stratum", F.concat_ws("|", "band", "event_type"))
    # no more than 40 of a stratum can be among the 40 of its band, and only these leave a map task
    first = banded.withColumn("_turn", F.row_number().over(Window.partitionBy("stratum").orderBy(keyed_hash("rr", F.col("item")), "item"))).where("_turn <= 40")
    rows = first.withColumn("turn", F.col("_turn") - 1).withColumn("n", F.row_number().over(Window.partitionBy("band").orderBy("turn", "event_type", "item"))).where("n <= 40")
    return rows.select(F.col("item").alias("event_id"), "band", "turn", (F.col("n") - 1 >= 20).cast("int").alias("half"))


@query("global_ratio_topk", "item:l prediction:l", f"WITH {SCORED_SQL} SELECT item, CASE WHEN row_number() OVER (ORDER BY p DESC, item) <= round_even((SELECT count(*) FROM scored) * 0.2295, 0) THEN 1 ELSE 0 END AS prediction FROM scored")
def global_ratio_topk(t):
    return topk.global_ratio(scored(t), 0.2295, "p", "item")


@query("count_preserving_topk", "item:l selected:l k:l boundary:d", f"""WITH {SCORED_SQL}, r AS (SELECT item, term, p, row_number() OVER (PARTITION BY term ORDER BY p DESC, item) AS rank, sum(anchor) OVER (PARTITION BY term) AS k, count(*) OVER (PARTITION BY term) AS n FROM scored),
    e AS (SELECT *, max(CASE WHEN rank = k THEN p END) OVER (PARTITION BY term) AS i, max(CASE WHEN rank = k + 1 THEN p END) OVER (PARTITION BY term) AS o FROM r)
    SELECT item, CASE WHEN rank <= k THEN 1 ELSE 0 END AS selected, k, CASE WHEN k = 0 THEN o + 1e-6 WHEN k = n THEN i - 1e-6 ELSE (i + o) / 2 END AS boundary FROM e""")
def count_preserving_topk(t):
    return topk.count_preserving(scored(t), "term", "p", "anchor", "item")


@query("priority_pool", "item:l priority:d", f"""WITH {SCORED_SQL} SELECT item, round(10 * ((p >= 0.5)::INT + (q >= 0.5)::INT) + abs(p - 0.5) + abs(q - 0.5), 6) AS priority FROM scored WHERE (p >= 0.5) <> (anchor = 1) OR (q >= 0.5) <> (anchor = 1) ORDER BY 2 DESC, item LIMIT 500""")
def priority_pool(t):
    p, q, a = F.col("p") >= 0.5, F.col("q") >= 0.5, F.col("anchor") == 1
    rows = scored(t).where((p != a) | (q != a)).withColumn("priority", F.round(10 * (p.cast("int") + q.cast("int")) + F.abs(F.col("p") - 0.5) + F.abs(F.col("q") - 0.5), 6))
    return topk.priority_pool(rows, "priority", "item", 500)


@query("group_argmax_prefix", "term:l best_item:l top3:s positives_at_best:l", f"""WITH {SCORED_SQL}, r AS (SELECT term, item, label, row_number() OVER (PARTITION BY term ORDER BY p DESC, item) AS rank, sum(label) OVER (PARTITION BY term ORDER BY p DESC, item ROWS UNBOUNDED PRECEDING) AS hits FROM scored)
    SELECT term, max(CASE WHEN rank = 1 THEN item END) AS best_item, string_agg(item::VARCHAR, ',' ORDER BY rank) FILTER (WHERE rank <= 3) AS top3, max(CASE WHEN rank <= 10 THEN hits END) AS positives_at_best FROM r GROUP BY term""")
def group_argmax_prefix(t):
    rows = W.top_k(scored(t), "term", 10, "p", "item").withColumn("hits", F.sum("label").over(Window.partitionBy("term").orderBy("rank")))
    top3 = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "item")))), lambda s: s["item"].cast("string")), ",")
    return rows.groupBy("term").agg(F.min_by("item", "rank").alias("best_item"), top3.alias("top3"), F.max("hits").alias("positives_at_best"))


@query("evidence_pick", "term:l item:l pick_rank:l weight:d", f"""WITH {SCORED_SQL} SELECT term, item, row_number() OVER (PARTITION BY term ORDER BY label DESC, q DESC, ts, item) AS pick_rank,
    CASE WHEN p >= 0.5 AND q >= 0.5 AND anchor = 1 THEN 1.0 WHEN p >= 0.5 AND q >= 0.5 THEN 0.9 WHEN p >= 0.5 THEN 0.8 WHEN q >= 0.5 THEN 0.7 ELSE 0.55 END AS weight FROM scored QUALIFY pick_rank <= 5""")
def evidence_pick(t):
    p, q = F.col("p") >= 0.5, F.col("q") >= 0.5
    rows = scored(t).withColumn("weight", mining.pseudo_label_weight(p & q, F.col("anchor") == 1, p, q))
    return topk.pick(rows, "term", [F.desc("label"), F.desc("q"), F.asc("ts"), F.asc("item")], F.lit(5))


@query("hash_sample_shuffle", "event_id:l place:l", f"SELECT event_id, row_number() OVER (ORDER BY {h('shuffle', 'event_id')}, event_id) AS place FROM events QUALIFY place <= 250")
def hash_sample_shuffle(t):
    chosen = topk.hash_order(t("events"), keyed_hash("shuffle", F.col("event_id")), 250, "event_id")
    return chosen.withColumn("place", F.row_number().over(Window.orderBy(keyed_hash("shuffle", F.col("event_id")), "event_id")))


@query("bucketize", "event_id:l rank_bin:s size_bucket:s clipped:d", """SELECT event_id, CASE WHEN r <= 1 THEN '1' WHEN r <= 3 THEN '2-3' WHEN r <= 10 THEN '4-10' ELSE '>10' END AS rank_bin,
    CASE WHEN n <= 50 THEN '<=50' WHEN n <= 100 THEN '51-100' WHEN n <= 150 THEN '101-150' WHEN n <= 300 THEN '151-300' ELSE '>300' END AS size_bucket, least(greatest(value, 5.0), 50.0) AS clipped
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) AS x""")
def bucketize(t):
    rows = t("events").withColumns({"r": W.ordinal_rank("user_id", "value", "event_id"), "n": W.group_size("user_id")})
    return rows.withColumns({"rank_bin": M.bins(F.col("r"), [1, 3, 10], ["1", "2-3", "4-10", ">10"]), "size_bucket": M.candidate_count_bucket(F.col("n")), "clipped": M.clip(F.col("value"), 5.0, 50.0)})
