"""Evaluation, calibration, ensemble, policy, scoring and model queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import keyed_hash
from ..functions.math import logit
from ..operators import calibration as C
from ..operators import metrics as M
from ..operators import policy as P
from ..operators import scoring as G
from ..operators import stacking as K
from ..operators import windows as W
from .frames import SCORED_SQL, scored
from .registry import h, query
from .table_queries import VOTES_SQL, votes

CONF = "count(*) FILTER (WHERE y = 0 AND z = 0) AS tn, count(*) FILTER (WHERE y = 0 AND z = 1) AS fp, count(*) FILTER (WHERE y = 1 AND z = 0) AS fn, count(*) FILTER (WHERE y = 1 AND z = 1) AS tp"
F1 = "coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_pos, coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f1_neg, (coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2 AS macro_f1"


@query("binary_report", "fold:l tn:l fp:l fn:l tp:l precision_pos:d recall_pos:d f1_pos:d f1_neg:d macro_f1:d accuracy:d positive_rate:d log_loss:d brier:d", f"""WITH {SCORED_SQL}, x AS (SELECT fold, label AS y, (p >= 0.5)::INT AS z, p, least(greatest(p, 1e-15), 1 - 1e-15) AS c FROM scored), s AS (SELECT fold, {CONF}, avg(-(y * ln(c) + (1 - y) * ln(1 - c))) AS log_loss, avg((p - y) * (p - y)) AS brier FROM x GROUP BY fold)
    SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision_pos, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall_pos, (tp + tn)::DOUBLE / (tp + tn + fp + fn) AS accuracy, (tp + fp)::DOUBLE / (tp + tn + fp + fn) AS positive_rate, {F1} FROM s""")
def binary_report(t):
    return M.binary_report(scored(t).withColumn("z", (F.col("p") >= 0.5).cast("int")), "label", "z", "p", "fold")


@query("ece", "ece:d", f"WITH {SCORED_SQL} SELECT sum(n * abs(y - m)) / sum(n) AS ece FROM (SELECT count(*) AS n, avg(label) AS y, avg(p) AS m FROM scored GROUP BY least(greatest(ceil(p * 15) - 1, 0), 14)) AS b")
def ece(t):
    return M.calibration_error(scored(t), "label", "p")


GRID_SQL = "g AS (SELECT i / 1000.0::DOUBLE AS threshold FROM (SELECT unnest(range(1, 1000, 7)) AS i) AS x)"


@query("threshold_sweep", "threshold:d tn:l fp:l fn:l tp:l macro_f1:d", f"WITH {SCORED_SQL}, {GRID_SQL}, s AS (SELECT threshold, {CONF} FROM (SELECT threshold, label AS y, (p >= threshold)::INT AS z FROM g, scored) AS x GROUP BY threshold) SELECT *, {F1} FROM s")
def threshold_sweep(t):
    return M.threshold_sweep(scored(t), "label", "p", M.grid(t.spark, 1, 999, 1000, 7))


@query("best_threshold", "threshold:d macro_f1:d", f"WITH {SCORED_SQL}, {GRID_SQL}, s AS (SELECT threshold, {CONF} FROM (SELECT threshold, label AS y, (q >= threshold)::INT AS z FROM g, scored) AS x GROUP BY threshold) SELECT threshold, macro_f1 FROM (SELECT threshold, {F1} FROM s) AS f ORDER BY round(macro_f1, 9) DESC, threshold LIMIT 1")
def best_threshold(t):
    return M.best_threshold(M.threshold_sweep(scored(t), "label", "q", M.grid(t.spark, 1, 999, 1000, 7)))


@query("auc_ap", "auc:d average_precision:d", f"""WITH {SCORED_SQL}, r AS (SELECT label, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS k FROM scored), d AS (SELECT p, sum(label) AS pos, count(*) AS n FROM scored GROUP BY p), c AS (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS m FROM d)
    SELECT (SELECT (sum(k) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0) / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0))::DOUBLE FROM r) AS auc, (SELECT sum(pos * tp::DOUBLE / m) / sum(pos) FROM c) AS average_precision""")
def auc_ap(t):
    return M.auc_ap(scored(t), "label", "p")


@query("slice_metrics", "event_type:s rows:l macro_f1:d", f"WITH {SCORED_SQL}, s AS (SELECT event_type, count(*) AS rows, count(DISTINCT y) AS classes, {CONF} FROM (SELECT event_type, label AS y, (q >= 0.5)::INT AS z FROM scored) AS x GROUP BY event_type) SELECT event_type, rows, {F1} FROM s WHERE rows >= 10 AND classes = 2")
def slice_metrics(t):
    return M.slice_rates(scored(t).withColumn("z", (F.col("q") >= 0.5).cast("int")), "event_type", "label", "z")


@query("error_groups", "error:s cause:s rows:l", f"WITH {SCORED_SQL} SELECT CASE WHEN label = 0 THEN 'fp' ELSE 'fn' END AS error, CASE WHEN event_type = 'view' THEN 'type' WHEN value < 5 THEN 'small' WHEN item % 7 = 0 THEN 'seventh' ELSE 'other' END AS cause, count(*) AS rows FROM scored WHERE label <> (u >= 0.5)::INT GROUP BY 1, 2")
def error_groups(t):
    return M.error_groups(scored(t).withColumn("z", (F.col("u") >= 0.5).cast("int")), "label", "z", [("type", F.col("event_type") == "view"), ("small", F.col("value") < 5), ("seventh", F.col("item") % 7 == 0)])


@query("fn_ablation", "variant:s tn:l fp:l fn:l tp:l macro_f1:d", f"WITH {SCORED_SQL}, x AS (SELECT 'before' AS variant, label AS y, (p >= 0.5)::INT AS z FROM scored UNION ALL SELECT 'after', label, (p >= 0.5 AND anchor = 1)::INT FROM scored), s AS (SELECT variant, {CONF} FROM x GROUP BY variant) SELECT *, {F1} FROM s")
def fn_ablation(t):
    s = scored(t).withColumns({"a": (F.col("p") >= 0.5).cast("int"), "b": ((F.col("p") >= 0.5) & (F.col("anchor") == 1)).cast("int")})
    return C.compare_false_negative_filter(s, "label", "a", "b")


BIN = "CASE WHEN rank <= 1 THEN '1' WHEN rank <= 3 THEN '2-3' WHEN rank <= 5 THEN '4-5' WHEN rank <= 10 THEN '6-10' WHEN rank <= 20 THEN '11-20' WHEN rank <= 50 THEN '21-50' WHEN rank <= 100 THEN '51-100' ELSE '>100' END"


@query("position_prior", "item:l bin:s log_odds:d adjusted:d", f"""WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY p DESC, item) AS rank FROM scored), g AS (SELECT avg(label) AS g FROM r), b AS (SELECT {BIN} AS bin, (sum(label) + 20 * (SELECT g FROM g)) / (count(*) + 20) AS rate FROM r GROUP BY 1),
    o AS (SELECT bin, ln(least(greatest(rate, 1e-6), 1 - 1e-6) / (1 - least(greatest(rate, 1e-6), 1 - 1e-6))) - ln((SELECT g / (1 - g) FROM g)) AS log_odds FROM b)
    SELECT item, bin, log_odds, CASE WHEN rank > 100 THEN 1.0 ELSE 1 / (1 + exp(-(ln(least(greatest(u, 1e-6), 1 - 1e-6) / (1 - least(greatest(u, 1e-6), 1 - 1e-6))) + log_odds))) END AS adjusted FROM (SELECT *, {BIN} AS bin FROM r) AS x JOIN o USING (bin)""")
def position_prior(t):
    s = scored(t).withColumn("rank", W.ordinal_rank("term", "p", "item"))
    return C.rank_adjusted(s, C.rank_log_odds(s, "rank", "label"), "rank", "u")


@query("precision_thresholds", "high:d low:d", f"""WITH {SCORED_SQL}, d AS (SELECT p, sum(label) AS pos, count(*) AS n FROM scored GROUP BY p), c AS (SELECT p, sum(pos) OVER (ORDER BY p DESC) AS hp, sum(n) OVER (ORDER BY p DESC) AS hn, sum(pos) OVER (ORDER BY p) AS lp, sum(n) OVER (ORDER BY p) AS ln FROM d)
    SELECT min(p) FILTER (WHERE hn >= 300 AND hp::DOUBLE / hn >= 0.8) AS high, max(p) FILTER (WHERE ln >= 300 AND 1 - lp::DOUBLE / ln >= 0.8) AS low FROM c""")
def precision_thresholds(t):
    return C.precision_thresholds(scored(t), "label", "p", 0.8, 300)


GRID20 = "g AS (SELECT i / 20.0::DOUBLE AS threshold FROM (SELECT unnest(range(1, 20)) AS i) AS x)"


@query("bucket_thresholds", "event_type:s rows:l terms:l threshold:d", f"""WITH {SCORED_SQL}, {GRID20}, s AS (SELECT event_type, threshold, {CONF} FROM (SELECT event_type, threshold, label AS y, (p >= threshold)::INT AS z FROM g, scored) AS x GROUP BY 1, 2),
    o AS (SELECT threshold FROM (SELECT threshold, {F1} FROM (SELECT threshold, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, sum(tp) AS tp FROM s GROUP BY threshold) AS a) AS b ORDER BY round(macro_f1, 9) DESC, threshold LIMIT 1), w AS (SELECT event_type, threshold AS own FROM (SELECT event_type, threshold, {F1} FROM s) AS c QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY round(macro_f1, 9) DESC, threshold) = 1),
    n AS (SELECT event_type, count(*) AS rows, count(DISTINCT term) AS terms FROM scored GROUP BY event_type) SELECT event_type, rows, terms, CASE WHEN rows >= 2000 AND terms >= 50 THEN rows / (rows + 5000.0) * own + (1 - rows / (rows + 5000.0)) * (SELECT threshold FROM o) ELSE (SELECT threshold FROM o) END AS threshold FROM n JOIN w USING (event_type)""")
def bucket_thresholds(t):
    return C.bucket_thresholds(scored(t), "event_type", "label", "p", "term", M.grid(t.spark, 1, 19, 20))


@query("bucket_threshold_predictions", "item:l prediction:l", f"WITH {SCORED_SQL} SELECT item, (p >= CASE event_type WHEN 'view' THEN 0.4 WHEN 'click' THEN 0.6 ELSE 0.5 END)::INT AS prediction FROM scored")
def bucket_threshold_predictions(t):
    table = t.spark.createDataFrame([("view", 0.4), ("click", 0.6)], "event_type string, threshold double")
    return C.apply_bucket_thresholds(scored(t), table, "event_type", "p", 0.5)


@query("temperature_crossfit", "fold:l temperature:d loss:d", f"""WITH {SCORED_SQL}, g AS (SELECT i AS step, exp(-4 + i * 0.05::DOUBLE) AS temperature FROM (SELECT unnest(range(0, 161)) AS i) AS x), l AS (SELECT fold, label AS y, ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))) AS z FROM scored),
    e AS (SELECT fold, step, temperature, y, least(greatest(1 / (1 + exp(-least(greatest(z / temperature, -40), 40))), 1e-15), 1 - 1e-15) AS c FROM l, g), s AS (SELECT fold, step, temperature, sum(-(y * ln(c) + (1 - y) * ln(1 - c))) AS loss, count(*) AS n FROM e GROUP BY 1, 2, 3),
    o AS (SELECT fold, step, temperature, round((sum(loss) OVER (PARTITION BY step) - loss) / (sum(n) OVER (PARTITION BY step) - n), 9) AS loss FROM s) SELECT fold, temperature, loss FROM o QUALIFY row_number() OVER (PARTITION BY fold ORDER BY loss, step) = 1""")
def temperature_crossfit(t):
    return C.cross_fit_temperature(scored(t).withColumn("raw_logit", logit(F.col("p"))), "label", "raw_logit", "fold")


@query("crossfit_predictions", "item:l calibrated:d threshold:d prediction:l", f"""WITH {SCORED_SQL}, g AS (SELECT i AS step, exp(-4 + i * 0.05::DOUBLE) AS temperature FROM (SELECT unnest(range(0, 161)) AS i) AS x), l AS (SELECT item, fold, label AS y, ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))) AS z FROM scored),
    e AS (SELECT fold, step, temperature, y, least(greatest(1 / (1 + exp(-least(greatest(z / temperature, -40), 40))), 1e-15), 1 - 1e-15) AS c FROM l, g), s AS (SELECT fold, step, temperature, sum(-(y * ln(c) + (1 - y) * ln(1 - c))) AS loss, count(*) AS n FROM e GROUP BY 1, 2, 3),
    o AS (SELECT fold, step, temperature, round((sum(loss) OVER (PARTITION BY step) - loss) / (sum(n) OVER (PARTITION BY step) - n), 9) AS loss FROM s), t AS (SELECT fold AS fit, temperature FROM o QUALIFY row_number() OVER (PARTITION BY fold ORDER BY loss, step) = 1),
    c AS (SELECT item, fold, fit, y, round(1 / (1 + exp(-least(greatest(z / temperature, -40), 40))), 9) AS p FROM l, t), k AS (SELECT unnest(range(1, 100)) AS i), m AS (SELECT fit, i / 100.0::DOUBLE AS threshold, y, (floor(p * 100) >= i)::INT AS z FROM c, k WHERE fold <> fit),
    f AS (SELECT fit, threshold, {F1} FROM (SELECT fit, threshold, {CONF} FROM m GROUP BY 1, 2) AS a), b AS (SELECT fit, threshold FROM f QUALIFY row_number() OVER (PARTITION BY fit ORDER BY round(macro_f1, 9) DESC, threshold) = 1)
    SELECT item, p AS calibrated, threshold, (p >= threshold)::INT AS prediction FROM c JOIN b USING (fit) WHERE fold = fit""")
def crossfit_predictions(t):
    return C.cross_fit_predictions(scored(t).withColumn("raw_logit", logit(F.col("p"))), "label", "raw_logit", "fold")


@query("crossfit_ensemble", "item:l fold:l blend:d")
def crossfit_ensemble(t):
    return C.cross_fit_ensemble(scored(t), ["p", "q", "u"], "label", "fold")


@query("platt_beta_isotonic", "method:s item:l calibrated:d")
def platt_beta_isotonic(t):
    s = scored(t)
    fit, apply = s.where("fold <> 0"), s.where("fold = 0")
    return reduce(DataFrame.unionByName, [C.calibrate(fit, apply, "label", "p", m).select(F.lit(m).alias("method"), "item", "calibrated") for m in ("identity", "platt", "beta", "isotonic")])


PCT = "(rank() OVER (PARTITION BY term ORDER BY {0}) + (count(*) OVER (PARTITION BY term, {0}) - 1) / 2.0) / count(*) OVER (PARTITION BY term)"


@query("ensemble_average_rank_geo", "item:l average:d weighted:d geometric:d query_rank:d", f"WITH {SCORED_SQL} SELECT item, (p + q) / 2 AS average, 0.7 * p + 0.3 * q AS weighted, exp((ln(least(greatest(p, 1e-6), 1 - 1e-6)) + ln(least(greatest(q, 1e-6), 1 - 1e-6))) / 2) AS geometric, ({PCT.format('p')} + {PCT.format('q')}) / 2 AS query_rank FROM scored")
def ensemble_average_rank_geo(t):
    s = scored(t)
    return s.select("item", C.average(["p", "q"]).alias("average"), C.average(["p", "q"], [0.7, 0.3]).alias("weighted"), C.geometric(["p", "q"]).alias("geometric"), ((W.average_percentile("p", "term") + W.average_percentile("q", "term")) / 2).alias("query_rank"))


@query("weight_grid_search", "weight:d threshold:d macro_f1:d", f"""WITH {SCORED_SQL}, {GRID20}, w AS (SELECT i / 4.0::DOUBLE AS weight FROM (SELECT unnest(range(0, 5)) AS i) AS x), s AS (SELECT weight, threshold, {CONF} FROM (SELECT weight, threshold, label AS y, (round(weight * p + (1 - weight) * q, 9) >= threshold)::INT AS z FROM scored, w, g) AS x GROUP BY 1, 2)
    SELECT weight, threshold, macro_f1 FROM (SELECT weight, threshold, {F1} FROM s) AS f ORDER BY round(macro_f1, 9) DESC, weight, threshold LIMIT 1""")
def weight_grid_search(t):
    return C.weight_search(scored(t), "p", "q", "label", M.grid(t.spark, 0, 4, 4).withColumnRenamed("threshold", "weight"), M.grid(t.spark, 1, 19, 20))


@query("experiment_upsert", "experiment_id:l fold:l score:d is_new:l", f"WITH {SCORED_SQL}, o AS (SELECT term AS experiment_id, fold, min(p) AS score, 0 AS is_new FROM scored GROUP BY 1, 2), n AS (SELECT term AS experiment_id, fold, max(p) AS score, 1 AS is_new FROM scored WHERE term % 3 = 0 GROUP BY 1, 2) SELECT * FROM n UNION ALL SELECT * FROM o WHERE (experiment_id, fold) NOT IN (SELECT (experiment_id, fold) FROM n)")
def experiment_upsert(t):
    s = scored(t).withColumnRenamed("term", "experiment_id")
    old = s.groupBy("experiment_id", "fold").agg(F.min("p").alias("score")).withColumn("is_new", F.lit(0))
    new = s.where("experiment_id % 3 = 0").groupBy("experiment_id", "fold").agg(F.max("p").alias("score")).withColumn("is_new", F.lit(1))
    return C.upsert_experiments(old, new, ["experiment_id", "fold"], "score")


# ---- policies ----------------------------------------------------------------------------------------------------


@query("min_per_query", "item:l prediction:l", f"WITH {SCORED_SQL}, r AS (SELECT item, z, row_number() OVER (PARTITION BY term, z ORDER BY p DESC, item) AS n, greatest(8 - sum(z) OVER (PARTITION BY term), 0) AS need FROM (SELECT *, (p >= 0.9)::INT AS z FROM scored) AS x) SELECT item, CASE WHEN z = 0 AND n <= need THEN 1 ELSE z END AS prediction FROM r")
def min_per_query(t):
    return P.at_least_per_group(scored(t).withColumn("prediction", (F.col("p") >= 0.9).cast("int")), "term", "prediction", "p", "item", 8)


@query("query_postprocess", "item:l adjusted:d prediction:l", f"WITH {SCORED_SQL}, a AS (SELECT item, term, greatest(p - 0.3 * anchor, 0) AS adjusted FROM scored), r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY round(adjusted, 9) DESC, item) AS n FROM a), z AS (SELECT *, (adjusted >= 0.99 OR n <= 2)::INT AS z FROM r) SELECT item, adjusted, CASE WHEN sum(z) OVER (PARTITION BY term) = 0 AND n = 1 THEN 1 ELSE z END AS prediction FROM z")
def query_postprocess(t):
    s = scored(t).withColumn("contradiction", F.col("anchor")).withColumn("p", F.round("p", 9))
    return P.postprocess(s, "term", "p", "item", 0.99, penalty=0.3, top_k=2)


@query("count_preserving_swap", "item:l prediction:l flipped:l", f"""WITH {SCORED_SQL}, c AS (SELECT item, term, anchor, row_number() OVER (PARTITION BY term, anchor ORDER BY abs(p - 0.5) DESC, q DESC, item) AS n, least(sum(1 - anchor) OVER (PARTITION BY term), sum(anchor) OVER (PARTITION BY term)) AS m FROM scored WHERE (p >= 0.5)::INT <> anchor), f AS (SELECT item FROM c WHERE n <= m)
    SELECT item, CASE WHEN item IN (SELECT item FROM f) THEN 1 - anchor ELSE anchor END AS prediction, (item IN (SELECT item FROM f))::INT AS flipped FROM scored""")
def count_preserving_swap(t):
    s = scored(t)
    candidates = s.where((F.col("p") >= 0.5).cast("int") != F.col("anchor"))
    chosen = P.swaps(candidates, "term", "anchor", [F.desc(F.abs(F.col("p") - 0.5)), F.desc("q"), F.asc("item")])
    return P.apply_flips(s.select("item", F.col("anchor").alias("prediction")), chosen, "item")


@query("floor_deficit", "item:l term:l deficit:l certainty:d", f"""WITH {SCORED_SQL}, d AS (SELECT *, greatest(greatest(n - 30, 0) - ones, 0) AS deficit, n - ones AS zeros FROM (SELECT item, term, anchor, p, q, count(*) OVER (PARTITION BY term) AS n, sum(anchor) OVER (PARTITION BY term) AS ones FROM scored) AS x)
    SELECT item, term, deficit, deficit::DOUBLE / zeros AS certainty FROM d WHERE anchor = 0 AND deficit > 0 AND deficit::DOUBLE / zeros >= 0.2 QUALIFY row_number() OVER (PARTITION BY term ORDER BY q DESC, p DESC, item) <= deficit""")
def floor_deficit(t):
    return P.floor_deficit(scored(t), "term", "anchor", [F.desc("q"), F.desc("p"), F.asc("item")], 30, 0.2)


@query("cardinality_nudge", "item:l mode:s prediction:l", f"""WITH {SCORED_SQL}, k AS (SELECT term, sum(anchor)::INT // 5 AS k, count(*) FILTER (WHERE p >= 0.5) AS n50, count(*) FILTER (WHERE p >= 0.7) AS n70 FROM scored GROUP BY term), m AS (SELECT *, greatest(k, 1) AS conservative, CASE WHEN k <= 2 AND n70 >= 5 THEN least(n70, k + 8) ELSE greatest(k, 1) END AS medium FROM k),
    a AS (SELECT *, CASE WHEN k > n50 + 15 THEN greatest(n50, 1) ELSE medium END AS aggressive FROM m), r AS (SELECT item, term, anchor, row_number() OVER (PARTITION BY term, anchor ORDER BY p DESC, item) AS z, row_number() OVER (PARTITION BY term, anchor ORDER BY p, item DESC) AS o, sum(anchor) OVER (PARTITION BY term) AS ones FROM scored),
    t AS (SELECT *, unnest([1, 2, 3]) AS i FROM r JOIN a USING (term)), g AS (SELECT *, ['conservative', 'medium', 'aggressive'][i] AS mode, [conservative, medium, aggressive][i] - ones AS gap FROM t)
    SELECT item, mode, CASE WHEN anchor = 0 AND z <= gap THEN 1 WHEN mode = 'aggressive' AND anchor = 1 AND o <= -gap THEN 0 ELSE anchor END AS prediction FROM g""")
def cardinality_nudge(t):
    s = scored(t)
    k = s.groupBy("term").agg(F.floor(F.sum("anchor") / 5).alias("k"), F.sum((F.col("p") >= 0.5).cast("int")).alias("n50"), F.sum((F.col("p") >= 0.7).cast("int")).alias("n70"))
    joined = s.join(k, "term")
    return reduce(DataFrame.unionByName, [P.nudge_to_target(joined.withColumn("target", P.target_counts(m)), "term", "anchor", "p", "item", "target", trim=m == "aggressive").select("item", F.lit(m).alias("mode"), "prediction") for m in ("conservative", "medium", "aggressive")])


@query("capped_flips", "item:l prediction:l", f"""WITH {SCORED_SQL}, a AS (SELECT item, term, anchor, p, (item % 10 <> 0 AND anchor = 0 AND p >= 0.6)::INT AS up, (item % 10 <> 0 AND anchor = 1 AND p <= 0.3)::INT AS down, greatest(3, ceil(0.1 * count(*) OVER (PARTITION BY term))) AS cap, sum(anchor) OVER (PARTITION BY term) AS k FROM scored),
    b AS (SELECT *, row_number() OVER (PARTITION BY term, up ORDER BY p DESC, item) AS ur, row_number() OVER (PARTITION BY term, down ORDER BY p, item) AS dr, least(sum(up) OVER (PARTITION BY term), cap) AS adds FROM a)
    SELECT item, CASE WHEN up = 1 AND ur <= cap THEN 1 WHEN down = 1 AND dr <= least(cap, greatest(0, k + adds - 1)) THEN 0 ELSE anchor END AS prediction FROM b""")
def capped_flips(t):
    return P.capped_flips(scored(t).withColumn("locked", (F.col("item") % 10 == 0).cast("int")), "term", "anchor", "p", "item", 0.6, 0.3)


JUDGES = ", ".join(f"j{i} AS (SELECT item, label, confidence FROM votes WHERE j = {i})" for i in (1, 2, 3))


@query("cascade_consensus", "item:l joint:d tier:s", f"""WITH {SCORED_SQL}, {VOTES_SQL}, {JUDGES}, pool AS (SELECT item, anchor, 1 - anchor AS alternative FROM scored) SELECT item, least(a.confidence, b.confidence) AS joint, CASE WHEN least(a.confidence, b.confidence) >= 0.8 THEN 'strict' WHEN least(a.confidence, b.confidence) >= 0.65 THEN 'medium' ELSE 'broad' END AS tier
    FROM pool JOIN j1 AS a USING (item) JOIN j2 AS b USING (item) WHERE a.label = alternative AND b.label = alternative""")
def cascade_consensus(t):
    v = votes(t)
    pool = scored(t).select("item", (1 - F.col("anchor")).alias("alternative"))
    return P.consensus(pool, [v.where(f"j = {i}") for i in (1, 2)], "item", {"strict": 0.80, "medium": 0.65, "broad": 0.50})


@query("cascade_veto", "rows:l seen:l confirmed:l vetoed:l collapsed:l", f"""WITH {SCORED_SQL}, {VOTES_SQL}, {JUDGES}, pool AS (SELECT item, 1 - anchor AS alternative FROM scored), two AS (SELECT item, alternative FROM pool JOIN j1 AS a USING (item) JOIN j2 AS b USING (item) WHERE a.label = alternative AND a.confidence >= 0.55 AND b.label = alternative AND b.confidence >= 0.65)
    SELECT count(*) AS rows, count(c.label) AS seen, count(*) FILTER (WHERE c.label = alternative) AS confirmed, count(*) FILTER (WHERE c.label <> alternative) AS vetoed, (count(DISTINCT c.label) <= 1)::INT AS collapsed FROM two LEFT JOIN (SELECT * FROM j3 WHERE item % 4 <> 0) AS c USING (item)""")
def cascade_veto(t):
    v = votes(t)
    pool = scored(t).select("item", (1 - F.col("anchor")).alias("alternative"))
    two = P.cascade(pool, [v.where("j = 1"), v.where("j = 2")], "item", [0.55, 0.65])
    return P.veto_audit(two, v.where("j = 3 and item % 4 <> 0"), "item")


@query("layered_stack", "item:l layer:l prediction:l", f"""WITH {SCORED_SQL}, {VOTES_SQL}, n AS (SELECT item FROM votes WHERE label = 0), l AS (SELECT item, min(l) AS l FROM (SELECT item, 1 AS l FROM scored WHERE p >= 0.8 UNION ALL SELECT item, 2 FROM scored WHERE q >= 0.7) AS x WHERE item NOT IN (SELECT item FROM n) GROUP BY item)
    SELECT item, CASE WHEN anchor = 0 AND l IS NOT NULL THEN l ELSE 0 END AS layer, CASE WHEN anchor = 0 AND l IS NOT NULL THEN 1 ELSE anchor END AS prediction FROM scored LEFT JOIN l USING (item)""")
def layered_stack(t):
    s = scored(t)
    return P.layered(s.select("item", F.col("anchor").alias("prediction")), [s.where("p >= 0.8"), s.where("q >= 0.7")], votes(t).where("label = 0"), "item")


@query("positive_only_flips", "item:l prediction:l", f"WITH {SCORED_SQL} SELECT item, greatest(anchor, (p >= 0.6 AND q >= 0.6)::INT) AS prediction FROM scored")
def positive_only_flips(t):
    s = scored(t)
    return P.raise_only(s.select("item", F.col("anchor").alias("prediction")), s.where("p >= 0.6 and q >= 0.6"), "item")


@query("disagreement_pool", "item:l votes:l priority:d", f"""WITH {SCORED_SQL}, g AS (SELECT *, (row_number() OVER (ORDER BY p DESC, item) <= round_even((SELECT count(*) FROM scored) * 0.24, 0))::INT AS a, (row_number() OVER (PARTITION BY term ORDER BY q DESC, item) <= sum(anchor) OVER (PARTITION BY term))::INT AS b FROM scored),
    v AS (SELECT item, (a <> anchor)::INT + (b <> anchor)::INT AS votes, abs(p - 0.5) + abs(q - 0.5) AS strength FROM g) SELECT item, votes, 10 * votes + round(strength, 6) AS priority FROM v WHERE votes > 0 ORDER BY priority DESC, item LIMIT 1000""")
def disagreement_pool(t):
    from ..operators import topk

    s = topk.global_ratio(scored(t), 0.24, "p", "item", into="a")
    s = topk.count_preserving(s, "term", "q", "anchor", "item").withColumnRenamed("selected", "b")
    s = s.withColumn("votes", (F.col("a") != F.col("anchor")).cast("int") + (F.col("b") != F.col("anchor")).cast("int")).where("votes > 0")
    strength = F.round(F.abs(F.col("p") - 0.5) + F.abs(F.col("q") - 0.5), 6)
    return topk.priority_pool(s.withColumn("priority", 10 * F.col("votes") + strength), "priority", "item", 1000)


# ---- scoring and models ------------------------------------------------------------------------------------------


@query("sharded_scoring", "item:l shard:l score:d", f"WITH {SCORED_SQL} SELECT item, (row_number() OVER (ORDER BY item) - 1) // 2500 AS shard, ({h('score', 'item')} % 1000003) / 1000003.0::DOUBLE AS score FROM scored")
def sharded_scoring(t):
    from ..sources.shards import with_row_index

    rows = with_row_index(scored(t).select("item"), "item").withColumn("shard", F.floor(F.col("row_idx") / 2500))
    return rows.withColumn("score", (keyed_hash("score", F.col("item")) % 1000003) / F.lit(1000003.0))


@query("injected_scorer", "doc_id:l label:l p_relevant:d confidence:d", "WITH p AS (SELECT doc_id, 1 / (1 + exp(-(length(coalesce(text, '')) % 7) + length(coalesce(text, '')) % 5)) AS p FROM documents) SELECT doc_id, CAST(p >= 0.5 AS INTEGER) AS label, p AS p_relevant, greatest(p, 1 - p) AS confidence FROM p")
def injected_scorer(t):
    def judge(texts: list[str]) -> list[tuple[float, float]]:
        return [(-float(len(x) % 7), -float(len(x) % 5)) for x in texts]

    return G.judge(t("documents").select("doc_id", F.col("text").alias("prompt")), "prompt", judge)


@query("hashing_embedding", "doc_id:l norm:d")
def hashing_embedding(t):
    from ..operators.retrieval import dot

    e = G.embed(t("documents").select("doc_id", "text"), "text", G.hashing_encoder(32), 32)
    return e.select("doc_id", F.sqrt(dot(F.col("embedding"), F.col("embedding"))).alias("norm"))


@query("gbt_oof", "item:l fold:l prediction:d")
def gbt_oof(t):
    return G.out_of_fold_gbt(scored(t).select("item", "fold", "label", "u", "v", "value"), ["u", "v", "value"], "label", "fold")


@query("adversarial_lr", "auc:d rows:l")
def adversarial_lr(t):
    d = t("documents").select(F.col("text"), F.lit(1).alias("label")).unionByName(t("benchmark").select("text", F.lit(0).alias("label")))
    return G.adversarial_auc(d, "text", "label")


@query("events_windows", "window_start:s event_type:s n:l total:d", "SELECT strftime(time_bucket(INTERVAL 1 day, ts), '%Y-%m-%d') AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def events_windows(t):
    from ..streaming.windows import tumbling

    return tumbling(t("events"), "1 day").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query("nested_ensemble", "item:l method:s blend:d")
def nested_ensemble(t):
    return K.nested_ensemble(scored(t), ["p", "q", "u"], "label", "fold", "term")[0].select("item", "method", "blend")


@query("ensemble_report", "method:s n:l log_loss:d")
def ensemble_report(t):
    return K.nested_ensemble(scored(t), ["p", "q", "u"], "label", "fold", "term")[1]
