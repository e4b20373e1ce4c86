"""Teachers, students, ranker features and fitted cardinalities over the scored candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_fold
from ..operators import distill as D
from ..operators import models as L
from ..operators import policy as P
from .frames import CATALOG_SQL, ORDER_PAIRS_SQL, SCORED_SQL, catalog, order_pairs, pair_parts, scored
from .registry import h, query

_PCT = "(rank() OVER ({1} ORDER BY {0}) + (count(*) OVER (PARTITION BY {2}{0}) - 1) / 2.0) / count(*) OVER ({1})"


def _pct(score: str, group: str = "") -> str:
    return _PCT.format(score, f"PARTITION BY {group}" if group else "", f"{group}, " if group else "")


@query("mean_global_percentile", "item:l relevance:d", f"WITH {SCORED_SQL} SELECT item, ({_pct('p')} + {_pct('q')} + {_pct('u')}) / 3 AS relevance FROM scored")
def mean_global_percentile(t):
    return D.mean_global_percentile(scored(t), ["p", "q", "u"], "relevance")


@query("student_features", "item:l global_rank_p:d global_rank_u:d term_rank_p:d term_rank_u:d model_mean:d model_std:d model_range:d term_size_log:d", f"""WITH {SCORED_SQL} SELECT item, {_pct('p')} AS global_rank_p, {_pct('u')} AS global_rank_u, {_pct('p', 'term')} AS term_rank_p, {_pct('u', 'term')} AS term_rank_u, (p + q + u) / 3 AS model_mean,
    sqrt(greatest((p * p + q * q + u * u) / 3 - ((p + q + u) / 3) ** 2, 0)) AS model_std, greatest(p, q, u) - least(p, q, u) AS model_range, ln(1 + count(*) OVER (PARTITION BY term)) AS term_size_log FROM scored""")
def student_features(t):
    return D.student_features(scored(t), "term", ["p", "q", "u"], ["p", "u"])


_LOGIT = "ln(least(greatest({0}, 1e-6), 1 - 1e-6) / (1 - least(greatest({0}, 1e-6), 1 - 1e-6)))"


@query("teacher_labels", "item:l teacher_prob:d teacher_label:l weight:d held_out:l", f"""WITH {SCORED_SQL}, j AS (SELECT item, term, p AS a, CASE WHEN item % 3 <> 0 THEN q END AS b FROM scored), m AS (SELECT *, CASE WHEN b IS NULL THEN a ELSE 1 / (1 + exp(-({_LOGIT.format('a')} + {_LOGIT.format('b')}) / 2)) END AS teacher_prob FROM j)
    SELECT item, teacher_prob, CAST(teacher_prob >= 0.5 AS INTEGER) AS teacher_label, (0.35 + 1.3 * abs(teacher_prob - 0.5)) * CASE WHEN b IS NULL THEN 1 WHEN (a >= 0.5) = (b >= 0.5) THEN 1.35 ELSE 0.55 END AS weight, CAST({h('student', 'term')} % 5 = 0 AS INTEGER) AS held_out FROM m""")
def teacher_labels(t):
    """Two judges, the second of whom saw two thirds of the pool."""
    s = scored(t).withColumn("second", F.when(F.col("item") % 3 != 0, F.col("q")))
    return s.select("item", *[v.alias(k) for k, v in D.teacher(F.col("p"), F.col("second")).items()], (hash_fold("student", F.col("term"), 5) == 0).cast("int").alias("held_out"))


@query("student_scores", "item:l held_out:l student_prob:d")
def student_scores(t):
    s = D.student_features(scored(t), "term", ["p", "q", "u"], ["p", "u"]).withColumn("second", F.when(F.col("item") % 3 != 0, F.col("q")))
    s = s.withColumns(D.teacher(F.col("p"), F.col("second")))
    return D.student(s, "term", ["u", "v", "value", "global_rank_u", "term_rank_u", "term_size_log"], trees=8)


@query("ranker_pair_features", "query_id:l item:l retrieval_rank:d retrieval_rank_pct:d retrieval_score:d query_char_count:d title_char_count:d attribute_char_count:d top_category_candidate_count:d leaf_category_candidate_count:d " + " ".join(f"source_{s}:d" for s in D.SOURCES), f"""WITH {CATALOG_SQL}, {ORDER_PAIRS_SQL},
    r AS (SELECT query_id, o.item, row_number() OVER (PARTITION BY query_id ORDER BY o.item) - 1 AS retrieval_rank, p_size / 50.0 AS retrieval_score, ['title', 'word', 'char', 'other'][o.item % 4 + 1] AS source, q.title AS query, c.title, c.attributes, c.p_type AS top, c.brand AS leaf FROM order_pairs AS o JOIN catalog AS c ON c.item = o.item JOIN (SELECT item, title FROM catalog) AS q ON q.item = query_id)
    SELECT query_id, item, retrieval_rank, CASE WHEN retrieval_rank > 0 THEN 1.0 / retrieval_rank ELSE 0 END AS retrieval_rank_pct, retrieval_score, length(query) AS query_char_count, length(title) AS title_char_count, length(attributes) AS attribute_char_count, count(*) OVER (PARTITION BY query_id, top) AS top_category_candidate_count, count(*) OVER (PARTITION BY query_id, leaf) AS leaf_category_candidate_count,
    {", ".join(f"CAST(source = '{s}' AS INTEGER) AS source_{s}" for s in D.SOURCES)} FROM r""")
def ranker_pair_features(t):
    from ..operators.windows import position

    # lengths, and hashes of the categories that are only counted: pairs are sorted by windows and should be narrow
    c = catalog(t).select("item", F.length("title").alias("title_length"), F.length("attributes").alias("attributes_length"), F.xxhash64("p_type").alias("top_category"), F.xxhash64("brand").alias("leaf_category"), (F.col("p_size") / 50).alias("retrieval_score"))
    q = catalog(t).select(F.col("item").alias("query_id"), F.length("title").alias("query_length"))
    pairs = order_pairs(t).join(c, "item").repartition(pair_parts(t), "query_id").withColumn("retrieval_rank", position("query_id", "item") - 1).withColumn("retrieval_source", F.get(F.array(*[F.lit(x) for x in ("title", "word", "char", "other")]), (F.col("item") % 4).cast("int")))
    rows = pairs.join(q, "query_id")
    return rows.select("query_id", "item", *[v.alias(k) for k, v in D.ranker_pair_features(rows, "query_id").items()])


@query("fitted_nudge", "item:l mode:s prediction:l")
def fitted_nudge(t):
    """The cardinality nudge towards the number of positives that the size regressor expects of a term."""
    s = scored(t)
    expected = L.size_regressor(L.group_size_features(s, "term", "label", "p", F.concat_ws(" ", "event_type", "term")), "term").select("term", F.greatest(F.round("prediction").cast("int"), F.lit(0)).alias("k"))
    counts = s.groupBy("term").agg(F.sum((F.col("p") >= 0.5).cast("int")).alias("n50"), F.sum((F.col("p") >= 0.7).cast("int")).alias("n70")).join(expected, "term")
    joined = s.join(counts, "term")
    return reduce(DataFrame.unionByName, [P.nudge_to_target(joined.withColumn("target", P.target_counts(m)), "term", "anchor", "p", "item", "target", trim=m == "aggressive").select("item", F.lit(m).alias("mode"), "prediction") for m in ("conservative", "medium", "aggressive")])
