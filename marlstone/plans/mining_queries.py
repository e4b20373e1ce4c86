"""Retrieval, negative mining, sampling and split queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import keyed_hash
from ..operators import joins as J
from ..operators import mining as N
from ..operators import retrieval as R
from ..operators import splits as V
from ..operators import windows as W
from .frames import CATALOG_SQL, ORDER_PAIRS_SQL, SCORED_SQL, catalog, norm_sql, order_pairs, scored
from .registry import Tables, h, query

# ---- retrieval ---------------------------------------------------------------------------------------------------

GRAMS = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
TFIDF_SQL = f"""iw AS (SELECT doc_id AS k, list_filter(string_split({norm_sql('text')}, ' '), lambda x: x <> '') AS w FROM documents), qw AS (SELECT item_id AS k, list_filter(string_split({norm_sql('text')}, ' '), lambda x: x <> '') AS w FROM benchmark),
    it AS (SELECT k, gram, count(*) AS tf FROM (SELECT k, unnest({GRAMS}) AS gram FROM iw) AS x GROUP BY k, gram), qt AS (SELECT k, gram, count(*) AS tf FROM (SELECT k, unnest({GRAMS}) AS gram FROM qw) AS x GROUP BY k, gram),
    idf AS (SELECT gram, ln((1 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf FROM it GROUP BY gram HAVING count(*) >= 2),
    ir AS (SELECT k, gram, (1 + ln(tf)) * idf AS w FROM it JOIN idf USING (gram)), qr AS (SELECT k, gram, (1 + ln(tf)) * idf AS w FROM qt JOIN idf USING (gram)),
    ii AS (SELECT k, gram, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM ir), qq AS (SELECT k, gram, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM qr)"""


@query("tfidf_topk", "item_id:l doc_id:l score:d rank:l", f"WITH {TFIDF_SQL} SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (SELECT qq.k AS item_id, ii.k AS doc_id, sum(qq.w * ii.w) AS score FROM qq JOIN ii USING (gram) GROUP BY 1, 2) AS s) AS r WHERE rank <= 5")
def tfidf_topk(t):
    return R.tfidf_search(t("benchmark"), t("documents"), "item_id", "text", "doc_id", "text", 5)


_CHAR_GRAMS = f"flatten(flatten(list_transform(list_filter(string_split({norm_sql('title')}, ' '), lambda x: x <> ''), lambda x: list_transform([3, 4, 5], lambda n: list_transform(range(1, length(x) + 4 - n), lambda i: substr(' ' || x || ' ', i, n))))))"
CHAR_SQL = f"""{CATALOG_SQL}, it AS (SELECT item AS k, gram, count(*) AS tf FROM (SELECT item, unnest({_CHAR_GRAMS}) AS gram FROM catalog) AS x GROUP BY item, gram), idf AS (SELECT gram, ln((1 + (SELECT count(*) FROM catalog)) / (1.0 + count(*))) + 1 AS idf FROM it GROUP BY gram HAVING count(*) >= 2),
    ir AS (SELECT k, gram, (1 + ln(tf)) * idf AS w FROM it JOIN idf USING (gram)), ii AS (SELECT k, gram, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM ir)"""


@query("char_tfidf_topk", "query_id:l item:l score:d rank:l", f"WITH {CHAR_SQL} SELECT query_id, item, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item) AS rank FROM (SELECT a.k AS query_id, b.k AS item, sum(a.w * b.w) AS score FROM ii AS a JOIN ii AS b USING (gram) WHERE a.k % 20 = 0 GROUP BY 1, 2) AS s QUALIFY rank <= 5")
def char_tfidf_topk(t):
    c = catalog(t)
    q = c.where("item % 20 = 0").select(F.col("item").alias("query_id"), F.col("title").alias("query"))
    return R.tfidf_search(q, c, "query_id", "query", "item", "title", 5, grams=R.char_grams)


@query("inverted_index_topk", "item_id:l doc_id:l score:l rank:l", f"""WITH q AS (SELECT item_id, unnest(list_distinct(string_split({norm_sql('text')}, ' '))) AS token FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct(string_split({norm_sql('text')}, ' '))) AS token FROM documents),
    p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY doc_id) AS n FROM d) AS x WHERE n <= 20000) SELECT item_id, doc_id, count(*) AS score, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, doc_id) AS rank FROM q JOIN p USING (token) WHERE token <> '' GROUP BY item_id, doc_id QUALIFY rank <= 5""")
def inverted_index_topk(t):
    tokens = F.array_distinct(T.split_tokens(T.normalize(F.col("text"))))
    return R.token_search(t("benchmark").select("item_id", tokens.alias("q")), t("documents").select("doc_id", tokens.alias("d")), "item_id", "q", "doc_id", "d", 5, posting_cap=20_000)


COSINE = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / (sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_dot_product({1}::DOUBLE[], {1}::DOUBLE[])))"


@query("cosine_knn", "query_id:l vec_id:l score:d rank:l", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, {COSINE.format('a.embedding', 'b.embedding')} AS score FROM embeddings AS a, embeddings AS b WHERE a.vec_id % 20 = 0) AS s) AS r WHERE rank <= 6")
def cosine_knn(t):
    e = t("embeddings")
    return R.dense_top_k(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, 6, "query_id", "vec_id")


@query("pair_cosine", "a:l b:l cosine:d", f"SELECT x.vec_id AS a, y.vec_id AS b, {COSINE.format('x.embedding', 'y.embedding')} AS cosine FROM embeddings AS x JOIN embeddings AS y ON y.vec_id = (x.vec_id * 7 + 3) % (SELECT count(*) FROM embeddings)")
def pair_cosine(t):
    e = t("embeddings")
    pairs = e.select(F.col("vec_id").alias("a"), ((F.col("vec_id") * 7 + 3) % e.count()).alias("b"))
    return R.pair_cosine(pairs, e.withColumnRenamed("vec_id", "a"), e.withColumnRenamed("vec_id", "b"), "a", "b")


@query("hard_decoys", "query_id:l decoy:l similarity:d", f"""WITH k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, n) AS r FROM (SELECT a.vec_id AS query_id, b.vec_id AS n, {COSINE.format('a.embedding', 'b.embedding')} AS s FROM embeddings AS a, embeddings AS b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) AS x) AS y WHERE r <= 4),
    seen AS (SELECT vec_id, (vec_id * 3 + j) % 97 AS item FROM embeddings, (SELECT unnest([0, 1, 2]) AS j) AS js), d AS (SELECT query_id, item AS decoy, max(s) AS similarity FROM k JOIN seen ON seen.vec_id = k.n GROUP BY 1, 2)
    SELECT query_id, decoy, similarity FROM d WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.vec_id = d.query_id AND seen.item = d.decoy) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, decoy) <= 5""")
def hard_decoys(t):
    e = t("embeddings")
    near = R.dense_top_k(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, 5, "query_id", "vec_id").where("query_id <> vec_id")
    near = N.keep(near, N.first_n("query_id", [F.desc("score"), F.asc("vec_id")], 4))
    seen = e.select("vec_id", F.explode(F.array(*[(F.col("vec_id") * 3 + j) % 97 for j in range(3)])).alias("decoy"))
    borrowed = near.join(seen, "vec_id").groupBy("query_id", "decoy").agg(F.max("score").alias("similarity"))
    fresh = J.without(borrowed, seen.withColumnRenamed("vec_id", "query_id"), ["query_id", "decoy"])
    return N.keep(fresh, N.first_n("query_id", [F.desc(F.round("similarity", 9)), F.asc("decoy")], 5))


@query("retrieval_metrics", "recall_10:d recall_25:d recall_50:d mrr:d mean_rank:d coverage:d", f"""WITH {SCORED_SQL}, r AS (SELECT term, item, row_number() OVER (PARTITION BY term ORDER BY u DESC, item) AS rank FROM scored), top AS (SELECT * FROM r WHERE rank <= 60),
    per AS (SELECT s.term, count(*) AS n, count(*) FILTER (WHERE rank <= 10) AS a, count(*) FILTER (WHERE rank <= 25) AS b, count(*) FILTER (WHERE rank <= 50) AS c, min(rank) AS m, sum(rank) AS rs, count(rank) AS f FROM scored AS s LEFT JOIN top USING (term, item) WHERE label = 1 GROUP BY s.term)
    SELECT avg(a::DOUBLE / n) AS recall_10, avg(b::DOUBLE / n) AS recall_25, avg(c::DOUBLE / n) AS recall_50, avg(coalesce(1.0 / m, 0)) AS mrr, sum(rs)::DOUBLE / sum(f) AS mean_rank, avg(CASE WHEN f > 0 THEN 1.0 ELSE 0.0 END) AS coverage FROM per""")
def retrieval_metrics(t):
    s = scored(t)
    return R.retrieval_metrics(W.top_k(s, "term", 60, "u", "item"), s.where("label = 1"), "term", "item")


@query("membership_metrics", "recall:d jaccard:d recall_p10:d", f"""WITH {SCORED_SQL}, p AS (SELECT term, item FROM scored QUALIFY row_number() OVER (PARTITION BY term ORDER BY p DESC, item) <= 20), o AS (SELECT term, item FROM scored WHERE anchor = 1),
    per AS (SELECT coalesce(p.term, o.term) AS term, count(*) FILTER (WHERE p.item IS NOT NULL AND o.item IS NOT NULL) AS s, count(o.item) AS os, count(*) AS n FROM p FULL JOIN o ON p.term = o.term AND p.item = o.item GROUP BY 1)
    SELECT avg(s::DOUBLE / os) AS recall, avg(s::DOUBLE / n) AS jaccard, quantile_cont(s::DOUBLE / os, 0.1) AS recall_p10 FROM per WHERE os > 0""")
def membership_metrics(t):
    s = scored(t)
    return R.membership_metrics(W.top_k(s, "term", 20, "p", "item"), s.where("anchor = 1"), "term", "item", 20)


@query("merged_search", "item_id:l doc_id:l score:d source:s rank:l", f"""WITH {TFIDF_SQL}, a AS (SELECT qq.k AS item_id, ii.k AS doc_id, sum(qq.w * ii.w) AS score FROM qq JOIN ii USING (gram) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY qq.k ORDER BY round(sum(qq.w * ii.w), 9) DESC, ii.k) <= 20),
    q AS (SELECT item_id, unnest(list_distinct(string_split({norm_sql('text')}, ' '))) AS token FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct(string_split({norm_sql('text')}, ' '))) AS token FROM documents),
    b AS (SELECT item_id, doc_id, count(*) / 100.0::DOUBLE AS score FROM q JOIN d USING (token) WHERE token <> '' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, doc_id) <= 20),
    u AS (SELECT item_id, doc_id, max(score) AS score, string_agg(n, '+' ORDER BY i) AS source FROM (SELECT *, 0 AS i, 'word' AS n FROM a UNION ALL SELECT *, 1, 'token' FROM b) AS x GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM u QUALIFY rank <= 10""")
def merged_search(t):
    tokens = F.array_distinct(T.split_tokens(T.normalize(F.col("text"))))
    b, d = t("benchmark"), t("documents")
    a = R.tfidf_search(b, d, "item_id", "text", "doc_id", "text", 20)
    c = R.token_search(b.select("item_id", tokens.alias("q")), d.select("doc_id", tokens.alias("d")), "item_id", "q", "doc_id", "d", 20).withColumn("score", F.col("score") / 100)
    return R.merge_channels({"word": a, "token": c}, "item_id", "doc_id", 10)


@query("fielded_tfidf_pair", "query_id:l item:l tfidf_title:d tfidf_brand:d semantic_score:d", f"""WITH {CATALOG_SQL}, {ORDER_PAIRS_SQL}, pr AS (SELECT query_id, title AS query, o.item FROM order_pairs AS o JOIN catalog AS c ON c.item = query_id),
    """ + ", ".join(f"""{f}w AS (SELECT item AS k, string_split({norm_sql(f)}, ' ') AS w FROM catalog), {f}t AS (SELECT k, gram, count(*) AS tf FROM (SELECT k, unnest({GRAMS}) AS gram FROM {f}w) AS x GROUP BY 1, 2), {f}d AS (SELECT gram, ln((1 + (SELECT count(*) FROM catalog)) / (1.0 + count(*))) + 1 AS idf FROM {f}t GROUP BY gram HAVING count(*) >= 2),
    {f}i AS (SELECT k, gram, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM (SELECT k, gram, (1 + ln(tf)) * idf AS w FROM {f}t JOIN {f}d USING (gram)) AS x), {f}qw AS (SELECT DISTINCT query_id AS k, string_split({norm_sql('query')}, ' ') AS w FROM pr), {f}qt AS (SELECT k, gram, count(*) AS tf FROM (SELECT k, unnest({GRAMS}) AS gram FROM {f}qw) AS x GROUP BY 1, 2),
    {f}q AS (SELECT k, gram, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM (SELECT k, gram, (1 + ln(tf)) * idf AS w FROM {f}qt JOIN {f}d USING (gram)) AS x), {f}s AS (SELECT query_id, item, sum(q.w * i.w) AS s FROM pr JOIN {f}q AS q ON q.k = query_id JOIN {f}i AS i ON i.k = item AND i.gram = q.gram GROUP BY 1, 2)""" for f in ("title", "brand")) + """
    SELECT query_id, item, coalesce(a.s, 0) AS tfidf_title, coalesce(b.s, 0) AS tfidf_brand, (coalesce(a.s, 0) + coalesce(b.s, 0)) / 2 AS semantic_score FROM pr LEFT JOIN titles AS a USING (query_id, item) LEFT JOIN brands AS b USING (query_id, item)""")
def fielded_tfidf_pair(t):
    c = catalog(t)
    q = c.select(F.col("item").alias("query_id"), F.col("title").alias("query"))
    pairs = order_pairs(t)
    return R.fielded_pair_scores(pairs, q, c, "query_id", "query", "item", ["title", "brand"])


@query("pool_augment", "term:l n:l augmented:l", f"WITH {SCORED_SQL} SELECT term, greatest(count(*), 80) AS n, greatest(80 - count(*), 0) AS augmented FROM scored GROUP BY term")
def pool_augment(t):
    filled = R.augment_pool(scored(t).select("term", "item"), t("events").select(F.col("event_id").alias("item")), F.lit(80), "term", "item", "fill")
    return filled.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("augmented").alias("augmented"))


# ---- sampling and mining -----------------------------------------------------------------------------------------


@query("group_sample", "event_id:l user_id:l", f"WITH g AS (SELECT user_id, coalesce(sum(n) OVER (ORDER BY hash, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT user_id, count(*) AS n, {h('gs', 'user_id')} AS hash FROM events GROUP BY user_id) AS x) SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM g WHERE b < 1500)")
def group_sample(t):
    return N.group_sample(t("events"), "user_id", 1500, "gs")


QUOTA_SQL = """target - easy - ambiguous - hard AS medium FROM (SELECT *, CASE WHEN generic = 1 THEN 0 ELSE easy END AS ambiguous, round_even(0.4 * target, 0)::INT + CASE WHEN generic = 1 THEN easy ELSE 0 END AS hard FROM (
    SELECT *, least(4, greatest(1, round_even(0.1 * target, 0)::INT)) AS easy FROM (SELECT *, least(greatest(ceil(2 * positives)::INT, 12), 40) AS target FROM (SELECT term, sum(label) AS positives, CASE WHEN term % 3 = 0 THEN 1 ELSE 0 END AS generic, median(p) FILTER (WHERE label = 1) AS known_score FROM scored GROUP BY term) AS a) AS b) AS c) AS d"""


@query("rank_bucket_negatives", "term:l item:l rank:l bucket:s weight:d", f"""WITH {SCORED_SQL}, q AS (SELECT *, {QUOTA_SQL}), c AS (SELECT term, item, p AS score, row_number() OVER (PARTITION BY term ORDER BY p DESC, item) AS rank FROM scored WHERE label = 0),
    b AS (SELECT *, CASE WHEN rank <= 10 THEN 'ambiguous' WHEN rank <= 75 THEN 'hard' WHEN rank <= 250 THEN 'medium' ELSE 'deep' END AS bucket FROM c JOIN q USING (term)),
    i AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY term, bucket ORDER BY rank) <= CASE bucket WHEN 'ambiguous' THEN ambiguous WHEN 'hard' THEN hard WHEN 'medium' THEN medium ELSE 0 END THEN 1 ELSE 0 END AS chosen FROM b),
    l AS (SELECT *, greatest(target - easy - sum(chosen) OVER (PARTITION BY term), 0) AS lack, CASE WHEN chosen = 0 AND rank >= 11 THEN 1 ELSE 0 END AS spare FROM i), f AS (SELECT *, row_number() OVER (PARTITION BY term, spare ORDER BY rank) AS fr FROM l)
    SELECT term, item, rank, CASE WHEN chosen = 1 THEN bucket ELSE 'fill' END AS bucket, CASE WHEN score >= known_score THEN 0.1 WHEN chosen = 1 AND bucket = 'ambiguous' THEN 0.2 WHEN chosen = 1 AND bucket = 'hard' THEN 0.6 ELSE 0.8 END AS weight FROM f WHERE chosen = 1 OR (spare = 1 AND fr <= lack)""")
def rank_bucket_negatives(t):
    s = scored(t)
    terms = s.groupBy("term").agg(F.sum("label").alias("positives"), F.percentile(F.when(F.col("label") == 1, F.col("p")), 0.5).alias("known_score")).withColumn("generic", (F.col("term") % 3 == 0).cast("int"))
    candidates = s.where("label = 0").select("term", "item", F.col("p").alias("score"), W.ordinal_rank("term", "p", "item").alias("rank"))
    return N.bucket_negatives(candidates, terms, "term", "item")


@query("testlike_groups", "term:l item:l rank:l label:l forced:l tier:s confidence:d", f"""WITH {SCORED_SQL}, c AS (SELECT term, item, p AS score, row_number() OVER (PARTITION BY term ORDER BY p DESC, item) AS rank FROM scored WHERE item % 3 <> 0), k AS (SELECT term, item, 1 AS label FROM scored WHERE label = 1 AND item % 4 = 0),
    j AS (SELECT term, item, coalesce(rank, 0) AS rank, coalesce(label, 0) AS label, (rank IS NULL)::INT AS forced FROM c FULL JOIN k USING (term, item)), r AS (SELECT *, 30 - sum(label) OVER (PARTITION BY term) AS room, row_number() OVER (PARTITION BY term, label ORDER BY rank, item) AS n FROM j)
    SELECT *, CASE WHEN label = 1 THEN 'positive' WHEN rank <= 10 THEN 'ambiguous' WHEN rank <= 50 THEN 'hard' ELSE 'medium' END AS tier, CASE WHEN label = 1 THEN 1.0 WHEN rank <= 10 THEN 0.15 WHEN rank <= 50 THEN 0.5 ELSE 0.85 END AS confidence FROM r WHERE label = 1 OR n <= room""")
def testlike_groups(t):
    s = scored(t)
    candidates = s.where("item % 3 <> 0").select("term", "item", F.col("p").alias("score"), W.ordinal_rank("term", "p", "item").alias("rank"))
    return N.test_like_groups(candidates, s.where("label = 1 and item % 4 = 0"), "term", "item", 30)


@query("typed_negatives", "term:l item:l source_item:l negative_type:s weight:d")
def typed_negatives(t):
    c = catalog(t).select("item", "brand", "p_type", "p_size")
    pairs = t("lineitem").select(F.col("l_orderkey").alias("term"), F.col("l_partkey").alias("item")).distinct()
    pools = [("easy_random", [], None), ("different_top_category", [], F.col("a_p_type") != F.col("b_p_type")), ("same_top_category_hard", ["p_type"], None), ("brand_hard", ["brand"], F.col("a_p_type") != F.col("b_p_type")), ("attribute_mismatch", ["p_type"], F.col("a_p_size") != F.col("b_p_size"))]
    drawn = N.dedup_by_type(N.pool_negatives(pairs, c, pools, pairs, "term", "item", "typed"), "term", "item")
    return N.downsample_by_type(drawn, 1500, ["term", "item"], "down").withColumn("weight", N.type_weight(F.col("negative_type")))


@query("negative_downsample", "event_type:s kept:l weight:d", f"""WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type), q AS (SELECT event_type, round_even(3000 * n / (SELECT sum(n) FROM n)::DOUBLE, 0) AS quota, n FROM n) SELECT event_type, least(n, quota) AS kept, 0.6 AS weight FROM q""")
def negative_downsample(t):
    rows = N.downsample_by_type(t("events").withColumnRenamed("event_type", "negative_type"), 3000, ["event_id"], "ds")
    return rows.groupBy(F.col("negative_type").alias("event_type")).agg(F.count(F.lit(1)).alias("kept")).withColumn("weight", N.type_weight(F.col("event_type")))


@query("curriculum_negatives", "term:l item:l negative_type:s", f"""WITH {SCORED_SQL}, s AS (SELECT * FROM (VALUES ('random', 0), ('same_parent_different_leaf', 1), ('complementary_product', 2)) AS v(negative_type, kind)), c AS (SELECT term, item, ['random', 'same_parent_different_leaf', 'complementary_product', 'accessory_main_product'][item % 4 + 1] AS negative_type FROM scored WHERE label = 0),
    p AS (SELECT term, 2 * sum(label)::INT AS target FROM scored GROUP BY term), r AS (SELECT term, item, negative_type, kind, target, {h('cur', 'term', 'negative_type', 'item')} AS hash FROM c JOIN s USING (negative_type) JOIN p USING (term)),
    a AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY term, negative_type ORDER BY hash, item) <= greatest(1, ceil(target / 3.0))) SELECT term, item, negative_type FROM a QUALIFY row_number() OVER (PARTITION BY term ORDER BY kind, hash, item) <= target""")
def curriculum_negatives(t):
    s = scored(t)
    kinds = F.array(*[F.lit(x) for x in ("random", "same_parent_different_leaf", "complementary_product", "accessory_main_product")])
    candidates = s.where("label = 0").select("term", "item", F.element_at(kinds, (F.col("item") % 4 + 1).cast("int")).alias("negative_type"))
    return N.curriculum(candidates, s.groupBy("term").agg(F.sum("label").alias("positives")), "term", "item", 0, 2, "cur")


TRIAGE_SQL = f"""t AS (SELECT item, label AS is_known, (item % 17 = 0)::INT AS same_family, (item % 19 = 0)::INT AS purged_item, (item % 23 = 0)::INT AS purged_family, u AS ce_prob, v AS teacher_prob, (u + v) / 2 AS embedding, anchor AS contradiction, item % 3 AS votes, v AS hardness FROM scored)"""


def _triage_frame(t: Tables) -> DataFrame:
    i, c = F.col("item"), F.col
    every = lambda n: (i % n == 0).cast("int")
    return scored(t).select("item", c("label").alias("is_known"), every(17).alias("same_family"), every(19).alias("purged_item"), every(23).alias("purged_family"), c("u").alias("ce_prob"), c("v").alias("teacher_prob"), ((c("u") + c("v")) / 2).alias("embedding"), c("anchor").alias("contradiction"), (i % 3).alias("votes"), c("v").alias("hardness"))


@query("false_negative_triage", "item:l signals:l reason:s status:s weight:d", f"""WITH {SCORED_SQL}, {TRIAGE_SQL}, s AS (SELECT *, (ce_prob >= 0.9)::INT + (teacher_prob >= 0.9)::INT + (embedding >= 0.93)::INT AS signals FROM t),
    r AS (SELECT *, CASE WHEN is_known = 1 THEN 'known_positive' WHEN same_family = 1 THEN 'same_family' WHEN purged_item = 1 THEN 'purged_item' WHEN purged_family = 1 THEN 'purged_family' WHEN signals >= 2 OR votes >= 2 THEN 'multi_model' WHEN embedding >= 0.93 AND contradiction = 0 THEN 'high_embedding' ELSE 'none' END AS reason FROM s),
    w AS (SELECT *, CASE WHEN reason IN ('known_positive', 'same_family', 'purged_item', 'purged_family') THEN 'excluded' WHEN reason <> 'none' THEN 'suspicious' ELSE 'train' END AS status, CASE WHEN hardness >= 0.75 THEN 0.75 WHEN hardness >= 0.45 THEN 0.9 ELSE 1.0 END AS base FROM r)
    SELECT *, CASE WHEN status = 'excluded' THEN 0 WHEN status = 'suspicious' THEN 0.05 WHEN ce_prob BETWEEN 0.35 AND 0.65 THEN least(base, 0.2) ELSE base END AS weight FROM w""")
def false_negative_triage(t):
    return N.triage_false_negatives(_triage_frame(t))


@query("pu_triage", "item:l exclude_reason:s weight:d", f"""WITH {SCORED_SQL}, r AS (SELECT item, label, u, (item % 29 = 0)::INT AS suspicious, row_number() OVER (PARTITION BY term ORDER BY p DESC, item) AS rank FROM scored),
    e AS (SELECT *, CASE WHEN suspicious = 1 THEN 'suspicious' WHEN label = 0 AND rank <= 3 THEN 'top_rank' WHEN label = 0 AND u > 0.9 THEN 'high_score' ELSE 'none' END AS exclude_reason FROM r) SELECT item, exclude_reason, CASE WHEN exclude_reason <> 'none' THEN 0 WHEN label = 0 AND u BETWEEN 0.5 AND 0.9 THEN 0.5 ELSE 1.0 END AS weight FROM e""")
def pu_triage(t):
    return N.pu_triage(scored(t).withColumns({"rank": W.ordinal_rank("term", "p", "item"), "ce_prob": F.col("u"), "is_suspicious": (F.col("item") % 29 == 0).cast("int")}))


@query("negative_cap", "term:l item:l label:l", f"WITH {SCORED_SQL}, r AS (SELECT term, item, label, sum(label) OVER (PARTITION BY term) AS pos, row_number() OVER (PARTITION BY term, label ORDER BY {h('cap', 'term', 'item')}, item) AS n FROM scored) SELECT term, item, label FROM r WHERE label = 1 OR n <= 1 * pos")
def negative_cap(t):
    return N.cap_negatives(scored(t), "term", "item", 1, "cap")


@query("model_hard_negatives", "term:l item:l weight:d", f"WITH {SCORED_SQL} SELECT term, item, least(greatest(0.35 - 0.2 * p, 0.15), 0.35) AS weight FROM scored WHERE label = 0 QUALIFY row_number() OVER (PARTITION BY term ORDER BY p DESC, item) <= 6")
def model_hard_negatives(t):
    s = scored(t)
    return N.model_hard(J.without(s, s.where("label = 1"), ["term", "item"]), "term", "item", "p")


@query("transductive_pairs", "term:l item:l label:l origin:s", f"WITH {SCORED_SQL} SELECT term, item, 1 AS label, 'structural' AS origin FROM scored WHERE anchor = 1 AND label = 1 UNION ALL SELECT term, item, 0, 'two_model' FROM (SELECT * FROM scored WHERE NOT (anchor = 1 AND label = 1) AND p < 0.5 AND q < 0.5 QUALIFY row_number() OVER (PARTITION BY term ORDER BY p + q, item) <= 10) AS x")
def transductive_pairs(t):
    s = scored(t).withColumns({"structural": ((F.col("anchor") == 1) & (F.col("label") == 1)).cast("int"), "p1": F.col("p"), "p2": F.col("q")})
    return N.transductive(s, "term", "item", 10)


@query("fixed_universe_oracle", "term:l item:l forced:l label:l", f"""WITH {SCORED_SQL}, t AS (SELECT term, item, row_number() OVER (PARTITION BY term ORDER BY u DESC, item) AS rank FROM scored QUALIFY rank <= 25), k AS (SELECT term, item FROM scored WHERE label = 1 AND anchor = 1), m AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.term = k.term AND t.item = k.item)),
    j AS (SELECT t.*, k.item IS NOT NULL AS known, count(*) OVER (PARTITION BY t.term) - coalesce((SELECT count(*) FROM m WHERE m.term = t.term), 0) AS room FROM t LEFT JOIN k ON k.term = t.term AND k.item = t.item), o AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY known DESC, rank, item) AS n FROM j)
    SELECT term, item, 0 AS forced, known::INT AS label FROM o WHERE n <= greatest(room, 0) UNION ALL SELECT term, item, 1, 1 FROM m""")
def fixed_universe_oracle(t):
    s = scored(t)
    return N.fixed_universe(s.withColumn("rank", W.ordinal_rank("term", "u", "item")), s.where("label = 1 and anchor = 1"), "term", "item", 25, oracle=True)


@query("teacher_selection", "item:l priority:l reason:s", f"""WITH {SCORED_SQL}, p AS (SELECT item, CASE WHEN label = 1 AND anchor = 1 THEN 0 WHEN v >= 0.9 THEN 1 WHEN p BETWEEN 0.35 AND 0.65 THEN 2 WHEN abs(p - q) >= 0.2 THEN 3 WHEN item % 5 = 0 THEN 4 END AS priority FROM scored)
    SELECT item, priority, ['positive', 'hard', 'uncertain', 'disagreement', 'test_like'][priority + 1] AS reason FROM p WHERE priority IS NOT NULL ORDER BY priority, {h('teach', 'item')}, item LIMIT 3000""")
def teacher_selection(t):
    c = F.col
    rows = scored(t).select("item", (c("label") * c("anchor")).alias("label"), F.when(c("v") >= 0.9, 1.0).otherwise(0.0).alias("hardness"), c("p").alias("prob"), F.abs(c("p") - c("q")).alias("disagreement"), (c("item") % 5 == 0).cast("int").alias("test_like"))
    return N.teacher_pairs(rows, "item", 3000, "teach")


@query("uniform_batches", "term:l item:l label:l place:l batch:l", f"""WITH {SCORED_SQL}, r AS (SELECT term, item, label, CASE WHEN label = 1 THEN (row_number() OVER (PARTITION BY term, label ORDER BY item) - 1 + 6) % count(*) OVER (PARTITION BY term, label) ELSE row_number() OVER (PARTITION BY term, label ORDER BY v DESC, item) - 1 END AS place FROM scored),
    b AS (SELECT term, (row_number() OVER (ORDER BY {h('batch', 'term')}, term) - 1) // 8 AS batch FROM (SELECT DISTINCT term FROM scored) AS d) SELECT term, item, label, place, batch FROM r JOIN b USING (term) WHERE place < CASE WHEN label = 1 THEN 2 ELSE 5 END""")
def uniform_batches(t):
    return N.uniform_batches(scored(t), "term", "item", "v", 3, 2, 5, 8, "batch")


@query("pseudo_label_feed", "item:l label:l mean_score:d", f"WITH {SCORED_SQL} SELECT item, (m >= 0.85)::INT AS label, m AS mean_score FROM (SELECT item, fold, round((p + q) / 2, 6) AS m FROM scored) AS x WHERE (m >= 0.85 OR m <= 0.1) AND fold <> 0 ORDER BY {h('feed', 'item')}, item LIMIT 800")
def pseudo_label_feed(t):
    m = scored(t).select("item", "fold", F.round((F.col("p") + F.col("q")) / 2, 6).alias("mean_score")).where("mean_score >= 0.85 or mean_score <= 0.1")
    fresh = J.without(m, m.where("fold = 0"), ["item"])
    return N.hash_sample(fresh, "item", 800, "feed").withColumn("label", (F.col("mean_score") >= 0.85).cast("int"))


@query("membership_dataset", "term:l item:l label:l fold:l", f"""WITH {SCORED_SQL}, g AS (SELECT term FROM scored GROUP BY term HAVING count(*) BETWEEN 60 AND 70), p AS (SELECT term, item FROM scored WHERE term IN (SELECT term FROM g) QUALIFY row_number() OVER (PARTITION BY term ORDER BY p DESC, item) <= 20), n AS (SELECT term + 1 AS term, item FROM p)
    SELECT term, item, label, {h('mem', 'term')} % 5 AS fold FROM (SELECT term, item, 1 AS label FROM p UNION ALL SELECT n.term, n.item, 0 FROM n JOIN g USING (term) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.term = n.term AND p.item = n.item)) AS x""")
def membership_dataset(t):
    s = scored(t)
    g = s.groupBy("term").count().where("count between 60 and 70").select("term")
    positives = W.top_k(s.join(g, "term", "left_semi"), "term", 20, "p", "item").select("term", "item")
    borrowed = J.without(positives.select((F.col("term") + 1).alias("term"), "item").join(g, "term", "left_semi"), positives, ["term", "item"])
    return V.hash_folds(positives.withColumn("label", F.lit(1)).unionByName(borrowed.withColumn("label", F.lit(0))), "term", 5, "mem")


# ---- splits ------------------------------------------------------------------------------------------------------


@query("group_holdout", "term:l positives:l split:s", f"""WITH {SCORED_SQL}, g AS (SELECT term, sum(label) AS positives, row_number() OVER (ORDER BY {h('hold', 'term')}, term) AS n FROM scored GROUP BY term) SELECT term, positives, CASE WHEN n <= greatest(1, floor((SELECT count(*) FROM g) * 0.2)) THEN 'valid' ELSE 'train' END AS split FROM g""")
def group_holdout(t):
    return V.group_holdout(scored(t).groupBy("term").agg(F.sum("label").alias("positives")), "term", 0.2, "hold")


@query("fold_overlap_audit", "fold:l items:l shared:l shared_rate:d", f"""WITH f AS (SELECT DISTINCT l_partkey AS item, {h('ov', 'l_orderkey')} % 4 AS fold FROM lineitem), s AS (SELECT *, count(*) OVER (PARTITION BY item) AS n FROM f) SELECT fold, count(*) AS items, count(*) FILTER (WHERE n > 1) AS shared, count(*) FILTER (WHERE n > 1)::DOUBLE / count(*) AS shared_rate FROM s GROUP BY fold""")
def fold_overlap_audit(t):
    return V.overlap_audit(V.hash_folds(t("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("item")), "o", 4, "ov"), "item")


@query("fold_scope_purge", "policy:s pairs:l leaks:l", f"""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 50 AS family, {h('sc', 'l_orderkey')} % 3 AS fold FROM lineitem), a AS (SELECT * FROM f WHERE fold <> 0), hd AS (SELECT * FROM f WHERE fold = 0)
    SELECT 'audit' AS policy, count(*) AS pairs, count(*) FILTER (WHERE l_partkey IN (SELECT l_partkey FROM hd)) AS leaks FROM a UNION ALL SELECT 'purge_item', count(*) FILTER (WHERE l_partkey NOT IN (SELECT l_partkey FROM hd)), 0 FROM a UNION ALL SELECT 'purge_family', count(*) FILTER (WHERE family NOT IN (SELECT family FROM hd)), 0 FROM a""")
def fold_scope_purge(t):
    f = V.hash_folds(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 50).alias("family")), "l_orderkey", 3, "sc")
    count = lambda p: V.fold_scope(f, 0, "l_partkey", "family", p).agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum("leaks"), F.lit(0)).alias("leaks")).withColumn("policy", F.lit(p))
    return count("audit").unionByName(count("purge_item")).unionByName(count("purge_family"))


@query("test_like_manifest", "term:l domain:d positives:l fold:l", f"""WITH {SCORED_SQL}, g AS (SELECT term, round(avg(v), 9) AS domain, sum(label) AS positives FROM scored GROUP BY term), b AS (SELECT *, coalesce(sum(positives) OVER (ORDER BY domain DESC, positives DESC, term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g) SELECT term, domain, positives, CASE WHEN before < 0.15 * (SELECT sum(positives) FROM g) THEN 0 ELSE -1 END AS fold FROM b""")
def test_like_manifest(t):
    g = scored(t).groupBy("term").agg(F.round(F.avg("v"), 9).alias("domain_score"), F.sum("label").alias("label"))
    return V.test_like(g, "term", 0.15)


@query("balanced_folds", "term:l load:l fold:l", f"""WITH RECURSIVE {SCORED_SQL}, g AS (SELECT term, sum(label) AS load, row_number() OVER (ORDER BY sum(label) DESC, {h("bal", "term")}, term) AS n FROM scored GROUP BY term),
    s AS (SELECT 0::BIGINT AS n, [0, 0, 0, 0, 0]::BIGINT[] AS totals, 0 AS fold, 0::BIGINT AS term, 0::BIGINT AS load UNION ALL
    SELECT n, list_transform(totals, lambda x, i: CASE WHEN i = fold + 1 THEN x + load ELSE x END), fold, term, load FROM (SELECT g.n, totals, list_position(totals, list_min(totals)) - 1 AS fold, g.term, CAST(g.load AS BIGINT) AS load FROM s JOIN g ON g.n = s.n + 1) AS x)
    SELECT term, load, fold FROM s WHERE n > 0""")
def balanced_folds(t):
    return V.balanced_folds(scored(t), "term", "label", 5, "bal")


@query("semantic_clusters", "vec_id:l cluster:l fold:l")
def semantic_clusters(t):
    return V.cluster_folds(t("embeddings"), "vec_id", "embedding", 10, 3)


@query("candidate_profile", "sizes:s", "SELECT string_agg(n || 'x' || c, ',' ORDER BY n) AS sizes FROM (SELECT n, count(*) AS c FROM (SELECT count(*) AS n FROM events GROUP BY user_id) AS x GROUP BY n) AS y")
def candidate_profile(t):
    return V.size_profile(t("events"), "user_id").select(F.array_join(F.transform("profile", lambda s: F.concat(s["n"], F.lit("x"), s["times"])), ",").alias("sizes"))
