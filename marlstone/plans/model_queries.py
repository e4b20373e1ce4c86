"""Fitted models, functions of one's own, artifacts, and event-time windows as queries."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import functions as F

from ..functions.hashing import keyed_hash
from ..operators import models as L
from ..operators import rankers as K
from ..operators import retrieval as R
from ..operators import sparse_svd as V
from ..operators import user_functions as U
from ..sources import artifacts as A
from ..sources.workspace import stored
from .frames import SCORED_SQL, scored
from .registry import h, query


@query("svd_embeddings", "vec_id:l size:l norm:d")
def svd_embeddings(t):
    r = L.truncated_svd(t("embeddings").select("vec_id", "embedding"), "embedding", 16)
    return r.select("vec_id", F.size("reduced").alias("size"), F.sqrt(F.aggregate("reduced", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))


@query("sparse_svd", "doc_id:l size:l norm:d")
def sparse_svd(t):
    """64 components of the documents' word TF-IDF over the 20,000 most frequent grams."""
    rows, width = V.frequent_rows(t("documents"), "doc_id", "text", R.word_grams, 20_000)
    rows = stored(rows, "sparse-rows")
    r = V.project(rows, V.sparse_svd(rows, width, 64, steps=6))
    return r.select("doc_id", F.size("reduced").alias("size"), F.sqrt(F.aggregate("reduced", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))


@query("group_size_features", "term:l n_candidates:l k:l score_mean:d score_max:d score_std:d query_chars:l query_tokens:l", f"""WITH {SCORED_SQL} SELECT term, count(*) AS n_candidates, sum(label) AS k, avg(p) AS score_mean, max(p) AS score_max, coalesce(stddev_samp(p), 0) AS score_std,
    length(min(event_type || ' ' || term)) AS query_chars, 2 AS query_tokens FROM scored GROUP BY term""")
def group_size_features(t):
    return L.group_size_features(scored(t), "term", "label", "p", F.concat_ws(" ", "event_type", "term"))


@query("size_regressor", "val_groups:l val_mae:d median_mae:d train_k_median:d train_k_mean:d")
def size_regressor(t):
    return L.size_report(L.size_regressor(group_size_features(t), "term"))


@query("pairwise_ranker", "item:l rank_score:d")
def pairwise_ranker(t):
    s = scored(t)
    names = ["u", "v", "value", "p"]
    return L.rank_scores(s, names, L.pairwise_ranker(s, "term", "label", "item", names))


@query("adversarial_validation", "fold:l auc:d")
def adversarial_validation(t):
    texts = t("part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"), (F.col("p_size") > 25).cast("int").alias("label"))
    return L.adversarial_validation(texts, "p_partkey", "text", "label")[1]


def _sums(state: bytes | None, values) -> bytes:
    n, s, q = struct.unpack("<qdd", state) if state else (0, 0.0, 0.0)
    x = np.asarray(values.drop_null(), np.float64)
    return struct.pack("<qdd", n + len(x), s + x.sum(), q + (x * x).sum())


def _merge_sums(states: list[bytes]) -> bytes:
    n, s, q = zip(*(struct.unpack("<qdd", x) for x in sorted(states)), strict=True)
    return struct.pack("<qdd", sum(n), sum(s), sum(q))


def _root_mean_square(state: bytes) -> float | None:
    n, _, q = struct.unpack("<qdd", state)
    return (q / n) ** 0.5 if n else None


@query("user_aggregate", "event_type:s result:d", "SELECT event_type, sqrt(sum(value * value) / count(value)) AS result FROM events GROUP BY event_type")
def user_aggregate(t):
    return U.aggregate(t("events"), "event_type", "value", _sums, _merge_sums, _root_mean_square)


@query("text_windows", "doc_id:l start:l n_chars:l", """WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM documents), s AS (SELECT doc_id, words, unnest(range(0, len(words), 80)) AS start FROM w)
    SELECT doc_id, start, length(array_to_string(words[start + 1 : start + 100], ' ')) AS n_chars FROM s""")
def text_windows(t):
    return U.text_windows(t("documents").select("doc_id", "text"), "text", 100, 80).select("doc_id", "start", F.length("window").alias("n_chars"))


@query("tree_ranker", "item:l rank_score:d")
def tree_ranker(t):
    s = scored(t)
    names = ["u", "v", "value", "p"]
    return K.tree_ranker(s, "term", "label", names, rounds=6).score(s).select("item", "rank_score")


@query("ranker_search", "depth:l rate:d rounds:l ndcg:d")
def ranker_search(t):
    """Three settings by successive halving, one fold of terms held out."""
    tried = [K.Settings(depth=2), K.Settings(depth=4), K.Settings(depth=3, rate=0.1)]
    _, trials = K.successive_halving(scored(t), "term", "label", "item", ["u", "v", "value"], tried, "fold", 0, rounds=2)
    return t.spark.createDataFrame([(x.settings.depth, x.settings.rate, x.rounds, float(x.ndcg)) for x in trials], "depth long, rate double, rounds long, ndcg double")


@query("state_audit", "name:s status:s rows:l same_keys:l is_binary:l positives:l rate:d pair_rows:l terms:l exact_terms:l over_terms:l", f"""WITH {SCORED_SQL}, g AS (SELECT count(*) AS n FROM scored GROUP BY term), b AS (SELECT sum(n) AS pair_rows, count(*) AS terms, count(*) FILTER (WHERE n = 100) AS exact_terms, count(*) FILTER (WHERE n > 100) AS over_terms FROM g),
    c AS (SELECT 'anchor' AS name, count(*) AS rows, 1 AS same_keys, 1 AS is_binary, sum(anchor) AS positives, avg(anchor) AS rate FROM scored
    UNION ALL SELECT 'votes', count(*), (count(*) = (SELECT count(*) FROM scored))::INT, (count(*) FILTER (WHERE vote > 1) = 0)::INT, sum(vote), avg(vote) FROM (SELECT {h("vote", "item")} % 3 AS vote FROM scored WHERE label = 0) AS x)
    SELECT name, 'available' AS status, rows, same_keys, is_binary, positives, rate, b.* FROM c, b UNION ALL SELECT 'second', 'missing', NULL, NULL, NULL, NULL, NULL, b.* FROM b""")
def state_audit(t):
    s = scored(t)
    votes = s.where("label = 0").select("item", (keyed_hash("vote", F.col("item")) % 3).alias("prediction"))
    return A.state_audit(s.select("term", "item"), {"anchor": s.select("item", F.col("anchor").alias("prediction")), "votes": votes, "second": None})


@query("label_score_summary", "label:l n:l mean:d deviation:d", f"WITH {SCORED_SQL} SELECT label, count(*) AS n, avg(q) AS mean, stddev_samp(q) AS deviation FROM scored GROUP BY label")
def label_score_summary(t):
    return scored(t).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("q").alias("mean"), F.stddev_samp("q").alias("deviation"))


@query("events_sliding", "window_start:s event_type:s n:l total:d", """SELECT strftime(time_bucket(INTERVAL 1 day, ts) - to_days(back), '%Y-%m-%d') AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events, (VALUES (0), (1)) AS v(back) GROUP BY 1, 2""")
def events_sliding(t):
    from ..streaming.windows import tumbling

    return tumbling(t("events"), "2 days", "1 day").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query("events_sessions", "user_id:l session_start:s session_end:s n:l total:d", """WITH e AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 hour THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS run FROM e)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 6 hour, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n, sum(value) AS total FROM s GROUP BY user_id, run""")
def events_sessions(t):
    from ..streaming.windows import sessions

    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return sessions(t("events"), "6 hours").withColumns({"session_start": day("session_start"), "session_end": day("session_end")})
