"""The training-data queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import ADDRESS, conversation_digests, format_turns
from .conversation_repair import damaged, repair_digests
from .decontaminate import find_leaks
from .drake_kmeans import cluster_report, integer_vectors
from .ngram_join import ngram_components, ngram_links
from .packing import pack
from .personal_data import personal_digest
from .quality_rules import quality_rules
from .secret_scan import secret_scan
from .substring_dedup import substring_dedup
from .suffix_tree_lm import suffix_tree_scores
from .token_tables import read_shards, write_shards
from .url_filter import url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> tuple[str, str, str]:
    """The byte-level tokenizer's file, the same vocabulary as ranks, and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def word_bpe() -> tuple[str]:
    import public_tokenizers

    return (public_tokenizers.path("word_bpe_49k.json"),)


def op1_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"))


def ngram_links_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_links(_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoy = r"\### Assistant: </turn> ok"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(decoy).alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_digests(format_turns(rows.unionByName(planted))).withColumnRenamed("tokens", "attachment_tokens")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), byte_bpe())


def op9_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(spark, write_shards(_table(spark, sf_dir, "documents"), word_bpe()))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_table(spark, sf_dir, "documents"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_digest(_table(spark, sf_dir, "documents"))


def op12_drake_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(integer_vectors(_table(spark, sf_dir, "embeddings")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(damaged(_table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_suffix_tree_lm, op2_decontaminate, op3_ngram_join, op4_url_filter, op5_chat_format, op6_quality_rules, op7_substring_dedup, op8_best_fit_packing, op9_token_tables, op10_secret_scan, op11_personal_data, op12_drake_kmeans, op13_conversation_repair)} | {"ngram_links": ngram_links_query}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_ADDRESS = ADDRESS.replace("'", "''")
_ROLE = "replace(replace(replace(replace(role, '\\', '\\\\'), '<', '\\l'), '>', '\\g'), chr(10), '\\n')"


def _edit(s: str, cost: str, edit: str, row: str, when: str = "true") -> str:
    return f"CASE WHEN {s} IS NOT NULL AND {when} THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}', 'r': {s}.r || {row}}} END"


def _least(*found: str) -> str:
    return f"list_min([{', '.join(found)}])"


# The repair lattice as dynamic programming: s0 to s3 are the cheapest (cost, audit, rows) in each grammar state; a row's edits, then inserts.
_OK, _EXTRA = "f NOT IN ('b', 'd')", "CASE f WHEN 't' THEN 3 ELSE 0 END"
_KEPT, _USER, _ASSISTANT = "chr(10) || role || ':' || text", "chr(10) || 'user:' || text", "chr(10) || 'assistant:' || text"
_FIRST = "{'c': 0::BIGINT, 'a': '', 'r': ''} AS n0, " + ", ".join(f"NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR) AS n{i}" for i in (1, 2, 3))
_STEP = ", ".join(
    _least(_edit(f"s{to}", "4", "D", "''"), *[_edit(f"s{q}", f"3 + {_EXTRA}", "R", row, _OK) for q in by if to > 1], *[_edit(f"s{q}", _EXTRA, "K", _KEPT, f"{_OK} AND i = '{i}'") for q in by]) + f" AS n{to}"
    for to, by, i, row in ((0, (), "", ""), (1, (0,), "s", ""), (2, (0, 1, 3), "u", _USER), (3, (2,), "a", _ASSISTANT))
)
_TWO = _least("n2", *[_edit(f"n{q}", "3", "I", "chr(10) || 'user:'") for q in (0, 1, 3)])
_NEXT = f"n0 AS s0, n1 AS s1, {_TWO} AS s2, {_least('n3', _edit(f'({_TWO})', '3', 'I', "chr(10) || 'assistant:'"))} AS s3"


def _kmeans_sql() -> str:
    """Plain k-means over integers: five rounds and a last assignment, all distances computed."""
    kept = """v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < 524288)) = 64),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS k, x FROM v QUALIFY k < 40)"""
    assign = "a{0} AS MATERIALIZED (SELECT id, min({{'d': CAST(list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x) AS BIGINT), 'k': c.k}}) AS n FROM v, c{0} AS c GROUP BY id)"
    means = """m{0} AS (SELECT k, list(s ORDER BY i) AS x FROM (SELECT n.k AS k, i, floor(sum(v.x[i]) / count(*)) AS s FROM a{0} JOIN v USING (id), range(1, 65) AS r(i) GROUP BY 1, 2) GROUP BY k),
        c{1} AS MATERIALIZED (SELECT k, coalesce(m.x, c.x) AS x FROM c{0} AS c LEFT JOIN m{0} AS m USING (k))"""
    steps = [s for i in range(5) for s in (assign.format(i), means.format(i, i + 1))]
    return f"""WITH {", ".join([kept, *steps, assign.format(5)])},
        t AS (SELECT n.k AS k, sum(n.d) AS s FROM a5 GROUP BY 1)
        SELECT vec_id, CAST(n.k AS INTEGER) AS cluster, n.d AS distance, CAST(t.s AS BIGINT) AS cluster_inertia, CAST((SELECT sum(s) FROM t) AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
        FROM a5 JOIN v USING (id) JOIN t ON t.k = n.k JOIN c5 AS c ON c.k = n.k"""


ORACLE: dict[str, str] = {
    "op12_drake_kmeans": _kmeans_sql(),
    "op3_ngram_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT u, v FROM c JOIN n AS x ON x.doc_id = u JOIN n AS y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
        b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
        r AS (SELECT doc_id, doc_id AS o FROM documents UNION SELECT r.doc_id, b.v FROM r JOIN b ON r.o = b.u)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(o) FROM r WHERE r.doc_id = d.doc_id) AS component_id FROM documents AS d LEFT JOIN n USING (doc_id)""",
    "op5_chat_format": f"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
        a AS (SELECT *, regexp_extract_all(text, '{_ADDRESS}') AS urls, regexp_replace(text, '{_ADDRESS}', '', 'g') AS plain FROM c),
        k AS (SELECT *, list_transform(urls, lambda u: CASE WHEN regexp_extract(lower(u), '[.]([^.]*)$', 1) IN ('png', 'jpg', 'jpeg', 'gif', 'webp') THEN 'image' WHEN regexp_extract(lower(u), '[.]([^.]*)$', 1) IN ('mp3', 'wav', 'ogg', 'flac') THEN 'audio' ELSE 'document' END) AS kinds FROM a),
        p AS (SELECT *, coalesce(list_sum(list_transform(kinds, lambda x, i: length(x) + length(CAST(turn AS VARCHAR)) + length(CAST(i AS VARCHAR)) + 4)), 0) AS placed, coalesce(list_sum(list_transform(kinds, lambda x: CASE x WHEN 'image' THEN 255 WHEN 'audio' THEN 25 ELSE 1024 END)), 0) AS cost FROM k)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(length({_ROLE}) + length(replace(replace(plain, '\\', '\\\\'), '<', '\\l')) + placed + 17) AS BIGINT) AS formatted_chars,
        CAST(sum(len(urls)) AS BIGINT) AS n_attachments, CAST(sum(cost) AS BIGINT) AS attachment_tokens FROM p GROUP BY conv_id""",
    "op7_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
        k AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM w WHERE len(ws) >= 50), h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS g FROM k),
        m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM h), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM m WHERE first < doc_id),
        lost AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, coalesce(len(js), 0) AS n_removed, sha256(array_to_string(CASE WHEN js IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(js, i)) END, ' ')) AS kept_sha256 FROM w LEFT JOIN lost USING (doc_id)""",
    "op13_conversation_repair": f"""WITH RECURSIVE c0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
        c1 AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(k, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) % 20 AS d FROM c0),
        c2 AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c1 WHERE d <> 0),
        c3 AS (SELECT *, substr(role, 1, 1) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS z, row_number() OVER w AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM c2 WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
        c4 AS MATERIALIZED (SELECT *, CASE WHEN z = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN z NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f, lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS pair FROM c3),
        counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM c4 GROUP BY conv_id),
        steps AS (SELECT conv_id, 0::BIGINT AS n, {_NEXT} FROM (SELECT DISTINCT conv_id, {_FIRST} FROM conversations)
            UNION ALL SELECT conv_id, n, {_NEXT} FROM (SELECT s.conv_id, c4.n, {_STEP} FROM steps AS s JOIN c4 ON c4.conv_id = s.conv_id AND c4.n = s.n + 1)),
        best AS (SELECT conv_id, x.c, x.a, substr(x.r, 2) AS r FROM (SELECT s.conv_id, list_min([s0, s3]) AS x FROM steps AS s LEFT JOIN counts USING (conv_id) WHERE s.n = coalesce(rows, 0)))
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.r, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counts USING (conv_id) LEFT JOIN best USING (conv_id)""",
}
