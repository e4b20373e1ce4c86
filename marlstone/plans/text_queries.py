"""Text, entity, category, attribute and prompt queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions import hashing as H
from ..functions import intent as I
from ..functions import math as M
from ..functions import text as T
from .frames import CATALOG_SQL, ORDER_PAIRS_SQL, SCORED_SQL, catalog, norm_sql, order_pairs, scored, tokens_sql
from .registry import Tables, h, query


PAIR_SQL = f"""{CATALOG_SQL}, {ORDER_PAIRS_SQL},
    pairs AS (SELECT o.query_id, q.title AS query, c.*, {tokens_sql('q.title')} AS qt, {tokens_sql('c.title')} AS tt, {tokens_sql('c.category')} AS ct, {norm_sql('q.title')} AS qn, {norm_sql('c.title')} AS tn, {norm_sql('c.brand')} AS bn FROM order_pairs AS o JOIN catalog AS q ON q.item = o.query_id JOIN catalog AS c ON c.item = o.item)"""
RECALL = "coalesce(len(list_intersect(qt, tt))::DOUBLE / nullif(len(qt), 0), 0)"
JACCARD = "coalesce(len(list_intersect(qt, tt))::DOUBLE / nullif(len(list_distinct(list_concat(qt, tt))), 0), 0)"


def _pair_frame(t: Tables) -> DataFrame:
    """The order pairs with their texts; text columns are made once a part, before pairs are joined."""
    q, c = catalog(t).select(F.col("item").alias("query_id"), F.col("title").alias("query")), catalog(t)
    q = q.withColumns({"qn": T.normalize(F.col("query")), "qt": T.token_set(F.col("query"))})
    c = c.withColumns({"tn": T.normalize(F.col("title")), "tt": T.token_set(F.col("title")), "ct": T.token_set(F.col("category")), "bn": T.normalize(F.col("brand"))})
    return order_pairs(t).join(q, "query_id").join(c, "item")


@query("normalize_text", "doc_id:l normalized:s folded:s", f"SELECT doc_id, md5({norm_sql('text')}) AS normalized, md5(translate({norm_sql('text')}, 'çğıöşü', 'cgiosu')) AS folded FROM documents")
def normalize_text(t):
    n = T.normalize(F.col("text"))
    return t("documents").select("doc_id", F.md5(n).alias("normalized"), F.md5(T.ascii_fold(n)).alias("folded"))


DOMAIN = "trim(regexp_replace(lower(translate(coalesce({0}, ''), 'Iİ', 'ıi')), '[^0-9a-zçğıöşü]+', ' ', 'g'))"


@query("query_views", "item_id:l normalized:s ascii:s", f"SELECT item_id, {DOMAIN.format('text')} AS normalized, translate({DOMAIN.format('text')}, 'çğıöşü', 'cgiosu') AS ascii FROM benchmark")
def query_views(t):
    n = T.normalize_domain(F.col("text"))
    return t("benchmark").select("item_id", n.alias("normalized"), T.ascii_fold(n).alias("ascii"))


@query("v3_normalize_units", "item:l normalized:s ascii:s", """WITH n AS (SELECT p_partkey AS item, p_size || ' gb ' || replace(p_name, 'i', 'ı') || ' ' || p_size % 9 || ' inç / ' || p_partkey || ' 5 l %' || p_size || '+ ' || p_size || ' cm' AS normalized FROM part)
    SELECT item, normalized, translate(normalized, 'çğıöşü', 'cgiosu') AS ascii FROM n""")
def v3_normalize_units(t):
    """Part names in capitals with units as words, stuck to their numbers or apart."""
    c = F.col
    raw = F.concat(F.lit(" "), c("p_size"), F.lit("Gigabyte "), F.upper("p_name"), F.lit("  "), c("p_size") % 9, F.lit("inch|"), c("p_partkey"), F.lit(" ,5 LİTRE %"), c("p_size"), F.lit("+ "), c("p_size"), F.lit(" Santimetre"))
    return t("part").select(c("p_partkey").alias("item"), T.normalize_units(raw).alias("normalized"), T.normalize_units(raw, fold=True).alias("ascii"))


_OF_KEY = {"color": ["kırmızı", "mavi", "siyah", "bej", ""], "gender": ["kadın", "erkek", "unisex", ""], "age": ["bebek", "çocuk", "yetişkin"], "measure": ["64gb", "128gb", "256gb", "512gb"]}
_MARKET_SQL = f"""{CATALOG_SQL}, {ORDER_PAIRS_SQL}, market AS (SELECT *, {", ".join(f"[{', '.join(f"'{w}'" for w in words)}][item % {len(words)} + 1] AS {name}" for name, words in _OF_KEY.items())}, 'k' || item % 7 || 'x' AS code, 36 + item % 5 AS shoe, item % 6 = 0 AS is_case, CAST(regexp_extract(brand, '[0-9]+') AS INTEGER) AS brand_number FROM catalog),
    worded AS (SELECT *, concat_ws(' ', title, color, gender, age, code, measure) AS name FROM market)"""


def _market(t):
    """The catalog with a colour, a gender, an age, a code, a measure and more by the part's key, and a name of them."""
    c = catalog(t)
    c = c.withColumns({k: F.get(F.array(*[F.lit(w) for w in words]), (F.col("item") % len(words)).cast("int")) for k, words in _OF_KEY.items()} | {"code": F.concat(F.lit("k"), F.col("item") % 7, F.lit("x")), "shoe": 36 + F.col("item") % 5})
    return c.withColumn("name", F.concat_ws(" ", "title", "color", "gender", "age", "code", "measure"))


@query("category_parts", "item:l top_category:s second_category:s parent_category:s leaf_category:s category_depth:l", f"WITH {CATALOG_SQL}, p AS (SELECT item, list_filter(list_transform(string_split(category, '/'), lambda x: {norm_sql('x')}), lambda x: x <> '') AS parts FROM catalog) SELECT item, parts[1] AS top_category, parts[2] AS second_category, array_to_string(parts[1:len(parts) - 1], '/') AS parent_category, parts[len(parts)] AS leaf_category, len(parts) AS category_depth FROM p")
def category_parts(t):
    return catalog(t).select("item", *[v.alias(k) for k, v in T.category_columns(F.col("category")).items()])


@query("attribute_map", "item:l attributes:s size:s selected:s", f"WITH {CATALOG_SQL} SELECT item, 'brand=' || brand || '|size=' || (p_size + 1) AS attributes, (p_size + 1)::VARCHAR AS size, 'size: ' || (p_size + 1) AS selected FROM catalog")
def attribute_map(t):
    c = F.col("attributes")
    return catalog(t).select("item", T.attribute_text(T.attribute_entries(c), "|", "=").alias("attributes"), T.attribute_map(c, ["size"])["size"].alias("size"), T.select_attributes(c, T.token_set(F.lit("none of it")), ["size"]).alias("selected"))


@query("regex_entities", "doc_id:l numbers:s units:s models:s first_number:d", f"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(x, '\\b[0-9]+(?:[.,][0-9]+)?\\b'))), ',') AS numbers, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(x, '\\b[0-9]+(?:[.,][0-9]+)?\\s*(?:gb|tb|mb|ml|cl|l|lt|kg|gr|g|cm|mm|m|w|watt|v|mah|inç|inc)\\b'), lambda u: regexp_replace(u, '\\s+', '', 'g')))), ',') AS units,
    array_to_string(list_sort(list_distinct(list_filter(string_split({norm_sql('x')}, ' '), lambda w: regexp_full_match(w, '[a-z0-9-]{{2,}}') AND regexp_matches(w, '[a-z]') AND regexp_matches(w, '[0-9]')))), ',') AS models, TRY_CAST(replace(regexp_extract(x, '([0-9]+(?:[.,][0-9]+)?)', 1), ',', '.') AS DOUBLE) AS first_number
    FROM (SELECT p_partkey AS doc_id, lower(p_name || ' ' || p_size || 'gb x' || (p_partkey % 97) || 'z ' || (p_size % 7) || '.5 kg') AS x FROM part) AS y""")
def regex_entities(t):
    text = F.lower(F.concat("p_name", F.lit(" "), "p_size", F.lit("gb x"), F.col("p_partkey") % 97, F.lit("z "), F.col("p_size") % 7, F.lit(".5 kg")))
    joined = lambda a: F.array_join(F.sort_array(a), ",")
    rows = t("part").select(F.col("p_partkey").alias("doc_id"), text.alias("x"))
    return rows.select("doc_id", joined(T.numbers_in(F.col("x"))).alias("numbers"), joined(T.units_in(F.col("x"))).alias("units"), joined(T.model_codes_in(T.normalize(F.col("x")))).alias("models"), T.first_number(F.col("x")).alias("first_number"))


@query("token_overlap_features", "query_id:l item:l overlap_title:d unmatched_title:d overlap_category:d jaccard_title:d", f"WITH {PAIR_SQL} SELECT query_id, item, {RECALL} AS overlap_title, coalesce(1 - {RECALL}, 0) AS unmatched_title, coalesce(len(list_intersect(qt, ct))::DOUBLE / nullif(len(qt), 0), 0) AS overlap_category, {JACCARD} AS jaccard_title FROM pairs")
def token_overlap_features(t):
    q, i = F.col("qt"), F.col("tt")
    return _pair_frame(t).select("query_id", "item", T.overlap_ratio(q, i).alias("overlap_title"), T.unmatched_ratio(q, i).alias("unmatched_title"), T.overlap_ratio(q, F.col("ct")).alias("overlap_category"), T.jaccard(q, i).alias("jaccard_title"))


@query("pair_text_channels", "query_id:l item:l recall:d jaccard:d in_title:d taxonomy:d lexical_score:d", f"""WITH {PAIR_SQL}, c AS (SELECT query_id, item, {RECALL} AS recall, {JACCARD} AS jaccard, CASE WHEN qn <> '' AND contains(tn, qn) THEN 1.0 ELSE 0.0 END AS in_title,
    CASE WHEN len(list_intersect(qt, ct)) > 0 OR (bn <> '' AND list_contains(qt, bn)) THEN 1.0 ELSE 0.0 END AS taxonomy FROM pairs) SELECT *, recall + 0.35 * jaccard + 0.5 * in_title + 0.2 * taxonomy AS lexical_score FROM c""")
def pair_text_channels(t):
    c = F.col
    rows = _pair_frame(t).select("query_id", "item", *[v.alias(k) for k, v in X.pair_channels(c("qn"), c("qt"), c("tn"), c("tt"), c("ct"), c("bn")).items()])
    return rows.withColumn("lexical_score", X.lexical_score(c("recall"), c("jaccard"), c("in_title"), c("taxonomy")))


_APART = "(q.{0} <> '' AND i.{0} <> '' AND q.{0} <> i.{0})::INT"


@query("contradiction_flags", "query_id:l item:l color:l gender:l age:l", f"WITH {_MARKET_SQL} SELECT o.query_id, o.item, {', '.join(_APART.format(c) + ' AS ' + c for c in ('color', 'gender', 'age'))} FROM order_pairs AS o JOIN worded AS q ON q.item = query_id JOIN worded AS i ON i.item = o.item")
def contradiction_flags(t):
    m = _market(t).select("item", T.token_set(F.col("name")).alias("tokens"))
    sets = m.select("item", T.colors_in(F.col("tokens")).alias("c"), T.groups_in(F.col("tokens"), T.GENDER_GROUPS).alias("g"), T.groups_in(F.col("tokens"), T.AGE_GROUPS).alias("a"))
    pairs = order_pairs(t).join(sets.toDF("query_id", "qc", "qg", "qa"), "query_id").join(sets, "item")
    return pairs.select("query_id", "item", T.contradicts(F.col("qc"), F.col("c")).alias("color"), T.contradicts(F.col("qg"), F.col("g")).alias("gender"), T.contradicts(F.col("qa"), F.col("a")).alias("age"))


_FLAGS = ["brands", "product_types", "categories", "colors", "genders", "ages", "models", "measures", "shoe_sizes", "accessory"]


@query("intent_contradictions", "query_id:l item:l " + " ".join(f"{f}_mismatch:l" for f in _FLAGS) + " contradiction_count:l has_contradiction:l", f"""WITH {_MARKET_SQL}, f AS (SELECT o.query_id, o.item, (q.brand <> i.brand)::INT AS brands_mismatch, (q.brand <> i.brand)::INT AS product_types_mismatch, (q.brand <> i.brand AND split_part(q.title, ' ', 1) <> split_part(i.title, ' ', 1))::INT AS categories_mismatch,
    (q.color <> '' AND q.color <> i.color)::INT AS colors_mismatch, (q.gender <> '' AND q.gender <> i.gender)::INT AS genders_mismatch, (q.age <> i.age)::INT AS ages_mismatch, (q.code <> i.code AND q.measure <> i.measure)::INT AS models_mismatch, (q.measure <> i.measure)::INT AS measures_mismatch,
    (q.shoe <> i.shoe)::INT AS shoe_sizes_mismatch, (q.is_case AND NOT i.is_case)::INT AS accessory_mismatch FROM order_pairs AS o JOIN worded AS q ON q.item = query_id JOIN worded AS i ON i.item = o.item)
    SELECT *, {" + ".join(f"{f}_mismatch" for f in _FLAGS)} AS contradiction_count, (contradiction_count > 0)::INT AS has_contradiction FROM f""")
def intent_contradictions(t):
    """All ten flags: what the query's part names, and the item's text lacks."""
    m = _market(t).withColumn("full", F.concat_ws(" ", "name", "brand", F.concat("shoe", F.lit(" numara")), F.when(F.col("item") % 6 == 0, F.lit("kılıf"))))
    intents = I.parse_intent(m, "item", "full", I.learn_lexicons(m, "brand", "category")).select(F.col("item").alias("query_id"), "intent")
    texts = m.select("item", T.normalize(F.col("full")).alias("item_text")).repartition("item").withColumns(I.item_columns(F.col("item_text"))).drop("item_text")
    pairs = order_pairs(t).join(texts, "item").join(intents, "query_id")  # the wider side comes last and is not shuffled with the pairs
    return I.with_contradictions(pairs, ["query_id", "item"])


def _share(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b}))::DOUBLE / nullif(len({a}), 0), 0)"


@query("lexical_features_24", "query_id:l item:l " + " ".join(f"{n}:d" for n in X.LEXICAL), f"""WITH {_MARKET_SQL}, s AS (SELECT *, {norm_sql("name || ' ' || brand")} AS qn, {tokens_sql("name || ' ' || brand")} AS qt, {tokens_sql("name")} AS tt, {tokens_sql("category")} AS ct, {tokens_sql("attributes")} AS at, {norm_sql("brand")} AS bn,
    {tokens_sql("concat_ws(' ', name, category, brand, gender, age, attributes)")} AS xt, {norm_sql("split_part(category, '/', 1)")} AS c1, {tokens_sql("split_part(category, '/', 1)")} AS t1, {tokens_sql("split_part(category, '/', 2)")} AS t2, {tokens_sql("split_part(category, '/', 3)")} AS t3 FROM worded)
    SELECT o.query_id, o.item, {_share("q.qt", "i.tt")} AS overlap_title, {_share("q.qt", "i.ct")} AS overlap_category, {_share("q.qt", "i.at")} AS overlap_attributes, {_share("q.qt", "i.xt")} AS overlap_item_text, 1 - {_share("q.qt", "i.tt")} AS unmatched_title, len(q.qt) AS query_token_count, 3 AS category_depth,
    (list_contains(q.qt, i.c1) OR contains(q.qn, i.c1))::INT AS top_category_match, {_share("q.qt", "i.t1")} AS overlap_top_category, {_share("q.qt", "i.t2")} AS overlap_second_category, {_share("q.qt", "i.t3")} AS overlap_leaf_category, contains(q.qn, i.bn)::INT AS brand_in_query,
    (q.gender <> '' AND q.gender = i.gender)::INT AS gender_overlap, (q.age = i.age)::INT AS age_overlap, CASE WHEN q.color = '' OR q.color <> i.color THEN 0 WHEN q.color = 'kırmızı' THEN 2 ELSE 1 END AS color_overlap, {_APART.format("color")} AS color_contradiction, {_APART.format("gender")} AS gender_contradiction, {_APART.format("age")} AS age_contradiction,
    (q.brand_number IN (i.brand_number, i.p_size, i.p_size + 1))::INT AS number_match, (q.brand_number NOT IN (i.brand_number, i.p_size, i.p_size + 1))::INT AS number_contradiction, (q.measure = i.measure)::INT AS unit_match, (q.measure = i.measure OR q.code = i.code)::INT AS model_code_match,
    len(list_intersect(q.qt, i.tt))::DOUBLE / len(list_distinct(list_concat(q.qt, i.tt))) AS jaccard_title, 0 AS is_generic_query FROM order_pairs AS o JOIN s AS q ON q.item = query_id JOIN s AS i ON i.item = o.item""")
def lexical_features_24(t):
    m = _market(t)
    queries = X.with_query_columns(m.select(F.col("item").alias("query_id"), F.concat_ws(" ", "name", "brand").alias("query"))).drop("query")
    items = X.with_item_columns(m.select("item", F.col("name").alias("title"), "category", "brand", "gender", F.col("age").alias("age_group"), "attributes"))
    pairs = order_pairs(t).join(queries, "query_id").join(items, "item")
    return pairs.select("query_id", "item", *[v.alias(k) for k, v in X.lexical_features().items()])


@query("generic_strong_match", "query_id:l item:l generic:l strong:l", f"WITH {PAIR_SQL} SELECT query_id, item, 0 AS generic, CASE WHEN len(qt) >= 2 AND {RECALL} >= 0.75 THEN 1 ELSE 0 END AS strong FROM pairs")
def generic_strong_match(t):
    return _pair_frame(t).select("query_id", "item", T.is_generic(F.col("qt")).alias("generic"), T.strong_match(F.col("qt"), F.col("tt")).alias("strong"))


@query("lexicon_ngram_match", "item:l matches:s", f"""WITH {CATALOG_SQL}, lex AS (SELECT DISTINCT split_part({norm_sql('title')}, ' ', 1) AS phrase FROM catalog UNION SELECT DISTINCT {norm_sql('title')} FROM catalog WHERE item % 3 = 0), ns AS (SELECT item, {norm_sql('title')} AS n FROM catalog),
    m AS (SELECT item, phrase FROM ns JOIN lex ON contains(' ' || n || ' ', ' ' || phrase || ' ')) SELECT item, string_agg(phrase, '|' ORDER BY -len(string_split(phrase, ' ')), -length(phrase), phrase) AS matches FROM m WHERE NOT EXISTS (SELECT 1 FROM m AS o WHERE o.item = m.item AND length(o.phrase) > length(m.phrase) AND contains(' ' || o.phrase || ' ', ' ' || m.phrase || ' ')) GROUP BY item""")
def lexicon_ngram_match(t):
    c = catalog(t).select("item", T.normalize(F.col("title")).alias("n"))
    lexicon = c.select(F.split_part("n", F.lit(" "), F.lit(1)).alias("phrase")).unionByName(c.where("item % 3 = 0").select(F.col("n").alias("phrase"))).distinct()
    grams = c.select("item", F.explode(T.ngrams(T.split_tokens(F.col("n")), 6)).alias("phrase"))
    found = grams.join(lexicon, "phrase").groupBy("item").agg(F.collect_set("phrase").alias("lexicon"))
    best = c.join(found, "item").select("item", T.longest_matches(T.split_tokens(F.col("n")), F.col("lexicon")).alias("m"))
    return best.where(F.size("m") > 0).select("item", F.array_join("m", "|").alias("matches"))


@query("compact_text", "doc_id:l compacted:s n:l", """SELECT doc_id, md5(c) AS compacted, length(c) AS n FROM (SELECT doc_id, CASE WHEN length(x) > 200 THEN x[:136] || ' … ' || right(x, 61) ELSE x END AS c FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS x FROM documents) AS a) AS b""")
def compact_text(t):
    c = T.compact(F.col("text"), 200)
    return t("documents").select("doc_id", F.md5(c).alias("compacted"), F.length(c).alias("n"))


@query("control_tokens", "page_id:l cleaned:s", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(coalesce(html, ''), '<\|[^|>]*\|>|</?[a-zA-Z_]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS cleaned FROM pages")
def control_tokens(t):
    return t("pages").select("page_id", F.md5(T.drop_control_tokens(F.col("html"))).alias("cleaned"))


@query("text_views", "item:l long_view:s short_view:s item_text:s", f"WITH {CATALOG_SQL} SELECT item, '[TITLE] ' || title || ' [CATEGORY] ' || category || ' [BRAND] ' || brand || ' [ATTR] ' || attributes AS long_view, '[TITLE] ' || title || ' [BRAND] ' || brand AS short_view, {norm_sql("title || ' ' || category || ' ' || brand || ' ' || attributes")} AS item_text FROM catalog")
def text_views(t):
    c = F.col
    return catalog(t).select("item", T.tagged_view({"TITLE": c("title"), "CATEGORY": c("category"), "BRAND": c("brand"), "GENDER": F.lit(" "), "ATTR": c("attributes")}).alias("long_view"), T.tagged_view({"TITLE": c("title"), "BRAND": c("brand")}).alias("short_view"), T.item_text(c("title"), c("category"), c("brand"), c("attributes")).alias("item_text"))


@query("brand_category_overlap", "query_id:l item:l brand_in_query:l top_match:l has_size_word:l", f"WITH {PAIR_SQL} SELECT query_id, item, CASE WHEN contains(qn, bn) OR list_contains(qt, bn) THEN 1 ELSE 0 END AS brand_in_query, CASE WHEN contains(qn, {norm_sql('p_type')}) OR list_contains(qt, {norm_sql('p_type')}) THEN 1 ELSE 0 END AS top_match, CASE WHEN contains(tn, 'red') OR contains(tn, 'steel') THEN 1 ELSE 0 END AS has_size_word FROM pairs")
def brand_category_overlap(t):
    c = F.col
    top = T.part_or_blank(T.category_parts(c("category")), 1)
    return _pair_frame(t).select("query_id", "item", (T.known_value(c("brand")) & (F.contains(c("qn"), c("bn")) | F.array_contains(c("qt"), c("bn")))).cast("int").alias("brand_in_query"), (F.contains(c("qn"), top) | F.array_contains(c("qt"), top)).cast("int").alias("top_match"), T.contains_any_word(c("tn"), ["red", "steel"]).cast("int").alias("has_size_word"))


@query("intent_flat", "item:l brand:s types:s models:s measures:s accessory:l", f"""WITH {CATALOG_SQL}, b AS (SELECT brand FROM (SELECT {norm_sql('brand')} AS brand FROM catalog) AS x GROUP BY brand HAVING count(*) >= 2), q AS (SELECT item, {norm_sql("title || ' ' || brand || ' ' || p_size || ' gb x' || p_size || ' kablo'")} AS n FROM catalog)
    SELECT item, (SELECT string_agg(brand, ',' ORDER BY brand) FROM b WHERE contains(' ' || n || ' ', ' ' || brand || ' ')) AS brand, split_part(n, ' ', 1) AS types, array_to_string(list_sort(list_distinct(list_filter(string_split(n, ' '), lambda w: regexp_full_match(w, '[a-z0-9-]{{2,}}') AND regexp_matches(w, '[a-z]') AND regexp_matches(w, '[0-9]')))), ',') AS models,
    array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(n, '\\b[0-9]+(?:[.,][0-9]+)?\\s*(?:gb|tb|mb|ml|cl|l|lt|kg|gr|g|cm|mm|m|w|watt|v|mah|inç|inc)\\b'), lambda u: regexp_replace(u, '\\s+', '', 'g')))), ',') AS measures, 1 AS accessory FROM q""")
def intent_flat(t):
    from ..functions.intent import flat_intent, learn_lexicons

    c = catalog(t)
    queries = c.select("item", F.concat_ws(" ", "title", "brand", "p_size", F.lit("gb"), F.concat(F.lit("x"), "p_size"), F.lit("kablo")).alias("query"))
    first = c.select(F.split_part(T.normalize(F.col("title")), F.lit(" "), F.lit(1)).alias("phrase")).distinct()
    return flat_intent(queries, "item", "query", learn_lexicons(c, "brand", "category").where("kind = 'brand'").unionByName(first.select("phrase", F.lit("type").alias("kind"))))


@query("logit_math", "item:l logit_p:d back:d mean:d lse:d softmax:d", f"""WITH {SCORED_SQL}, c AS (SELECT item, p, q, ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))) AS lp, ln(least(greatest(q, 1e-6), 1 - 1e-6) / (1 - least(greatest(q, 1e-6), 1 - 1e-6))) AS lq FROM scored)
    SELECT item, lp AS logit_p, 1 / (1 + exp(-lp)) AS back, 1 / (1 + exp(-(lp + lq) / 2)) AS mean, ln(exp(p) + exp(q)) AS lse, exp(q) / (exp(p) + exp(q)) AS softmax FROM c""")
def logit_math(t):
    p, q = F.col("p"), F.col("q")
    return scored(t).select("item", M.logit(p).alias("logit_p"), M.sigmoid(M.logit(p)).alias("back"), M.logit_mean(p, q).alias("mean"), M.log_sum_exp(p, q).alias("lse"), M.two_class_probability(p, q).alias("softmax"))


@query("prompt_and_parse", "conv_id:l turn:l prompt:s parsed:l", f"""SELECT conv_id, turn, md5('Query: ' || role || chr(10) || 'Item: ' || text || chr(10) || 'Answer 0 or 1.') AS prompt, CASE WHEN {h('answer', 'conv_id', 'turn')} % 3 < 2 THEN {h('answer', 'conv_id', 'turn')} % 3 END AS parsed FROM conversations""")
def prompt_and_parse(t):
    k = H.keyed_hash("answer", F.col("conv_id"), F.col("turn")) % 3
    completion = F.concat(F.lit("<|channel|>analysis<|message|>think 1<|end|><|channel|>final<|message|>"), F.when(k < 2, k.cast("string")).otherwise(F.lit("maybe 1")), F.lit("<|return|>"))
    prompt = F.format_string("Query: %s\nItem: %s\nAnswer 0 or 1.", "role", "text")
    return t("conversations").select("conv_id", "turn", F.md5(prompt).alias("prompt"), T.parse_final_label(completion).alias("parsed"))
