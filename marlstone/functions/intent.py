"""Query intent: lexicons learned from a catalog, and what a query asks for.

Lexicons stay tables: a query's n-grams meet them in an equi-join, so neither side is held on the driver or scanned for each query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import small_side
from ..sources.workspace import stored
from . import text as T

LIMITS = {"brand": 2, "type": 3, "category": 3}
AGE, SHOE, LETTER_SIZE, NUMERIC_SIZE = r"\b([0-9]{1,2})\s*(?:yaş|yas)\b", r"\b([0-9]{2})\s*(?:numara|no)\b", r"\b(xxs|xs|s|m|l|xl|xxl|xxxl)\b", r"\b([0-9]{2,3})\s*beden\b"


def learn_lexicons(items: DataFrame, brand: str, category: str, normalizer=T.normalize) -> DataFrame:
    """phrase, kind: brands of 2 to 40 characters seen twice, all category parts, leaves of 2 to 60 characters as product types."""
    b = normalizer(F.col(brand))
    brands = items.where(T.known_value(F.col(brand))).groupBy(b.alias("phrase")).agg(F.count(F.lit(1)).alias("n")).where(F.length("phrase").between(2, 40) & (F.col("n") >= 2)).select("phrase", F.lit("brand").alias("kind"))
    parts = items.select(T.category_parts(F.col(category)).alias("parts")).distinct()
    categories = parts.select(F.explode("parts").alias("phrase")).distinct().select("phrase", F.lit("category").alias("kind"))
    types = parts.select(T.part_or_blank(F.col("parts"), -1).alias("phrase")).distinct().where(F.length("phrase").between(2, 60)).select("phrase", F.lit("type").alias("kind"))
    return brands.unionByName(categories).unionByName(types)


def parse_intent(queries: DataFrame, key: str, query: str, lexicons: DataFrame) -> DataFrame:
    """key, normalized, and intent: a struct of what the query names.  Keys are unique.

    Each text is read once, whatever its copies, and texts are dealt evenly, as a small file of short texts is a task or two.  The lexicon
    is stored, so that its size is known when its join is planned: some of its phrases are in all queries.
    """
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = queries.select(key, T.normalize(F.col(query)).alias("normalized"))
    q = stored(asked.select("normalized").distinct().repartition(parts, "normalized").withColumn("tokens", T.split_tokens(F.col("normalized"))), "intent-texts")
    lexicons = small_side(stored(lexicons.distinct(), "lexicons"))
    grams = q.repartition(parts, "normalized").select("normalized", F.explode(T.ngrams(F.col("tokens"), 6)).alias("phrase"))
    found = grams.join(lexicons, "phrase").groupBy("normalized").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("phrase"))).alias(k) for k in LIMITS])
    rows = q.join(found, "normalized", "left")
    empty = F.array().cast("array<string>")

    def named(kind: str) -> Column:
        return T.outermost(F.coalesce(F.col(kind), empty), LIMITS[kind])  # the text's own n-grams have been found

    n = F.col("normalized")
    groups = F.array_distinct(F.array_union(F.col("tokens"), T.split_tokens(T.ascii_fold(n))))
    number = lambda pattern: F.array_distinct(F.regexp_extract_all(n, F.lit(pattern), F.lit(1)))
    fields = {
        "brands": named("brand"), "product_types": named("type"), "categories": named("category"), "colors": T.colors_in(groups, extended=True), "genders": T.groups_in(groups, T.GENDER_GROUPS), "ages": F.array_union(T.groups_in(groups, T.AGE_GROUPS), number(AGE)),
        "models": T.model_codes_in(n), "measures": T.units_in(n), "shoe_sizes": number(SHOE), "apparel_sizes": F.array_union(number(LETTER_SIZE), number(NUMERIC_SIZE)), "accessory": T.any_phrase_in(n, T.words_of(*T.ACCESSORY_WORDS)), "main_product": T.any_phrase_in(n, T.words_of(*T.MAIN_PRODUCT_WORDS)),
    }
    rows = rows.withColumns({f"_{k}": v for k, v in fields.items()})
    mandatory = F.filter(F.array(*[F.when(F.size(f"_{k}") > 0, F.lit(k)) for k in fields if k not in ("accessory", "main_product")]), lambda x: x.isNotNull())
    read = rows.select("normalized", F.struct(*[F.col(f"_{k}").alias(k) for k in fields], mandatory.alias("mandatory")).alias("intent"))
    return asked.join(small_side(stored(read, "intents")), "normalized").select(key, "normalized", "intent")


def flat_intent(queries: DataFrame, key: str, query: str, lexicons: DataFrame) -> DataFrame:
    i = parse_intent(queries, key, query, lexicons)
    joined = lambda c: F.array_join(F.sort_array(F.col(f"intent.{c}")), ",")
    return i.select(key, joined("brands").alias("brand"), joined("product_types").alias("types"), joined("models").alias("models"), joined("measures").alias("measures"), F.col("intent.accessory").cast("int").alias("accessory"))


def item_columns(item_text: Column) -> dict[str, Column]:
    """What contradiction_flags() takes of an item: apply to items before they are joined to pairs."""
    return {"i_padded": F.concat(F.lit(" "), item_text, F.lit(" ")), "i_accessory": T.contains_any_word(item_text, T.ACCESSORY_WORDS)}


def contradiction_flags(intent: Column, padded: Column, accessory: Column) -> dict[str, Column]:
    """Flags of what a query names and the item's text, with a space at each end, lacks."""
    missing = lambda values: ((F.size(values) > 0) & ~F.exists(values, lambda p: (p != "") & F.contains(padded, F.concat(F.lit(" "), p, F.lit(" "))))).cast("int")
    flags = {f"{k}_mismatch": missing(intent[k]) for k in ("brands", "product_types", "categories", "colors", "genders", "ages", "models", "measures", "shoe_sizes")}
    flags["accessory_mismatch"] = ((intent["accessory"] != accessory) & (intent["accessory"] | intent["main_product"])).cast("int")
    return flags


def contradictions(intent: Column, item_text: Column) -> dict[str, Column]:
    """The flags, their number, and whether there is any; with_contradictions() works each out once."""
    flags = contradiction_flags(intent, *item_columns(item_text).values())
    total = sum(flags.values(), F.lit(0))
    return flags | {"contradiction_count": total, "has_contradiction": (total > 0).cast("int")}


def with_contradictions(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, flags of the pairs' intent, i_padded and i_accessory, their number, and whether there is any.  A flag is worked out once."""
    flags = contradiction_flags(F.col("intent"), F.col("i_padded"), F.col("i_accessory"))
    rows = pairs.select(*keys, *[v.alias(k) for k, v in flags.items()])
    total = sum((F.col(k) for k in flags), F.lit(0))
    return rows.withColumns({"contradiction_count": total, "has_contradiction": (total > 0).cast("int")})


def family_key(title: Column, brand: Column, category: Column) -> Column:
    """Hash of brand, category and the folded title without measures, colours and sizes."""
    t = T.ascii_fold(T.normalize_units(title))
    t = F.regexp_replace(t, T.NUMBER_UNIT, " ")
    for pattern in (SHOE, NUMERIC_SIZE, LETTER_SIZE, r"\b(?:" + "|".join(sorted({c for c in [*T.COLORS, *T.EXTRA_COLORS] if c.isascii()})) + r")\b"):
        t = F.regexp_replace(t, pattern, " ")
    return F.md5(F.concat_ws("|", T.normalize(brand), T.category_path(category), F.trim(F.regexp_replace(t, r"\s+", " "))))
