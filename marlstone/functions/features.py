"""Feature columns of (query, item) pairs, from token arrays computed once for each side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

LEXICAL = [
    "overlap_title", "overlap_category", "overlap_attributes", "overlap_item_text", "unmatched_title", "query_token_count", "category_depth", "top_category_match",
    "overlap_top_category", "overlap_second_category", "overlap_leaf_category", "brand_in_query", "gender_overlap", "age_overlap", "color_overlap", "color_contradiction",
    "gender_contradiction", "age_contradiction", "number_match", "number_contradiction", "unit_match", "model_code_match", "jaccard_title", "is_generic_query",
]
ITEM_FIELDS = ("title", "category", "brand", "gender", "age_group", "attributes")


def with_query_columns(df: DataFrame, query: str = "query") -> DataFrame:
    """Columns q_*: apply to queries before they are joined to pairs."""
    q = F.col(query)
    df = df.withColumns({"q_norm": T.normalize(q), "q_tokens": T.token_set(q), "q_numbers": T.numbers_in(q), "q_units": T.units_in(q)})
    tokens = F.col("q_tokens")
    return df.withColumns({"q_models": T.model_codes_in(F.col("q_norm")), "q_colors": T.colors_in(tokens), "q_genders": T.groups_in(tokens, T.GENDER_GROUPS), "q_ages": T.groups_in(tokens, T.AGE_GROUPS), "q_generic": T.is_generic(tokens)})


def with_item_columns(df: DataFrame) -> DataFrame:
    """Columns i_*: apply to items before they are joined to pairs."""
    fields = {f: T.blank_if_null(F.col(f)) for f in ITEM_FIELDS}
    parts = T.category_columns(F.col("category"))
    df = df.withColumns({"i_text": T.item_text(*fields.values()), "i_title": T.token_set(F.col("title")), "i_category": T.token_set(F.col("category")), "i_attributes": T.token_set(F.col("attributes")), "i_brand": T.normalize(F.col("brand")), "i_has_brand": T.known_value(F.col("brand"))})
    df = df.withColumns({"i_tokens": T.token_set(F.col("i_text")), "i_depth": parts["category_depth"], "i_top": parts["top_category"], "i_second": parts["second_category"], "i_leaf": parts["leaf_category"], "i_numbers": T.numbers_in(F.col("i_text")), "i_units": T.units_in(F.col("i_text")), "i_models": T.model_codes_in(F.col("i_text"))})
    tokens = F.col("i_tokens")
    df = df.withColumns({"i_colors": T.colors_in(tokens), "i_text_genders": T.groups_in(tokens, T.GENDER_GROUPS), "i_text_ages": T.groups_in(tokens, T.AGE_GROUPS)} | {f"{c}_tokens": T.token_set(F.col(c)) for c in ("i_top", "i_second", "i_leaf")})
    return df.withColumns({"i_genders": F.array_union(T.groups_in(T.token_set(F.col("gender")), T.GENDER_GROUPS), F.col("i_text_genders")), "i_ages": F.array_union(T.groups_in(T.token_set(F.col("age_group")), T.AGE_GROUPS), F.col("i_text_ages"))})


def lexical_features() -> dict[str, Column]:
    """The 24 lexical features of a pair that has the q_* and i_* columns.  What one side alone tells is in those: nothing here reads a text."""
    q, c = F.col("q_tokens"), F.col
    q_genders, q_ages = c("q_genders"), c("q_ages")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    values = [
        T.overlap_ratio(q, c("i_title")), T.overlap_ratio(q, c("i_category")), T.overlap_ratio(q, c("i_attributes")), T.overlap_ratio(q, c("i_tokens")), T.unmatched_ratio(q, c("i_title")), F.size(q), c("i_depth"),
        flag((c("i_top") != "") & (F.array_contains(q, c("i_top")) | F.contains(c("q_norm"), c("i_top")))),
        T.overlap_ratio(q, c("i_top_tokens")), T.overlap_ratio(q, c("i_second_tokens")), T.overlap_ratio(q, c("i_leaf_tokens")),
        flag(c("i_has_brand") & (F.contains(c("q_norm"), c("i_brand")) | F.array_contains(q, c("i_brand")))),
        flag((F.size(q_genders) > 0) & F.arrays_overlap(q_genders, c("i_genders"))), flag((F.size(q_ages) > 0) & F.arrays_overlap(q_ages, c("i_ages"))),
        F.size(F.array_intersect(c("q_colors"), c("i_colors"))), T.contradicts(c("q_colors"), c("i_colors")), T.contradicts(q_genders, c("i_text_genders")), T.contradicts(q_ages, c("i_text_ages")),
        flag(F.arrays_overlap(c("q_numbers"), c("i_numbers"))), T.contradicts(c("q_numbers"), c("i_numbers")), flag(F.arrays_overlap(c("q_units"), c("i_units"))), flag(F.arrays_overlap(c("q_models"), c("i_models"))),
        T.jaccard(q, c("i_title")), c("q_generic"),
    ]
    return {name: value.cast("double") for name, value in zip(LEXICAL, values, strict=True)}


def pair_channels(q_norm: Column, q: Column, title_norm: Column, title: Column, category: Column, brand: Column) -> dict[str, Column]:
    """Token recall, Jaccard, query inside title, taxonomy; a brand counts only if it is one token."""
    inside = ((q_norm != "") & F.contains(title_norm, q_norm)).cast("double")
    taxonomy = ((F.size(F.array_intersect(q, category)) > 0) | ((brand != "") & F.array_contains(q, brand))).cast("double")
    return {"recall": T.overlap_ratio(q, title), "jaccard": T.jaccard(q, title), "in_title": inside, "taxonomy": taxonomy}


def lexical_score(recall: Column, jaccard: Column, in_title: Column, taxonomy: Column) -> Column:
    return recall + 0.35 * jaccard + 0.5 * in_title + 0.2 * taxonomy
