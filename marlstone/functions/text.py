"""Text functions as columns: normalisers, token sets, category paths, attribute maps, entities and views.

There are three normalisers, and token sets of one must not be compared with those of another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
STOPWORDS = ["ve", "ile", "icin", "için", "bir", "the", "of", "adet", "urun", "ürün"]
COLORS = ["siyah", "beyaz", "kırmızı", "kirmizi", "mavi", "lacivert", "bej", "krem", "haki", "bordo", "gri", "yeşil", "yesil", "pembe", "mor", "turuncu", "kahverengi", "ekru", "vizon", "taş", "tas", "füme", "fume", "antrasit"]
EXTRA_COLORS = ["sarı", "sari", "altın", "altin", "gümüş", "gumus"]
GENERIC_NOUNS = ["elbise", "çanta", "canta", "bot", "ayakkabı", "ayakkabi", "gömlek", "gomlek", "mont", "telefon", "kulaklık", "kulaklik", "kitaplık", "kitaplik", "tabak", "termos", "tişört", "tisort", "kazak", "pantolon"]
GENDER_GROUPS = {"kadın": ["kadın", "kadin", "bayan", "kız", "kiz"], "erkek": ["erkek"], "unisex": ["unisex"]}
AGE_GROUPS = {"bebek": ["bebek", "yenidoğan", "yenidogan"], "çocuk": ["çocuk", "cocuk", "kız", "kiz", "oğlan", "oglan"], "yetişkin": ["yetişkin", "yetiskin"]}
UNKNOWN = ["", "unknown", "bilinmiyor", "none", "nan", "null", "-"]
UNITS = [
    (r"\bterabyte\b", "tb"),
    (r"\bgigabyte\b", "gb"),
    (r"\bmililitre\b|\bmililiter\b", "ml"),
    (r"\blitre\b|\bliter\b|\blt\b", "l"),
    (r"\bkilogram\b|\bkilo\b", "kg"),
    (r"\bgram\b|\bgr\b", "g"),
    (r"\bsantimetre\b", "cm"),
    (r"\bmilimetre\b", "mm"),
    (r"\binch\b", "inç"),
]
ATTRIBUTE_KEYS = ["renk", "color detail", "materyal", "materyal bileşeni", "beden", "boyut/ebat", "kapasite", "hacim", "yaş", "cinsiyet", "model", "araç marka ve model", "uyumlu marka", "uyumlu model", "numara", "güç (watt)", "paket içeriği", "parça sayısı"]
ACCESSORY_WORDS = ["kılıf", "kilif", "kapak", "ekran koruyucu", "şarj", "sarj", "adaptör", "adaptor", "kablo", "askı", "aski", "yedek parça", "filtre", "çanta", "canta", "stand"]
MAIN_PRODUCT_WORDS = ["telefon", "tablet", "bilgisayar", "laptop", "televizyon", "tv", "kamera", "saat", "kulaklık", "kulaklik", "ayakkabı", "ayakkabi", "elbise", "mont"]
NUMBER = r"\b[0-9]+(?:[.,][0-9]+)?\b"
UNIT = r"\b[0-9]+(?:[.,][0-9]+)?\s*(?:gb|tb|mb|ml|cl|l|lt|kg|gr|g|cm|mm|m|w|watt|v|mah|inç|inc)\b"
NUMBER_UNIT = r"\b([0-9]+(?:[.,][0-9]+)?)\s*(tb|gb|mb|mah|ml|cl|l|kg|g|cm|mm|m|w|v|inç|inc)\b"
LETTERS_V3 = "0-9a-zçğıöşü"


def words_of(*words: str) -> Column:
    return F.array(*[F.lit(w) for w in words])


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


# ---- normalisers -------------------------------------------------------------------------------------------------


def normalize(c: Column) -> Column:
    """General: lower case, everything but letters and digits becomes one space."""
    return F.trim(F.regexp_replace(F.lower(blank_if_null(c)), r"[^\p{L}\p{N}]+", " "))


def turkish_lower(c: Column) -> Column:
    return F.lower(F.translate(blank_if_null(c), "Iİ", "ıi"))


def normalize_domain(c: Column) -> Column:
    """Turkish lower case, only Turkish letters and digits kept."""
    return F.trim(F.regexp_replace(turkish_lower(c), rf"[^{LETTERS_V3}]+", " "))


def ascii_fold(c: Column) -> Column:
    return F.translate(c, "çğıöşü", "cgiosu")


def normalize_units(c: Column, fold: bool = False) -> Column:
    """Turkish lower case, units as symbols and set apart from their number, `/` and `|` set apart, `+ . / % -` kept.

    Unicode compatibility forms are for the caller to compose beforehand, see udf.nfkc.
    """
    text = F.regexp_replace(turkish_lower(c), r"([0-9])([a-zçğıöşü])", "$1 $2")
    text = reduce(lambda t, u: F.regexp_replace(t, u[0], u[1]), UNITS, text)
    text = F.regexp_replace(text, NUMBER_UNIT, "$1 $2")
    text = F.regexp_replace(text, r"[/|]", " / ")
    text = _collapsed(F.regexp_replace(text, rf"[^{LETTERS_V3}+./%\-]+", " "))
    return ascii_fold(text) if fold else text


# ---- tokens ------------------------------------------------------------------------------------------------------


def split_tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def token_set(c: Column) -> Column:
    """Distinct tokens of the normalised text and of its folded form, without stop words."""
    n = normalize(c)
    return F.array_except(F.array_distinct(F.array_union(split_tokens(n), split_tokens(ascii_fold(n)))), words_of(*STOPWORDS))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def overlap_ratio(query: Column, other: Column) -> Column:
    """Share of the query's tokens found in the other token set; 0 for an empty query."""
    return ratio(F.size(F.array_intersect(query, other)), F.size(query))


def unmatched_ratio(query: Column, other: Column) -> Column:
    return ratio(F.size(F.array_except(query, other)), F.size(query))


def jaccard(a: Column, b: Column) -> Column:
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def colors_in(tokens: Column, extended: bool = False) -> Column:
    return F.array_intersect(tokens, words_of(*COLORS, *(EXTRA_COLORS if extended else [])))


def groups_in(tokens: Column, groups: dict[str, list[str]]) -> Column:
    """Names of the groups one of whose words is among the tokens."""
    return F.filter(F.array(*[F.when(F.arrays_overlap(tokens, words_of(*words)), F.lit(name)) for name, words in groups.items()]), lambda g: g.isNotNull())


def contradicts(a: Column, b: Column) -> Column:
    return ((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)).cast("int")


def is_generic(tokens: Column) -> Column:
    return (F.size(tokens).between(1, 2) & (F.size(F.array_except(tokens, words_of(*GENERIC_NOUNS))) == 0)).cast("int")


def strong_match(query: Column, other: Column) -> Column:
    share = overlap_ratio(query, other)
    return F.when(is_generic(query) == 1, share >= 0.60).otherwise((F.size(query) >= 2) & (share >= 0.75)).cast("int")


def known_value(c: Column) -> Column:
    """Null, blank and the words for unknown are no values."""
    return ~F.lower(F.trim(blank_if_null(c))).isin(*UNKNOWN)


# ---- categories and attributes -----------------------------------------------------------------------------------


def category_parts(c: Column) -> Column:
    """Parts of an a/b/c path, split before normalising, empty ones dropped."""
    return F.filter(F.transform(F.split(blank_if_null(c), "/"), normalize), lambda p: p != "")


def category_path(c: Column) -> Column:
    return F.array_join(category_parts(c), "/")


def part_or_blank(parts: Column, at: int) -> Column:
    return F.coalesce(F.try_element_at(parts, F.lit(at)), F.lit(""))


def category_columns(c: Column) -> dict[str, Column]:
    parts = category_parts(c)
    return {
        "top_category": part_or_blank(parts, 1),
        "second_category": part_or_blank(parts, 2),
        "parent_category": F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/"),
        "leaf_category": part_or_blank(parts, -1),
        "category_depth": F.size(parts),
    }


def attribute_entries(c: Column, normalizer=normalize) -> Column:
    """(key, value) structs of `key: value, key: value`; of equal keys the last one, in key order."""
    pieces = F.filter(F.split(blank_if_null(c), ","), lambda p: F.instr(p, ":") > 0)
    flat = F.transform(pieces, lambda p: F.concat(F.lit("\x02"), normalizer(F.substring_index(p, ":", 1)), F.lit("\x01"), F.trim(F.substr(p, F.instr(p, ":") + 1))))
    last = F.regexp_replace(F.array_join(flat, ""), "(?s)\x02([^\x01\x02]*)\x01[^\x02]*(?=.*\x02\\1\x01)", "")
    kept = F.filter(F.split(last, "\x02"), lambda e: (F.substring_index(e, "\x01", 1) != "") & (F.substring_index(e, "\x01", -1) != "") & F.contains(e, F.lit("\x01")))
    return F.transform(F.array_sort(kept), lambda e: F.struct(F.substring_index(e, "\x01", 1).alias("key"), F.substring_index(e, "\x01", -1).alias("value")))


def attribute_map(c: Column, keys: list[str] | None = None) -> Column:
    every = F.map_from_entries(attribute_entries(c))
    return F.map_filter(every, lambda k, v: k.isin(*keys)) if keys else every


def attribute_text(entries: Column, separator: str = " | ", between: str = ": ") -> Column:
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(between), e["value"])), separator)


def select_attributes(c: Column, query_tokens: Column, keys: list[str] = ATTRIBUTE_KEYS) -> Column:
    """Attributes whose key is listed, or which share a token with the query, as `key: value | key: value`."""
    def shown(e: Column) -> Column:
        wanted = e["key"].isin(*keys) | F.arrays_overlap(token_set(F.concat_ws(" ", e["key"], e["value"])), query_tokens)
        return F.when(wanted, F.concat(e["key"], F.lit(": "), e["value"]))

    return F.array_join(F.transform(attribute_entries(c), shown), " | ")


# ---- entities ----------------------------------------------------------------------------------------------------


def numbers_in(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(blank_if_null(c)), F.lit(NUMBER), F.lit(0)))


def units_in(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(blank_if_null(c)), F.lit(UNIT), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"\s+", "")))


def model_codes_in(normalized: Column) -> Column:
    """Tokens of two or more characters holding both a letter and a digit."""
    return F.array_distinct(F.filter(split_tokens(normalized), lambda w: w.rlike("^[a-z0-9-]{2,}$") & w.rlike("[a-z]") & w.rlike("[0-9]")))


def first_number(c: Column) -> Column:
    found = F.regexp_extract(blank_if_null(c), r"([0-9]+(?:[.,][0-9]+)?)", 1)
    return F.when(found != "", F.regexp_replace(found, ",", ".").cast("double"))


def phrase_in(text: Column, phrase: Column) -> Column:
    """The phrase occurs in the text between word boundaries."""
    return (phrase != "") & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def any_phrase_in(text: Column, phrases: Column) -> Column:
    return F.exists(phrases, lambda p: phrase_in(text, p))


def contains_any_word(text: Column, words: list[str]) -> Column:
    return F.exists(words_of(*words), lambda w: F.contains(text, w))


def ngrams(tokens: Column, longest: int) -> Column:
    """Distinct n-grams of 1 to longest tokens, joined by a space."""
    grams = [tokens]
    for n in range(2, longest + 1):
        # shifting whole arrays keeps tokens out of the lambda, where it would be computed again for every element
        grams.append(F.filter(F.zip_with(grams[-1], F.slice(tokens, n, F.greatest(F.size(tokens), F.lit(1))), lambda g, w: F.when(w.isNotNull(), F.concat(g, F.lit(" "), w))), lambda g: g.isNotNull()))
    return F.array_distinct(F.flatten(F.array(*grams)))


def longest_matches(tokens: Column, lexicon: Column, longest: int = 6, limit: int | None = None) -> Column:
    """Lexicon phrases among the n-grams, without those inside a longer match; most tokens first, then longest, then by text."""
    return outermost(F.array_intersect(ngrams(tokens, longest), lexicon), limit)


def outermost(found: Column, limit: int | None = None) -> Column:
    """Distinct phrases without those inside a longer one; most tokens first, then longest, then by text."""
    outer = F.filter(found, lambda p: ~F.exists(found, lambda o: (F.length(o) > F.length(p)) & phrase_in(o, p)))
    ordered = F.transform(F.array_sort(F.transform(outer, lambda p: F.struct((-F.size(F.split(p, " "))).alias("tokens"), (-F.length(p)).alias("n"), p.alias("p")))), lambda s: s["p"])
    return F.slice(ordered, 1, limit) if limit else ordered


# ---- views -------------------------------------------------------------------------------------------------------


def item_text(*fields: Column) -> Column:
    return normalize(F.concat_ws(" ", *[blank_if_null(f) for f in fields]))


def tagged_view(fields: dict[str, Column]) -> Column:
    """`[TAG] value [TAG] value`, fields without a value left out."""
    return F.concat_ws(" ", *[F.when(F.trim(blank_if_null(c)) != "", F.concat(F.lit(f"[{tag}] "), F.trim(blank_if_null(c)))) for tag, c in fields.items()])


def compact(c: Column, most: int) -> Column:
    """White space collapsed; of a text over most characters the first 68 % and the end, joined by an ellipsis."""
    if most < 80:
        raise ValueError("most must be 80 or more")
    text = _collapsed(blank_if_null(c))
    head = -(-68 * most // 100)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, head), F.lit(" … "), F.right(text, F.lit(most - head - 3)))).otherwise(text)


def drop_control_tokens(c: Column) -> Column:
    """`<|...|>` and `<...>` marks out, white space collapsed."""
    return _collapsed(F.regexp_replace(blank_if_null(c), r"<\|[^|>]*\|>|</?[a-zA-Z_]+>", " "))


def parse_final_label(c: Column) -> Column:
    """The label 0 or 1 after the last final-channel mark, else null."""
    found = F.regexp_extract(blank_if_null(c), r"(?s).*<\|channel\|>final<\|message\|>\s*([01])\s*(?:<\|return\|>|<\|end\|>)?\s*$", 1)
    return F.when(found != "", found.cast("int"))


def id_text(c: Column) -> Column:
    """Ids read as floating point back to whole numbers; blank ids are null."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^-?[0-9]+\.0+$"), F.regexp_replace(text, r"\.0+$", "")).otherwise(F.nullif(text, F.lit("")))


def clean_text(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(" "))
