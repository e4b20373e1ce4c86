"""Sampling, negative mining, triage and training-set assembly.  Every draw is ordered by a keyed hash, so it can be repeated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import keyed_hash
from ..functions.math import clip, half_even
from ..sources.workspace import stored
from .joins import small_side
from .windows import number_rows, range_sums

# Strategies, weights and thresholds that results depend on.
TYPE_WEIGHTS = {"easy_random": 1.0, "different_top_category": 1.0, "attribute_mismatch": 0.90, "same_gender_age_hard": 0.75, "same_top_category_hard": 0.70, "brand_hard": 0.70, "title_similar_hard": 0.55}
DEFAULT_TYPE_WEIGHT = 0.60
TYPE_PRIORITY = ["attribute_mismatch", "title_similar_hard", "brand_hard", "same_gender_age_hard", "same_top_category_hard", "different_top_category", "easy_random"]
TRIES = 30
ROUNDS = (1, 4, TRIES)  # a pair's tries so far at the end of each round
POOL_BYTES = 8 << 20
EASY = ["random", "same_parent_different_leaf", "complementary_product"]
MEDIUM = [*EASY, "same_leaf_wrong_brand", "same_product_wrong_gender", "same_product_wrong_age_group", "same_product_wrong_color_material", "lexical_overlap_wrong_product", "accessory_main_product"]
ALL_TYPES = [
    "random", "same_parent_different_leaf", "same_leaf_wrong_brand", "same_category_brand_wrong_model", "same_product_wrong_gender", "same_product_wrong_age_group", "same_product_wrong_color_material",
    "lexical_overlap_wrong_product", "accessory_main_product", "complementary_product", "near_title_critical_attribute", "bi_encoder_high_score", "cross_encoder_uncertain", "ensemble_disagreement",
]


def first_n(group: str | list[str], order: list[Column], n: Column | int) -> Column:
    return F.row_number().over(Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order)) <= n


def keep(df: DataFrame, condition: Column) -> DataFrame:
    """The rows for which a condition with window functions holds."""
    return df.withColumn("_keep", condition).where("_keep").drop("_keep")


def group_sample(df: DataFrame, group: str, target: int, seed: str) -> DataFrame:
    """Whole groups in hash order until the rows before a group reach the target.  Only one row a group is ordered."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_hash", keyed_hash(seed, F.col(group)))
    chosen = range_sums(sizes, ["_hash", group], {"_rows": "_before"}, before=True).where(F.col("_before") < target)
    return df.join(chosen.select(group), group, "left_semi")


def hash_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    return df.withColumn("_hash", keyed_hash(seed, F.col(key))).orderBy("_hash", key).limit(n).drop("_hash")


def catalog_subset(items: DataFrame, referenced: DataFrame, key: str, n: int) -> DataFrame:
    """The first n items by key and all referenced ones; a referenced item that is missing is an error."""
    if not referenced.select(key).join(items, key, "left_anti").isEmpty():
        raise ValueError(f"referenced {key} missing from the catalog")
    return items.orderBy(key).limit(n).unionByName(items.join(referenced.select(key), key, "left_semi")).dropDuplicates([key])


def target_negatives(positives: Column) -> Column:
    return clip(F.ceil(2 * positives), 12, 40).cast("int")


def negative_quotas(positives: Column, generic: Column) -> dict[str, Column]:
    """target, easy, ambiguous, hard, medium; a generic query's ambiguous share goes to hard."""
    target = target_negatives(positives)
    tenth = F.least(F.lit(4), F.greatest(F.lit(1), half_even(0.1 * target)))
    easy, ambiguous = tenth, F.when(generic == 1, F.lit(0)).otherwise(tenth)
    hard = half_even(0.4 * target) + F.when(generic == 1, tenth).otherwise(F.lit(0))
    return {"target": target, "easy": easy, "ambiguous": ambiguous, "hard": hard, "medium": target - easy - ambiguous - hard}


def rank_bucket(rank: Column) -> Column:
    return F.when(rank.between(1, 10), "ambiguous").when(rank.between(11, 75), "hard").when(rank.between(76, 250), "medium").otherwise("deep")


def bucket_negatives(candidates: DataFrame, terms: DataFrame, term: str, item: str) -> DataFrame:
    """Unknown candidates (rank, score) by rank bucket under the term's quotas, then the best from rank 11 to fill up, with weights.

    terms: term, positives, generic, known_score (median score of known positives, or null).
    """
    quotas = terms.withColumns(negative_quotas(F.col("positives"), F.col("generic")))
    rows = candidates.join(quotas, term).withColumn("bucket", rank_bucket(F.col("rank")))
    quota = F.when(F.col("bucket") == "ambiguous", F.col("ambiguous")).when(F.col("bucket") == "hard", F.col("hard")).when(F.col("bucket") == "medium", F.col("medium")).otherwise(F.lit(0))
    rows = rows.withColumn("_in", first_n([term, "bucket"], [F.col("rank"), F.col(item)], quota).cast("int"))
    taken = F.sum("_in").over(Window.partitionBy(term))
    rows = rows.withColumn("_lack", F.greatest(F.col("target") - F.col("easy") - taken, F.lit(0)))
    spare = F.when((F.col("_in") == 0) & (F.col("rank") >= 11), 1).otherwise(0)
    rows = rows.withColumn("_spare", spare)
    rows = rows.withColumn("_fill", F.when((F.col("_spare") == 1) & first_n([term, "_spare"], [F.col("rank"), F.col(item)], F.col("_lack")), 1).otherwise(0))
    rows = rows.where((F.col("_in") == 1) | (F.col("_fill") == 1)).withColumn("bucket", F.when(F.col("_in") == 1, F.col("bucket")).otherwise("fill"))
    weight = F.when(F.coalesce(F.col("score") >= F.col("known_score"), F.lit(False)), 0.1).when(F.col("bucket") == "ambiguous", 0.2).when(F.col("bucket") == "hard", 0.6).otherwise(0.8)
    return rows.select(term, item, "rank", "score", "bucket", weight.alias("weight"))


def test_like_groups(candidates: DataFrame, positives: DataFrame, term: str, item: str, top_n: int) -> DataFrame:
    """All positives (missing ones forced in at rank 0) and the best unknown candidates up to top_n, with tier and confidence."""
    known = positives.select(term, item).distinct().withColumn("label", F.lit(1))
    rows = candidates.select(term, item, "rank", "score").join(known, [term, item], "full").withColumns({"label": F.coalesce("label", F.lit(0)), "forced": F.col("rank").isNull().cast("int")}).withColumns({"rank": F.coalesce("rank", F.lit(0)), "score": F.coalesce("score", F.lit(0.0))})
    room = top_n - F.sum("label").over(Window.partitionBy(term))
    rows = keep(rows.withColumn("_room", room), (F.col("label") == 1) | first_n([term, "label"], [F.col("rank"), F.col(item)], F.col("_room")))
    tier = F.when(F.col("label") == 1, "positive").when(F.col("rank") <= 10, "ambiguous").when(F.col("rank") <= 50, "hard").otherwise("medium")
    confidence = F.when(F.col("label") == 1, 1.0).when(F.col("rank") <= 10, 0.15).when(F.col("rank") <= 50, 0.50).otherwise(0.85)
    return rows.select(term, item, "rank", "score", "label", "forced", tier.alias("tier"), confidence.alias("confidence"))


def _met(rows: DataFrame, pool: DataFrame, keys: list[str], how: str) -> DataFrame:
    """rows with the item of the pool that their try asks for.  A large pool is hashed part by part, so rows are dealt but not sorted."""
    on = reduce(lambda x, k: x & (F.col(f"a_{k}") == F.col(f"b_{k}")), keys, F.col("_want") == F.col("_at"))
    small = small_side(pool, POOL_BYTES)
    return rows.join(pool.hint("shuffle_hash") if small is pool else small, on, how)


def _known_among(doubtful: DataFrame, known: DataFrame, term: str, item: str) -> DataFrame:
    """Those of the doubtful (term, _other) that are known pairs; few of them are sent to the known pairs, not these to them."""
    asked = stored(doubtful.select(term, "_other").distinct(), "doubtful")
    return stored(known.select(term, F.col(item).alias("_other")).join(small_side(asked), [term, "_other"]).distinct(), "known-drawn")


def pool_negatives(pairs: DataFrame, catalog: DataFrame, pools: list[tuple[str, list[str], Column | None]], known: DataFrame, term: str, item: str, seed: str) -> DataFrame:
    """One negative a pair and strategy, from the first of the strategy's key sets whose pool has one.

    pools: (type, catalog columns that must be equal, condition on a_* source and b_* candidate columns).  A pool is drawn by number: its
    items are numbered in hash order and each pair tries up to TRIES from a hashed start, so a pool of any size costs a pair the same.  Tries
    go in rounds, and only pairs without a negative go on to the next.  The first round is one row a pair with a column for each pool.  A
    pair carries 64 bits of its term's known items, and only a candidate whose bit is set is looked up among them.
    """
    kind_of = catalog.schema[item].dataType
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c), F.lit(64)).cast("int"))
    others, result = [c for c in catalog.columns if c != item], [f"_o{i}" for i in range(len(pools))]
    pairs_known = stored(known.select(term, item).distinct(), "known")
    pairs, known = pairs_known if known is pairs else pairs.select(term, item).distinct(), pairs_known
    bits = known.where(F.col(item).isNotNull()).groupBy(term).agg(F.bit_or(bit(F.col(item).cast(kind_of))).alias("_bits"))
    source = pairs.join(catalog, item).select(term, item, *[F.col(c).alias(f"a_{c}") for c in others])
    source = stored(source.join(bits, term, "left").fillna(0, ["_bits"]), "pairs")
    doubt = lambda c: bit(c).bitwiseAND(F.col("_bits")) != 0
    n, tables, wide = catalog.count(), [], source
    for i, (kind, keys, condition) in enumerate(pools):
        hashed = catalog.withColumn("_hash", keyed_hash(f"{seed}:{kind}", F.col(item)))
        if keys:
            w = Window.partitionBy(*keys)
            numbered = hashed.withColumns({"_at": F.row_number().over(w.orderBy("_hash", item)) - 1, "_size": F.count(F.lit(1)).over(w)})
        else:
            numbered = number_rows(stored(hashed, "hashed"), ["_hash", item], "_at").withColumn("_size", F.lit(n).cast("long"))
        b = stored(numbered.select(F.col(item).alias("_other"), F.col("_at").cast("long").alias("_at"), "_size", *[F.col(c).alias(f"b_{c}") for c in others]), "pool")
        sizes = small_side(stored(b.select(*[F.col(f"b_{k}").alias(f"a_{k}") for k in keys], "_size").distinct(), "sizes")) if keys else None
        sized = lambda rows, sizes=sizes, keys=keys: rows.join(sizes, [f"a_{k}" for k in keys], "left") if keys else rows.withColumn("_size", F.lit(n).cast("long"))
        start = keyed_hash(f"{seed}:{kind}", F.col(term), F.col(item))
        holds = F.coalesce((F.col("_other") != F.col(item)) & (condition if condition is not None else F.lit(True)), F.lit(False))
        b = b.drop("_size")
        tables.append((b, sized, start, holds))
        tried = sized(wide).withColumn("_want", F.try_mod(start, F.col("_size")))
        wide = _met(tried, b, keys, "left").select(*wide.columns, F.when(holds, F.col("_other")).alias(result[i]))
    wide = stored(wide, "first-tries")
    doubtful = F.explode(F.filter(F.array(*result), lambda o: o.isNotNull() & doubt(o)))
    drawn = small_side(_known_among(wide.select(term, "_bits", doubtful.alias("_other")), known, term, item))
    # few of the pairs with a doubtful candidate have a known one; those, and no others, lose it
    drawn = drawn.groupBy(term).agg(F.collect_set("_other").alias("_drawn"))
    wide = wide.join(small_side(stored(drawn, "known-of-terms")), term, "left").withColumns({c: F.when(~F.coalesce(F.array_contains("_drawn", F.col(c)), F.lit(False)), F.col(c)) for c in result}).drop("_drawn")
    late = []
    for i, (kind, keys, _) in enumerate(pools):
        b, sized, start, holds = tables[i]
        rest, at = stored(sized(wide.where(F.col(result[i]).isNull())).where(F.col("_size") > ROUNDS[0]).drop(*result), "untried"), ROUNDS[0]
        for end in ROUNDS[1:]:
            if rest.isEmpty():
                break
            tried = rest.where(F.col("_size") > at).withColumn("_try", F.explode(F.sequence(F.lit(at), F.least(F.lit(end), F.col("_size").cast("int")) - 1)))
            found = _met(tried.withColumn("_want", (start + F.col("_try")) % F.col("_size")), b, keys, "inner").where(holds)
            found = stored(found.select(term, item, "_other", "_try", doubt(F.col("_other")).alias("_doubt")), "tried")
            drawn = _known_among(found.where("_doubt"), known, term, item)
            found = found.join(small_side(drawn), [term, "_other"], "left_anti")
            found = stored(keep(found, first_n([term, item], [F.col("_try")], 1)).select(term, item, "_other"), "negatives")
            late.append(found.select(term, item, *[(F.col("_other") if j == i else F.lit(None).cast(kind_of)).alias(c) for j, c in enumerate(result)]))
            if end < TRIES:
                rest, at = stored(rest.join(found.select(term, item), [term, item], "left_anti"), "untried"), end
    every = reduce(DataFrame.unionByName, late, wide.select(term, item, *result))
    named = F.array(*[F.struct(F.col(c).alias("_o"), F.lit(kind).alias("negative_type")) for c, (kind, *_) in zip(result, pools, strict=True)])
    rows = every.select(term, F.col(item).alias("source_item"), F.inline(named)).where(F.col("_o").isNotNull())
    return rows.select(term, F.col("_o").alias(item), "source_item", "negative_type")


def dedup_by_type(negatives: DataFrame, term: str, item: str, priority: list[str] = TYPE_PRIORITY) -> DataFrame:
    order = reduce(lambda c, t: c.when(F.col("negative_type") == t[1], t[0]), enumerate(priority), F.when(F.lit(False), -1)).otherwise(len(priority))
    return keep(negatives, first_n([term, item], [order, F.col("source_item")], 1))


def downsample_by_type(negatives: DataFrame, target: int, key: list[str], seed: str) -> DataFrame:
    """Each type keeps its share of the target, rows in hash order.

    Rows are counted by type and by the 12 leading bits of their hash, and only those up to the bits where a type's share is full are
    dealt by type and ordered.  The largest such bits are a literal, so Catalyst drops other rows before windows over the key.
    """
    hashed = negatives.withColumn("_hash", keyed_hash(seed, *[F.col(k) for k in key])).withColumn("_lead", F.coalesce(F.shiftright("_hash", 48).cast("int"), F.lit(-1)))
    leads = stored(hashed.groupBy("negative_type", "_lead").agg(F.count(F.lit(1)).alias("_n")), "leads")
    counts = leads.groupBy("negative_type").agg(F.sum("_n").alias("_n"))
    counts = counts.crossJoin(F.broadcast(counts.agg(F.sum("_n").alias("_all")))).withColumn("_quota", half_even(target * F.col("_n") / F.col("_all")))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy("negative_type").orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = leads.withColumn("_ahead", ahead).drop("_n").join(F.broadcast(counts), "negative_type").where((F.col("_all") <= target) | (F.col("_ahead") < F.col("_quota")))
    last = stored(needed.groupBy("negative_type").agg(F.max("_lead").alias("_last"), F.first("_n").alias("_n"), F.first("_all").alias("_all"), F.first("_quota").alias("_quota")), "shares")
    rows = hashed.where(F.col("_lead") <= F.lit(last.agg(F.max("_last")).first()[0])).join(F.broadcast(last), "negative_type").where(F.col("_lead") <= F.col("_last"))
    return keep(rows, (F.col("_all") <= target) | first_n("negative_type", [F.col("_hash"), *[F.col(k) for k in key]], F.col("_quota"))).drop("_n", "_all", "_quota", "_hash", "_lead", "_last")


def type_weight(kind: Column) -> Column:
    return reduce(lambda c, t: c.when(kind == t[0], t[1]), TYPE_WEIGHTS.items(), F.when(F.lit(False), 0.0)).otherwise(DEFAULT_TYPE_WEIGHT)


def schedule(epoch: int, easy_epochs: int = 1, medium_epochs: int = 2) -> list[str]:
    return EASY if epoch < easy_epochs else MEDIUM if epoch < medium_epochs else ALL_TYPES


def curriculum(candidates: DataFrame, terms: DataFrame, term: str, item: str, epoch: int, ratio: int, seed: str) -> DataFrame:
    """Typed candidates under an epoch's schedule: a quota for each type, then the term's target; earlier types win repeats."""
    kinds = schedule(epoch)
    target = (ratio * F.col("positives")).cast("int")
    order = reduce(lambda c, t: c.when(F.col("negative_type") == t[1], t[0]), enumerate(kinds), F.when(F.lit(False), -1))
    rows = candidates.where(F.col("negative_type").isin(kinds)).join(terms.select(term, "positives"), term).withColumns({"_kind": order, "_target": target, "_hash": keyed_hash(seed, F.col(term), F.col("negative_type"), F.col(item))})
    rows = keep(rows, first_n([term, item], [F.col("_kind")], 1))
    rows = keep(rows, first_n([term, "negative_type"], [F.col("_hash"), F.col(item)], F.greatest(F.lit(1), F.ceil(F.col("_target") / len(kinds)))))
    return keep(rows, first_n(term, [F.col("_kind"), F.col("_hash"), F.col(item)], F.col("_target"))).drop("_kind", "_target", "_hash")


def triage_false_negatives(df: DataFrame) -> DataFrame:
    """status, reason and weight from known flags, model signals and hardness.

    Columns: is_known, same_family, purged_item, purged_family, ce_prob, teacher_prob, embedding, contradiction, votes, hardness.
    """
    c = F.col
    signals = sum((F.coalesce(x, F.lit(False)).cast("int") for x in (c("ce_prob") >= 0.90, c("teacher_prob") >= 0.90, c("embedding") >= 0.93)), F.lit(0))
    many, high = (signals >= 2) | (F.coalesce("votes", F.lit(0)) >= 2), F.coalesce((c("embedding") >= 0.93) & (c("contradiction") == 0), F.lit(False))
    reason = F.when(c("is_known") == 1, "known_positive").when(c("same_family") == 1, "same_family").when(c("purged_item") == 1, "purged_item").when(c("purged_family") == 1, "purged_family").when(many, "multi_model").when(high, "high_embedding").otherwise("none")
    df = df.withColumns({"signals": signals, "reason": reason})
    status = F.when(c("reason").isin("known_positive", "same_family", "purged_item", "purged_family"), "excluded").when(c("reason") != "none", "suspicious").otherwise("train")
    base = F.when(c("hardness") >= 0.75, 0.75).when(c("hardness") >= 0.45, 0.90).otherwise(1.0)
    unsure = F.when(c("ce_prob").between(0.35, 0.65), F.least(base, F.lit(0.20))).otherwise(base)
    return df.withColumn("status", status).withColumn("weight", F.when(c("status") == "excluded", 0.0).when(c("status") == "suspicious", 0.05).otherwise(unsure))


def pu_triage(df: DataFrame) -> DataFrame:
    """exclude_reason and weight of candidates with label, rank, ce_prob and is_suspicious."""
    c, unknown = F.col, F.col("label") == 0
    reason = F.when(c("is_suspicious") == 1, "suspicious").when(unknown & (c("rank") <= 3), "top_rank").when(unknown & (c("ce_prob") > 0.90), "high_score").otherwise("none")
    return df.withColumns({"exclude_reason": reason, "weight": F.when(reason != "none", 0.0).when(unknown & c("ce_prob").between(0.50, 0.90), 0.5).otherwise(1.0)})


def cap_negatives(df: DataFrame, term: str, item: str, per_positive: int, seed: str) -> DataFrame:
    """All positives, and of each term's negatives per_positive for each positive, in hash order."""
    positives = F.sum("label").over(Window.partitionBy(term))
    rows = df.withColumn("_cap", per_positive * positives)
    return keep(rows, (F.col("label") == 1) | first_n([term, "label"], [keyed_hash(seed, F.col(term), F.col(item)), F.col(item)], F.col("_cap"))).drop("_cap")


def model_hard(df: DataFrame, term: str, item: str, score: str, most: int = 6) -> DataFrame:
    rows = keep(df, first_n(term, [F.desc(score), F.asc(item)], most))
    return rows.withColumn("weight", clip(0.35 - 0.2 * F.col(score), 0.15, 0.35))


def transductive(df: DataFrame, term: str, item: str, most: int = 30) -> DataFrame:
    """Structural positives (label 1, weight by tier) and each term's least likely rows by both models (label 0)."""
    positives = df.where("structural = 1").select(term, item, F.lit(1).alias("label"), F.lit("structural").alias("origin"))
    low = df.where("structural = 0 and p1 < 0.5 and p2 < 0.5").withColumn("_p", F.col("p1") + F.col("p2"))
    negatives = keep(low, first_n(term, [F.col("_p"), F.col(item)], most)).select(term, item, F.lit(0).alias("label"), F.lit("two_model").alias("origin"))
    return positives.unionByName(negatives)


def pseudo_label_weight(both: Column, models: Column, fast: Column, order: Column) -> Column:
    return F.when(both & models, 1.0).when(both, 0.90).when(fast, 0.80).when(order, 0.70).otherwise(0.55)


def fixed_universe(retrieved: DataFrame, positives: DataFrame, term: str, item: str, size: int, oracle: bool) -> DataFrame:
    """The best candidates of each term; oracle: missing positives take the last places, so the size stays."""
    top = retrieved.where(F.col("rank") <= size).select(term, item, "rank", F.lit(0).alias("forced"))
    known = positives.select(term, item).distinct()
    if oracle:
        missing = known.join(top, [term, item], "left_anti")
        counts = missing.groupBy(term).agg(F.count(F.lit(1)).alias("_missing"))
        kept = top.join(known.withColumn("_known", F.lit(1)), [term, item], "left").join(counts, term, "left")
        n = F.count(F.lit(1)).over(Window.partitionBy(term))
        room = F.greatest(n - F.coalesce("_missing", F.lit(0)), F.lit(0))
        kept = keep(kept.withColumn("_room", room), F.row_number().over(Window.partitionBy(term).orderBy(F.desc(F.coalesce("_known", F.lit(0))), "rank", item)) <= F.col("_room")).select(term, item, "rank", "forced")
        top = kept.unionByName(missing.join(top.select(term).distinct(), term, "left_semi").select(term, item, F.lit(0).alias("rank"), F.lit(1).alias("forced")))
    return top.join(known.withColumn("label", F.lit(1)), [term, item], "left").fillna(0, ["label"])


def teacher_pairs(df: DataFrame, key: str, most: int, seed: str) -> DataFrame:
    """Pairs worth a teacher's answer, by reason and hash."""
    c = F.col
    priority = F.when(c("label") == 1, 0).when(c("hardness") >= 0.75, 1).when(c("prob").between(0.35, 0.65), 2).when(c("disagreement") >= 0.20, 3).when(c("test_like") == 1, 4)
    names = F.element_at(F.array(*[F.lit(x) for x in ("positive", "hard", "uncertain", "disagreement", "test_like")]), c("priority") + 1)
    rows = df.withColumn("priority", priority).where("priority is not null").withColumn("reason", names)
    return rows.withColumn("_hash", keyed_hash(seed, c(key))).orderBy("priority", "_hash", key).limit(most).drop("_hash")


def uniform_batches(df: DataFrame, term: str, item: str, hardness: str, epoch: int, positives: int, negatives: int, terms_in_batch: int, seed: str) -> DataFrame:
    """For each term some positives, rotated by epoch, and its hardest negatives; batch: which group of terms in hash order."""
    w = Window.partitionBy(term, "label")
    turn = F.pmod(F.row_number().over(w.orderBy(item)) - 1 + F.lit(epoch * positives), F.count(F.lit(1)).over(w))
    place = F.when(F.col("label") == 1, turn).otherwise(F.row_number().over(w.orderBy(F.desc(hardness), item)) - 1)
    rows = df.withColumn("place", place).where(F.col("place") < F.when(F.col("label") == 1, positives).otherwise(negatives))
    order = number_rows(df.select(term).distinct().withColumn("_hash", keyed_hash(seed, F.col(term))), ["_hash", term], "_at")
    return rows.join(order.select(term, F.floor(F.col("_at") / terms_in_batch).cast("int").alias("batch")), term)
