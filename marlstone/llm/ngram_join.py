"""N-gram Jaccard join, size-aware: small sets by enumerated subsets, large sets by scanned inverted lists.

Two documents link when the Jaccard similarity of their shingle sets is 0.8 or more.  Texts that are equal are one set from
the start.  An exchange gives every batch the document frequencies of its shingles; ordered from rare to frequent, a set's first
fifth (its prefix) must share a shingle with the prefix of any partner, so a set whose prefix occurs nowhere else is done.

Small sets enumerate, for each size their partner may have, all subsets of the overlap that size requires; equal subsets are
links, with nothing to verify.  Larger sets are posted in inverted lists under their prefix.  The size where enumeration stops
is the one of least cost, from the counts of sizes and the mean length of the lists.

Lists are never expanded into all pairs.  Each list first links its members to one leader, the one with the smallest share of
unshared shingles; only members still in different components after that are paired, where sizes, prefix places and parity
bits (a bound on the difference) allow the similarity, and every pair is verified on whole sets.  Components are thus exact.  They are found by alternating large and small stars.
Tokens and nodes with many rows are joined in parts.

ngram_links() also counts each document's links.  For that every pair of different texts is verified, inside components too; equal
texts are weights of their text's links, so they are counted without being paired.

Defined results: without words n_shingles is 0 and the document is its own component; rows with one doc_id are one document
for links, each row counting its own shingles; a null doc_id links with nothing and is its own (null) component; no rows, no
result rows.  Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

LARGEST_SMALL = 24
BATCH_BYTES = 2 << 20
BITS = 2048
BLOCK = 4096
_INFO = "doc_id long, n int, active boolean, singles int, prefix array<long>, grams array<long>, bits binary"
_INFO_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("active", pa.bool_()), ("singles", pa.int32()), ("prefix", pa.list_(pa.int64())), ("grams", pa.list_(pa.int64())), ("bits", pa.binary())])
_MASK = 0xFFFFFFFFFFFF0000


def overlap_needed(n: int, m: int) -> int:
    """The least intersection i with 100 * i >= 80 * (n + m - i)."""
    return -(-4 * (n + m) // 9)


def prefix_length(n: int) -> int:
    return n - -(-4 * n // 5) + 1


def partner_sizes(n: int) -> range:
    return range(-(-4 * n // 5), 5 * n // 4 + 1)


def parity_bits(grams: np.ndarray) -> bytes:
    """BITS parities of the shingles dealt to them: two sets differ in at least as many shingles as their parities in bits."""
    return np.packbits(np.bincount((C.mix(grams) % C.U64(BITS)).astype(np.int64), minlength=BITS) & 1).tobytes()


def _sets(table: pa.Table) -> list[np.ndarray]:
    return C.shingle_sets(*C.hash_texts(C.texts_of(table["text"])))


FREQUENCY = C.summed(np.uint32)


def _info(docs: DataFrame, copies: DataFrame, n: int, fan_bits: int = C.FAN_BITS) -> DataFrame:
    """A row for each row of docs: its set's size, and for sets that may have a partner their prefix and all shingles.  Copies (batch, doc_id, text_hash) are never active."""
    base, _ = C.with_batches(docs.withColumns({"text_hash": F.xxhash64("text")}), "doc_id", ["doc_id", "text_hash"], n)
    copies = copies.groupBy("batch").agg(F.collect_list("doc_id").alias("ids"), F.collect_list("text_hash").alias("hashes"))

    def own_sets(table: pa.Table, copied: pa.Table) -> tuple[list[np.ndarray], list[bool], np.ndarray, np.ndarray]:
        """All rows' sets, which rows stand for their text, and the distinct keys of their sets with the number of sets."""
        known = {x for ids, hashes in zip(copied["ids"].to_pylist(), copied["hashes"].to_pylist(), strict=True) if ids for x in zip(ids, hashes, strict=True)}
        own = [d is not None and (d, h) not in known for d, h in zip(table["doc_id"].to_pylist(), table["text_hash"].to_pylist(), strict=True)]
        sets = _sets(table)
        keys, counts = np.unique(np.concatenate([np.empty(0, C.U64), *(s for s, o in zip(sets, own, strict=True) if o)]) & C.U64(_MASK), return_counts=True)
        return sets, own, keys, counts.astype(np.uint32)

    def ask(table: pa.Table, copied: pa.Table) -> pa.Table:
        if not table.num_rows:
            return C.BLOBS_ARROW.empty_table()
        return C.requests_table(table["batch"][0].as_py(), n, *own_sets(table, copied)[2:], fan_bits=fan_bits)

    def prefixes(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _INFO_ARROW.empty_table()
        sets, own, keys, _ = own_sets(table, answers)
        dfs = C.joined(answers.filter(answers["blob"].is_valid()), *FREQUENCY.answers)[0]
        rows = []
        for s, o in zip(sets, own, strict=True):
            size = len(s)
            if not o or not size:
                rows.append((size, False, 0, None, None, None))
                continue
            df = dfs[np.searchsorted(keys, s & C.U64(_MASK))]
            singles, k = int((df == 1).sum()), prefix_length(size)
            if singles >= k:
                rows.append((size, False, singles, None, None, None))
                continue
            first = s[np.lexsort((s, df))[singles:k]]
            rows.append((size, True, singles, first.view(np.int64), s.view(np.int64), parity_bits(s)))
        return pa.table([table["doc_id"].cast(pa.int64()).combine_chunks(), *(pa.array([r[i] for r in rows], f.type) for i, f in enumerate(list(_INFO_ARROW)[1:]))], schema=_INFO_ARROW)

    answers = C.exchange(base.groupBy("batch").cogroup(copies.groupBy("batch")).applyInArrow(C.trimmed(ask), C.BLOBS), FREQUENCY, n, fan_bits)
    none = F.lit(None).cast("array<long>")
    both = answers.select("batch", "bucket", "blob", none.alias("ids"), none.alias("hashes")).unionAll(copies.select("batch", F.lit(None).cast("long"), F.lit(None).cast("binary"), "ids", "hashes"))
    return base.groupBy("batch").cogroup(both.groupBy("batch")).applyInArrow(C.trimmed(prefixes), _INFO)


def boundary(sizes: dict[int, int], mean_list: float) -> int:
    """The largest size to enumerate, at the least total cost: subsets made, against lists scanned."""

    def subsets(n: int) -> int:
        return sum(comb(n, min(n, overlap_needed(n, m))) for m in partner_sizes(n))

    costs = [sum(sizes.get(n, 0) * (subsets(n) if n <= x else prefix_length(n) * mean_list) for n in range(1, LARGEST_SMALL + 1)) for x in range(LARGEST_SMALL + 1)]
    return costs.index(min(costs))


def _boundary(active: DataFrame) -> tuple[DataFrame, int, int, int]:
    """The inverted lists' rows, the largest size to enumerate, the number of rows, and the number of subsets."""
    posts = active.select("doc_id", "n", "singles", F.posexplode("prefix").alias("at", "token"))
    lengths = posts.groupBy("token").agg(F.count("*").alias("c"))
    scan, total = lengths.agg(F.coalesce(F.sum(F.col("c") * F.col("c")) / F.sum("c"), F.lit(0.0)), F.coalesce(F.sum("c"), F.lit(0))).first()
    sizes = {r[0]: r[1] for r in active.where(F.col("n") <= LARGEST_SMALL).groupBy("n").count().collect()}
    most = boundary(sizes, float(scan))
    subsets = sum(c * sum(comb(n, min(n, overlap_needed(n, m))) for m in partner_sizes(n) if m <= most) for n, c in sizes.items() if n <= most)
    return posts, most, int(total), subsets


def _subsets(active: DataFrame, most: int) -> DataFrame:
    """A row for each subset (key) that links two sets of at most most shingles, one of low and one of high shingles."""

    def enumerate_subsets(batches):
        for b in batches:
            keys, docs, lows, highs, sizes = [], [], [], [], []
            for doc, n, grams in zip(b["doc_id"].to_pylist(), b["n"].to_pylist(), b["grams"].to_pylist(), strict=True):
                values = C.mix(np.array(grams, np.int64).view(C.U64)).tolist()
                whole = sum(values)
                for m in partner_sizes(n):
                    if m <= most:
                        salt = min(n, m) * 0x9E3779B97F4A7C15 + max(n, m) * 0xBF58476D1CE4E5B9
                        made = [whole - sum(gone) + salt & (1 << 64) - 1 for gone in combinations(values, n - overlap_needed(n, m))]
                        keys += made
                        docs += [doc] * len(made)
                        lows += [min(n, m)] * len(made)
                        highs += [max(n, m)] * len(made)
                        sizes += [n] * len(made)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, C.U64).view(np.int64)), pa.array(docs, pa.int64()), pa.array(lows, pa.int32()), pa.array(highs, pa.int32()), pa.array(sizes, pa.int32())], names=["key", "doc_id", "low", "high", "n"])

    return active.where(F.col("n") <= most).select("doc_id", "n", "grams").mapInArrow(enumerate_subsets, "key long, doc_id long, low int, high int, n int")


def _small_links(active: DataFrame, most: int, subsets: int) -> DataFrame:
    """Links between sets of at most most shingles, as edges that join the same components.  A subset of many sets is joined in parts."""
    rows = _subsets(active, most)
    is_low, is_high = F.col("n") == F.col("low"), F.col("n") == F.col("high")
    ends = rows.groupBy("key").agg(F.min(F.when(is_low, F.col("doc_id"))).alias("a"), F.min(F.when(is_high, F.col("doc_id"))).alias("b"), F.count("*").alias("c")).where("a is not null and b is not null and c > 1")
    return C.split_join(rows, ends, "key", "c", subsets).select(F.col("doc_id").alias("u"), F.when(is_low, F.col("b")).otherwise(F.col("a")).alias("v")).where("u <> v").distinct()


def _small_pairs(active: DataFrame, most: int) -> DataFrame:
    """All links (u, v) between sets of at most most shingles."""
    rows = _subsets(active, most)
    low, high = rows.where("n = low").select("key", F.col("doc_id").alias("a")), rows.where("n = high").select("key", F.col("doc_id").alias("b"))
    return low.join(high, "key").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def _verified(pairs: DataFrame, active: DataFrame) -> DataFrame:
    """The pairs (u, v) that link, on whole sets.  A document of many pairs, such as a leader of near copies, is joined in parts; pairs is a table."""
    sets, total = active.select("doc_id", "grams"), pairs.count()

    def with_sets(rows: DataFrame, end: str, grams: str) -> DataFrame:
        counts = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("c"))
        return C.split_join(rows, sets.toDF(end, grams).join(counts, end), end, "c", total).drop("c")

    shared = F.size(F.array_intersect("gu", "gv"))
    return with_sets(with_sets(pairs, "u", "gu"), "v", "gv").where(100 * shared >= 80 * (F.size("gu") + F.size("gv") - shared)).select("u", "v").distinct()


def _fits(n: Column, m: Column) -> Column:
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _open_pairs(active: DataFrame, labels: DataFrame, small: int, total: int) -> DataFrame:
    """Pairs (u, v) of one list, still in different components, whose sizes, prefix places and parities allow the similarity.

    Within a list only members outside its most common component are held against all members.  A long list is cut into
    blocks of either, so a task's rows are bounded; pairs are made and dropped inside the task.
    """
    docs = active.join(labels, active["doc_id"] == labels["node"], "left").select("doc_id", "n", "singles", F.coalesce("component", "doc_id").alias("label"), "prefix", "bits")
    posts = docs.select("doc_id", "n", "singles", "label", "bits", F.posexplode("prefix").alias("at", "token"))
    sizes = posts.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    lists = sizes.groupBy("token").agg(F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("all")).where("all > most.c")
    lists = lists.select("token", "all", F.col("most.label").alias("core"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("most.c")) / BLOCK).cast("int").alias("outer_blocks"))
    rows = C.split_join(posts, lists, "token", "all", total)
    place = F.xxhash64("doc_id")
    every = rows.select("*", F.lit(False).alias("outer"), F.pmod(place, "blocks").cast("int").alias("mb"), F.explode(F.sequence(F.lit(0), F.col("outer_blocks") - 1)).alias("ob"))
    outside = rows.where("label <> core").select("*", F.lit(True).alias("outer"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("mb"), F.pmod(place, "outer_blocks").cast("int").alias("ob"))
    # where list and outsiders are one block, an outsider needs no second row: it meets everyone as a member
    single = F.col("blocks") == 1
    met = every.unionAll(outside.where(~single).select(every.columns))
    key = F.xxhash64("token", "ob", "mb").alias("key")
    met = met.select(key, "doc_id", "n", "singles", (F.col("at") + F.col("singles")).alias("at"), "label", (F.col("label") != F.col("core")).alias("outsider"), (F.col("outer") | single).alias("may_lead"), "bits")

    def pair_up(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            keys = t["key"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            held = t.slice(cut)
            if cut:
                yield from _pairs_of(t.slice(0, cut), small)
        if held is not None and held.num_rows:
            yield from _pairs_of(held, small)

    return met.repartition("key").sortWithinPartitions("key").mapInArrow(pair_up, "u long, v long").distinct()


def _pairs_of(t: pa.Table, small: int):
    """All allowed pairs of rows with one key.  Rows are sorted by key, and each step holds every row against the one d places on."""
    key, doc, n, singles, at, label = (t[c].to_numpy() for c in ("key", "doc_id", "n", "singles", "at", "label"))
    n, singles, at = n.astype(np.int64), singles.astype(np.int64), at.astype(np.int64)
    outsider, lead = t["outsider"].to_numpy(zero_copy_only=False).astype(bool), t["may_lead"].to_numpy(zero_copy_only=False).astype(bool)
    bits = np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint64).reshape(len(key), BITS // 64)
    i, d, out = np.arange(len(key)), 0, []
    while True:
        d += 1
        i = i[i + d < len(key)]
        i = i[key[i] == key[i + d]]
        if not len(i):
            break
        j = i + d
        ok = (label[i] != label[j]) & ((outsider[i] & lead[i]) | (outsider[j] & lead[j])) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])) & (np.maximum(n[i], n[j]) > small)
        a, b = i[ok], j[ok]
        need = 4 * (n[a] + n[b])  # nine times the overlap needed
        ok = (9 * (np.minimum(at[a], at[b]) + np.minimum(n[a] - at[a], n[b] - at[b])) >= need) & (9 * np.minimum(n[a] - singles[a], n[b] - singles[b]) >= need)
        a, b, need = a[ok], b[ok], need[ok]
        for k in range(0, len(a), 1 << 16):
            x, y = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
            apart = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
            ok = 9 * (n[x] + n[y] - apart) >= 2 * need[k : k + (1 << 16)]
            out.append((np.minimum(doc[x[ok]], doc[y[ok]]), np.maximum(doc[x[ok]], doc[y[ok]])))
    if out:
        u, v = (np.concatenate([o[k] for o in out]) for k in (0, 1))
        if len(u):
            u, v = np.unique(np.stack([u, v]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node with an edge (u, v), by alternating large and small stars."""
    edges = C.materialized(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state(edges)
    total = before[0]
    while total:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("c"))
        large = C.split_join(both, least, "u", "c", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = C.split_join(large, least, "u", "c", 2 * total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        old, edges = edges, C.materialized(small, "edges")
        for path in old.inputFiles()[:1]:
            C.remove_dir(edges.sparkSession, path.rsplit("/", 1)[0])
        after = state(edges)
        if after == before:
            break
        before, total = after, after[0]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select("v", "v").distinct())


def ngram_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs."""
    batches = C.n_batches(docs, BATCH_BYTES)  # before columns are dropped: Catalyst would then guess the texts' share of the size
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    digests = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select(C.batch_of(batches, "doc_id", "text"), "doc_id", F.md5("text").alias("digest"), F.xxhash64("text").alias("text_hash"))
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1")
    copies = C.materialized(C.split_join(digests, first, "digest", "c", docs.count()).where("doc_id <> rep").select("batch", "doc_id", "text_hash", "rep"), "copies")
    info = C.materialized(_info(docs, copies, batches), "sets")
    active = info.where("active")

    posts, small, total, subsets = _boundary(active)
    repeated = docs.groupBy("doc_id").count().where("count > 1").select("doc_id")
    links = _small_links(active, small, subsets).unionAll(copies.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))

    posts = posts.where(F.col("n") >= -(-4 * (small + 1) // 5)).withColumn("at", F.col("at") + F.col("singles"))
    leaders = posts.groupBy("token").agg(F.min_by(F.struct("doc_id", "n"), F.struct(F.col("singles") / F.col("n"), F.col("doc_id"))).alias("leader"), F.count("*").alias("c")).where("c > 1")
    large_enough = lambda n, m: F.greatest(n, m) > small
    stars = C.split_join(posts, leaders, "token", "c", total).where((F.col("doc_id") != F.col("leader.doc_id")) & _fits(F.col("n"), F.col("leader.n")) & large_enough(F.col("n"), F.col("leader.n")))
    tried = C.materialized(stars.select(F.least("doc_id", "leader.doc_id").alias("u"), F.greatest("doc_id", "leader.doc_id").alias("v")).distinct(), "tried")
    links = C.materialized(links.unionAll(_verified(tried, active)), "links")
    labels = C.materialized(components(links), "labels")

    pairs = C.materialized(_open_pairs(active.where(F.col("n") >= -(-4 * (small + 1) // 5)), labels, small, total).join(tried, ["u", "v"], "left_anti"), "open-pairs")
    more = C.materialized(_verified(pairs, active), "more-links")
    if not more.isEmpty():
        labels = C.materialized(components(links.unionAll(more)), "labels")

    return _named(info, copies, labels)


def _named(info: DataFrame, copies: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row's component: that of the text's first document, or of the document itself; of a repeated doc_id, the smallest.

    The first document of many copies is joined in parts."""
    own = copies.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    rows = info.select("doc_id", F.col("n").cast("long").alias("n_shingles")).join(own, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    counts = rows.where("rep is not null").groupBy("rep").agg(F.count(F.lit(1)).alias("c"))
    named = counts.join(labels, counts["rep"] == labels["node"], "left").select("rep", F.coalesce("component", "rep").alias("component_id"), "c")
    out = C.split_join(rows.where("rep is not null"), named, "rep", "c", info.count())
    return out.select("doc_id", "n_shingles", "component_id").unionAll(rows.where("rep is null").select("doc_id", "n_shingles", F.col("rep").alias("component_id")))


def ngram_links(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links, the number of other documents it links with, for each row of docs."""
    batches = C.n_batches(docs, BATCH_BYTES)
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    has_words = F.col("doc_id").isNotNull() & F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    # a node is one text of one document: the document, or of a document with several texts a hash of both
    texts = docs.where(has_words).select("doc_id", F.md5("text").alias("digest")).distinct()
    many = C.materialized(texts.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("many")), "many")
    if not many.isEmpty():
        docs = docs.join(many, "doc_id", "left")
        docs = docs.select(F.when(F.col("many") & has_words, F.xxhash64("doc_id", F.md5("text"))).otherwise(F.col("doc_id")).alias("doc_id"), "text", F.col("doc_id").alias("owner"))
    else:
        docs = docs.withColumn("owner", F.col("doc_id"))
    digests = docs.where(has_words).select(C.batch_of(batches, "doc_id", "text"), "doc_id", "owner", F.md5("text").alias("digest"), F.xxhash64("text").alias("text_hash")).distinct()
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1")
    copies = C.materialized(C.split_join(digests, first, "digest", "c", docs.count()).where("doc_id <> rep").select("batch", "doc_id", "text_hash", "rep"), "copies")
    owners = C.materialized(docs.where("doc_id <> owner").select("doc_id", "owner").distinct(), "owners")
    info = C.materialized(_info(docs.select("doc_id", "text"), copies, batches), "sets")
    active = info.where("active")
    _, small, total, _ = _boundary(active)
    alone = spark.createDataFrame([], "node long, component long")
    pairs = C.materialized(_open_pairs(active.where(F.col("n") >= -(-4 * (small + 1) // 5)), alone, small, total), "open-pairs")
    links = C.materialized(_verified(pairs, active).unionAll(_small_pairs(active, small)), "links")

    owned = lambda df, c: df.join(owners.select(F.col("doc_id").alias(c), F.col("owner").alias("_o")), c, "left").withColumn(c, F.coalesce("_o", c)).drop("_o")
    shared = copies.join(owners.select(F.col("doc_id"), F.lit(True).alias("a")), "doc_id", "left").join(owners.select(F.col("doc_id").alias("rep"), F.lit(True).alias("b")), "rep", "left").where("a or b")
    edges = links.unionAll(shared.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    labels = C.materialized(components(owned(owned(edges, "u"), "v")), "labels")

    # nodes that stand for a whole document count as weights of their text
    members = C.materialized(digests.select("doc_id", "owner").join(copies.select("doc_id", "rep"), "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id")), "members")
    whole = members.where("doc_id = owner")
    weights = whole.groupBy("rep").agg(F.count("*").alias("w"))
    near = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = near.join(weights, near["v"] == weights["rep"]).groupBy("u").agg(F.sum("w").alias("around"))
    one = whole.join(weights, "rep").join(around, whole["rep"] == F.col("u"), "left").select("owner", (F.coalesce("around", F.lit(0)) + F.col("w") - 1).alias("c"))
    # documents with several texts are paired out, so that each counts once
    parts = members.where("doc_id <> owner").select(F.col("rep").alias("u"), F.col("owner").alias("x"))
    reached = parts.select("x", "u").unionAll(parts.join(near, "u").select("x", F.col("v").alias("u"))).distinct()
    met = reached.join(members.select(F.col("rep").alias("u"), "doc_id", F.col("owner").alias("y")), "u").where("x <> y").select("x", "y", (F.col("doc_id") == F.col("y")).alias("plain")).distinct()
    several = met.select(F.col("x").alias("owner"), "y").unionAll(met.where("plain").select(F.col("y").alias("owner"), F.col("x").alias("y"))).distinct().groupBy("owner").agg(F.count("*").alias("c"))
    counts = one.unionAll(several).groupBy("owner").agg(F.sum("c").alias("n_links"))

    rows = info.select(F.col("doc_id").alias("node"), "n").join(copies.select(F.col("doc_id").alias("node"), "rep"), "node", "left")
    rows = owned(owned(rows.select(F.col("node").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("rep", "node").alias("rep")), "doc_id"), "rep")
    rows = rows.join(labels.toDF("doc_id", "mine"), "doc_id", "left").join(labels.toDF("rep", "theirs"), "rep", "left").join(counts.withColumnRenamed("owner", "doc_id"), "doc_id", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("mine", "theirs", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, with all their columns; rows without doc_id stay."""
    gone = "gone"
    while gone in docs.columns:
        gone += "_"
    keep = ngram_components(docs).where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(keep, docs["doc_id"] == F.col(gone), "left_anti")
