"""Benchmark decontamination with SimHash windows and a multi-index Hamming search.

Benchmark items are the query set.  A document's windows as long as an item are fingerprinted by SimHash over their five-word
shingles.  The 128 bits are cut into 13 blocks; two fingerprints within 36 bits agree to within 2 bits in one block at least,
so tables of every block value within 2 bits of an item's find all items within the radius.  Candidates within it are then
verified by exact weighted Jaccard similarity of their shingle multisets, 0.8 or more.  At that similarity fingerprints
differ in about 19 bits, with a deviation of 4, so the radius lies four deviations out.  Windows are fingerprinted only where enough of
their shingles occur in some item for the similarity to be reachable, which loses nothing.

Items are taken in blocks of ITEM_BLOCK, one pass over the documents each; a block is what is sent to the executors.

Defined results: items without words match nothing; an item without item_id counts like any other and is reported as null; items or documents of under five words are one shingle of all their words;
a document shorter than an item is one window; null texts are empty; of equal windows the first is reported; repeated item
rows report each distinct item_id; no rows, no result rows.  Other columns are ignored by find_leaks() and passed on by
drop_leaks(), whatever their names.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, grouped, hash_texts, lookup, mix, prefix_sums, rolling, texts_of, windows_at

SHINGLE = 5
BITS, RADIUS = 128, 36
CUTS = [*range(0, 120, 10), 120, 128]
FLIPS = RADIUS // (len(CUTS) - 1)
ITEM_BLOCK = 4096
DOCS_AT_ONCE = 512
JUDGED = 50_000


def shingles(h: np.ndarray) -> np.ndarray:
    return rolling(h, SHINGLE) if len(h) >= SHINGLE else rolling(h, len(h)) ^ U64(len(h)) if len(h) else h


def signs(grams: np.ndarray) -> np.ndarray:
    """128 signs for each shingle."""
    raw = np.stack([mix(grams), mix(grams ^ U64(0x9E3779B97F4A7C15))], 1)
    return np.unpackbits(raw.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: a shingle weighs as often as it occurs."""
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


class Items:
    """A block of items with its Hamming index."""

    def __init__(self, rows: list[tuple[int, str]], threshold: float):
        self.threshold = threshold
        self.ids, self.grams, self.n_words = [], [], []
        for item, text in sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
            words = hash_texts([text.encode()])[0]
            if len(words):
                self.ids.append(item)
                self.n_words.append(len(words))
                self.grams.append(shingles(words))
        self.judged: dict[tuple[int, int], list[tuple[int, float]]] = {}  # windows' matches, kept between batches
        self.bags = [Counter(g.tolist()) for g in self.grams]
        self.known = np.unique(np.concatenate(self.grams)) if self.grams else np.empty(0, U64)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.known >> U64(44)).astype(np.int64)] = True
        self.prints = np.array([signs(g).sum(0, dtype=np.int32) > 0 for g in self.grams], bool).reshape(-1, BITS)
        self.wide = -(-len(self.ids) // 8)
        self.tables = []
        for a, b in zip(CUTS[:-1], CUTS[1:], strict=True):
            values = self.block(self.prints, a, b)
            table = np.zeros((1 << (b - a), max(1, self.wide)), np.uint8)
            flips = [sum(1 << i for i in c) for n in range(FLIPS + 1) for c in combinations(range(b - a), n)]
            for i, v in enumerate(values.tolist()):
                table[[v ^ f for f in flips], i // 8] |= 1 << i % 8
            self.tables.append(table)

    @staticmethod
    def block(prints: np.ndarray, a: int, b: int) -> np.ndarray:
        return prints[:, a:b] @ (1 << np.arange(b - a))

    def near(self, prints: np.ndarray):
        """(window, item) pairs within the radius."""
        found = reduce(np.bitwise_or, (t[self.block(prints, a, b)] for t, a, b in zip(self.tables, CUTS[:-1], CUTS[1:], strict=True)))
        w, i = np.nonzero(np.unpackbits(found, axis=1, bitorder="little")[:, : len(self.ids)])
        ok = (prints[w] != self.prints[i]).sum(1) <= RADIUS
        return w[ok], i[ok]

    def matches(self, h: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(text, item, first word, words, similarity), the best window of each text and item."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        if len(self.judged) > JUDGED:
            self.judged.clear()
        lengths = sorted(set(self.n_words))
        total, grams = prefix_sums(h), rolling(h, SHINGLE)
        hit = np.zeros(len(grams), bool)
        sure = np.flatnonzero(self.sieve[(grams >> U64(44)).astype(np.int64)])
        hit[sure] = lookup(grams[sure], self.known)[0]
        for a in ends[1:-1].tolist():
            hit[max(0, a - SHINGLE + 1) : a] = False
        seen = np.concatenate([[0], np.cumsum(hit)])
        hits = np.flatnonzero(hit)
        share = self.threshold / (1 + self.threshold)

        def judge(starts: np.ndarray, n: int, keys: np.ndarray, bag_of) -> None:
            """Windows of n words at starts.  Each distinct one (key) is fingerprinted once; bag_of(places) gives their shingles."""
            order, at = grouped(keys)
            new = [int(p) for p, k in zip(order[at], keys[order[at]].tolist(), strict=True) if (n, k) not in self.judged]
            for i in range(0, len(new), 2000):
                places = np.array(new[i : i + 2000])
                bags = bag_of(places)
                found: list[list[tuple[int, float]]] = [[] for _ in new[i : i + 2000]]
                kinds, inverse = np.unique(bags, return_inverse=True)
                prints = signs(kinds)[inverse.reshape(bags.shape)].sum(1, dtype=np.int32) > 0
                for w, item in zip(*self.near(prints), strict=True):
                    x = similarity(Counter(bags[w].tolist()), self.bags[item])
                    if x >= self.threshold:
                        found[w].append((int(item), x))
                self.judged.update(((n, int(keys[p])), f) for p, f in zip(places, found, strict=True))
            for p, k in enumerate(keys.tolist()):
                for item, x in self.judged[(n, k)]:
                    start = int(starts[p])
                    text = int(np.searchsorted(ends, start, "right")) - 1
                    old = best.get((text, item))
                    if old is None or (-x, start, n) < (-old[0], old[1], old[2]):
                        best[(text, item)] = (x, start, n)

        for n in lengths:
            size = n - SHINGLE + 1
            if size >= 1:
                need = int(np.ceil(2 * share * size - 1e-9))
                # a window with need hits has one among its first size - need + 1 shingles
                q = np.unique((hits[:, None] - np.arange(size - need + 1)).ravel())
                q = q[(q >= 0) & (q + n <= len(h))]
                q = q[seen[q + size] - seen[q] >= need]
                text = np.searchsorted(ends, q, "right") - 1
                q = q[q + n <= ends[text + 1]]
                judge(q, n, windows_at(total, q, n), lambda places, q=q, size=size: grams[q[places][:, None] + np.arange(size)])
        longest = lengths[-1] if lengths else 0
        for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            if 0 < b - a < longest and (b - a < SHINGLE or seen[max(a, b - SHINGLE + 1)] - seen[a] >= share * (b - a - SHINGLE + 1)):
                judge(np.array([a]), b - a, rolling(h[a:b], b - a), lambda places, a=a, b=b: shingles(h[a:b])[None])
            if b - a >= 1 and lengths and lengths[0] < SHINGLE:
                for n in {x for x in lengths if x < SHINGLE and x <= b - a}:
                    whole = rolling(h[a:b], n) ^ U64(n)
                    q = np.flatnonzero(np.isin(whole, self.known))
                    judge(q + a, n, whole[q], lambda places, q=q, whole=whole: whole[q[places]][:, None])
        return [(k, i, s - int(ends[k]), n, x) for (k, i), (x, s, n) in best.items()]


_LEAKS = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def _blocks(benchmark: DataFrame, threshold: float):
    rows = ((r[0], r[1]) for r in benchmark.select("item_id", "text").toLocalIterator())
    while block := list(islice(rows, ITEM_BLOCK)):
        yield Items(block, threshold)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, similarity, first_word and n_words of the best window for each document row and item it leaks."""
    found = []
    for items in _blocks(benchmark, threshold):

        def run(batches, items=items):
            for b in (x.slice(i, DOCS_AT_ONCE) for x in batches for i in range(0, x.num_rows, DOCS_AT_ONCE)):
                rows = items.matches(*hash_texts(texts_of(b["text"])))
                ids = b["doc_id"].cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([items.ids[r[1]] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        found.append(docs.select("doc_id", "text").mapInArrow(run, _LEAKS))
    return reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], _LEAKS)


def _is_clean(items: Items):
    def clean(text: pa.Array) -> pa.Array:
        ok = np.ones(len(text), bool)
        for i in range(0, len(text), DOCS_AT_ONCE):
            ok[[i + r[0] for r in items.matches(*hash_texts(texts_of(text.slice(i, DOCS_AT_ONCE))))]] = False
        return pa.array(ok)

    return F.arrow_udf(clean, "boolean")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs without a leak, with all their columns."""
    for items in _blocks(benchmark, threshold):
        docs = docs.filter(_is_clean(items)(F.col("text")))
    return docs
