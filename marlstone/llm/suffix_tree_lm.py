"""Language-model scores from a probabilistic suffix tree over words.

The tree's contexts are the last one, two, ... up to depth words.  A context that occurs MIN_COUNT times in training is a
candidate, at any corpus size, so the tree grows with the corpus.  It is retained by a divergence test: the log-likelihood of the words
that follow it, each counted out of its own estimate, must be GAIN nats higher under the context's distribution than under
the longest retained suffix of it.  That sum is the context's count times the divergence from its parent, less what the
context only knows by heart.  The next-word distribution of a state is its counts, smoothed by its parent's distribution
with a weight of the square root of its count; the root's is discounted and spreads what is left over one unknown word.  So
every state's probabilities sum to one.  A token is scored in the longest retained suffix of the words before it.

No task holds the tree.  Documents are dealt to batches, and each batch asks the exchange for what concerns its own texts: first
counts of its words and word pairs, then level by level the gains of its candidate contexts of one more word, with the counts
of the longer sequences that follow the candidates of the next level.  The number of passes over a batch is depth + 2.

Defined results: a null or empty text is the end token alone; a null doc_id has empty text for its fold; with no training
rows every probability is one and scores are 0; repeated rows count and score as often as they occur; no rows, no result
rows.  Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

DEPTH = 2
MIN_COUNT = 2
GAIN = 2.0
UNITS = 16  # gains travel in sixteenths of a nat, so their sums do not depend on order
SPARE_BITS = 16
FOLDS, HELD_OUT = 7, 2
END = C.U64(0x7C3A5E1D9B2F4861)
NO_PARENT = C.U64(0x3C6EF372FE94F82B)
LEVEL = C.summed(np.uint32, np.int32, finish=(C.OTHERS, lambda gains: (gains > GAIN * UNITS).astype(np.uint8)))


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens, each text's end token included, and where texts begin."""
    h, ends = C.hash_texts(texts)
    out = np.full(len(h) + len(texts), END, C.U64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(texts)), np.diff(ends))] = h
    return out, ends + np.arange(len(ends))


def key_mask(n: int) -> np.uint64:
    """Keys of sequences have SPARE_BITS bits more than it takes to count 4 * n of them, so about one in a hundred thousand meets another's key, at any size."""
    bits = min(64, max(40, (4 * n).bit_length() + SPARE_BITS))
    return C.U64((1 << 64) - (1 << (64 - bits)))


@dataclass(frozen=True)
class Root:
    """The distribution without context: n training tokens, v distinct ones, n1 and n2 of them met once and twice."""

    n: int
    v: int
    n1: int
    n2: int

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.ones(len(counts))
        d = float(np.clip(self.n1 / max(1, self.n1 + 2 * self.n2), 0.1, 0.9))
        return np.where(counts > 0, counts - d, d * self.v) / self.n


class Walk:
    """One batch's texts, level by level.  request() gives the sorted keys to ask for with their counts and gains; accept() takes the other batches' counts and
    whether a context is retained.  A replayed request needs its keys alone."""

    def __init__(self, texts: list[bytes], training: np.ndarray, root: Root, depth: int, learns: bool = True):
        self.learns = learns  # whether gains are still asked for
        self.root, self.depth, self.level, self.mask = root, depth, 0, key_mask(root.n)
        self.tokens, self.starts = _tokens(texts)
        sizes = np.diff(self.starts)
        self.place = np.arange(len(self.tokens), dtype=np.int32) - np.repeat(self.starts[:-1].astype(np.int32), sizes)
        self.train = np.repeat(training, sizes)
        self.gram = self.tokens  # the sequence of level + 1 tokens that ends at each token
        self.counts: np.ndarray | None = None  # its training count, 0 where nobody asked

    def _longer(self) -> np.ndarray:
        out = np.zeros(len(self.gram), C.U64)
        out[1:] = C.mix(self.gram[:-1] * C.U64(0x9E3779B97F4A7C15) + self.tokens[1:] + C.U64(self.level))
        return out

    def _candidates(self, counts: np.ndarray, size: int) -> np.ndarray:
        """Tokens after a candidate context of size tokens, given the counts of sequences that end at each token."""
        out = np.zeros(len(counts), bool)
        out[1:] = (counts[:-1] >= MIN_COUNT) & (self.place[1:] >= size)
        return out

    def _ask(self, contexts: np.ndarray, gains: np.ndarray | None, grams: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = np.concatenate([contexts, grams])
        self.order, self.at = C.grouped(keys)
        counts, sums = np.zeros(len(self.at), np.uint32), np.zeros(len(self.at), np.int32)
        if len(keys):
            weight = np.zeros(len(keys), np.uint8)
            weight[len(contexts) :] = weights
            counts = np.add.reduceat(weight[self.order], self.at, dtype=np.uint32)
            if gains is not None:
                gain = np.zeros(len(keys), np.int32)
                gain[: len(contexts)] = gains
                sums = np.add.reduceat(gain[self.order], self.at)
        self.own = counts
        return keys[self.order[self.at]], counts, sums

    def request(self, replay: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One bit tells words, whose counts must be exact, from the longer sequences."""
        one = C.U64(int(~self.mask) + 1)
        if self.level == 0:
            self.pairs = np.flatnonzero(self.place > 0)
            self.next = self._longer()
            keys = np.concatenate([(self.tokens & self.mask) | one, self.next[self.pairs] & self.mask & ~one])
            return self._ask(keys[:0], None, keys, np.concatenate([self.train, self.train[self.pairs]]))
        k = self.level
        self.here = np.flatnonzero(self._candidates(self.counts, k))
        i, train, gains = self.here, self.train[self.here], None
        over, met = self.counts[i - 1].astype(float), self.longer[i].astype(float)
        weight = np.sqrt(over)
        self.p_here = (met + weight * self.p[i]) / (over + weight)
        if self.learns:
            over, met, q = over - train, met - train, self.q[i]
            weight = np.sqrt(over)
            self.q_here = (met + weight * q) / (over + weight)
            if not replay:
                gains = np.where(train, np.rint(UNITS * np.log(self.q_here / q)), 0).astype(np.int32)
        context = C.mix(self.gram[i - 1] ^ NO_PARENT) & self.mask & ~one
        self.counts, self.gram = self.longer, self.next
        grams, self.after = context[:0], np.empty(0, np.int64)
        if k < self.depth:
            self.next = self._longer()
            follows = self._candidates(self.counts, k + 1)
            # a sequence is no more frequent than the one without its first word: some counts need no question
            self.once = np.flatnonzero(follows & self.train & (self.counts == 1))
            self.after = np.flatnonzero(follows & (self.counts > self.train))
            grams = self.next[self.after] & self.mask & ~one
        return self._ask(context, gains, grams, self.train[self.after])

    def accept(self, counts: np.ndarray, retained: np.ndarray) -> None:
        counts = C.spread(self.order, self.at, counts + self.own)
        self.longer = np.zeros(len(self.tokens), np.uint32)
        if self.level == 0:
            n = len(self.tokens)
            self.counts, self.longer[self.pairs] = counts[:n], counts[n:]
            self.words = self.counts
            self.p = self.root.probabilities(self.counts)
            if self.learns:
                self.q = self.root.probabilities(self.counts.astype(np.int64) - self.train)
        else:
            n = len(self.here)
            kept = C.spread(self.order, self.at, retained)[:n] > 0
            i = self.here[kept]
            self.p[i] = self.p_here[kept]
            if self.learns:
                self.q[i] = self.q_here[kept]
            self.longer[self.after] = counts[n:]
            if self.level < self.depth:
                self.longer[self.once] = 1
        self.level += 1


_STATS = "v long, n1 long, n2 long, n long"
_SCORES_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def fit_root(docs: DataFrame, n: int, fan_bits: int = C.FAN_BITS) -> Root:
    """Exact counts of all training tokens, reduced on executors to four sums."""

    def count_words(batches):
        part = TaskContext.get().partitionId()
        for b in batches:
            texts = [t for t, d in zip(C.texts_of(b["text"]), b["doc_id"].to_pylist(), strict=True) if not held_out(d)]
            keys, counts = np.unique(_tokens(texts)[0], return_counts=True)
            yield from C.requests_table(part, n, keys, counts.astype(np.uint32), fan_bits=fan_bits).to_batches()

    def sums(keys, totals):
        return pa.table([[len(keys)], [int((totals[0] == 1).sum())], [int((totals[0] == 2).sum())], [int(totals[0].sum(dtype=np.int64))]], names=["v", "n1", "n2", "n"])

    parts = C.tally(docs.select("doc_id", "text").mapInArrow(count_words, C.BLOBS), C.summed(np.uint32), n, sums, _STATS, fan_bits)
    total = parts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("v", "n1", "n2", "n"))).first()
    return Root(total["n"], total["v"], total["n1"], total["n2"])


def suffix_tree_scores(docs: DataFrame, depth: int = DEPTH, fan_bits: int = C.FAN_BITS) -> DataFrame:
    """Learn from the rows that are not held out and score all rows."""
    n = C.n_batches(docs)
    root = fit_root(docs, n, fan_bits)
    base, _ = C.with_batches(docs, "doc_id", ["doc_id"], n)

    def walk(rows: pa.Table, told: list[pa.Table]) -> Walk:
        training = np.array([not held_out(d) for d in rows["doc_id"].to_pylist()], bool)
        out = Walk(C.texts_of(rows["text"]), training, root, depth, learns=len(told) <= depth)
        for t in told:
            out.request(replay=True)
            out.accept(*C.joined(t, *LEVEL.answers))
        return out

    def at_level(told: pa.Table, levels: int) -> list[pa.Table]:
        level = told["level"].to_numpy()
        return [told.take(pa.array(np.flatnonzero(level == k))) for k in range(levels)]

    def first(rows: pa.Table) -> pa.Table:
        return C.requests_table(rows["batch"][0].as_py(), n, *walk(rows, []).request(), fan_bits=fan_bits)

    def asker(levels: int):
        def ask(rows: pa.Table, told: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return C.BLOBS_ARROW.empty_table()
            return C.requests_table(rows["batch"][0].as_py(), n, *walk(rows, at_level(told, levels)).request(), fan_bits=fan_bits)

        return ask

    def judge(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _SCORES_ARROW.empty_table()
        done = walk(rows, at_level(told, depth + 1))
        owner = np.repeat(np.arange(rows.num_rows), np.diff(done.starts))
        total = lambda x: np.bincount(owner, x, rows.num_rows)
        base_score = total(np.log10(done.words + 1.0) - np.log10(root.n + root.v + 1))
        ids = rows["doc_id"].cast(pa.int64()).combine_chunks()
        columns = [ids, [held_out(d) for d in ids.to_pylist()], np.diff(done.starts), total(done.words > 0).astype(np.int64), [root.n] * rows.num_rows, base_score, total(np.log10(done.p))]
        return pa.table([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, _SCORES_ARROW, strict=True)], schema=_SCORES_ARROW)

    answers = None
    for level in range(depth + 1):
        asked = base.groupBy("batch").applyInArrow(first, C.BLOBS) if answers is None else base.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(asker(level), C.BLOBS)
        got = C.materialized(C.exchange(asked, LEVEL, n, fan_bits), f"level-{level}").withColumn("level", F.lit(level))  # read at every later level
        answers = got if answers is None else answers.unionAll(got)
    return base.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(judge, _SCORES)
